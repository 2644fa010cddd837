from datetime import date

from pyspark.sql import functions as F

from quillbook.operators import bank as B
from quillbook.operators import geometry as G
from quillbook.parsers import bill, gst
from tests import fixtures

CELLS = "source_file string, page_no int, table_no int, row_no int, cells array<string>"


def test_statement_header_goes_on_to_the_next_page(spark):
    rows = [("a", 1, 1, 1, ["Tran Date", "Particulars", "Debit", "Credit", "Balance"]), ("a", 1, 1, 2, ["01-04-2025", "x", "100", "", "900"]), ("a", 1, 1, 3, ["", "no date", "1", "", ""]), ("a", 2, 1, 1, ["02-04-2025", "y", "", "50.00", "950"]), ("a", 3, 1, 1, ["notes", "", "", "", ""])]
    cells = spark.createDataFrame(rows, CELLS)
    docs = spark.createDataFrame([("a", False, "Account No: 12345678\nAccount Name: ACME\nCurrency: INR")], "source_file string, debt boolean, text string")
    t = B.transactions(cells, docs)
    got = [(r.TransactionDate, r.Debit, r.Credit, r.Balance, r.Page) for r in t.orderBy("page_no", "row_no").collect()]
    assert got == [(date(2025, 4, 1), 100.0, 0.0, 900.0, 1), (date(2025, 4, 2), 0.0, 50.0, 950.0, 2)]
    meta = B.infer_balances(B.metadata(docs), t, ["source_file"], B.ORDER)
    m = meta.first()
    assert (m.OpeningBalance, m.ClosingBalance, m.PeriodFrom, m.PeriodTo, m.AccountNumber) == (1000.0, 950.0, date(2025, 4, 1), date(2025, 4, 2), "12345678")
    r = B.reconciled(t, meta, ["source_file"], B.ORDER).first()
    assert (r.Status, r.codes, r.RunningMismatches, r.ExpectedClosing) == ("PASS", [], 0, 950.0)
    wrong = t.withColumn("Balance", F.when(F.col("page_no") == 2, 999.0).otherwise(F.col("Balance")))
    r = B.reconciled(wrong, meta, ["source_file"], B.ORDER).first()
    assert (r.Status, r.codes) == ("REVIEW", ["RUNNING_BALANCE_MISMATCH"])


def test_deposits_and_key_values(spark):
    cells = spark.createDataFrame([("a", 1, 1, 1, ["FD Account No", "FD Date", "Principal Amount", "Maturity Date"]), ("a", 1, 1, 2, ["77", "01-04-2025", "1,000", "01-04-2026"]), ("a", 1, 1, 3, ["", "", "5", ""])], CELLS)
    got = B.deposits(cells).first()
    assert (got.DepositNumber, got.Principal, got.MaturityDate) == ("77", 1000.0, date(2026, 4, 1))
    text = "head\nTransaction Description wire in\nValue Date: 01/04/2025\nDebit/Credit: Credit\nCheque Amount/Transaction Amount: 1,500.00\nCustomer Reference: R1\nTransaction Description fee\nValue Date: 02/04/2025\nDebit/Credit: Debit\nCheque Amount/Transaction Amount: 10\n"
    rows = B.key_value_transactions(spark.createDataFrame([("c", text)], "source_file string, text string")).orderBy("row_no").collect()
    assert [(r.Description, r.Debit, r.Credit, r.Reference) for r in rows] == [("wire in", 0.0, 1500.0, "R1"), ("fee", 10.0, 0.0, "")]


def test_sections_are_carried_and_missing_ones_are_zero(spark):
    def row(n, desc, *nums):
        return ("a", 1, 1, n, [desc, *nums])

    cells = spark.createDataFrame([("a", 1, 1, 0, ["Description"]), row(1, "4A - B2B Regular"), row(2, "Total", "3", "Invoice", "1,000", "180", "0", "0", "0"), row(3, "5 - B2CL"), row(4, "Total", "2", "Invoice", "100", "18", "1", "0", "0"), row(5, "Total Liability", "", "", "1,100", "198", "0", "0", "0")], CELLS)
    labelled = gst.labelled(gst.summary_rows(cells))
    assert [r.Section_Code for r in labelled.orderBy("row_no").collect()] == ["4A", "4A", "5", "5", "TOTAL_LIABILITY"]
    totals = gst.section_totals(labelled, spark.createDataFrame([("a",), ("b",)], "SourceFile string"))
    assert totals.count() == 66
    got = {r.Section_Code: (r.Found, r.Value, r.Num_Records) for r in totals.where("SourceFile = 'a'").collect()}
    assert got["4A"] == (True, 1000.0, 3) and got["TOTAL_LIABILITY"][:2] == (True, 1100.0) and got["6A"] == (False, 0.0, 0)
    checks = {r.Check: (r.Status, r.Variance) for r in gst.gstr1_checks(totals.where("SourceFile = 'a'")).collect()}
    assert checks == {"HSN_vs_Supply_Tables": ("WARN", -1100.0), "B2CL_Threshold": ("FAIL", 0.0), "Interstate_Tax_5": ("FAIL", 1.0)}
    assert {r.Has_Data for r in gst.coverage(totals.where("SourceFile = 'b'")).collect()} == {"No"}


def three_b(spark, with_payments=True):
    return gst.gstr3b(*fixtures.three_b(spark, with_payments))


def test_analysis_row(spark):
    ledger, wide = three_b(spark)
    r = wide.first().asDict()
    assert len(r) == 43 and r["Missing Fields"] == "" and r["Status"] == "OK" and r["Return Period"] == "2025-06" and r["Date of filing"] == "2025-07-20"
    want = {"Output IGST": 100.0, "RCM IGST Payable": 1.0, "Total Input IGST": 60.0, "Ineligible IGST": 10.0, "Net Input IGST": 50.0, "IGST to IGST": 60.0, "CGST to CGST": 20.0, "IGST Payable": 41.0, "CGST Payable": 30.0, "SGST Payable": 30.0, "Interest paid": 1.0, "Late Fees paid": 2.0}
    assert {k: r[k] for k in want} == want
    row = ledger.first()
    assert (row.EntityID, row.PrimaryAmount, row.PeriodDate, row.Flags, row.Status) == ("27ABCDE1234F1Z5", 201.0, date(2025, 6, 1), "", "OK")


def test_absent_numbers_are_null_and_not_zero(spark):
    _, wide = three_b(spark, with_payments=False)
    r = wide.first().asDict()
    assert r["IGST to IGST"] is None and r["IGST Payable"] is None and r["Output IGST"] == 100.0
    assert "IGST Payable" in r["Missing Fields"] and r["Status"] == "Review"


def test_sheet_rules(spark):
    from quillbook.operators import flags

    _, wide = three_b(spark)
    row = wide.withColumn("PeriodDate", F.lit(date(2025, 6, 1)))
    got = row.select(flags.sheet_gstr3b(F.lit(True)).alias("f"), flags.sheet_amount().alias("a")).first()
    assert (got.f, got.a) == ("UTIL>ITC", 101.0)
    lost = row.withColumn("Output CGST", F.lit(60.0)).withColumn("GSTIN", F.lit("x")).withColumn("PeriodDate", F.lit(None).cast("date"))
    assert lost.select(flags.sheet_gstr3b(F.lit(True))).first()[0] == "PERIOD?; GSTIN?; CGST<>SGST(out); UTIL>ITC"
    assert spark.range(1).select(flags.sheet_status(F.lit(""), F.lit(False))).first()[0] == "Error"


def test_orders_of_sheets_shards_and_statements(spark):
    from quillbook.operators import bank
    from quillbook.plans import sheets

    frame = spark.createDataFrame([("2025-26", 1, "B"), ("2025-26", 1, None), ("2024-25", 12, "Z"), ("2025-26", 1, "A")], "FY string, MonthIndex int, EntityID string")
    assert [r.EntityID for r in sheets.in_order(frame, "PF").collect()] == ["Z", None, "A", "B"]
    shards = [spark.createDataFrame([(s,)], "SourceFile string") for s in ("c", "a", "b")]
    assert [r[0] for r in sheets.merged([*shards[:2], shards[2].withColumn("More", F.lit(1))]).collect()] == ["a", "b", "c"]
    recon = spark.createDataFrame([("a", "PASS", "X"), ("d", "REVIEW", "Y"), ("c", "REVIEW", "X"), ("b", "REVIEW", "Y")], "source_file string, Status string, Bank string")
    assert [r.source_file for r in bank.review_first(recon).collect()] == ["c", "b", "d", "a"]


def test_lines_are_a_fold_and_no_gap_rule(spark):
    words = spark.createDataFrame([("a", 1, f"w{i}", float(i), i + 0.5, t, t + 1) for i, t in enumerate([10.0, 11.5, 13.0, 15.6, 16.0])], "source_file string, page_no int, text string, x0 double, x1 double, top double, bottom double")
    assert [r.text for r in G.cluster_lines(words, ["source_file", "page_no"]).orderBy("line_no").collect()] == ["w0 w1", "w2", "w3 w4"]


def test_zones(spark):
    w = lambda t, x: {"text": t, "x0": x, "x1": x + 10.0, "top": 0.0, "bottom": 1.0}
    df = spark.createDataFrame([([w("B", 100.0), w("A", 50.0)], [w("left", 10.0), w("1", 44.0), w("2", 60.0), w("3", 400.0)])], f"a array<{G.WORD}>, v array<{G.WORD}>")
    assert df.select(G.zones(F.col("a"), F.col("v"))).first()[0] == ["1 2", "3"]


def test_a_bill(spark):
    doc = bill.parse(fixtures.bill_words(spark)).cache()
    r = doc.first()
    assert (r.sb_no, r.port_code, r.iec, r.gstin, r.fob_value_inr, r.freight_inr, r.insurance_inr) == ("1234567", "INBOM1", "0312345678", "27ABCDE1234F1Z5", 1000.5, 20.0, 0.81)
    assert [(i.invoice_no, i.invoice_value, i.currency) for i in r.invoices] == [("INV/1", 12.5, "USD")]
    assert [(i.hs_code, i.description, i.quantity, i.value_fc) for i in r.items_two] == [("84137010", "pumps of 2 sizes and more", 5.0, 12.5)]
    assert [(i.item_sno, i.description, i.fob_inr, i.dbk_claimed, i.igst_status) for i in r.items] == [(1, "pumps of steel", 1000.5, "Y", "LUT")]
    assert len(r.rodtep) == 1 and len(r.containers) == 1 and len(r.invoice_summary) == 1
    checks = {c.check: c.ok for c in r.checks}
    assert checks == {"invoice_count": True, "item_count_part3": True, "item_count_part2": True, "container_count": True, "fob_total_vs_item_sum": True, "invoice_1_value_vs_items": True} and r.score == 1.0
    row = bill.ledger(doc).first()
    assert (row.EntityID, row.PrimaryAmount, row.PeriodDate, row.Flags) == ("0312345678", 1000.5, date(2025, 5, 5), "FIELDS?")
    assert bill.item_rows(doc).first().Invoice_No == "INV/1" and bill.invoice_rows(doc).count() == 1 and bill.flat_rows(doc).first().Items == 1


def test_an_item_of_many_lines_is_read_to_its_end(spark):
    words = fixtures.bill_words(spark)
    rows = [("b.pdf", 3, t, x, x + 5.0 * len(t), top, top + 8, True) for top, line in [(10.0, "PART - III - x"), (20.0, "1INVSN 2ITEMSN"), (30.0, "1 1 84137010 pumps 5 NOS 2.5 12.5 1000.50 90"), *[(40.0 + 10 * k, f"more{k}") for k in range(1500)]] for x, t in zip(range(40, 4000, 60), line.split(), strict=False)]
    long = spark.createDataFrame([(f, p, t, float(x), float(x1), float(a), float(b), u) for f, p, t, x, x1, a, b, u in rows], words.schema)
    text = bill.items(bill.lines_of(long)).first().description
    assert text.startswith("pumps more0 more1 ") and text.endswith("more1499")
