from datetime import date

from pyspark.sql import functions as F

from quillbook.operators import classify as C
from quillbook.operators import ledger as L
from quillbook.sources import layout


def forms_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.form for r in C.with_forms(df).orderBy("i").collect()]


def test_classification_needs_a_lead(spark):
    one, tie, near, noisy, weak, none = forms_of(spark, "gstr-1 return", "GSTR-1 and GSTR-3B", "PROVIDENT FUND ORGANISATION GSTR-1", "CUST0MS ED1 SYSTEM", "PORT OF LOADING", None)
    assert (one.accepted, one.return_type, one.margin) == (True, "GSTR1", 100)
    assert (tie.accepted, tie.return_type, tie.margin) == (False, "GSTR3B", 0)
    assert (near.accepted, near.margin) == (False, 10)
    assert (noisy.accepted, noisy.return_type, noisy.ocr_policy) == (True, "SB", "identify_then_skip")
    assert not weak.accepted and not none.accepted and none.return_type is None


def test_pf_kinds(spark):
    kinds = [f.doc_kind for f in forms_of(spark, "COMBINED CHALLAN OF A/C", "PAYMENT CONFIRMATION RECEIPT", "PROVIDENT FUND ORGANISATION ARREAR", "(ECR)", "ELECTRONIC CHALLAN CUM RETURN ARREAR")]
    assert kinds == ["Challan", "Payment", "Arrears", "Return", "Return"]


def test_banks(spark):
    axis, fund = "Axis Bank\nStatement of Axis Bank Account\nTran Date", "Axis Bank Statement of Axis Bank Account mutual fund folio no balance units"
    df = spark.createDataFrame([(0, axis, [axis, "paid to HDFC Bank"]), (1, fund, [fund]), (2, axis, [axis, "State Bank of India statement of account"])], "i int, text string, pages array<string>")
    got = [(r.accepted, r.bank.code, r.mixed) for r in C.with_banks(df).orderBy("i").collect()]
    assert got == [(True, "axis", False), (False, "axis", False), (False, "axis", True)]


def rows(spark, *r):
    return L.consolidated(spark.createDataFrame(list(r), "ReturnType string, DocKind string, EntityID string, PeriodDate date, PrimaryAmount double, SourceFile string"))


def test_reconciliation(spark):
    d = date(2025, 4, 1)
    ledger = rows(
        spark, ("PTRC", "Return", "a", d, 100.0, "1"), ("PTRC", "Challan", "a", d, 100.9, "2"), ("PTRC", "Return", "b", d, 500.0, "3"), ("PTRC", "Challan", "b", d, 400.0, "4"), ("PTRC", "Return", "c", d, 9.0, "5"),
        ("PTRC", "Challan", "d", d, 9.0, "6"), ("PTRC", "Return", "e", None, 7.0, "7"), ("PTRC", "Challan", "e", None, 7.0, "8"), ("PF", "Challan", "p", d, 10.0, "9"), ("PF", "Payment", "p", d, 10.0, "10"), ("PF", "Return", "p", d, 99.0, "11"), ("EWB", "Return", "x", d, 5.0, "12"), ("PTRC", "Return", "z", d, 0.0, "13"),
    )
    recon = L.reconcile(ledger)
    got = {(r.ReturnType, r.EntityID, r.PeriodDate): (r.Status, r.Delta, r.Docs) for r in recon.collect() if r.EntityID != "e"}
    assert got == {("PTRC", "a", d): ("Matched", 0.9, 2), ("PTRC", "b", d): ("Mismatch", -100.0, 2), ("PTRC", "c", d): ("Unpaid?", -9.0, 1), ("PTRC", "d", d): ("No demand doc", 9.0, 1), ("PF", "p", d): ("Matched", 0.0, 3)}
    assert sorted(r.Status for r in recon.collect() if r.EntityID == "e") == ["No demand doc", "Unpaid?"]  # undated ones aren't pooled
    back = {r.SourceFile: (r.Flags, r.Status) for r in L.flag_back(ledger, recon).collect()}
    assert back["3"] == back["4"] == ("UNRECONCILED", "Review") and back["1"] == ("", "OK") and back["5"] == ("UNPAID?", "Review") and back["12"] == ("", "OK") and len(back) == 13


def test_audit(spark):
    docs = C.with_forms(spark.createDataFrame([("a", "GSTR-1 x", "E1", "", "OK"), ("b", "FORM_IIIB", "Unknown", "X?", "OK"), ("c", "GSTR-1 GSTR-3B", "E", "", "Error")], "SourceFile string, text string, EntityID string, Flags string, Status string"))
    df = docs.select("SourceFile", "EntityID", "Flags", "Status", F.col("form.return_type").alias("ReturnType"), F.lit(date(2025, 4, 1)).alias("PeriodDate"), F.lit("R").alias("DocRef"), "form", F.lit(False).alias("sparse_text"), (F.col("SourceFile") == "b").alias("ocr_used"))
    audited = L.audited(df)
    got = {r.SourceFile: (r.Confidence, r.ConfidenceGrade, r.Status, r.Flags) for r in audited.collect()}
    assert got == {"a": (100, "High", "OK", ""), "b": (40, "Low", "Review", "X?; OCR_TEXT; ENTITYID_MISSING; PARSER_CHECK"), "c": (50, "Low", "Error", "AMBIGUOUS_TYPE")}
    found, evidence = L.finding_rows(audited), L.evidence_rows(audited)
    assert {(r.SourceFile, r.Code, r.Severity) for r in found.collect()} == {("b", "OCR_TEXT", "Review"), ("b", "ENTITYID_MISSING", "Review"), ("b", "PARSER_CHECK", "Review"), ("c", "AMBIGUOUS_TYPE", "Error")}
    assert evidence.count() == 2 + 3 + 2
    packets = {r.SourceFile: len(r.Findings) for r in L.review_packets(audited, found, evidence).collect()}
    assert packets == {"b": 3, "c": 1}


def test_dashboard_drops_null_keys(spark):
    df = rows(spark, ("A", "Return", "e", date(2025, 4, 1), 1.0, "1"), (None, "Return", "e", date(2025, 4, 1), 5.0, "2"))
    assert [(r.ReturnType, r.Records, r.OK, r.TotalAmount) for r in L.dashboard(df).collect()] == [("A", 1, 1, 1.0)]


def test_preflight_and_ocr(spark):
    pages = spark.createDataFrame([("a", 1, " "), ("a", 2, "long enough text " * 9), ("b", 1, "x" * 30), ("c", 1, "y" * 200)], "source_file string, page_no int, text string")
    side = spark.createDataFrame([("a", ["first page of ocr text, " * 5])], "source_file string, ocr_pages array<string>")
    got = {r.source_file: (r.needs_ocr, r.sparse_text, r.ocr_used, len(r.pages)) for r in layout.documents(pages, side).collect()}
    assert got == {"a": (False, True, True, 1), "b": (False, True, False, 1), "c": (False, False, False, 1)}
    assert spark.range(1).select(layout.ocr_pages(F.lit("first\f\f second "))).first()[0] == ["first", "second"]


def test_union_of_shards_is_the_whole(spark):
    a, b = rows(spark, ("A", "Return", "e", date(2025, 4, 1), 1.0, "1")), rows(spark, ("A", "Return", "f", date(2025, 5, 1), 2.0, "2"))
    both = L.dashboard(L.union_all([a, b])).first()
    assert (both.Records, both.Periods, both.TotalAmount) == (2, 2, 3.0)
