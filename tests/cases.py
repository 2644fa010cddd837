"""The parsers and functions on small documents made up by hand, with what has to come out.

Each gives rows (source, field, value), values as text; what is wanted is worked out by hand from the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import numbers as N
from quillbook.functions import text as T
from quillbook.operators import bank as B
from quillbook.operators import classify as C
from quillbook.operators import flags
from quillbook.operators import geometry as G
from quillbook.operators import ledger as L
from quillbook.parsers import bill, forms, gst
from quillbook.plans import facts, pipelines, sheets
from quillbook.rules import banks
from quillbook.sources import layout
from tests import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Want = dict[str, dict[str, object]]


def _text(v: object) -> str:
    if v is None:
        return "cast(null as varchar)"
    return "'" + (str(v).lower() if isinstance(v, bool) else str(v)).replace("'", "''") + "'"


def case(name: str, make: Callable[[SparkSession], DataFrame], want: Want, key: str = "SourceFile") -> None:
    """Registers a query over make's rows, told apart by `key`: the fields that want names of its sources, of all rows."""
    fields = list(dict.fromkeys(f for row in want.values() for f in row))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(spark)
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
        return df.select(F.col(f"`{key}`").cast("string").alias("source"), F.explode(pairs).alias("p")).select("source", "p.field", "p.value")

    QUERIES[name] = run
    rows = ", ".join(f"({_text(s)}, {_text(f)}, {_text(row.get(f))})" for s, row in want.items() for f in fields)
    ORACLES[name] = f"select * from (values {rows}) v(source, field, value)"


def texts(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "source_file string, text string")


def strings(name: str, wants: dict[str, tuple[Callable[[Column], Column], dict[str, object]]]) -> None:
    """A case of functions of one string: function name to (function, input to result)."""
    rows = [(f, s) for f, (_, cases) in wants.items() for s in cases]

    def make(spark: SparkSession) -> DataFrame:
        df, value = spark.createDataFrame(rows, "f string, s string"), None
        for f, (function, _) in wants.items():
            value = F.when(F.col("f") == f, function(F.col("s")).cast("string")) if value is None else value.when(F.col("f") == f, function(F.col("s")).cast("string"))
        return df.select(F.concat_ws(": ", "f", "s").alias("SourceFile"), value.alias("value"))

    case(name, make, {f"{f}: {s}": {"value": v} for f, (_, cases) in wants.items() for s, v in cases.items()})


# forms ----------------------------------------------------------------------------------------------------------------

for (_form, _kind), (_body, _want) in fixtures.TEXTS.items():
    case(f"parse_{_form}_{_kind}".lower(), lambda spark, form=_form, kind=_kind, body=_body: flags.flagged(forms.PARSERS[form, kind](texts(spark, ("a.pdf", body))), form, kind), {"a.pdf": {"ReturnType": _form, "DocKind": _kind, **_want}})

case("parse_tds_schedule", lambda spark: flags.flagged(forms.tds(texts(spark, ("a.pdf", fixtures.SCHEDULE))), "TDS", "Challan"), {"a.pdf": {
    "EntityID": "ABCDE1234F", "Taxpayer ID Type": "PAN", "Tax": 50.0, "Interest": 10.0, "Crosscheck Diff": 0.0, "FY": "2026-27", "Payment Schedule": "Schedule A", "Minor Head Code": "100", "PeriodDate": "2026-05-01", "Section": "Unknown", "Flags": "SECTION?; CIN?; BSR?; CHALLAN?",
}})
case("parse_esic", lambda spark: flags.flagged(forms.esic(texts(spark, *[(f"{n}.pdf", fixtures.ESIC.format(a, n)) for n, a in enumerate(("300", "1,000", "20"))])), "ESIC", "Challan"), {
    "0.pdf": {"Party": "Employee", "Flags": "", "Amount": 300.0, "ChallanNumber": "50", "Month": "Apr", "PeriodDate": "2025-04-01", "FilingDate": "2025-05-12", "FY": "2025-26"},
    "1.pdf": {"Party": "Employer", "Flags": "", "Amount": 1000.0, "ChallanNumber": "51", "Month": "Apr", "PeriodDate": "2025-04-01", "FilingDate": "2025-05-12", "FY": "2025-26"},
    "2.pdf": {"Party": "Other", "Flags": "EXTRA CHALLAN", "Amount": 20.0, "ChallanNumber": "52", "Month": "Apr", "PeriodDate": "2025-04-01", "FilingDate": "2025-05-12", "FY": "2025-26"},
})
case("parse_nothing", lambda spark: forms.tds(texts(spark, ("a.pdf", ""))), {"a.pdf": {"EntityID": "Unknown", "EntityName": "Unknown", "Tax": 0.0, "PrimaryAmount": 0.0, "PeriodDate": None, "FilingDate": None, "Month": "Unknown", "DocRef": ""}})

# the two returns ------------------------------------------------------------------------------------------------------

case("gstr1_ledger", lambda spark: gst.gstr1(*fixtures.outward(spark)), {"a.pdf": {"EntityID": "27ABCDE1234F1Z5", "EntityName": "ACME LTD", "FY": "2025-26", "PeriodDate": "2025-04-01", "Status": "Error", "Flags": "B2CL_Threshold; HSN_vs_Supply_Tables; Interstate_Tax_5", "PrimaryAmount": 198.0, "DocRef": "AA2704251234567", "FilingDate": "2025-05-11"}})
case("gstr1_section_labels", lambda spark: gst.labelled(gst.summary_rows(fixtures.outward(spark)[1])), {"1": {"Section_Code": "4A"}, "2": {"Section_Code": "4A"}, "3": {"Section_Code": "5"}, "4": {"Section_Code": "5"}, "5": {"Section_Code": "TOTAL_LIABILITY"}}, key="row_no")


def _totals(spark: SparkSession) -> DataFrame:
    pages, cells = fixtures.outward(spark)
    return gst.section_totals(gst.labelled(gst.summary_rows(cells)), gst.gstr1_metadata(pages))


case("gstr1_section_totals", lambda spark: gst.coverage(_totals(spark)).where("Section_Code in ('4A', '5', '6A', 'TOTAL_LIABILITY')"), {
    "4A": {"Found": True, "Num_Records": 3, "Value": 1000.0, "IGST": 180.0, "CGST": 0.0, "Has_Data": "Yes"}, "5": {"Found": True, "Num_Records": 2, "Value": 100.0, "IGST": 18.0, "CGST": 1.0, "Has_Data": "Yes"},
    "6A": {"Found": False, "Num_Records": 0, "Value": 0.0, "IGST": 0.0, "CGST": 0.0, "Has_Data": "No"}, "TOTAL_LIABILITY": {"Found": True, "Num_Records": 0, "Value": 1100.0, "IGST": 198.0, "CGST": 0.0, "Has_Data": "Yes"},
}, key="Section_Code")
case("gstr1_exceptions", lambda spark: gst.gstr1_checks(_totals(spark)), {"HSN_vs_Supply_Tables": {"Status": "WARN", "Computed": 1100.0, "Reported": 0.0, "Variance": -1100.0}, "B2CL_Threshold": {"Status": "FAIL", "Computed": 50.0, "Reported": 250000.0, "Variance": 0.0}, "Interstate_Tax_5": {"Status": "FAIL", "Computed": 1.0, "Reported": 0.0, "Variance": 1.0}}, key="Check")
case("gstr1_summary", lambda spark: facts.gstr1_star(*fixtures.outward(spark))["Summary"], {"27ABCDE1234F1Z5": {"Period_Year": "Apr-25", "SupplyValue": 1100.0, "ExportValue": 0.0, "NotesValue": 0.0, "Total_IGST": 198.0, "Total_CGST": 1.0, "Total_SGST": 0.0}}, key="GSTIN")
case("taxpayer_calendar", lambda spark: facts.gstr1_star(*fixtures.outward(spark))["Dim_Taxpayer_Calendar"], {"27ABCDE1234F1Z5": {"Legal_Name": "ACME LTD", "Trade_Name": "ACME", "FY": "2025-26", "PeriodDate": "2025-04-01", "MonthIndex": 1, "IsoMonth": "2025-04"}}, key="GSTIN")
case("gstr3b_analysis", lambda spark: gst.gstr3b(*fixtures.three_b(spark))[1], {"a": {
    "Return Period": "2025-06", "GSTIN": "27ABCDE1234F1Z5", "Date of filing": "2025-07-20", "Output IGST": 100.0, "Output CGST": 50.0, "RCM IGST Payable": 1.0, "Total Input IGST": 60.0, "Ineligible IGST": 10.0, "Net Input IGST": 50.0, "IGST to IGST": 60.0, "CGST to CGST": 20.0,
    "IGST Payable": 41.0, "CGST Payable": 30.0, "SGST Payable": 30.0, "Interest paid": 1.0, "Late Fees paid": 2.0, "Missing Fields": "", "Validation Findings": "", "Status": "OK",
}}, key="Source File")
case("gstr3b_without_payments", lambda spark: gst.gstr3b(*fixtures.three_b(spark, False))[1], {"a": {"IGST to IGST": None, "IGST Payable": None, "Interest paid": None, "Output IGST": 100.0, "Net Input IGST": 50.0, "Validation Findings": "GSTR3B_FIELDS_MISSING", "Status": "Review"}}, key="Source File")
case("gstr3b_ledger", lambda spark: gst.gstr3b(*fixtures.three_b(spark))[0], {"a": {"EntityID": "27ABCDE1234F1Z5", "EntityName": "ACME", "PeriodDate": "2025-06-01", "Status": "OK", "Flags": "", "PrimaryAmount": 201.0, "DocRef": "AA270625", "FilingDate": "2025-07-20"}})


def _unsound(spark: SparkSession) -> DataFrame:
    """The checks of the summary return after its credit, reverse charge and cash were put wrong."""
    _, cells = fixtures.three_b(spark)
    wrong = lambda x: F.when(x == "40", "30").when(x == "59", "69").otherwise(x)
    tables = gst.routed(cells.withColumn("cells", F.transform("cells", wrong)))
    supplies = gst.promoted(tables, ["Table_3_1"]).withColumn("row", F.transform_values("row", lambda k, v: F.when(v == "10", v).when((F.col("seq") == 4) & (v == "1"), "2").otherwise(v)))
    return gst.gstr3b_checks(supplies, gst.input_credit(tables), gst.payments(tables))


case("gstr3b_exceptions", _unsound, {"Payment_Recon_6_1": {"Sanity_Status": "FAIL", "Variance": 10.0}, "ITC_Math_Integrated_tax": {"Sanity_Status": "FAIL", "Variance": 10.0}, "RCM_CrossCheck": {"Sanity_Status": "WARN", "Variance": 1.0}}, key="Check")
case("gstr3b_payment_rows", lambda spark: gst.payments(gst.routed(fixtures.three_b(spark)[1])).withColumn("k", F.concat_ws(" ", "Section", "Description")).where("Description = 'Integrated tax'"), {
    "(A) Other than reverse charge Integrated tax": {"Net_Tax_Payable": 100.0, "ITC_Integrated": 60.0, "Tax_paid_cash": 40.0, "Interest_paid_cash": 1.0, "Late_fee_paid_cash": 0.0},
    "(B) Reverse charge Integrated tax": {"Net_Tax_Payable": 1.0, "ITC_Integrated": 0.0, "Tax_paid_cash": 1.0, "Interest_paid_cash": 0.0, "Late_fee_paid_cash": 0.0},
}, key="k")
case("gstr3b_summary", lambda spark: facts.gstr3b_star(*fixtures.three_b(spark))["Summary"], {"27ABCDE1234F1Z5": {"Period_Year": "Jun-25", "GrossOutward": 200.0, "RcmDeclared": 1.0, "CreditUsed": 100.0, "CashPaid": 101.0, "RcmCredit": 1.0, "NetPayable": 201.0, "NetTaxPaid": 201.0, "Variance": 0.0, "Status": "PASS"}}, key="GSTIN")
case("sheet_flags", lambda spark: gst.gstr3b(*fixtures.three_b(spark))[1].withColumn("PeriodDate", F.lit(None).cast("date")).select(F.col("`Source File`").alias("SourceFile"), flags.sheet_gstr3b(F.lit(True)).alias("Flags"), flags.sheet_amount().alias("Amount"), flags.sheet_status(F.lit("x"), F.lit(True)).alias("Status")), {"a": {"Flags": "PERIOD?; UTIL>ITC", "Amount": 101.0, "Status": "Review"}})

# bills ----------------------------------------------------------------------------------------------------------------


def _bill(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: f(bill.parse(fixtures.bill_words(spark)))


case("bill_header", _bill(lambda d: d), {"a.pdf": {"sb_no": "1234567", "sb_date": "05-MAY-25", "port_code": "INBOM1", "iec": "0312345678", "gstin": "27ABCDE1234F1Z5", "n_invoices": 1, "port_of_loading": "INBOM1", "country_of_final_destination": "GERMANY", "fob_value_inr": 1000.5, "freight_inr": 20.0, "insurance_inr": 0.81, "passed": 6, "evaluated": 6, "score": 1.0}}, key="source_file")
case("bill_invoices", _bill(lambda d: d.select(F.explode("invoices").alias("i")).select("i.*")), {"INV/1": {"sno": 1, "invoice_date": "01/05/2025", "invoice_value": 12.5, "fob_value": 12.5, "currency": "USD", "exchange_rate": 80.0}}, key="invoice_no")
case("bill_items_two", _bill(lambda d: d.select(F.explode("items_two").alias("i")).select("i.*")), {"84137010": {"sno": 1, "invoice_sno": 1, "description": "pumps of 2 sizes and more", "quantity": 5.0, "uqc": "NOS", "rate": 2.5, "value_fc": 12.5}}, key="hs_code")
case("bill_items", _bill(lambda d: d.select(F.explode("items").alias("i")).select("i.*")), {"84137010": {"invoice_sno": 1, "item_sno": 1, "description": "pumps of steel", "quantity": 5.0, "value_fc": 12.5, "fob_inr": 1000.5, "pmv": "90.0", "dbk_claimed": "Y", "igst_status": "LUT", "scheme_code": "0"}}, key="hs_code")
case("bill_part_four", _bill(lambda d: d.select(F.explode("rodtep").alias("r"), F.get("containers", F.lit(0)).alias("c"), F.size("invoice_summary").alias("n")).select("r.*", "c.container_no", "n")), {"1": {"invoice_sno": 1, "quantity": 5.0, "uqc": "NOS", "value": 10.25, "container_no": "ABCD1234567", "n": 1}}, key="item_sno")
case("bill_checks", _bill(lambda d: d.select(F.explode("checks").alias("c")).select("c.*")), {"invoice_count": {"ok": True, "expected": 1.0, "actual": 1.0}, "item_count_part3": {"ok": True, "expected": 1.0, "actual": 1.0}, "item_count_part2": {"ok": True, "expected": 1.0, "actual": 1.0}, "container_count": {"ok": True, "expected": 1.0, "actual": 1.0}, "fob_total_vs_item_sum": {"ok": True, "expected": 1000.5, "actual": 1000.5}, "invoice_1_value_vs_items": {"ok": True, "expected": 12.5, "actual": 12.5}}, key="check")
case("bill_ledger", _bill(bill.ledger), {"a.pdf": {"EntityID": "0312345678", "FY": "2025-26", "PeriodDate": "2025-05-05", "PrimaryAmount": 1000.5, "DocRef": "1234567", "Flags": "FIELDS?", "Status": "Review"}})
case("bill_sheets", _bill(lambda d: bill.item_rows(d).join(bill.invoice_rows(d).select(F.col("source_file").alias("SourceFile"), "Invoice_Amount", "Invoice_Currency", "Warnings", "Items"), "SourceFile")), {"a.pdf": {"SB_No": "1234567", "Invoice_No": "INV/1", "Item_SNo": 1, "Currency": "USD", "Invoice_Amount": 12.5, "Items": 1, "Warnings": "missing core fields: exporter, consignee"}})

# banks ----------------------------------------------------------------------------------------------------------------

_STATEMENT = "Axis Bank\nStatement of Axis Bank Account No: 12345678\nAccount Name: ACME\nTran Date Opening Balance: 1,000.00\nCurrency: INR\n" + "x" * 60


def _cells(spark: SparkSession) -> DataFrame:
    rows = [("a.pdf", 1, 1, 1, ["Tran Date", "Particulars", "Debit", "Credit", "Balance"]), ("a.pdf", 1, 1, 2, ["01-04-2025", "x", "100", "", "900"]), ("a.pdf", 1, 1, 3, ["", "no date", "1", "", ""]), ("a.pdf", 2, 1, 1, ["02-04-2025", "y", "", "50.00", "950 Cr"]), ("a.pdf", 3, 1, 1, ["notes", "", "", "", ""])]
    return spark.createDataFrame(rows, layout.CELLS)


def _deposit_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("f.pdf", 1, 1, 1, ["FD Account No", "FD Date", "Principal Amount", "Maturity Date"]), ("f.pdf", 1, 1, 2, ["77", "01-04-2025", "1,000", "01-04-2026"]), ("f.pdf", 1, 1, 3, ["", "", "5", ""]), ("f.pdf", 1, 1, 4, ["78", "02-04-2025", "500", "01-05-2026"])], layout.CELLS)


_profiles = lambda spark: spark.createDataFrame([("a.pdf", False, _STATEMENT)], "source_file string, debt boolean, text string")
case("bank_transactions", lambda spark: B.transactions(_cells(spark), _profiles(spark)), {"x": {"TransactionDate": "2025-04-01", "Debit": 100.0, "Credit": 0.0, "Balance": 900.0, "Page": 1}, "y": {"TransactionDate": "2025-04-02", "Debit": 0.0, "Credit": 50.0, "Balance": 950.0, "Page": 2}}, key="Description")
case("bank_metadata", lambda spark: B.metadata(_profiles(spark)), {"a.pdf": {"AccountNumber": "12345678", "AccountName": "ACME", "Currency": "INR", "OpeningBalance": 1000.0, "ClosingBalance": None, "PeriodFrom": None}}, key="source_file")
case("bank_key_values", lambda spark: B.key_value_transactions(texts(spark, ("c.pdf", "head\nTransaction Description wire in\nValue Date: 01/04/2025\nDebit/Credit: Credit\nCheque Amount/Transaction Amount: 1,500.00\nCustomer Reference: R1\nTransaction Description fee\nValue Date: 02/04/2025\nDebit/Credit: Debit\nCheque Amount/Transaction Amount: 10\n"))), {"wire in": {"TransactionDate": "2025-04-01", "Debit": 0.0, "Credit": 1500.0, "Reference": "R1"}, "fee": {"TransactionDate": "2025-04-02", "Debit": 10.0, "Credit": 0.0, "Reference": ""}}, key="Description")
case("bank_deposits", lambda spark: B.deposits(_deposit_cells(spark)), {"77": {"DepositDate": "2025-04-01", "Principal": 1000.0, "MaturityDate": "2026-04-01"}, "78": {"DepositDate": "2025-04-02", "Principal": 500.0, "MaturityDate": "2026-05-01"}}, key="DepositNumber")
case("bank_deposit_totals", lambda spark: B.deposit_totals(B.deposits(_deposit_cells(spark))), {"f.pdf": {"n": 2, "PrimaryAmount": 1500.0, "PeriodTo": "2026-05-01", "codes": "[]"}}, key="source_file")


def _bank_batch(spark: SparkSession) -> dict[str, DataFrame]:
    long = "x" * 60
    pages = [("a.pdf", 1, _STATEMENT, None), ("b.pdf", 1, "axis bank mutual fund folio no balance units nav(inr) " + long, None), ("s.pdf", 1, "x", None), ("u.pdf", 1, "nothing known " * 9, None), ("e.pdf", None, None, "PDFPasswordIncorrect: locked"), ("p.pdf", None, None, "ValueError: broken file")]
    pages += [("m.pdf", 1, "Axis Bank statement of axis bank account " + long, None), ("m.pdf", 2, "State Bank of India statement of account account number " + long, None)]
    return pipelines.bank(spark.createDataFrame(pages, "source_file string, page_no int, text string, error string"), _cells(spark))


case("bank_summary", lambda spark: _bank_batch(spark)["Bank_Summary"], {"a.pdf": {"ReturnType": "BANK", "EntityID": "12345678", "Status": "OK", "Flags": "", "Confidence": 100, "ConfidenceGrade": "High", "PrimaryAmount": 950.0, "RowsExtracted": 2, "PeriodFrom": "2025-04-01", "PeriodTo": "2025-04-02"}})
case("bank_errors", lambda spark: _bank_batch(spark)["Parsing_Errors"], {"b.pdf": {"Error_Type": "UnsupportedDocument"}, "s.pdf": {"Error_Type": "NeedsOCR"}, "u.pdf": {"Error_Type": "UnknownBankLayout"}, "m.pdf": {"Error_Type": "MixedDocument"}, "e.pdf": {"Error_Type": "EncryptedPDF"}, "p.pdf": {"Error_Type": "ParserError"}}, key="File")

# batches --------------------------------------------------------------------------------------------------------------

case("statutory_errors", lambda spark: pipelines.statutory(*fixtures.batch(spark))["Parsing_Errors"], {"scan.pdf": {"Error_Type": "NeedsOCR"}, "tie.pdf": {"Error_Type": "AmbiguousType"}, "odd.pdf": {"Error_Type": "UnknownType"}, "mix.pdf": {"Error_Type": "MixedDocument"}}, key="File")
case("statutory_ledger", lambda spark: pipelines.statutory(*fixtures.batch(spark))["Consolidated"].where("ReturnType in ('TDS', 'PF')"), {
    "TDS_Challan.pdf": {"ReturnType": "TDS", "DocKind": "Challan", "Status": "OK", "Confidence": 90, "FY": "2025-26"}, "PF_Challan.pdf": {"ReturnType": "PF", "DocKind": "Challan", "Status": "Review", "Confidence": 90, "FY": "2025-26"}, "PF_Return.pdf": {"ReturnType": "PF", "DocKind": "Return", "Status": "OK", "Confidence": 90, "FY": "2025-26"},
    "PF_Arrears.pdf": {"ReturnType": "PF", "DocKind": "Arrears", "Status": "OK", "Confidence": 90, "FY": "2025-26"}, "PF_Payment.pdf": {"ReturnType": "PF", "DocKind": "Payment", "Status": "Review", "Confidence": 90, "FY": "2025-26"},
})

# functions ------------------------------------------------------------------------------------------------------------

strings("date_functions", {
    "form_date": (D.form_date, {"05 Sep 2025": "2025-09-05", "31/12/2024": "2024-12-31", "12/31/2024": None, "Sep 5, 2025": "2025-09-05", "16/05/2025 18:52:00": "2025-05-16", "x": None}), "payment_date": (D.payment_date, {"01/06/2025": "2025-06-01", "01-06-2025": "2025-06-01"}),
    "bank_date": (D.bank_date, {"12/31/2024": "2024-12-31", "1-4-25": "2025-04-01", "03/04/2025": "2025-04-03", "2025-04-01": None}), "filing_date": (D.filing_date, {"2025-07-20": "2025-07-20", "20/07/2025": "2025-07-20"}),
    "month_and_year": (D.month_and_year, {"wage JUL-2025": "2025-07-01", "Julx 25": None}), "label_date": (D.label_date, {"Apr-25": "2025-04-01", "Apr 2025": "2025-04-01", "April": None}), "month_number": (D.month_number, {"SEPTEMBER": 9, "jan": 1, "xyz": None}),
    "period_year": (lambda c: D.period_year(c, F.lit("2025-26")), {"April": "Apr-25", "march": "Mar-26"}), "period_in_fiscal_year": (lambda c: D.period_in_fiscal_year(c, F.lit(2025)), {"May": "2025-05-01", "Feb": "2026-02-01"}),
})
strings("number_functions", {
    "numbers_on_line": (lambda c: N.numbers_on_line(c, "Employee"), {"Employee 1,000 2 x 3.5": "[1000.0, 2.0, 3.5, 0.0, 0.0, 0.0]"}), "last_two_numbers": (lambda c: N.last_two_numbers(c, "Slab")[1], {"Slab 200 74 14,800": 14800.0, "Slab 7": 0.0}),
    "amount_after": (lambda c: N.amount_after(c, "Total"), {"Total 13,000.00": 13000.0, "none": 0.0}), "strict_number": (N.strict_number, {"1,234.5": 1234.5, ".81": 0.81, "12x": None}), "format_indian": (lambda c: N.format_indian(c.cast("double")), {"12345678": "1,23,45,678", "999": "999", "-1234": "-1,234"}),
    "numeric_or_zero": (N.numeric_or_zero, {"1.5": 1.5, "x": 0.0}),
})
strings("text_functions", {
    "clean_cell": (T.clean_cell, {"A\n b  c": "b c"}), "squeeze": (T.squeeze, {" a \n b ": "a b"}), "after_label": (lambda c: T.after_label(c, "Period:", 8), {"x period: Apr-25 y": "Apr-25", "none": None}), "key_value": (lambda c: T.key_value(c, "Name"), {"TAN : 1\nName : ACME LTD\n": "ACME LTD"}),
    "label_line": (lambda c: T.label_line(c, "Value Date"), {"a\nValue Date: 1/4\n": "1/4", "a Value Date": None}), "first_of": (lambda c: T.first_of(c, r"X (\d+)", r"Y (\d+)"), {"Y 2": "2", "Y 2 X 1": "1"}), "last_match": (lambda c: T.last_match(c, r"B (\d+)"), {"B 1 B 2": "2"}),
    "without_courtesy": (T.without_courtesy, {"M/S ACME": "ACME", "M S ACME": "ACME", "MSX": "MSX"}), "head_code": (T.head_code, {"Corporation Tax (0020)": "0020"}), "cut_message": (lambda c: T.cut_message(c, 3), {"abcdef": "abc"}), "escaped": (T.html_escaped, {"a < b & \"c\"": "a &lt; b &amp; &quot;c&quot;"}),
    "unique_headers": (lambda c: F.array_join(T.unique_headers(F.split(c, r"\|")), "|"), {"a||a|": "a|Col|a_2|Col_2"}), "fit": (lambda c: F.array_join(T.fit(F.split(c, ","), 3, F.lit("-")), ","), {"a": "a,-,-", "a,b,c,d": "a,b,c"}),
    "name_and_address": (lambda c: F.concat_ws("|", *T.name_and_address(F.split(c, "\n"))), {"ACME LTD 2. X\n1 Road\nTown": "ACME LTD|1 Road Town"}), "canonical_header": (lambda c: T.canonical_header(c, banks.HEADERS), {"Tran Date": "date", "Withdrawals (Rs)": "debit"}),
})

# classification and geometry ------------------------------------------------------------------------------------------

_PAGES = {"pf1": "PROVIDENT FUND ORGANISATION COMBINED CHALLAN OF A/C", "pf2": "ELECTRONIC CHALLAN CUM RETURN (ECR) PROVIDENT FUND ORGANISATION", "pf3": "PAYMENT CONFIRMATION RECEIPT PROVIDENT FUND ORGANISATION TRRN"}
case("pf_kinds", lambda spark: C.with_forms(texts(spark, *_PAGES.items())).select("source_file", "form.return_type", "form.doc_kind", "form.accepted"), {"pf1": {"return_type": "PF", "doc_kind": "Challan", "accepted": True}, "pf2": {"return_type": "PF", "doc_kind": "Return", "accepted": True}, "pf3": {"return_type": "PF", "doc_kind": "Payment", "accepted": True}}, key="source_file")
case("page_votes", lambda spark: C.with_banks(spark.createDataFrame([("one", ["Axis Bank statement of axis bank account", "federal bank paid"]), ("two", ["Axis Bank statement of axis bank account", "State Bank of India statement of account"])], "source_file string, pages array<string>").withColumn("text", F.array_join("pages", "\n"))), {"one": {"page_banks": "[Axis Bank]", "mixed": False}, "two": {"page_banks": "[Axis Bank, State Bank of India]", "mixed": True}}, key="source_file")
case("page_probe", lambda spark: C.probe(texts(spark, ("a", "GSTR-3B form"), ("b", "nothing"))).select("source_file", "probe.*"), {"a": {"accepted": True, "return_type": "GSTR3B"}, "b": {"accepted": False, "return_type": None}}, key="source_file")
case("bill_parts", lambda spark: texts(spark, ("a", "x\nPART - IV - y"), ("b", "x\n" * 20 + "PART - I"), ("c", "part-ii z")).withColumn("part", C.bill_part(F.col("text"))), {"a": {"part": "IV"}, "b": {"part": None}, "c": {"part": "II"}}, key="source_file")


def _word(text: str, x: float) -> dict:
    return {"text": text, "x0": x, "x1": x + 10.0, "top": 0.0, "bottom": 1.0}


def _zones(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("p", [_word("B", 100.0), _word("A", 50.0)], [_word("left", 10.0), _word("1", 44.0), _word("2", 60.0), _word("3", 400.0)])], f"SourceFile string, a array<{G.WORD}>, v array<{G.WORD}>")
    return df.withColumn("zones", F.array_join(G.zones(F.col("a"), F.col("v")), "|"))


case("word_zones", _zones, {"p": {"zones": "1 2|3"}})
case("word_lines", lambda spark: G.cluster_lines(spark.createDataFrame([("a", 1, f"w{i}", float(i), i + 0.5, t, t + 1) for i, t in enumerate([10.0, 11.5, 13.0, 15.6, 16.0])], "source_file string, page_no int, text string, x0 double, x1 double, top double, bottom double"), ["source_file", "page_no"]).withColumn("k", F.row_number().over(G.Window.orderBy("line_no"))), {"1": {"text": "w0 w1"}, "2": {"text": "w2"}, "3": {"text": "w3 w4"}}, key="k")
case("ledger_columns", lambda spark: spark.createDataFrame([(",".join(L.lead_columns(spark.createDataFrame([(1, 2, 3)], "z int, ReturnType int, SourceFile int"), ["SourceFile", "ReturnType"]).columns), "f")], "columns string, SourceFile string"), {"f": {"columns": "SourceFile,ReturnType,z"}})


def _challan_cells(spark: SparkSession) -> DataFrame:
    rows = [("t.pdf", r) for r in (["TAN :", "ABCD12345E"], ["Name", "Acme Ltd", None, "Financial Year", "2024-25"], ["Nature of Payment", "194C Contractors"], ["Major Head", "Corporation Tax (0020)"], ["Challan No", "00123"], ["Date of Deposit", "05-Jun-2025"], ["Amount (in Rs.)", "Rs 1,050.00"], ["Tax", "1,000"], ["Surcharge", "0"], ["Cess", "0"], ["Interest", "50"], ["Penalty", "0"])]
    rows += [("u.pdf", r) for r in (["Amount (in Rs.)", "100"], ["Tax", "90"], ["Major Head", "Other than companies"])]
    return spark.createDataFrame([(f, 1, 1, i, r) for i, (f, r) in enumerate(rows)], layout.CELLS)


def _sheet_tds(spark: SparkSession) -> DataFrame:
    return sheets.tds(_challan_cells(spark), spark.createDataFrame([("e.pdf",)], "source_file string"))


case("sheet_tds", _sheet_tds, {
    "t.pdf": {"EntityID": "ABCD12345E", "EntityName": "Acme Ltd", "FY": "2025-26", "MonthName": "May", "MonthIndex": 2, "Section": "194C", "Major Head": "Corporation Tax", "Challan No": "00123", "Payment Date": "2025-06-05", "PeriodDate": "2025-05-01", "PrimaryAmount": 1050.0, "Flags": "", "Status": "OK"},
    "u.pdf": {"EntityID": "Unknown", "EntityName": "", "FY": "Unknown", "MonthName": "Unknown", "MonthIndex": 0, "Section": "Unknown", "Major Head": "Other than Companies", "Challan No": "", "PrimaryAmount": 100.0, "Flags": "MONTH?; CROSSCHECK; SECTION?", "Status": "Review"},
    "e.pdf": {"EntityID": "ERROR", "EntityName": "e.pdf", "FY": "Unknown", "MonthName": "Unknown", "MonthIndex": 0, "Flags": "PARSE ERR; MONTH?; SECTION?; AMT?", "Status": "Error"},
})


def _all_returns(spark: SparkSession) -> DataFrame:
    bare = spark.createDataFrame([("PF", "2024-25", 12)], "ReturnType string, FY string, MonthIndex int")
    return sheets.all_returns([_sheet_tds(spark).where("Status = 'OK'"), None, bare])


case("all_returns", _all_returns, {"PF": {"FY": "2024-25", "MonthIndex": 12, "EntityID": None, "PrimaryAmount": None}, "TDS": {"FY": "2025-26", "MonthIndex": 2, "EntityID": "ABCD12345E", "PrimaryAmount": 1050.0}}, key="ReturnType")


def _sheet_rules(spark: SparkSession) -> DataFrame:
    row = spark.createDataFrame([("a", "", None, 100.0, 60.0, 40.0, 5.0, "PTRC", 10.0), ("b", "X", "2025-06-01", 100.0, 40.0, 60.0, None, "Other", 0.0)], "SourceFile string, EntityID string, d string, Employee_EPF_AC01 double, Employer_EPF_AC01 double, Employer_EPS_AC10 double, PF_Admin_AC02 double, `Type of Return` string, `PT Paid` double")
    row = row.withColumn("PeriodDate", F.col("d").cast("date"))
    return row.withColumns({"pf": flags.sheet_pf(F.lit(True)), "ptrc": flags.sheet_ptrc(F.lit(True))})


case("sheet_rules", _sheet_rules, {"a": {"pf": "PERIOD?", "ptrc": "PERIOD?; TAN?"}, "b": {"pf": "EPS>EPF?; NO ADMIN", "ptrc": "AMT?; TYPE?"}})
