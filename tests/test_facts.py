from quillbook.plans import facts
from tests.test_tables import CELLS


def test_outward_star(spark):
    pages = spark.createDataFrame([("a", 1, "GSTR-1\nFinancial year 2025-26\nTax period April\nGSTIN 27ABCDE1234F1Z5\nLegal name of the registered person ACME")], "source_file string, page_no int, text string")
    rows = [["Description"], ["4A - B2B Regular"], ["Total", "3", "Invoice", "1,000", "180", "0", "0", "0"], ["Total Liability", "", "", "1,000", "170", "0", "0", "0"]]
    star = facts.gstr1_star(pages, spark.createDataFrame([("a", 1, 1, i, r) for i, r in enumerate(rows)], CELLS))
    assert [(r.Section_Code, r.Head, r.Amount) for r in star["Fact_Liability"].where("Section_Code = '4A'").orderBy("Head").collect()] == [("4A", "IGST", 180.0), ("4A", "Value", 1000.0)]
    s = star["Summary"].first()
    assert (s.GSTIN, s.Period_Year, s.SupplyValue, s.Total_IGST, s.Total_Cess) == ("27ABCDE1234F1Z5", "Apr-25", 1000.0, 180.0, 0.0)
    assert {r.Head: r.Status for r in star["Reconciliation"].collect()} == {"Value": "PASS", "IGST": "FAIL", "CGST": "PASS", "SGST": "PASS", "Cess": "PASS"}
    assert star["Table_Coverage"].where("Has_Data = 'Yes'").count() == 2 and star["Dim_Taxpayer_Calendar"].first().IsoMonth == "2025-04"


def test_summary_star(spark):
    pages = spark.createDataFrame([("a", 1, "GSTR-3B\nYear 2025-26\nPeriod June\nGSTIN of the supplier 27ABCDE1234F1Z5")], "source_file string, page_no int, text string")
    supplies = [["Nature of Supplies", "Total taxable value", "Integrated tax", "Central tax", "State/UT tax"], ["(a) Outward taxable supplies (other than zero rated)", "1,000", "100", "50", "50"], ["(d) Inward supplies (liable to reverse charge)", "10", "1", "0", "0"]]
    pay = [["Description", "Net Tax", "ITC", None, None, None, "Tax paid in cash"], ["", "Payable", "Integrated", "Central", "State/UT", "Cess", ""], ["(A) Other than reverse charge", *[None] * 6], ["Integrated tax", "100", "60", "0", "0", "0", "30"]]
    cells = spark.createDataFrame([("a", 1, t, n, r) for t, rows in enumerate((supplies, pay)) for n, r in enumerate(rows)], CELLS)
    star = facts.gstr3b_star(pages, cells)
    s = star["Summary"].first()
    assert (s.GrossOutward, s.RcmDeclared, s.CreditUsed, s.CashPaid, s.NetPayable, s.Variance, s.Status) == (200.0, 1.0, 60.0, 30.0, 100.0, 10.0, "REVIEW")
    matrix = {r.Check: r.Sanity_Status for r in star["Checksum_Matrix"].collect()}
    assert matrix["Payment_Recon_6_1"] == "FAIL" and matrix["ITC_Math_Cess"] == "PASS" and len(matrix) == 6
