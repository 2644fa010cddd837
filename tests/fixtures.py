"""Small documents made up by hand, as the layout relations have them: what the parsers' queries and the tests read."""

from __future__ import annotations

from datetime import date

from quillbook.sources import layout

#: A text of each form, and what has to be read from it.
TEXTS = {
    ("TDS", "Challan"): (
        "INCOME TAX DEPARTMENT\nChallan Receipt\nTAN : ABCD12345E\nName : ACME LTD\nFinancial Year : 2025-26\nMajor Head : Corporation Tax (0020)\nMinor Head : TDS (200)\nNature of Payment : 94C contracts\n"
        "Amount (in Rs.) : ₹ 1,100\nA Tax ₹ 1,000\nD Interest ₹ 100\nChallan No : 00123\nDate of Deposit : 05-Jun-2025\nBSR code : 0002271\nCIN : 25060500123XX\n",
        {"EntityID": "ABCD12345E", "Section": "94C", "Major Head": "Corporation Tax", "Major Head Code": "0020", "Tax": 1000.0, "Crosscheck Diff": 0.0, "PeriodDate": date(2025, 5, 1), "BSR Code": "0002271", "DocRef": "00123", "Flags": ""},
    ),
    ("PF", "Challan"): (
        "CHALLAN FOR WAGE MONTH : SEP 2025\nCode : MHBAN0012345 Name : ACME LTD\nAddress x\nEmployee's Share Of Contribution 1,000 NA NA NA NA\nEmployer's Share Of Contribution 300 NA 700 50 NA\n"
        "Admin/ Insp. Charges NA 40 NA NA 5\nTRRN : 123456\nsystem generated challan on 10-Oct-2025 11:00",
        {"EntityID": "MHBAN0012345", "EntityName": "ACME LTD", "Employer_EPS_AC10": 700.0, "PF_Admin_AC02": 40.0, "EDLI_Admin_AC22": 5.0, "Grand_Total": 2095.0, "PeriodDate": date(2025, 9, 1), "FilingDate": date(2025, 10, 10), "FY": "2025-26", "Flags": ""},
    ),
    ("PF", "Return"): (
        "ELECTRONIC CHALLAN CUM RETURN (ECR)\nName of Establishment ACME LTD LIN 123\nEstablishment Id MHBAN0012345000\nWage Month AUG-2025\nTotal EPF Contribution 1,000\nTotal EPS Contribution 500\nTotal EPF-EPS Contribution 250\nTotal Members 12\nECR Id 998877\nUploaded Date Time 12-SEP-2025 10:00",
        {"EntityName": "ACME LTD", "Total_Contribution": 1750.0, "Total_Members": 12, "DocRef": "998877", "PeriodDate": date(2025, 8, 1), "FilingDate": date(2025, 9, 12), "Month": "Aug", "Flags": ""},
    ),
    ("PF", "Arrears"): ("ARREAR\nName of Establishment ACME\nEstablishment Id MH1\nFrom Date APR 2025\nTotal EPF Contribution 10\nArrear Id 55\nDisbursement Date 01-Sep-2025", {"PrimaryAmount": 10.0, "DocRef": "55", "PeriodDate": date(2025, 4, 1), "FilingDate": date(2025, 9, 1)}),
    ("PF", "Payment"): ("PAYMENT CONFIRMATION RECEIPT\nTRRN No : 12345 x\nEstablishment ID : MH1\nEstablishment Name : ACME\nWage Month : AUG-2025\nTotal Amount (Rs) : 2,095\nAccount-1 Amount (Rs) : 1,300\nPayment Date : 14-SEP-2025", {"TRRN": "12345", "PrimaryAmount": 2095.0, "AC01": 1300.0, "AC02": 0.0, "PeriodDate": date(2025, 8, 1), "Flags": ""}),
    ("EBRC", "Return"): (
        "STATEMENT OF BANK REALISATION\n1 Firm Name ACME EXPORTS\nIEC 0312345678\nBank Realisation Certificate\n4 SBIN0001234567890 No\nDate of Realisation of Money\n5 12-08-2025 by bank\nTotal Realised Value 1,000.50\nNet Realised Value 990.50\nDeductions 1.0 2.0 3.0 4.0 0.0\nx PORT\n9 Shipping Bill Port\nMUMBAI y\nCurrency of Realisation USD",
        {"EntityID": "0312345678", "BRC_No": "SBIN0001234567890", "Freight": 4.0, "ShippingBill_Port": "x PORT MUMBAI y", "Net_Realised": 990.5, "PeriodDate": date(2025, 8, 1), "Flags": ""},
    ),
    ("EWB", "Return"): (
        "E-WAY BILL SYSTEM\nE-Way Bill No: 1234 5678 9012\nE-Way Bill Date: 16/05/2025 10:00 AM\nGSTIN of Supplier 27ABCDE1234F1Z5 , ACME\nGSTIN of Recipient URP , Bob\nDocument No. INV/1\nDocument Date 15/05/2025\nValue of Goods 12,345.60\npumps 84137010\nHSN Code\nwater pumps\nValid From: 16/05/2025 18:52:00[350 Kms]\nRoad MH12AB1234",
        {"EWB_No": "123456789012", "HSN_Code": "84137010", "HSN_Desc": "water pumps", "Distance_Km": 350.0, "Vehicle_No": "MH12AB1234", "Mode": "Road", "PeriodDate": date(2025, 5, 1), "Recipient_Name": "Bob"},
    ),
    ("PTRC", "Return"): (
        "FORM_IIIB PROFESSION TAX R.C. NO. (TIN) 27441462175\nRegistration ) 3\nName of the Employer M/S ACME LTD Type of Return Original\nPeriodicity Monthly\nPeriod Covered by Return 6 From 01 Aug 2025 To 31 Aug 2025\n2025-2026\nTotal Tax Payable Rs. 14,800.00\nExceed Rs. 10,000 for Male 200 74 14800\nTransaction Id 998877\nDate of Filing Return 20 Sep 2025",
        {"EntityID": "27441462175", "EntityName": "ACME LTD", "FY": "2025-26", "Slab_Above10000_Count": 74.0, "Slab_Above10000_Amt": 14800.0, "PrimaryAmount": 14800.0, "PeriodDate": date(2025, 8, 1), "FilingDate": date(2025, 9, 20)},
    ),
    ("PTRC", "Challan"): ("MTR Form Number-6\nTAX ID / TAN 27441462175P\nFull Name M/S ACME LTD Location x\nFrom 01/06/2025 To 30/06/2025\nAMOUNT OF TAX 13000.00\nTotal 13,000.00\nGRN MH001234567\nDate 05/07/2025", {"EntityID": "27441462175", "EntityName": "ACME LTD", "Total": 13000.0, "DocRef": "MH001234567", "PeriodDate": date(2025, 6, 1), "FY": "2025-26"}),
}

SCHEDULE = "INCOME TAX DEPARTMENT\nPAN : ABCDE1234F\nName : B\nTax Year : 2026-27\nMinor Head : Schedule A :- Salary (100)\nAmount (in Rs.) : ₹ 60\n(a) Amount deducted ₹ 50\n(b) Interest ₹ 10\nDate of Deposit : 20-Jun-2026"
ESIC = "Challan Period: Apr-25 \nAmount Paid: {} \nChallan Number: 5{}\nChallan Submitted Date 12/05/2025"


def outward(spark):
    """Pages and cells of an outward-supplies return with two sections and a footer."""
    row = lambda n, *cells: ("a.pdf", 1, 1, n, list(cells))
    cells = [row(0, "Description"), row(1, "4A - B2B Regular"), row(2, "Total", "3", "Invoice", "1,000", "180", "0", "0", "0"), row(3, "5 - B2CL"), row(4, "Total", "2", "Invoice", "100", "18", "1", "0", "0"), row(5, "Total Liability", "", "", "1,100", "198", "0", "0", "0")]
    text = "FORM GSTR-1\nFinancial year 2025-26\nTax period April\nGSTIN 27ABCDE1234F1Z5\nLegal name of the registered person ACME LTD\nTrade name, if any ACME\nARN AA2704251234567\nARN date 11/05/2025"
    return spark.createDataFrame([("a.pdf", 1, text)], "source_file string, page_no int, text string"), spark.createDataFrame(cells, layout.CELLS)


def three_b(spark, with_payments=True):
    """Pages and cells of a summary return."""
    supplies = [["Nature of Supplies", "Total taxable value", "Integrated tax", "Central tax", "State/UT tax"], ["(a) Outward taxable supplies (other than zero rated)", "1,000", "100", "50", "50"], ["(b) Outward taxable supplies (zero rated)", "0", "0", "0", "0"], ["(c) Other outward supplies", "0", "0", "0", "0"], ["(d) Inward supplies (liable to reverse charge)", "10", "1", "0", "0"]]
    credit = [["Details", "Integrated tax", "Central tax", "State/UT tax", "Cess"], ["A. ITC Available", "", "", "", ""], ["(3) Inward supplies liable to reverse charge", "1", "0", "0", "0"], ["(5) All other ITC", "59", "20", "20", "0"], ["B. ITC Reversed", "", "", "", ""], ["(1) As per rules", "10", "0", "0", "0"], ["C. Net ITC available (A-B)", "50", "20", "20", "0"]]
    pay = [["Description", "Net Tax", "Tax paid through ITC", None, None, None, "Tax paid in cash", "Interest\npaid in cash", "Late fee"], ["", "Payable", "Integrated", "Central", "State/UT", "Cess", "", "", ""], ["(A) Other than reverse charge", *[None] * 8], ["Integrated tax", "100", "60", "0", "0", "0", "40", "1", "0"], ["Central tax", "50", "0", "20", "0", "0", "30", "0", "0"], ["State/UT tax", "50", "0", "0", "20", "0", "30", "0", "2"], ["(B) Reverse charge", *[None] * 8], ["Integrated tax", "1", "0", "0", "0", "0", "1", "0", "0"], ["Central tax", "0", "0", "0", "0", "0", "0", "0", "0"], ["State/UT tax", "0", "0", "0", "0", "0", "0", "0", "0"]]
    tables = [supplies, credit, *([pay] if with_payments else [])]
    cells = spark.createDataFrame([("a", 1, t, n, row) for t, rows in enumerate(tables) for n, row in enumerate(rows)], layout.CELLS)
    text = "GSTR-3B\nYear 2025-26\nPeriod June\nGSTIN of the supplier 27ABCDE1234F1Z5\nLegal name of the registered person ACME\nTrade name, if any ACME T\nARN AA270625\nDate of ARN 20/07/2025"
    pages = spark.createDataFrame([("a", 1, text)], "source_file string, page_no int, text string")
    return pages, cells


def bill_words(spark):
    """Two pages: part one with its value grid, part three with one item; part four with its tables."""
    def line(page, top, text, xs=None):
        out, x = [], 40.0
        for k, t in enumerate(text.split()):
            x0 = xs[k] if xs else x
            out.append(("a.pdf", page, t, float(x0), float(x0 + 5 * len(t)), float(top), float(top + 8), True))
            x = x0 + 5 * len(t) + 4
        return out

    rows = []
    for top, t in ((10, "PART - I - x"), (20, "INDIAN CUSTOMS EDI SYSTEM INBOM1 1234567 05-MAY-25"), (30, "IEC/Br 0312345678 1"), (40, "GSTIN/TYPE 27ABCDE1234F1Z5 GSN"), (50, "Nos 1 1 1"), (60, "12.PORT OF LOADING INBOM1 (Mumbai) 13.COUNTRY OF FINAL DESTINATION GERMANY")):
        rows += line(1, top, t)
    rows += line(1, 100, "1.FOB VALUE 2.FREIGHT 3.INSURANCE", [40, 90, 140, 240]) + line(1, 110, "1,000.50 20 .81", [42, 145, 245])
    rows += line(2, 10, "PART - II - x") + line(2, 20, "1.S.No 2.INVOICE") + line(2, 30, "1 INV/1 01/05/2025 FOB") + line(2, 40, "1.INVOICE VALUE 2.FOB VALUE") + line(2, 50, "12.5 12.5 0 0 1 USD INR 80.0") + line(2, 60, "1.ItemSNo 2.HS CD") + line(2, 70, "1 84137010 pumps of 2 sizes 5 NOS 2.5 12.5") + line(2, 80, "and more") + line(2, 90, "Glossary x")
    rows += line(3, 10, "PART - III - x") + line(3, 20, "1INVSN 2ITEMSN") + line(3, 30, "1 1 84137010 pumps 5 NOS 2.5 12.5 1000.50 90") + line(3, 40, "of steel") + line(3, 50, "11.DUTYAMT") + line(3, 60, "0 Y LUT 60")
    rows += line(4, 10, "PART - IV - x") + line(4, 20, "M. RODTEP DETAILS") + line(4, 30, "1 1 5 NOS 5 10.25") + line(4, 40, "I. CONTAINER DETAILS") + line(4, 50, "1 ABCD1234567 S1 05-MAY-25") + line(4, 60, "H. INVOICE DETAILS") + line(4, 70, "1 INV/1 12.5 USD") + line(4, 80, "1 INV/1 12.5 USD")
    return spark.createDataFrame(rows, "source_file string, page_no int, text string, x0 double, x1 double, top double, bottom double, upright boolean")


def batch(spark):
    """Pages, cells and words of a folder of forms and of files that are turned down."""
    pages = [(f"{f}_{k}.pdf", 1, t + "\n" + "PROVIDENT FUND ORGANISATION " * (f == "PF") + "x" * 100) for (f, k), (t, _) in TEXTS.items() if f != "EWB"]
    pages += [("scan.pdf", 1, "x"), ("tie.pdf", 1, "GSTR-1 GSTR-3B " + "x" * 80), ("odd.pdf", 1, "nothing known here " * 6), ("mix.pdf", 1, "E-WAY BILL NO 1 " + "x" * 90), ("mix.pdf", 2, "FORM_IIIB " + "y" * 90)]
    return spark.createDataFrame(pages, "source_file string, page_no int, text string"), spark.createDataFrame([], layout.CELLS), spark.createDataFrame([], layout.WORDS)
