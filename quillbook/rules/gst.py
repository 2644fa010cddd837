"""Sections of the outward-supplies return, tables of the summary return, and their checks' fixed parts."""

from __future__ import annotations

#: Code, printed title, what starts the section, what its total row says. The first match of a row counts.
SECTIONS = [
    ("4A", "B2B Regular", r"4A\s*[-–]", r"^Total$"),
    ("4B", "B2B Reverse Charge", r"4B\s*[-–]", r"^Total$"),
    ("5", "B2CL (Large – Inter-state Unregistered > ₹2.5L)", r"(?<![0-9A-Za-z])5\s*[-–].*B2CL", r"^Total$"),
    ("6A", "Exports (EXPWP / EXPWOP)", r"6A\s*[-–]", r"^Total$"),
    ("6B", "SEZ Supplies (SEZWP / SEZWOP)", r"6B\s*[-–]", r"^Total$"),
    ("6C", "Deemed Exports", r"6C\s*[-–]", r"^Total$"),
    ("7", "B2CS (Small – Unregistered)", r"(?<![0-9])7\s*[-–\s].*B2CS", r"^Total$"),
    ("8", "Nil / Exempt / Non-GST Supplies", r"(?<![0-9])8\s*[-–].*[Nn]il", r"^Total$"),
    ("9A_B2B", "Amendments to B2B Regular (Table 4) – Net Diff", r"9A\s*[-–].*table\s*4.*B2B Regular", r"^Net differential"),
    ("9A_B2B_RCM", "Amendments to B2B RCM (Table 4) – Net Diff", r"9A\s*[-–].*table\s*4.*[Rr]everse", r"^Net differential"),
    ("9A_B2CL", "Amendments to B2CL (Table 5) – Net Diff", r"9A\s*[-–].*table\s*5", r"^Net differential"),
    ("9A_EXP", "Amendments to Exports (Table 6A) – Net Diff", r"9A\s*[-–].*table\s*6A", r"^Net differential"),
    ("9A_SEZ", "Amendments to SEZ (Table 6B) – Net Diff", r"9A\s*[-–].*table\s*6B", r"^Net differential"),
    ("9A_DE", "Amendments to Deemed Exports (Table 6C) – Net Diff", r"9A\s*[-–].*table\s*6C", r"^Net differential"),
    ("9B_CDNR", "Credit/Debit Notes – Registered (CDNR) – Total Net", r"9B\s*[-–].*\bRegistered\b.*CDNR", r"^Total\s*[-–]\s*Net off"),
    ("9B_CDNR_B2B", "CDNR – B2B Regular", r"Credit.*?Debit.*?table\s*4.*?B2B Regular", r"^Net Total"),
    ("9B_CDNR_RCM", "CDNR – B2B Reverse Charge", r"Credit.*?Debit.*?table\s*4.*?[Rr]everse", r"^Net Total"),
    ("9B_CDNR_SEZ", "CDNR – SEZ (Table 6B)", r"Credit.*?Debit.*?table\s*6B", r"^Net Total"),
    ("9B_CDNR_DE", "CDNR – Deemed Exports (Table 6C)", r"Credit.*?Debit.*?table\s*6C", r"^Net Total"),
    ("9C_CDNUR", "Credit/Debit Notes – Unregistered (CDNUR)", r"9B\s*[-–].*\bUnregistered\b.*CDNUR", r"^Total\s*[-–]\s*Net off"),
    ("9C_CDNRA", "Amended CDNR – Registered (CDNRA) – Net Diff", r"9C\s*[-–].*\bRegistered\b.*CDNRA", r"^Net Differential"),
    ("9C_CDNURA", "Amended CDNUR – Unregistered (CDNURA) – Net Diff", r"9C\s*[-–].*\bUnregistered\b.*CDNURA", r"^Net Differential"),
    ("10", "Amendments to B2CS (Table 7) – Net Diff", r"(?<![0-9])10\s*[-–]", r"^Net differential"),
    ("11A", "Advances Received (Net of Refund Vouchers)", r"11A\s*\(1\)", r"^Total$"),
    ("11B", "Advances Adjusted Against Supplies (Net)", r"11B\s*\(1\)", r"^Total$"),
    ("11A_AMND", "Amendments: Advances Received", r"11A\s*[-–].*[Aa]mendment.*received", r"^Total$"),
    ("11B_AMND", "Amendments: Advances Adjusted", r"11B\s*[-–].*[Aa]mendment.*adjusted", r"^Total$"),
    ("12_HSN", "HSN-wise Summary – Grand Total", r"(?<![0-9])12\s*[-–].*HSN", r"^Total$"),
    ("13_DOCS", "Documents Issued", r"(?<![0-9])13\s*[-–].*[Dd]oc", r"^Net issued"),
    ("14_ECO", "E-Commerce Operator Supplies (u/s 52 & 9(5))", r"(?<![A-Za-z0-9])14\s*[-–]", r"^Total$"),
    ("14A_ECO", "Amendments: E-Commerce Supplies", r"(?<![A-Za-z0-9])14A\s*[-–]", r"^Net differential"),
    ("15", "Supplies u/s 9(5) (ECO pays tax)", r"(?<![A-Za-z0-9])15\s*[-–].*9\(5\)", r"^Total$"),
    ("TOTAL_LIABILITY", "Total Liability (excl. Reverse Charge)", r"Total Liability", r"Total Liability"),
]
#: Sections that add up to the stated liability; those whose value is held against the HSN summary; those
#: whose record count is checked; those of supplies between states.
LIABILITY = ["4A", "5", "6A", "6B", "6C", "7", "9A_B2B", "9A_B2CL", "9A_EXP", "9A_SEZ", "9A_DE", "9B_CDNR", "9C_CDNUR", "9C_CDNRA", "9C_CDNURA", "10", "11A", "11B", "14_ECO", "15"]
SUPPLY = ["4A", "4B", "5", "6A", "6B", "6C", "7"]
COUNTED = ["4A", "4B", "5", "6A", "9B_CDNR", "9C_CDNUR"]
INTERSTATE = {"5": "B2CL", "6A": "Export", "6B": "SEZ"}
HEADS = ["Value", "IGST", "CGST", "SGST", "Cess"]
SUMMARY_COLUMNS = ["Description", "Num_Records", "Doc_Type", *HEADS]

#: What tells the tables of the summary return apart, in the order in which it is tried.
TABLES = [
    ("Table_3_1", r"\(a\)\s*Outward taxable supplies"),
    ("Table_3_1_1", r"electronic commerce operator pays tax"),
    ("Table_3_2", r"Supplies made to Unregistered Persons"),
    ("ITC_first", r"A\.\s*ITC Available"),
    ("ITC_more", r"\(4\)\s*Inward supplies from ISD|B\.\s*ITC Reversed"),
    ("Table_5", r"From a supplier under composition scheme"),
    ("Table_5_1", r"System computed Interest|Interest Paid"),
    ("Table_6_1", r"\(A\)\s*Other than reverse charge"),
    ("Table_Breakup", r"Breakup of tax liability"),
]
#: Rows of table 3.1, taxes of table 6.1, columns of the input-credit table.
SUPPLY_ROWS = {"a": r"\(\s*a\s*\).*other than zero rated", "b": r"\(\s*b\s*\).*zero rated", "c": r"\(\s*c\s*\).*other outward supplies", "d": r"\(\s*d\s*\).*reverse charge"}
TAXES = {"IGST": "integrated tax", "CGST": "central tax", "SGST": "state ut tax"}
ITC_COLUMNS = ["Details", "Integrated tax", "Central tax", "State/UT tax", "Cess"]
PAYMENT_HEADERS = ["Description", "Net_Tax_Payable", "Adjustment", "Tax_Payable", "ITC_Integrated", "ITC_Central", "ITC_State_UT", "ITC_Cess", "Tax_paid_cash", "Interest_paid_cash", "Late_fee_paid_cash"]
#: Columns of the analysis row; the first 39 must be there.
OUTWARD = {"a": "Outward taxable supplies (other than zero rated, nil rated and exempted)", "b": "Outward taxable supplies (zero rated)", "c": "Other outward supplies (nil rated, exempted)"}
ANALYSIS = [
    "Year", "Return Period", "Month", "GSTIN", "Company Name", "Trade Name", "ARN", "Date of filing", *OUTWARD.values(),
    "Output IGST", "Output CGST", "Output SGST", "RCM Taxable Value", "RCM IGST Payable", "RCM CGST Payable", "RCM SGST Payable",
    "Total Input IGST", "Total Input CGST", "Total Input SGST", "Ineligible IGST", "Ineligible CGST", "Ineligible SGST",
    "Net Input IGST", "Net Input CGST", "Net Input SGST", "IGST to IGST", "IGST to CGST", "IGST to SGST", "CGST to IGST", "CGST to CGST",
    "SGST to IGST", "SGST to SGST", "IGST Payable", "CGST Payable", "SGST Payable", "Interest paid", "Late Fees paid",
    "Status", "Validation Findings", "Missing Fields", "Source File",
]
REQUIRED = ANALYSIS[:39]
#: The checks whose outcome the checksum matrix lists for every return.
KNOWN_CHECKS = ["Payment_Recon_6_1", "ITC_Math_Integrated_tax", "ITC_Math_Central_tax", "ITC_Math_State_UT_tax", "ITC_Math_Cess", "RCM_CrossCheck"]

#: Field: labels and form of the value, on the first page of the outward-supplies return.
OUTWARD_META = {
    "GSTIN": (["GSTIN"], "[A-Z0-9]{15}"), "Legal_Name": (["Legal name of the registered person"], r"[^\n]+"), "Trade_Name": (["Trade name, if any", "Trade name if any"], r"[^\n]+"), "ARN": (["ARN"], r"[A-Z]{2}[A-Z0-9]*\d[A-Z0-9]*"),
    "ARN_Date": (["ARN date", "Date of ARN"], r"[\d/]+"), "FY": (["Financial year"], r"[\d\-]+"), "Period": (["Tax period"], "[A-Za-z]+"),
}
#: The same for the summary return.
SUMMARY_META = {
    "GSTIN": (["GSTIN of the supplier"], "[A-Z0-9]+"), "Period": (["Period"], "[A-Za-z]+"), "Year": (["Year"], r"[\d\-]+"), "Legal_Name": (["Legal name of the registered person"], r"[^\n]+"), "Trade_Name": (["Trade name, if any"], r"[^\n]+"),
    "ARN": (["ARN"], r"[A-Z]{2}[A-Z0-9]*\d[A-Z0-9]*"), "Date_of_ARN": (["Date of ARN"], r"[\d/]+"),
}
#: Column of the payment table: what its header has to say, and what it must not say; the first that fits.
PAYMENT_WORDS = [
    ("Description", ["descrip"], []), ("Net_Tax_Payable", ["net tax"], []), ("Adjustment", ["adjustment"], []), ("Adjustment", ["negative"], []), ("Tax_Payable", ["payable"], ["net"]), ("ITC_Integrated", ["integrated"], []), ("ITC_Central", ["central"], []),
    ("ITC_State_UT", ["state"], []), ("ITC_State_UT", ["ut"], []), ("ITC_Cess", ["cess"], []), ("Tax_paid_cash", ["cash"], ["interest", "late"]), ("Interest_paid_cash", ["interest"], []), ("Late_fee_paid_cash", ["late"], []),
]
