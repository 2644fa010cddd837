"""Flags that the standard forms' rows raise; each rule set is a list of conditions in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions import numbers, text
from quillbook.operators.ledger import party_rank

IDENTITY = {"PF": "ENTITY?", "PTRC": "TIN?", "EBRC": "ENTITY?", "EWB": "ENTITY?"}


def _joined(rules: list[tuple[Column, Column | str]]) -> Column:
    return text.joined_flags(*[F.when(cond, flag if isinstance(flag, Column) else F.lit(flag)) for cond, flag in rules])


def _unknown(c: str) -> Column:
    return F.col(c).isin("Unknown", "")


def standard(form: str) -> Column:
    rules = [(_unknown("EntityID"), IDENTITY[form]), (F.col("PeriodDate").isNull(), "PERIOD?"), (F.coalesce("PrimaryAmount", F.lit(0.0)) == 0, "AMT?")]
    return _joined(rules)


def pf_challan(tol: numbers.Tolerances = numbers.DEFAULT) -> Column:
    employer = F.col("Employer_EPF_AC01") + F.col("Employer_EPS_AC10")
    uneven = (employer > 0) & (F.abs(F.col("Employee_EPF_AC01") - employer) / F.greatest(employer, F.lit(1.0)) > tol.pf_share)
    return text.joined_flags(text.blank_to_null(standard("PF")), F.when(uneven, "EE<>ER?"))


def tds(tol: numbers.Tolerances = numbers.DEFAULT) -> Column:
    identity = F.when(F.col("Taxpayer ID Type") == "PAN", "PAN?").otherwise("TAN?")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _joined([
        (_unknown("EntityID"), identity), (F.col("PeriodDate").isNull(), "MONTH?"), (F.abs("Crosscheck Diff") > tol.crosscheck, "CROSSCHECK"), (F.col("Section") == "Unknown", "SECTION?"),
        (blank("CIN"), "CIN?"), (blank("BSR Code"), "BSR?"), (blank("Challan No"), "CHALLAN?"), (blank("Minor Head"), "MINOR_HEAD?"), (F.col("PrimaryAmount") <= 0, "AMT?"), (F.col("PeriodEstimated"), "PERIOD_EST"),
    ])


def esic_ranked(rows: DataFrame) -> DataFrame:
    """Adds Party, by amount within year and printed month over the batch, and Flags."""
    out = party_rank(rows, ["FY", "Month"], "Amount", ["SourceFile"])
    return out.withColumn("Flags", _joined([(F.col("PeriodDate").isNull(), "PERIOD?"), (F.col("Party") == "Other", "EXTRA CHALLAN"), (F.col("Amount") <= 0, "AMT?")]))


def flagged(rows: DataFrame, form: str, kind: str) -> DataFrame:
    if form == "ESIC":
        return esic_ranked(rows)
    return rows.withColumn("Flags", tds() if form == "TDS" else pf_challan() if (form, kind) == ("PF", "Challan") else standard(form))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _not_positive(amount: Column) -> tuple[Column, str]:
    return amount.isNull() | (amount <= 0), "AMT?"


#: The rule sets of the spreadsheet generation. A frame that a document couldn't be parsed to has null numbers, and a
#: condition on nulls doesn't hold; `parsed` says which rows were.
def sheet_gstr3b(parsed: Column) -> Column:
    """On analysis rows with PeriodDate."""
    near = lambda a, b: F.abs(_c(a) - _c(b)) > 1
    used = _c("IGST to IGST") + _c("IGST to CGST") + _c("IGST to SGST") + _c("CGST to IGST") + _c("CGST to CGST") + _c("SGST to IGST") + _c("SGST to SGST")
    net = _c("Net Input IGST") + _c("Net Input CGST") + _c("Net Input SGST")
    return _joined([
        (~parsed, "PARSE ERR"), (F.col("PeriodDate").isNull(), "PERIOD?"), (parsed & (F.coalesce(F.length("GSTIN"), F.lit(0)) != 15), "GSTIN?"), (near("Output CGST", "Output SGST"), "CGST<>SGST(out)"), (near("Net Input CGST", "Net Input SGST"), "ITC CGST<>SGST"),
        (F.least(_c("IGST Payable"), _c("CGST Payable"), _c("SGST Payable")) < 0, "NEG PAYABLE"), (used > net + 1, "UTIL>ITC"),
    ])


def sheet_amount() -> Column:
    return _c("IGST Payable") + _c("CGST Payable") + _c("SGST Payable")


def sheet_pf(parsed: Column) -> Column:
    uneven = F.abs(F.col("Employee_EPF_AC01") - F.col("Employer_EPF_AC01") - F.col("Employer_EPS_AC10")) > 1
    return _joined([(~parsed, "PARSE ERR"), (F.col("PeriodDate").isNull(), "PERIOD?"), (F.col("Employer_EPS_AC10") > F.col("Employer_EPF_AC01") + 1, "EPS>EPF?"), (uneven, "EE<>ER(EPF+EPS)"), (F.coalesce("PF_Admin_AC02", F.lit(0.0)) == 0, "NO ADMIN")])


def sheet_ptrc(parsed: Column) -> Column:
    return _joined([(~parsed, "PARSE ERR"), (F.col("PeriodDate").isNull(), "PERIOD?"), _not_positive(_c("PT Paid")), (~F.coalesce(_c("Type of Return").contains("PTRC"), F.lit(False)), "TYPE?"), (_unknown("EntityID"), "TAN?")])


def sheet_tds(parsed: Column) -> Column:
    return _joined([(~parsed, "PARSE ERR"), (F.col("PeriodDate").isNull(), "MONTH?"), (F.abs(_c("Crosscheck Diff")) > 1, "CROSSCHECK"), (F.col("Section").isNull() | (F.col("Section") == "Unknown"), "SECTION?"), _not_positive(_c("Total Amount Paid"))])


def sheet_esic(parsed: Column) -> Column:
    """On ranked rows."""
    return _joined([(~parsed, "PARSE ERR"), (F.col("PeriodDate").isNull(), "PERIOD?"), (F.col("Party") == "Other", "EXTRA CHALLAN"), _not_positive(F.col("Amount"))])


def sheet_status(flags: Column, parsed: Column) -> Column:
    """A row that couldn't be parsed is an error with null numbers, not a row of zeros."""
    return F.when(~parsed, "Error").when(flags != "", "Review").otherwise("OK")
