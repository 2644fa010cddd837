"""Dates and the April-to-March fiscal calendar. Whatever can't be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbook.functions.text import FLAGS, bound, squeeze, strip

#: Accepted date formats, in the order in which they are tried.
FORM_FORMATS = ["d MMM y", "d MMMM y", "d-MMM-y", "d/M/y", "d-M-y", "MMM d, y", "MMM d,y", "y-M-d"]
PAYMENT_FORMATS = ["d-M-y", "d/M/y", "d-MMM-y", "d/MMM/y", "d MMM y"]
BANK_FORMATS = ["d-M-y", "d/M/y", "d MMM y", "d-MMM-y", "M/d/y", "d-M-yy", "d/M/yy"]
#: Months of the fiscal year, April first.
FISCAL_MONTHS = ["APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC", "JAN", "FEB", "MAR"]


def _shape(fmt: str) -> str:
    """A pattern for texts of a format, so that two-digit years aren't read as four-digit ones."""
    parts = {"yy": r"\d{2}", "y": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    out, i = "", 0
    while i < len(fmt):
        n = next((k for k in ("MMMM", "MMM", "yy", "y", "M", "d") if fmt.startswith(k, i)), None)
        out, i = (out + parts[n], i + len(n)) if n else (out + fmt[i], i + 1)
    return f"^{out}$"


def _in_title_case(c: Column) -> Column:
    """A text whose month names are written as the parser wants them: one capital, then small letters."""
    def titled(s: Column) -> Column:
        # case is costly, and a text of digits and signs has none
        low = F.regexp_replace(F.lower(s), r"\bsept\b", "sep")
        named = F.regexp_replace(F.initcap(F.regexp_replace(low, "([-/])", "$1 ")), "([-/]) ", "$1")
        return F.when(s.rlike(r"^[\x00-@]*$"), s).otherwise(named)

    return bound(squeeze(c), titled)


def parsed(c: Column, formats: list[str]) -> Column:
    def tries(s: Column) -> Column:
        java = lambda fmt: fmt.replace("yy", "~").replace("y", "yyyy").replace("~", "yy")
        return F.coalesce(*[F.when(s.rlike(_shape(fmt)), F.try_to_timestamp(s, F.lit(java(fmt))).cast("date")) for fmt in formats])

    return bound(_in_title_case(c), tries)


def form_date(c: Column) -> Column:
    """A date as the forms print it; day first where a format leaves that open, and with a time of day after it."""
    return parsed(F.regexp_replace(strip(c), r"^(\S+)\s+\d{1,2}:\d{2}.*$", "$1"), FORM_FORMATS)


def payment_date(c: Column) -> Column:
    return parsed(c, [*PAYMENT_FORMATS, *[f for f in FORM_FORMATS if f not in PAYMENT_FORMATS]])


def bank_date(c: Column) -> Column:
    return parsed(c, BANK_FORMATS)


def filing_date(c: Column) -> Column:
    """ISO dates as they are, others day first."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")).otherwise(form_date(c))


def fiscal_start(d: Column) -> Column:
    """The year in which the date's fiscal year begins."""
    return F.year(F.add_months(d, -3))


def fiscal_year(d: Column) -> Column:
    y = fiscal_start(d)
    return F.when(y.isNull(), "Unknown").otherwise(F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0")))


def fiscal_index(d: Column) -> Column:
    """April 1 to March 12; 0 without a date."""
    return F.coalesce(F.pmod(F.month(d) - 4, F.lit(12)) + 1, F.lit(0))


def month_name(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMMM"), F.lit("Unknown"))


def month_label(d: Column) -> Column:
    """Apr-25"""
    return F.date_format(d, "MMM-yy")


def month_number(token: Column) -> Column:
    """The calendar month that a token's first three letters name."""
    at = F.array_position(F.array(*map(F.lit, FISCAL_MONTHS)), F.upper(F.left(token, F.lit(3))))
    return F.when(at > 0, F.pmod(at + 2, F.lit(12)) + 1).cast("int")


def period_of(token: Column, year: Column) -> Column:
    """The first of the month of a printed month and calendar year."""
    return F.try_to_timestamp(F.concat_ws("-", F.when(year > 0, year).cast("string"), month_number(token).cast("string"), F.lit("1")), F.lit("y-M-d")).cast("date")


def month_and_year(c: Column) -> Column:
    """The first of the month of the first token like JUL-2025 or July 2025."""
    p = FLAGS + r"([A-Za-z]{3,9})[-\s]+(\d{4})"
    return period_of(F.regexp_extract(c, p, 1), F.nullif(F.regexp_extract(c, p, 2), F.lit("")).try_cast("int"))


def period_in_fiscal_year(token: Column, start: Column) -> Column:
    m = month_number(token)
    return period_of(token, F.when(start > 0, start + F.when(m < 4, 1).otherwise(0)))


def period_year(token: Column, fy: Column) -> Column:
    """April and 2025-26 as Apr-25; January to March take the second year; ?? without a fiscal year."""
    years = F.split(fy, "-")
    first, second = F.right(strip(F.get(years, F.lit(0))), F.lit(2)), F.right(strip(F.get(years, F.lit(1))), F.lit(2))
    late = F.lower(F.left(token, F.lit(3))).isin("jan", "feb", "mar")
    second = F.coalesce(second, F.lpad(F.pmod(first.try_cast("int") + 1, F.lit(100)).cast("string"), 2, "0"))
    known = fy.rlike(r"^\s*\d{4}")
    return F.concat_ws("-", F.initcap(F.left(token, F.lit(3))), F.when(known, F.when(late, second).otherwise(first)).otherwise("??"))


def label_date(c: Column) -> Column:
    """Apr-25 or Apr 2025 as the first of the month."""
    s = squeeze(c)
    two = F.when(s.rlike(r"^[A-Za-z]{3}-\d{2}$"), F.try_to_timestamp(F.concat(F.lit("1-"), F.initcap(F.left(s, F.lit(3))), F.right(s, F.lit(3))), F.lit("d-MMM-yy")).cast("date"))
    four = F.when(s.rlike(r"^[A-Za-z]{3} \d{4}$"), F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(s)), F.lit("d MMM yyyy")).cast("date"))
    return F.coalesce(two, four)


def iso_month(c: Column) -> Column:
    return F.date_format(label_date(c), "yyyy-MM")


def deduction_month(paid: Column, interest: Column, fy_start: Column) -> tuple[Column, Column]:
    """The month that a tax payment is for, and whether it is a guess.

    A payment of April is for March; one by the seventh, or with interest, for the month before; else for its own month.
    A month outside the stated fiscal year becomes that year's March, as a guess.
    """
    own = F.trunc(paid, "MM")
    month = F.when((F.month(paid) == 4) | (F.dayofmonth(paid) <= 7) | (interest > 0), F.trunc(F.add_months(paid, -1), "MM")).otherwise(own)
    month = F.when(F.month(paid) == 4, F.trunc(F.add_months(own, -1), "MM")).otherwise(month)
    lo = F.make_date(F.when(fy_start > 0, fy_start), F.lit(4), F.lit(1))
    hi = F.add_months(lo, 11)
    guess = F.coalesce((month < lo) | (month > hi), F.lit(False))
    return F.when(guess, hi).otherwise(month), guess


def day_before_month(d: Column) -> Column:
    """The month before a From date, as the spreadsheet generation of the rules dates a profession-tax period."""
    return F.trunc(F.add_months(d, -1), "MM")
