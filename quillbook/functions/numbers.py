"""Number functions. Two families differ on a miss: to_float gives 0, the others null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbook.functions.text import FLAGS, NUMBER, blank_to_null, bound, clean_cell, squeeze

_DOUBLE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Tolerances:
    """Every threshold of the checks; pass another instance to tighten or relax them."""

    gst: float = 1.0
    hsn_percent: float = 10.0
    rcm_percent: float = 10.0
    b2cl_average: float = 250_000.0
    reconcile_floor: float = 1.0
    reconcile_share: float = 0.01
    bank: float = 0.05
    crosscheck: float = 1.0
    pf_share: float = 0.05
    box: float = 1.0
    line: float = 2.5


DEFAULT = Tolerances()


def to_float(c: Column) -> Column:
    """A printed number with commas as a double; 0 for whatever isn't one."""
    number = lambda s: F.when(s.rlike(_DOUBLE), s.try_cast("double"))
    return F.coalesce(bound(F.regexp_replace(clean_cell(c), r"(?U)[,\s]", ""), number), F.lit(0.0))


def parse_amount(c: Column) -> Column:
    """The first amount in a text: rupee signs and back-ticks dropped, minus or parentheses negative; null if none."""
    s = F.translate(squeeze(c), "₹`", "")

    def amount(token: Column) -> Column:
        size = F.translate(token, "()+-,", "").try_cast("double")
        negative = token.startswith("-") | (token.startswith("(") & token.endswith(")"))
        return F.when(token != "", F.when(negative, -size).otherwise(size))

    return bound(F.regexp_extract(s, r"[-+]?\(?\d[\d,]*(?:\.\d+)?\)?", 0), amount)


def signed_balance(amount: Column, kind: Column, debt: Column) -> Column:
    """A balance with the sign that DR, CR, or an account that is a debt by default gives it."""

    def signed(v: Column) -> Column:
        x, words = v["x"], v["words"]
        is_debit = words.contains("DR") | (debt & ~words.contains("CR"))
        return F.when(is_debit, -F.abs(x)).when(words.contains("CR"), F.abs(x)).otherwise(x)

    return bound(F.struct(parse_amount(amount).alias("x"), F.upper(F.concat_ws(" ", squeeze(amount), squeeze(kind))).alias("words")), signed)


def strict_number(c: Column) -> Column:
    """A whole text that is a number, .81 included; else null."""
    number = lambda s: F.when(s.rlike(r"^-?(\d+(\.\d+)?|\.\d+)$"), s.try_cast("double"))
    return bound(F.replace(squeeze(c), F.lit(","), F.lit("")), number)


def numbers_on_line(c: Column, pattern: str, n: int = 6) -> Column:
    """The first n numbers after the pattern's first match on its line, 0 where there are fewer."""
    rest = F.regexp_extract(c, FLAGS + pattern + r"([^\n]*)", 1)
    found = F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(0)), to_float)
    return F.slice(F.concat(found, F.array_repeat(F.lit(0.0), n)), 1, n)


def last_two_numbers(c: Column, pattern: str) -> tuple[Column, Column]:
    """The last two numbers of the line that the pattern matches on; both 0 if there are fewer than two."""
    line = F.regexp_extract(c, FLAGS + pattern + r"[^\n]*", 0)
    found = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))
    pick = lambda k: F.when(F.size(found) >= 2, to_float(F.element_at(F.slice(found, -2, 2), k))).otherwise(0.0)
    return pick(1), pick(2)


def amount_after(c: Column, label: str) -> Column:
    return to_float(F.regexp_extract(c, FLAGS + label + rf"\s+({NUMBER})", 1))


def numeric_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def clamp(c: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "High").when(score >= 70, "Medium").otherwise("Low")


def format_indian(c: Column) -> Column:
    """Whole rupees with Indian grouping: the last three digits, then pairs."""
    digits = F.abs(F.round(c)).cast("long").cast("string")
    head = F.reverse(F.regexp_replace(F.reverse(F.left(digits, F.length(digits) - 3)), r"(\d{2})(?=\d)", "$1,"))
    grouped = F.when(F.length(digits) <= 3, digits).otherwise(F.concat_ws(",", head, F.right(digits, F.lit(3))))
    return F.concat(F.when(F.round(c) < 0, "-").otherwise(""), grouped)


def or_null(c: Column) -> Column:
    """NaN, as it comes from pandas, as null."""
    return F.nanvl(c, F.lit(None).cast("double"))


def text_or_unknown(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("Unknown"))
