"""String functions: Column in, Column out. A miss is null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-blind, Unicode classes, and only \n ends a line.
FLAGS = "(?idU)"
NUMBER = r"[\d,]+(?:\.\d+)?"


def bound(c: Column, f) -> Column:
    """f of c, with c worked out once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Stretches of white space become one space; ends are trimmed; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_cell(c: Column) -> Column:
    """A table cell without the watermark letter on a line of its own in front, and with squeezed white space."""
    return squeeze(F.regexp_replace(c, r"^[A-Z]\n", ""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, stripped; null on a miss or an empty group."""
    return blank_to_null(strip(F.regexp_extract(c, FLAGS + pattern, group)))


def first_of(c: Column, *patterns: str, group: int = 1) -> Column:
    return F.coalesce(*[found(c, p, group) for p in patterns])


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(squeeze(F.get(F.reverse(F.regexp_extract_all(c, F.lit(FLAGS + "(?m)" + pattern), F.lit(group))), F.lit(0))))


def printed(*labels: str) -> str:
    """A pattern of any of these printed labels, however wide their spaces are."""
    return "(?:" + "|".join(r"\s*".join(f"\\Q{w}\\E" for w in label.split()) for label in labels) + ")"


def labelled(labels: list[str], value: str, start: bool = False) -> str:
    """A pattern of a value (one group) that follows a label, a colon or dash between them or not; `start`: at a line's start."""
    return ("(?m)^" if start else "") + printed(*labels) + rf"\s*[:\-]?\s*({value})"


def between(c: Column, start: str, end: str) -> Column:
    """What stands between two labels, squeezed; null if they aren't there in that order."""
    return blank_to_null(squeeze(F.regexp_extract(c, FLAGS + "(?s)" + printed(start) + "(.*?)" + printed(end), 1)))


def until(c: Column, *words: str) -> Column:
    """c up to the first of these printed words, squeezed."""
    return squeeze(F.get(F.split(c, FLAGS + r"\b" + printed(*words) + r"\b"), F.lit(0)))


def line_above(c: Column, label: str) -> Column:
    return blank_to_null(squeeze(F.regexp_extract(c, FLAGS + r"(?m)^([^\n]*)\n[\d ]*" + printed(label), 1)))


def line_below(c: Column, label: str) -> Column:
    return blank_to_null(squeeze(F.regexp_extract(c, FLAGS + r"(?m)" + printed(label) + r"[^\n]*\n([^\n]*)", 1)))


def without_printed(c: Column, phrases: list[str]) -> Column:
    """c without these phrases, wherever they stand whole, in either case; a bracket of a phrase may be missing."""
    def pattern(phrase: str) -> str:
        words = [rf"\Q{w}\E" for w in phrase.strip("() ").split()]
        return (r"\(?\s*" if phrase.startswith("(") else "") + r"\b" + r"\s+".join(words) + r"\b" + (r"\s*\)?" if phrase.endswith(")") else "")

    return F.regexp_replace(c, "(?i)" + "|".join(map(pattern, phrases)), " ")


def key_value(c: Column, key: str) -> Column:
    """What stands after `key :` on its line."""
    return found(c, rf"{key}\s*:\s*(.+)")


def label_line(c: Column, label: str) -> Column:
    """What stands after a label that begins a line, with or without a colon."""
    return blank_to_null(squeeze(F.regexp_extract(c, FLAGS + rf"(?m)^\Q{label}\E\s*:?\s*(.+)$", 1)))


def after_label(c: Column, label: str, width: int) -> Column:
    """The `width` characters after the first occurrence of label, in either case, stripped; null on a miss."""
    at = F.instr(F.upper(c), F.lit(label.upper()))
    return F.when(at > 0, blank_to_null(strip(F.substring(c, at + len(label), F.lit(width)))))


def first_token(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"(?U)\S+", 0))


def without_courtesy(c: Column) -> Column:
    """A dealer's name without M/s or M S in front."""
    return strip(F.regexp_replace(c, r"(?U)^M\s*/?\s*[Ss]\.?\s+", ""))


def normalised(c: Column) -> Column:
    """Lower-case words and digits, anything else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]+", " "))


def canonical_header(c: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a printed table header: the longest alias that it is, or that it begins with as words."""
    def canonical(name: Column) -> Column:
        out = None
        for alias in sorted(aliases, key=lambda a: (-len(a), a)):
            hit = (name == alias) | name.startswith(alias + " ")
            out = F.when(hit, aliases[alias]) if out is None else out.when(hit, aliases[alias])
        return out.otherwise(name)

    return bound(normalised(F.coalesce(c, F.lit(""))), canonical)


def joined_flags(*flags: Column) -> Column:
    """Those of the flags that aren't null, with semicolons; the empty string if none is raised."""
    return F.concat_ws("; ", *flags)


def distinct_flags(flags: Column) -> Column:
    return F.array_join(F.array_distinct(flags), "; ")


def split_flags(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def is_missing(c: Column) -> Column:
    """Null, empty, or a word that stands for nothing."""
    s = c.cast("string")
    return F.coalesce(s.isNull() | (s == "") | F.lower(strip(s)).isin("unknown", "nat", "none"), F.lit(True))


def cut_message(c: Column, width: int = 300) -> Column:
    return F.left(c, F.lit(width))


def html_escaped(c: Column) -> Column:
    """c with the characters that markup is made of as references."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def head_code(c: Column) -> Column:
    return found(c, r"\((\d+)\)")


def name_and_address(lines: Column) -> tuple[Column, Column]:
    """The first line, and the rest as one line, of an address block whose numbered labels are cut off."""
    kept = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"(?U)\s*\d{1,2}\s*\.\s*[A-Z].*$", ""))), lambda x: x != "")
    return F.get(kept, F.lit(0)), blank_to_null(F.array_join(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), " "))


def unique_headers(cells: Column) -> Column:
    """Cleaned header cells; a blank one is Col, and the k-th of equal ones gets _k."""
    names = F.transform(cells, lambda c: F.coalesce(blank_to_null(clean_cell(c)), F.lit("Col")))
    numbered = lambda x, k: F.when(k > 1, F.concat_ws("_", x, k)).otherwise(x)

    def unique(all_: Column) -> Column:
        seen = lambda x, i: F.size(F.filter(F.slice(all_, 1, i + 1), lambda y: y == x))
        return F.transform(all_, lambda x, i: bound(seen(x, i), lambda k: numbered(x, k)))

    return bound(names, unique)


def fit(cells: Column, width: int, filler: Column | None = None) -> Column:
    """An array of exactly `width` cells."""
    filler = F.lit(None).cast("string") if filler is None else filler
    return F.slice(F.concat(cells, F.array_repeat(filler, width)), 1, width)
