"""Page geometry: words to lines, values to columns. Pages are folded within a row or joined by range; nothing collects."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbook.functions import numbers
from quillbook.functions.text import bound

WORD = "struct<text:string,x0:double,x1:double,top:double,bottom:double>"


def line_starts(tops: Column, tolerance: float) -> Column:
    """The places (from 0) of an array of tops, sorted to a tenth, at which a new line begins: the first, and from each the
    next one that lies more than the tolerance below it. A word without a top is a line. Exact for tolerances of 0.1 and more.

    The greatest top so far, which rises, tells by binary search where a line ends: a step a line, not a word.
    """

    @F.arrow_udf("array<int>")
    def starts(pages: pa.Array) -> pa.Array:
        values, offsets = pages.values, pages.offsets.to_numpy()
        lost = values.is_null().to_numpy(zero_copy_only=False)
        values = values.to_numpy(zero_copy_only=False)
        found, ends = [], [0]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            i = a
            # places without a top come first
            while i < b and lost[i]:
                found.append(i - a)
                i += 1
            first, high = i, np.maximum.accumulate(values[i:b])
            while i < b:
                found.append(i - a)
                i = max(i + 1, first + int(high.searchsorted(values[i] + tolerance, "right")))
            ends.append(len(found))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))

    return starts(tops)


def line_starts_in_place(tops: Column, tolerance: float) -> Column:
    """The same as `line_starts`, where few words of a page lie close to a line without being in it.

    Where tops that follow each other are equal or further apart than the tolerance, each run of equal ones is a line. Other
    pages are folded from top to top; starts are gathered in chunks, since an array is copied when it grows. No function leaves
    the JVM, so pages stay where they are dealt; folding costs more than the search does.
    """

    def apart(a: Column, b: Column) -> Column:
        return a.isNull() | b.isNull() | (b > a + tolerance)

    def runs(t: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | apart(F.get(t, i - 1), F.get(t, i)))

    def folded(t: Column) -> Column:
        def step(a: Column, top: Column) -> Column:
            new, full = (a["i"] == 0) | apart(a["start"], top), F.size(a["last"]) >= 256
            done = F.when(new & full, F.concat(a["done"], F.array(a["last"]))).otherwise(a["done"])
            last = F.when(new, F.concat(F.when(full, none).otherwise(a["last"]), F.array(a["i"]))).otherwise(a["last"])
            return F.struct((a["i"] + 1).alias("i"), F.when(new, top).otherwise(a["start"]).alias("start"), done.alias("done"), last.alias("last"))

        none = F.expr("cast(array() as array<int>)")
        zero = F.struct(F.lit(0).alias("i"), F.lit(None).cast("double").alias("start"), F.expr("cast(array() as array<array<int>>)").alias("done"), none.alias("last"))
        return F.aggregate(t, zero, step, lambda a: F.concat(F.flatten(a["done"]), a["last"]))

    def starts(t: Column) -> Column:
        after = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: (a == b) | apart(a, b))
        return F.when(F.size(t) < 2, F.slice(F.array(F.lit(0)), 1, F.size(t))).when(F.forall(after, lambda x: x), runs(t)).otherwise(folded(t))

    return bound(tops, starts)


def clustered_pages(words: DataFrame, keys: list[str], tolerance: float = numbers.DEFAULT.line, upright: Column | None = None, more: dict[str, Column] | None = None, starts: Callable[[Column, float], Column] = line_starts) -> DataFrame:
    """keys, lines from rows of words (text, x0, x1, top, bottom), and aggregates over all words of a page; a line is a struct of
    top, words and text. Words that aren't upright are in no line.

    A word starts a line if it lies more than the tolerance below that line's first word, which drifts less than the last
    one does, so no gap rule finds the lines. A page is one row; its lines are cut from it where they begin.
    """
    word = F.struct("text", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")])
    sortable = F.struct(F.round("top", 1).alias("t"), F.col("x0").cast("double").alias("x"), word.alias("w"))
    pages = words.groupBy(*keys).agg(F.sort_array(F.collect_list(sortable if upright is None else F.when(upright, sortable))).alias("sorted"), *[c.alias(n) for n, c in (more or {}).items()])
    pages = pages.withColumn("starts", starts(F.col("sorted")["w"]["top"], tolerance))
    ends = lambda i: F.coalesce(F.get(F.col("starts"), i + 1), F.size("sorted"))

    def line(s: Column, i: Column) -> Column:
        across = F.sort_array(F.transform(F.slice(F.col("sorted"), s + 1, ends(i) - s), lambda x: F.struct(x["x"].alias("x"), x["w"].alias("w"))))
        return bound(across["w"], lambda w: F.struct(F.array_min(w["top"]).alias("top"), w.alias("words"), F.array_join(w["text"], " ").alias("text")))

    return pages.select(*keys, F.transform("starts", line).alias("lines"), *(more or {}))


def cluster_lines(words: DataFrame, keys: list[str], tolerance: float = numbers.DEFAULT.line) -> DataFrame:
    """keys, line_no, top, words, text: a row a line of the pages."""
    return clustered_pages(words, keys, tolerance).select(*keys, F.posexplode("lines").alias("line_no", "line")).select(*keys, "line_no", "line.*")


def in_box(w: Column, x0: Column, top: Column, x1: Column, bottom: Column, slack: float = numbers.DEFAULT.box) -> Column:
    """Whether a word lies in a box, give or take the slack."""
    return (w["x0"] >= x0 - slack) & (w["x1"] <= x1 + slack) & w["top"].between(top - slack, bottom + slack)


def first_line(lines: Column, pattern: str) -> Column:
    """The first of an array of line structs whose text the pattern is found in."""
    return F.get(F.filter(lines, lambda x: x["text"].rlike(pattern)), F.lit(0))


def first_word(words: Column, pattern: str) -> Column:
    """The first word that the pattern matches from its start."""
    return F.get(F.filter(words, lambda w: w["text"].rlike(f"^(?:{pattern})")), F.lit(0))


def zones(anchors: Column, values: Column, slack: float = 8.0) -> Column:
    """Texts of the values under each anchor, left to right: a value belongs to the last anchor whose left edge, less the
    slack, is at or left of the value's centre. Values left of all anchors belong to none; an empty zone is null."""
    ordered = F.array_sort(F.transform(anchors, lambda a: a["x0"]))
    inside = F.array_sort(F.transform(values, lambda v: F.struct(v["x0"].alias("x0"), ((v["x0"] + v["x1"]) / 2).alias("mid"), v["text"].alias("text"))))

    def texts(edges: Column, values: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            hit = F.filter(values, lambda v: (v["mid"] >= x - slack) & F.coalesce(v["mid"] < F.get(edges, i + 1) - slack, F.lit(True)))
            return F.nullif(F.array_join(F.transform(hit, lambda v: v["text"]), " "), F.lit(""))

        return F.transform(edges, one)

    # both are worked out once, not for every anchor and value
    return bound(ordered, lambda edges: bound(inside, lambda inner: texts(edges, inner)))


def zone_join(values: DataFrame, anchors: DataFrame, keys: list[str], at: str = "at", x: str = "x0", slack: float = 8.0) -> DataFrame:
    """The same as a range join: values (keys, at) get the columns of the anchor (keys, x0) whose interval they fall in."""
    w = Window.partitionBy(*keys).orderBy(x)
    bounded = anchors.withColumns({"lo_": F.col(x) - slack, "hi_": F.lead(x).over(w) - slack})
    on = [values[k] == bounded[k] for k in keys] + [values[at] >= bounded["lo_"], values[at] < F.coalesce(bounded["hi_"], F.lit(float("inf")))]
    out = values.join(bounded, on)
    for k in keys:
        out = out.drop(bounded[k])
    return out.drop("lo_", "hi_")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, initial: Column | None = None) -> DataFrame:
    """The last value that wasn't null, up to and with each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(value, ignorenulls=True).over(w)
    return df.withColumn(name, filled if initial is None else F.coalesce(filled, initial))
