"""Which of many fixed markers a text holds. Rules work on the short list that results, not on the text.

Each marker is searched for by itself, as bytes: some fifty such searches cost less than one pattern of all markers, which has to
be tried at every place of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbook.functions.text import bound


def scan(text: Column, markers: list[str]) -> Column:
    """The markers that the text contains, each once, in no order. None of them may be empty; a null text gives null."""
    distinct = sorted(set(markers))
    if not distinct or not distinct[0]:
        raise ValueError("markers are strings of a character or more")
    names = F.array(*map(F.lit, distinct))
    return bound(text, lambda t: F.when(t.isNotNull(), F.filter(names, lambda m: F.contains(t, m))))


def held(found: Column, markers: list[str]) -> Column:
    """Those of the markers that were found, in the order given."""
    return F.array_intersect(F.array(*map(F.lit, markers)), found)


def any_held(found: Column, markers: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, markers)))


def weight(found: Column, weights: dict[str, int]) -> Column:
    """The sum of the weights of the markers that were found."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(found, F.lit(0), lambda total, m: total + F.coalesce(F.element_at(table, m), F.lit(0)))
