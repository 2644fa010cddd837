"""Bills are parsed in one pass: no word or page is shuffled, kept or read again."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillbook.operators import geometry as G
from quillbook.parsers import bill
from quillbook.plans.catalogue import QUERIES
from tests import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["shipping_bills", "shipping_bill_items", "shipping_bill_invoices"])
def test_only_orders_are_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and len(re.findall(r"FileScan", plan)) == 1 and "EvalPython" not in plan


def test_lines_begin_where_a_fold_says(spark):
    rng, tolerance = random.Random(5), 3.0
    pages = [[], [None], [None, None, 1.0, 1.0, 9.0], [float("nan"), float("nan")], [1.0, float("inf"), float("inf"), float("nan")], [i * 2.5 for i in range(3000)]]
    pages += [sorted(rng.choice((1.0, 2.9, 3.0, 10.0)) * rng.randint(0, 9) for _ in range(rng.randint(1, 30))) for _ in range(200)]

    def fold(tops):
        found, start = [], None
        for i, t in enumerate(tops):
            # a top that is no number is after all others, and of one line
            more = start is None or t is None or (t != t and start == start) or t > start + tolerance
            if i == 0 or more:
                found.append(i)
                start = t
        return found

    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, tops array<double>")
    got = df.select("i", G.line_starts_in_place(F.col("tops"), tolerance).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [fold(p) for p in pages]


def test_files_without_a_readable_page_are_told_in_the_same_pass(spark):
    words = fixtures.bill_words(spark)
    lost = words.limit(1).withColumns({"source_file": F.lit("lost.pdf"), "x0": F.lit(None).cast("double")})
    got = {r.source_file: r for r in bill.files(bill.pages_of(words.unionByName(lost))).select("source_file", "error", "sb_no", F.size("items").alias("n")).collect()}
    assert got["lost.pdf"].error.endswith("1 words have no place") and got["lost.pdf"].sb_no is None and got["lost.pdf"].n == 0
    assert got["a.pdf"].error is None and got["a.pdf"].n == 1
