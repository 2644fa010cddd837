"""Forms that are long to read are dealt over the cores, and no line is read again from each of its characters."""

from __future__ import annotations

import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.operators.classify import with_forms
from quillbook.parsers import forms
from quillbook.plans import pipelines
from quillbook.plans.catalogue import QUERIES
from quillbook.plans.registered import TASK_ROWS, spread
from quillbook.sources import layout

SF = "/root/testdata/sf0.001"


def test_goods_below_a_long_line(spark):
    text = "Document Date 31/01/1996\n" + "x" * 400_000 + "\npumps 84130001\nHSN Code\nwater pumps"
    start = time.time()
    got = forms.ewb(spark.createDataFrame([("a", text), ("b", "HSN Code 841300-steel"), ("c", "\nHSN Code\n")], "source_file string, text string")).orderBy("SourceFile").collect()
    assert [(r.HSN_Code, r.HSN_Desc) for r in got] == [("84130001", "water pumps"), ("841300", "steel"), ("", "")]
    assert time.time() - start < 60


def test_dates_with_and_without_letters(spark):
    shown = ["01/02/1996", " 1-2-1996 ", "01- 02-1996", "3 SEPT 2024", "03-sep-2024", "2024-9-3", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(shown)], "i int, x string")
    got = [r.d for r in df.select("i", D.form_date(F.col("x")).alias("d")).orderBy("i").collect()]
    assert got == [date(1996, 2, 1), date(1996, 2, 1), None, *[date(2024, 9, 3)] * 3, None, None]


@pytest.mark.parametrize("name", ["eway_bills", "ptrc_returns", "pf_challans", "pf_other_forms", "realisation_certificates", "tds_challans", "mtr_challans"])
def test_forms_of_one_small_file_are_many_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 32


def test_rows_of_a_task_are_bounded(spark):
    tasks = lambda rows: spread(spark.range(10), "id", rows).rdd.getNumPartitions()
    assert tasks(0) == tasks(TASK_ROWS) == 32 and tasks(300 * TASK_ROWS) == 300


def test_names_of_a_forms_files_are_kept(spark):
    kept = []

    def keep(df, name, by=None):
        kept.append(name)
        if name == "SB_files":
            raise StopIteration
        return df

    pages = spark.createDataFrame([("a", 1, "x")], "source_file string, page_no int, text string")
    with pytest.raises(StopIteration):
        pipelines.statutory(pages, spark.createDataFrame([], layout.CELLS), spark.createDataFrame([], layout.WORDS), keep=keep)
    assert {"GSTR1_files", "GSTR3B_files", "SB_files"} <= set(kept)


def test_pages_of_one_form_and_of_two(spark):
    bill, ptrc = "E-WAY BILL NO 1", "FORM_IIIB"
    df = spark.createDataFrame([(0, [bill]), (1, [bill, ptrc]), (2, [bill, bill]), (3, []), (4, None)], "i int, pages array<string>").withColumn("text", F.array_join("pages", "\n"))
    assert [r.mixed for r in with_forms(df, pages="pages").orderBy("i").collect()] == [False, True, False, False, None]
