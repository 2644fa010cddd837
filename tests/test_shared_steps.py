"""Steps that many tables share are worked out once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillbook.operators import bank as B
from quillbook.operators import geometry as G
from quillbook.operators import ledger as L
from quillbook.plans import sheets
from quillbook.plans.catalogue import QUERIES
from quillbook.sources.store import staged

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["shipping_bills", "shipping_bill_items", "shipping_bill_invoices"])
def test_bills_are_read_from_kept_pages(spark, name):
    files = QUERIES[name](spark, SF).inputFiles()
    assert files and not [f for f in files if "orders.parquet" in f]


def test_words_without_a_place_are_lines_of_their_own(spark):
    df = spark.createDataFrame([(1, [None, None, 1.0, 2.0, float("nan"), float("nan")]), (2, [None]), (3, [])], "i int, tops array<double>")
    got = df.select("i", G.line_starts(F.col("tops"), 2.5).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [[0, 1, 2, 4], [0], []]


def test_deposits_are_read_once(spark):
    files = QUERIES["deposit_statements"](spark, SF).inputFiles()
    assert files and not [f for f in files if "orders.parquet" in f]


def test_a_header_cell_is_normalised_once(spark):
    plan = spark.range(1).select(B.header_map(F.array(F.lit("Tran Date"), F.lit("tran date"), F.lit(""), F.lit("Balance"))).alias("m"))
    assert plan.first().m == {"date": 1, "balance": 4}
    assert plan._jdf.queryExecution().analyzed().toString().count("[^a-z0-9]+") == 1


def test_review_packets_classify_once(spark):
    files = QUERIES["review_packet"](spark, SF).inputFiles()
    assert files and not [f for f in files if "documents.parquet" in f]


def test_forms_are_sent_to_the_documents(spark):
    ledger = spark.createDataFrame([("A", "Return", "1", None, "f", 1.0), ("A", "Challan", "1", None, "f", 1.0)], "ReturnType string, DocKind string, EntityID string, PeriodDate date, SourceFile string, PrimaryAmount double")
    recon = L.reconcile(ledger)
    assert recon.count() == 1 and "strategy=broadcast" in recon._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_over_kept_groups_are_the_same(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("file"), (F.col("id") * 7 % 101).cast("double").alias("amount"))
    rank = lambda keep: sorted(map(tuple, L.party_rank(rows, ["k"], "amount", ["file"], keep=keep).collect()))
    assert rank(staged(spark, "ranks")) == rank(None)
    plan = L.party_rank(rows, ["k"], "amount", ["file"], keep=staged(spark, "ranks"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_returns_do_not_go_through_the_driver(spark):
    df = QUERIES["summary_star"](spark, SF)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in df.inputFiles() if "customer.parquet" in f]


def test_ranked_challans_are_read_once(spark):
    files = QUERIES["esic_challans"](spark, SF).inputFiles()
    assert files and not [f for f in files if "orders.parquet" in f]


def test_sheets_are_read_once(spark, monkeypatch):
    tds, seen = sheets.tds, []
    monkeypatch.setattr(sheets, "tds", lambda cells, failed=None: seen.append(cells) or tds(cells, failed))
    df = QUERIES["sheet_challans"](spark, SF)
    assert df.inputFiles() and not [f for f in df.inputFiles() if "orders.parquet" in f]
    # files are dealt before their cells are printed, so a file's cells meet without being shuffled
    plan = seen[0].groupBy("source_file").count()._jdf.queryExecution().executedPlan().toString()
    assert seen[0].rdd.getNumPartitions() >= 32 and plan.count("Exchange") == 1
    rows = [(r.ReturnType, r.FY, r.MonthIndex) for r in df.collect()]
    assert len(rows) == 1525 and rows == sorted(rows)
