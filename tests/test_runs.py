"""Markers in one scan, top two, line starts, the store, the cache, handlers and settings."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillbook.operators import geometry as G
from quillbook.operators import ledger as L
from quillbook.operators import markers as M
from quillbook.parsers import gst
from quillbook.plans import settings as S
from quillbook.plans.registry import Handler, Registry
from quillbook.rules import gst as RG
from quillbook.sources.cache import TABLE, read_through
from quillbook.sources.store import Conflict, Store, publish_run

MARKERS = ["A", "AB", "ABC", "BCA", "CAB", "B C", "(X).*", "GSTR-1", "GSTR1", "GSTR-3B", "é", "A\nB"]


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*MARKERS, "A", "B", "C", " ", "X", "G", "GSTR", "-", "3"]), max_size=12).map("".join), min_size=1, max_size=20))
def test_one_scan_finds_what_contains_finds(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", M.scan(F.col("t"), MARKERS).alias("m")).collect():
        assert sorted(r.m) == sorted(m for m in MARKERS if m in r.t)


def test_markers_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("AB" * 200_000,)], "t string")
    got = [r.m if r.m is None else sorted(r.m) for r in df.select(M.scan(F.col("t"), MARKERS).alias("m")).collect()]
    assert got == [None, [], ["A", "AB"]]
    with pytest.raises(ValueError):
        M.scan(F.col("t"), ["", "x"])
    row = spark.createDataFrame([(["B", "A"],)], "f array<string>").select(M.held(F.col("f"), ["A", "C", "B"]).alias("h"), M.weight(F.col("f"), {"A": 3, "C": 5}).alias("w"), M.any_held(F.col("f"), ["C"]).alias("a")).first()
    assert (row.h, row.w, row.a) == (["A", "B"], 3, False)


def test_top_two_has_no_window_and_takes_nulls_ties_and_one_group(spark):
    rows = [("x", 5.0, "b"), ("x", 5.0, "a"), ("x", 1.0, "c"), (None, None, "n"), (None, 2.0, "m"), (None, None, "o"), ("y", 1.0, "only")]
    df = spark.createDataFrame(rows, "k string, amount double, file string")
    got = {(r.k, r.file): r.Party for r in L.party_rank(df, ["k"], "amount", ["file"]).collect()}
    assert got == {("x", "a"): "Employer", ("x", "b"): "Employee", ("x", "c"): "Other", (None, "m"): "Employer", (None, "n"): "Employee", (None, "o"): "Other", ("y", "only"): "Employer"}
    plan = L.party_rank(df, ["k"], "amount", ["file"])._jdf.queryExecution().toString()
    assert "Window" not in plan
    same = spark.createDataFrame([("x", 1.0, "a")] * 3, "k string, amount double, file string")
    assert {r.Party for r in L.party_rank(same, ["k"], "amount", ["file"]).collect()} == {"Employer"}
    assert L.party_rank(df.limit(0), ["k"], "amount", ["file"]).collect() == []


def starts_one_by_one(tops, tolerance):
    out, anchor = [], None
    for i, t in enumerate(tops):
        if anchor is None or abs(t - anchor) > tolerance:
            out.append(i)
            anchor = t
    return out


def test_line_starts_are_those_found_word_by_word(spark):
    rnd = random.Random(2)
    pages = [sorted((round(rnd.uniform(0, n / rnd.choice([1, 5, 20])), 3) for _ in range(n)), key=lambda t: round(t, 1)) for n in [0, 1, 2, 3, 7, 8, 9, 64, 65, 300] * 3]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, tops array<double>")
    for r in df.select("i", G.line_starts(F.col("tops"), 2.5).alias("s")).collect():
        assert sorted(r.s) == r.s == starts_one_by_one(pages[r.i], 2.5)


def test_a_page_of_100_000_words(spark):
    import time

    n = 100_000
    words = spark.range(n).select(F.lit("a").alias("source_file"), F.lit(1).alias("page_no"), F.col("id").cast("string").alias("text"), (F.col("id") % 4).cast("double").alias("x0"), F.lit(1.0).alias("x1"), F.floor(F.col("id") / 4).cast("double").alias("top"), F.lit(1.0).alias("bottom"))
    began = time.time()
    got = G.cluster_lines(words, ["source_file", "page_no"]).agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("w")).first()
    assert (got.n, got.w) == ((n // 4 + 2) // 3, n)
    assert time.time() - began < 60


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, length long, modificationTime timestamp, body string")


def files(spark, *rows):
    import datetime

    return rows_of(spark, *[(p, n, datetime.datetime(2025, 1, d), b) for p, n, d, b in rows])


def test_cache_reads_only_what_is_new_changed_or_lost(spark, tmp_path):
    store, calls = Store(spark, f"file://{tmp_path}/store"), spark.sparkContext.accumulator(0)

    def extract(fs):
        def run(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return fs.mapInArrow(run, fs.schema).withColumn("body", F.upper("body"))

    def result(fs):
        before = calls.value
        got = sorted((r.path, r.body) for r in read_through(fs, extract, store, parts=4).collect())
        return got, calls.value - before

    a = files(spark, ("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "z"))
    want = [("a", "X"), ("b", "Y"), ("c", "Z")]
    assert result(a) == (want, 3)
    assert result(a) == (want, 0)
    b = files(spark, ("a", 1, 1, "not read"), ("b", 2, 1, "yy"), ("c", 1, 2, "zz"), ("d", 1, 1, "new"))
    assert result(b) == ([("a", "X"), ("b", "YY"), ("c", "ZZ"), ("d", "NEW")], 3)
    assert result(files(spark, ("a", 1, 1, "x"))) == ([("a", "X")], 0)
    for part in store.current()[TABLE].values():  # every part is cut short or gone
        fs, p = store._path(part)
        for f in fs.listStatus(p):
            if f.getPath().getName().startswith("part"):
                out = fs.create(f.getPath(), True)
                out.write(bytearray(b"no parquet"))
                out.close()
    got, n = result(b)
    assert n == 4 and [p for p, _ in got] == ["a", "b", "c", "d"]
    assert result(b)[1] == 0
    assert result(a.limit(0)) == ([], 0)
    other = Store(spark, f"file://{tmp_path}/store", version=2)
    assert other.current() == {}


def test_runs_are_published_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/runs")
    df = lambda x: spark.createDataFrame([(x, ""), (x, None)], "n int, year string")
    read = lambda t: sorted(r.n for r in store.read(t, df(0).schema).collect())
    assert read("one") == []
    publish_run(store, lambda keep: {"one": keep(df(1), "kept", ["year"]), "two": df(1)})
    assert sorted(str(r.year) for r in store.read("one", df(0).schema).collect()) == ["", "None"]

    def fails(keep):
        return {"one": keep(df(2), "kept"), "two": df(2).withColumn("n", F.raise_error(F.lit("full")).cast("int"))}

    with pytest.raises(Exception, match="full"):
        publish_run(store, fails)
    assert (read("one"), read("two")) == ([1, 1], [1, 1])
    seen = store.last()
    publish_run(store, lambda keep: {"one": df(3), "two": df(3)})
    assert (read("one"), read("two")) == ([3, 3], [3, 3])
    with pytest.raises(Conflict):
        store.publish({}, seen)
    fs, p = store._path(f"{store.root}/log/{store.last() + 1:020d}.json")  # a crash in the middle of the pointer
    out = fs.create(p, False)
    out.write(bytearray(b'{"version": 1, "tab'))
    out.close()
    assert read("two") == [3, 3]
    publish_run(store, lambda keep: {"one": df(4)})
    store.vacuum(keep=1)
    assert read("one") == [4, 4] and len(store._numbers()) == 1


def memo(name="MEMO", **more):
    return Handler(name, lambda t: F.when(t.contains(name), 100).otherwise(0), lambda text: {"PrimaryAmount": F.char_length(text).cast("double")}, **more)


def test_handlers_come_and_go(spark):
    docs = spark.createDataFrame([("a", "a memo"), ("b", "memo and note"), ("c", "nothing"), ("d", None), ("e", "note")], "source_file string, text string")
    registry = Registry([memo(checks=lambda v: [(v["PrimaryAmount"] < 100, "SHORT?")])])
    rows, errors = registry.plan(docs)
    assert sorted((r.SourceFile, r.PrimaryAmount, r.Flags, r.Status) for r in rows.collect()) == [("a", 6.0, "SHORT?", "Review"), ("b", 13.0, "SHORT?", "Review")]
    assert sorted((r.File, r.Error_Type) for r in errors.collect()) == [("c", "UnknownType"), ("d", "UnknownType"), ("e", "UnknownType")]
    registry.register(memo("NOTE"))
    rows, errors = registry.plan(docs)
    assert sorted((r.ReturnType, r.SourceFile, r.Status) for r in rows.collect()) == [("MEMO", "a", "Review"), ("NOTE", "e", "OK")]
    assert ("b", "AmbiguousType") in {(r.File, r.Error_Type) for r in errors.collect()}
    with pytest.raises(ValueError):
        registry.register(memo())
    registry.unregister("MEMO")
    assert registry.names() == ["NOTE"]
    with pytest.raises(ValueError):
        registry.unregister("MEMO")


def test_a_handler_that_fails_takes_only_its_own_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a", "memo"), ("b", "bad"), ("c", "odd"), ("d", "x")], "source_file string, text string")
    bad = Handler("BAD", lambda t: F.when(t.contains("BAD"), 90).otherwise(0), lambda text: {"PrimaryAmount": F.raise_error(F.lit("boom")).cast("double")})
    odd = Handler("ODD", lambda t: F.when(t.contains("ODD"), 90).otherwise(0), lambda text: {"Colour": text}, row=lambda v: v)

    def keep(folder):
        def write(df, name):
            df.write.parquet(f"file://{tmp_path}/{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"file://{tmp_path}/{folder}/{name}")

        return write

    rows, errors = Registry([memo(), bad, odd]).materialised(docs, keep("a"))
    assert [r.SourceFile for r in rows.collect()] == ["a"]
    said = {r.File: (r.Error_Type, r.Message) for r in errors.collect()}
    assert said["b"][0] == said["c"][0] == "ParserError" and said["d"][0] == "UnknownType"
    assert "boom" in said["b"][1] and "Colour" in said["c"][1]
    rows, errors = Registry([bad]).materialised(docs, keep("b"))
    assert rows.collect() == [] and {r.File: r.Error_Type for r in errors.collect()}["b"] == "ParserError"
    rows, errors = Registry().materialised(docs, keep("c"))
    assert rows.collect() == [] and len(errors.collect()) == 4


def config(spark, *rows):
    return spark.createDataFrame(list(rows), "Setting string, Value string")


def test_settings(spark):
    s = S.settings(config(spark, ("variance_tolerance", " 2.5 "), ("checks_enabled", "ITC_Math"), ("checks_enabled", "Record_Count"), ("", "x"), (None, None)))
    assert (s.tolerances.gst, s.tolerances.hsn_percent, s.enabled) == (2.5, 10.0, {"ITC_Math", "Record_Count"})
    assert S.settings(config(spark, ("hsn_supply_variance_pct", "5"))).enabled is None
    assert S.settings(config(spark, ("checks_enabled", ""))).enabled == frozenset()
    with pytest.raises(ValueError, match="unknown check Nope; unknown setting colour; variance_tolerance is no number: x"):
        S.settings(config(spark, ("checks_enabled", "Nope"), ("colour", "red"), ("variance_tolerance", "x")))
    with pytest.raises(ValueError, match="several"):
        S.settings(config(spark, ("variance_tolerance", "1"), ("variance_tolerance", "2")))


def test_checks_that_are_off_are_not_in_the_plan(spark):
    totals = spark.createDataFrame([("a", "5", 100.0, 1.0, 1.0, 0.0, 0.0, 2), ("a", "TOTAL_LIABILITY", 90.0, 1.0, 1.0, 0.0, 0.0, 0)], "SourceFile string, Section_Code string, " + ", ".join(f"{h} double" for h in RG.HEADS) + ", Num_Records int")
    everything = {r.Check for r in gst.gstr1_checks(totals).collect()}
    assert {"B2CL_Threshold", "Interstate_Tax_5"} <= everything
    one = gst.gstr1_checks(totals, enabled=frozenset({"B2CL_Threshold"}))
    assert {r.Check for r in one.collect()} == {"B2CL_Threshold"}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "CGST" not in plan.split("Aggregate", 1)[1].split("LogicalRDD")[0] and "12_HSN" not in plan
    assert gst.gstr1_checks(totals, enabled=frozenset()).collect() == []
