import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from quillbook.llm import langid, secrets
from tests.llm.helpers import SF, documents, empty, odd
from tests.llm.test_duplicates import brute_classes
from tests.llm.test_quality_secrets import base_spans
from tests.llm.test_sharding_packing import packed_ok


def test_pipeline_against_stage_by_stage_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    names, p = langid.learn(documents(spark))
    told = lambda r: sum(c.isalpha() for c in r.text) < corpus_pipeline.LEAST_LETTERS or r.score >= corpus_pipeline.LEAST_SCORE
    und = {r.doc_id for r in langid.identify(documents(spark), names, p).collect() if r.lang_pred == "und" or not told(r)}
    docs = [(i, t) for i, t in docs if i not in und]
    classes = brute_classes(docs)
    docs = [(i, t) for i, t in docs if classes[i] == i]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = [(i, t) for i, t in docs if not any(b.text in t for b in bench)]
    clean = []
    for i, t in docs:
        for s in reversed([tuple(map(int, x.split(":")[1:])) for x in base_spans(t).split(",") if x]):
            t = t if "[SECRET]" in t[s[0] : s[1] + 8] else t[: s[0]] + "[SECRET]" + t[s[1] :]
        clean.append((i, t))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {i for i, _ in clean}
    packed_ok(got, clean)


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    for make in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, make(spark), SF)
            rows = out.collect()
            if name != "best_fit_packing":
                assert out.columns == make(spark).columns, name
            if name == "near_dedup" and make is odd:
                assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "6", "7", "8", "None"]


def test_foreign_texts_go_and_short_ones_stay(spark):
    greek = " ".join("θάλασσα και δρόμος προς την πόλη" for _ in range(10))
    rows = [(9001, greek, None), (9002, "No", None), (9003, "Gracias", None), (9004, "12", None)]
    docs = documents(spark).select("doc_id", "text", "lang")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")), SF).collect()}
    assert {9002, 9003} <= kept and not {9001, 9004} & kept


def test_clean_documents_stay(spark):
    prose = spark.createDataFrame([(i, f"the quick brown fox number {i} ran over hill {i * 7} and met {i * 13} friends of its own at place {i * 31}", "en") for i in range(30)], "doc_id long, text string, lang string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, prose, SF).count() == 30, name


def test_pipeline_returns_the_token_ids(spark):
    docs = documents(spark).limit(20)
    rows = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(len(r.ids) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32 for r in rows)


def test_columns_of_callers_stay_as_they_are(spark):
    names = ["found id", "kept id", "found mark", "text 0", "text_0", "kept_id_", "found_id_", "found_spans_"]
    docs = spark.createDataFrame([(1, "password: hunter2hunter2 and " + "more words " * 30, "en"), (2, "plain words", "en")], "doc_id long, text string, lang string")
    for n in names:
        docs = docs.withColumn(n, F.lit("mine"))
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.secret_scan):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[n] == "mine" for r in out.collect() for n in names)
    found = secrets.scan(docs)
    assert all(r[n] == "mine" for r in found.collect() for n in names)
