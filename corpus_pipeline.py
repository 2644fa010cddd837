"""A training-data pipeline over `documents`: five stages, each one operator of quillbook.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs, whatever else these are called. Null texts are rejected by the first
stage and pass the others; empty tables and very long texts pass all of them; what a stage does with ties and repeated rows
is in its docstring.

What the stages write stays until `quillbook.llm.common.release` is called, after the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm import decontamination, langid, neardup, packing, secrets
from quillbook.llm.common import cut, fresh, table

#: A text of so many letters whose best cosine is below this, five deviations of what unrelated texts have in 1024
#: dimensions, is in none of the languages. Shorter ones can't be told, and stay.
LEAST_SCORE, LEAST_LETTERS = 0.16, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or are long enough to tell and near no language's prototype. Learns from
    the labelled rows of docs; where there are none, all texts are undecided, and then no text is rejected for that.
    Repeated rows are judged alike."""
    names, prototypes = langid.learn(docs)
    if not names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("row")), names, prototypes, text="row.text")
    told = (F.col("score") >= LEAST_SCORE) | (langid.letters(F.col("row.text")) < LEAST_LETTERS)
    return found.where((F.col("lang_pred") != langid.UNDECIDED) & told).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each class; of rows equal in doc_id and text, one."""
    classes = neardup.near_duplicates(docs)
    alone = F.when(F.col("class_id").isNull(), F.col("node"))
    kept = classes.groupBy("class_id", alone.alias("alone")).agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("k")).select("k.id", "k.node")
    node, kept_id, kept_node = (fresh(docs, c) for c in ("node_", "kept_id_", "kept_node_"))
    kept = kept.toDF(kept_id, kept_node)
    out = docs.withColumn(node, neardup.text_key(F.col("text"), F.col("doc_id")))
    out = out.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node)), "left_semi")
    return out.dropDuplicates(["doc_id", node]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item; rows equal in doc_id and text are dropped together."""
    mark = fresh(docs, "mark_")
    marked = docs.withColumn(mark, F.md5(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.col("text"))))
    hits = decontamination.contaminated(marked, table(spark, sf_dir, "benchmark"), id_col=mark)
    hits = cut(hits.select(mark).distinct(), "hits")
    return marked.join(hits, mark, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every reported span, in every row of a text alike; n_chars, if there, follows. No row is dropped."""
    found = secrets.scan(docs.select("doc_id", "text"))
    mark = next(c for c in found.columns if c.startswith("text_md5_"))
    found = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", mark]).select("doc_id", mark, "spans")
    found_id, found_mark, spans = (fresh(docs, c) for c in ("found_id_", "found_mark_", "found_spans_"))
    found = found.toDF(found_id, found_mark, spans)
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col(found_id)) & (F.md5(F.coalesce("text", F.lit(""))) == F.col(found_mark)), "left")
    out = out.withColumn("text", F.when(F.col(spans).isNotNull(), secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), changed).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids and their place in sequences of 1024 tokens. Repeated rows are packed
    each; pieces of equal length are interchangeable."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate classes, language prototypes and token ids have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
