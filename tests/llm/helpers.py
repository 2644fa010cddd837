import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    same = " ".join(f"copy{i}" for i in range(80))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, long, "en", None), (4, same, "en", "a"), (5, same, "en", "b"), (5, same, "en", "b"), (None, same, None, None), (6, "   \n\t", "de", "b"), (7, "é " * 60 + "\x00\x1c<b>", "fr", "b"), (None, None, None, None), (8, "one two", "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("shard", "Slot", "id", "node", "score", "lang_pred", "Base", "spans", "length", "kept", "n_words", "row", "label", "found id", "kept id", "text_0", "node_", "kept_id_", "found_id_", "found_spans_"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def empty(spark):
    return odd(spark).limit(0)
