"""An extension: new page files are classified as they come, and rejected ones kept apart. The checkpoint is the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quillbook.plans.pipelines import STATUTORY_GATES, classified, errors
from quillbook.sources.layout import PAGES


def start(spark: SparkSession, pages_dir: str, checkpoint: str, publish: Callable[[DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """publish(accepted, errors, batch) for each batch of page rows; a document's pages must come in one file."""
    stream = spark.readStream.schema(PAGES).parquet(pages_dir)

    def each(batch: DataFrame, n: int) -> None:
        docs = classified(batch.drop("ocr_text"))
        publish(docs.where("reject_reason is null"), errors(docs, STATUTORY_GATES), n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
