"""What the operators of this subpackage share: tables, lineage cuts, exact distributed ranks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. Where that is unset, a folder of the warehouse
    for a local master, as in tests; on a cluster an error, since its executors have no folder in common that we know of."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


#: What `cut` has written in the scratch blocks that are open, and all that is still there.
_open: list[list[str]] = []
_there: dict[str, None] = {}


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written within the block removes its shuffle files when it is done. Else they stay until the driver collects
    its garbage, so those of all an operator's steps would be on the disk at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs a reread at most.
    What is written stays until its scratch block ends, or until `release`, since results are read from it lazily."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with without_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _there[path] = None
    if _open:
        _open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what was cut within the block when it ends, but for the tables that were passed to the function it gives."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.cut_path)
        return df

    _open.append([])
    try:
        yield keep
    finally:
        mine = _open.pop()
        _remove(spark, [p for p in mine if p not in kept])
        if _open:
            _open[-1].extend(p for p in mine if p in kept)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _there.pop(p, None)


def kept_table(df: DataFrame, name: str, parts: int, key: str) -> DataFrame:
    """df as a table of the warehouse, bucketed by a column; `release` drops it."""
    spark, name = df.sparkSession, f"quillbook_{name}_{uuid.uuid4().hex}"
    with without_shuffles(spark):
        df.write.option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    _tables[name] = None
    return spark.table(name)


_tables: dict[str, None] = {}


def release(spark: SparkSession) -> None:
    """Removes all that the operators have written for results so far. Call it when those results are themselves written:
    DataFrames that were returned before can't be read any more."""
    _remove(spark, list(_there))
    for name in list(_tables):
        spark.sql(f"drop table if exists {name}")
        del _tables[name]


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to 8 MB and 2000 rows, so that a task holds little of the texts at once in
    the JVM and in Python. Smaller limits that are set stay. Spark reads the limits when a plan runs, which is after the
    operator returns, so they stay for the session."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)):
        now = int(re.sub(r"\D", "", conf.get(key)) or 0)
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are matched without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, group: list[str], order: list[Column], bucket: Column, name: str, monotone: bool = False) -> DataFrame:
    """Adds the exact 0-based rank (long) of each row within its group, without ever holding a group in one task.

    `bucket` (an integer) must not decrease along `order` within a group, so that ranks in buckets and the sums of the
    counts of earlier buckets add up to the rank. Only these counts, one row a group and bucket, meet by group. Nulls in
    `group` form a group. Rows equal in `order` get different ranks in some order.
    """
    b, before, n = (fresh(df, x) for x in ("bucket_", "before_", "n_"))
    keys = [*group, b]
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"{k}_of") for k in keys), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    here = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(here).cast("long") - 1)
    on = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    joined = out.join(offsets, on)
    return joined.withColumn(name, F.col(name) + F.col(before)).drop(before, b, *(f"{k}_of" for k in keys))


def crc32_of(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))
