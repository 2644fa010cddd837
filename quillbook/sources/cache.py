"""Reading through a store of what was extracted before: only new and changed files are extracted again.

A row of the store is a file: its key (path, length, modificationTime) and what was extracted from it. Rows lie in parts by a
hash of the path. An upsert rewrites the parts that it touches and publishes all of them in one entry of the store's log.
Whether a file is known is told by its row, so what a lost or damaged part held is extracted again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillbook.sources.store import Store

KEYS = ["path", "length", "modificationTime"]
TABLE = "extracted"
#: Parts of a store. A part is what an upsert rewrites: so many that one has some 100 MB.
PARTS = 16


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")


def unread(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that known doesn't have as they are now."""
    return files.join(known.select(*KEYS).distinct(), KEYS, "left_anti")


def read_through(files: DataFrame, extract: Callable[[DataFrame], DataFrame], store: Store, parts: int = PARTS) -> DataFrame:
    """One row for each of files: its key and what extract makes of it, from the store where the store has it.

    files has the key columns and whatever extract reads; paths are unique. extract gives one row a file, with the key
    columns. Nothing of a known file but its key is read. Rows of files that are gone stay in the store and aren't returned.
    """
    schema: StructType = extract(files.limit(0)).schema
    seen = store.last()
    new = unread(files.select(*KEYS), store.read(TABLE, schema).select(*KEYS))
    folder = store.stage()
    new.write.parquet(f"{folder}/keys")
    new = store.spark.read.schema(new.schema).parquet(f"{folder}/keys")
    if not new.isEmpty():
        _upsert(store, extract(files.join(new, KEYS, "left_semi")), schema, parts, folder, seen)
    return store.read(TABLE, schema).join(files.select(*KEYS), KEYS, "left_semi")


def _upsert(store: Store, rows: DataFrame, schema: StructType, parts: int, folder: str, seen: int) -> None:
    """Puts rows in the place of those of the same path."""
    rows.write.parquet(f"{folder}/rows")
    rows = store.spark.read.schema(schema).parquet(f"{folder}/rows")
    touched = sorted(r.part for r in rows.select(_part(parts).alias("part")).distinct().collect())  # no more than parts
    before = store.current().get(TABLE, {})
    kept = store.read(TABLE, schema).where(_part(parts).isin(touched)).join(rows.select("path"), "path", "left_anti") if before else None
    rows = rows if kept is None else kept.select(*schema.names).unionByName(rows)
    # a part goes to as many tasks as its size asks for, and small ones share a task
    rows.withColumn("part_", _part(parts)).hint("rebalance", "part_").write.partitionBy("part_").parquet(f"{folder}/parts")
    now = {str(p): f"{folder}/parts/part_={p}" for p in touched}
    store.publish({TABLE: {p: f for p, f in before.items() if p not in now} | now}, seen)
