"""A folder of tables that change together: data is staged where no reader looks, and one small file publishes it.

The log of a store is a folder of numbered entries, each a JSON list of which folders make up which table. An entry is made
under a number that isn't taken, so of two writers that start from the same state one is refused. Readers use the highest
entry that is whole; one that a crash cut short is passed over. Data is never changed in place, so readers of an older entry
aren't disturbed until `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, by spark.checkpoint.dir; a local master may do with the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


class Conflict(Exception):
    """Another writer published first."""


class Store:
    """Tables under a root folder, of one version of their layout; entries of other versions count as absent."""

    def __init__(self, spark: SparkSession, root: str, version: int = 1):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, log = self._path(f"{self.root}/log")
        if not fs.exists(log):
            return []
        return sorted((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(log) if f.getPath().getName().endswith(".json")), reverse=True)

    def _entry(self, number: int) -> dict | None:
        fs, p = self._path(f"{self.root}/log/{number:020d}.json")
        stream = fs.open(p)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            entry = json.loads(raw)
        except ValueError:
            return None
        return entry if isinstance(entry, dict) and entry.get("version") == self.version else None

    def current(self) -> dict[str, dict[str, str]]:
        """table: {part: folder} of the last entry that is whole; nothing if there is none."""
        return next((e["tables"] for n in self._numbers() if (e := self._entry(n))), {})

    def stage(self) -> str:
        """A new folder for the data of one run."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def publish(self, tables: dict[str, dict[str, str]], seen: int | None = None) -> int:
        """Makes these tables the current ones. seen: the entry that the caller started from, if no other may have come since."""
        number = next(iter(self._numbers()), -1) + 1
        if seen is not None and seen != number - 1:
            raise Conflict(f"entry {number - 1} was published after entry {seen}")
        fs, p = self._path(f"{self.root}/log/{number:020d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"entry {number} is taken") from e
        try:
            out.write(bytearray(json.dumps({"version": self.version, "tables": tables}), "utf-8"))
        finally:
            out.close()
        return number

    def last(self) -> int:
        return next(iter(self._numbers()), -1)

    def there(self, folder: str) -> bool:
        fs, p = self._path(folder)
        return fs.exists(p)

    def read(self, table: str, schema: StructType) -> DataFrame:
        """The table's rows; a part that is missing or can't be read counts as empty, and so does a table that isn't there."""
        parts = [p for p in self.current().get(table, {}).values() if self.there(p)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(*parts)

    def vacuum(self, keep: int = 2) -> None:
        """Removes the entries before the last `keep` whole ones, and all data that those left don't name. Not while a run is
        staged."""
        whole = [n for n in self._numbers() if self._entry(n)][:keep]
        named = {f.split("/data/")[1].split("/")[0] for n in whole for parts in self._entry(n)["tables"].values() for f in parts.values()}
        for n in self._numbers():
            if n not in whole:
                fs, p = self._path(f"{self.root}/log/{n:020d}.json")
                fs.delete(p, False)
        fs, data = self._path(f"{self.root}/data")
        for f in fs.listStatus(data) if fs.exists(data) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)


def new_store(spark: SparkSession, name: str) -> Store:
    """A store of its own in the shared folder."""
    return Store(spark, f"{shared_dir(spark)}/stores/{name}-{uuid.uuid4().hex}")


def staged(spark: SparkSession, name: str) -> Callable[..., DataFrame]:
    """A function that writes a frame to a folder of its own store and reads it back, for plans that many tables share. The
    folder stays."""
    return _keeper(spark, new_store(spark, name).stage())


def _keeper(spark: SparkSession, folder: str) -> Callable[..., DataFrame]:
    def keep(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = f"{folder}/kept/{name}"
        # folders are named by copies of the columns: as names, an empty string and null would be one
        out = df.withColumns({f"by_{c}": F.col(c) for c in by or []})
        (out.write.partitionBy(*[f"by_{c}" for c in by]) if by else out.write).parquet(path)
        return spark.read.schema(df.schema).parquet(path).select(*df.columns)

    return keep


def publish_run(store: Store, build: Callable[[Callable[..., DataFrame]], dict[str, DataFrame]]) -> int:
    """Writes all tables that build gives and publishes them as one run; the number of its entry.

    build gets a function that writes a frame to the run's folder and reads it back, for what many tables are made of. If
    anything fails, nothing is published, and readers stay with the run before.
    """
    folder, seen = store.stage(), store.last()
    tables = {}
    for name, df in build(_keeper(store.spark, folder)).items():
        path = f"{folder}/{name}"
        df.write.parquet(path)
        tables[name] = {"all": path}
    return store.publish(tables, seen)
