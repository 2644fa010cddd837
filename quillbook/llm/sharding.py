"""Sharding by proportional stratified interleaving.

Rows are ranked in seeded-shuffled order within their source; rank r of n rows stands at (2r + 1) / 2n of the way through
that source. Sorted by this fractional rank, any stretch of the table holds the sources in the mixture of the whole, so
equal cuts give shards that match it. DataFrame operations only; no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm.common import crc32_of, fresh, ranked, table


def shuffled(seed: str, id_col: Column) -> Column:
    """32 hexadecimal digits that put rows in a seeded random order; null ids hash as the empty string."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def interleave(docs: DataFrame, n_shards: int, *, source: str = "source", id_col: str = "doc_id", seed: str = "mix-1") -> DataFrame:
    """Adds `shard` (int) and `slot` (long, gapless from 0 in each shard) to docs; every other column is passed on.

    Shard sizes in rows differ by one at most, and in each shard a source with n rows has n / n_shards rows to within
    two. Null sources are a source of their own. Rows with equal ids are ordered by all their other columns; rows equal in
    every column are interchangeable. An empty table gives an empty result. Columns of docs named shard or slot give way
    to the new ones.
    """
    docs = docs.drop("shard", "slot")
    h, within, size, at, n_all, g = (fresh(docs, x) for x in ("hash_", "within_", "size_", "at_", "all_", "global_"))
    rest = [F.col(c) for c in docs.columns if docs.schema[c].dataType.typeName() != "map"]
    tie = F.xxhash64(*rest)
    df = docs.withColumn(h, shuffled(seed, F.col(id_col)))
    df = ranked(df, [source], [F.col(h), F.col(id_col), tie], F.conv(F.substring(h, 1, 3), 16, 10).cast("int"), within)
    sizes = docs.groupBy(F.col(source).alias(f"{source}_of")).agg(F.count(F.lit(1)).alias(size))
    df = with_sizes(df, sizes, source, size, h)
    df = df.withColumn(at, (2 * F.col(within) + 1) / (2 * F.col(size)))
    order = [F.col(at), F.col(h), F.col(id_col), tie]
    # fractional ranks are spread evenly over (0, 1), so equal slices of it are equal buckets
    df = ranked(df.withColumn(f"{g}_group", F.lit(0)), [f"{g}_group"], order, F.floor(F.col(at) * 4096).cast("int"), g)
    total = docs.agg(F.count(F.lit(1)).alias(n_all))
    df = df.crossJoin(F.broadcast(total))  # one row
    lo = F.floor(F.col(g) * n_shards / F.col(n_all))
    # the division is in doubles: put right what rounding moved over a cut
    first = lambda s: F.ceil(F.expr(f"cast({n_all} as decimal(20,0))") * s / n_shards)
    shard = F.when(F.col(g) < first(lo), lo - 1).when(F.col(g) >= first(lo + 1), lo + 1).otherwise(lo)
    df = df.withColumn("shard", shard.cast("int"))
    df = df.withColumn("slot", (F.col(g) - first(F.col("shard"))).cast("long"))
    return df.select(*docs.columns, "shard", "slot")


def with_sizes(df: DataFrame, sizes: DataFrame, source: str, size: str, h: str, salts: int = 256) -> DataFrame:
    """Adds each source's row count. A source may hold a third of all rows, so its rows are dealt over `salts` parts."""
    s = fresh(df, "salt_")
    dealt = df.withColumn(s, F.pmod(F.xxhash64(F.col(h)), F.lit(salts)).cast("int"))
    copies = sizes.withColumn(f"{s}_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [F.col(source).eqNullSafe(F.col(f"{source}_of")), F.col(s) == F.col(f"{s}_of")]
    return dealt.join(copies, on).drop(s, f"{s}_of", f"{source}_of")


def op1_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), crc32_of(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    out = interleave(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same mixture in plain windows. crc32 isn't a function of DuckDB, so it is folded over the bytes.
OP1_SQL = """
with bytes as (
  select doc_id, source, text, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as x from documents),
tab as (select list(list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
crc as (
  select doc_id, source, n + 8 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, range(n)), lambda c, k: xor(c >> 8, t[xor(c & 255, ('0x' || x[2 * k + 1 : 2 * k + 2])::bigint) + 1])), 4294967295) as text_crc32
  from bytes, tab),
w as (select *, md5('mix-1:' || coalesce(doc_id::varchar, '')) as h from crc),
r as (select *, (2 * (row_number() over (partition by source order by h, doc_id) - 1) + 1)::double / (2 * count(*) over (partition by source)) as part from w),
g as (select *, row_number() over (order by part, h, doc_id) - 1 as g, count(*) over () as total from r),
s as (select *, g * 24 // total as shard from g)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, shard::int as shard,
  (row_number() over (partition by shard order by g) - 1)::bigint as slot, null::int as grown_shard
from s
"""
