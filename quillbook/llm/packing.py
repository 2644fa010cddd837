"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Lengths are at most the capacity, so all that best-fit decreasing depends on is how many pieces there are of each length:
a histogram of `capacity` numbers, which the driver packs exactly. A segment tree over remaining capacities holds the open
bins and yields the tightest one that fits in logarithmic time; equal pieces that go to equal bins go there in one step, as
ranges of ranks and bins. The pieces, which stay on the executors, get their rank within their length and look up its range.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm.common import cut, in_small_batches, ranked, table

#: With so many ranges (40 bytes each, 4 MB) the table of ranges is still broadcast; beyond it the join is shuffled. The
#: result is the same.
BROADCAST_RANGES = 100_000


class BinTree:
    """Open bins by remaining capacity. Leaf c holds ranges [lo, hi) of the numbers of the bins with c tokens left."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)  # of ranges below each node
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, left: int, lo: int, hi: int) -> None:
        self.ranges[left].append((lo, hi))
        self._bump(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self._bump(left, -1)
        return self.ranges[left].pop()

    def _bump(self, leaf: int, by: int) -> None:
        node = leaf + self.width
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` that an open bin has."""
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:  # up until there is a filled right sibling, then down its leftmost filled path
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node + (not self.count[2 * node])
                return node - self.width
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end rank, first bin, offset) for each run of equal pieces in equal bins; the number of bins.

    The piece of that length with rank r lies in bin (first bin + r - first rank) at that offset.
    """
    tree, out, bins = BinTree(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            left = tree.tightest(length)
            if left is None:
                # no open bin fits: open enough for all that remain of this length, each filled with as many as fit
                per = capacity // length
                full, rest = divmod(end - rank, per)
                for k in range(per):
                    if full:
                        out.append((length, rank + k * full, rank + (k + 1) * full, bins, k * length))
                rank += per * full
                if full and capacity - per * length:
                    tree.add(capacity - per * length, bins, bins + full)
                bins += full
                for k in range(rest):
                    out.append((length, rank + k, rank + k + 1, bins, k * length))
                if rest:
                    rank += rest
                    if capacity - rest * length:
                        tree.add(capacity - rest * length, bins, bins + 1)
                    bins += 1
                continue
            lo, hi = tree.pop(left)
            if hi - lo > end - rank:
                tree.add(left, lo + end - rank, hi)
                hi = lo + end - rank
            out.append((length, rank, rank + hi - lo, lo, capacity - left))
            rank += hi - lo
            if left > length:
                tree.add(left - length, lo, hi)
    return out, bins


@lru_cache(maxsize=2)
def tokenizer(json_path: str, ranks_path: str):
    """text -> uint32 ids, those of the JSON file's tokenizer. The ranks file is the same vocabulary in a form that is encoded
    five times faster, with the same ids (tests compare them on random Unicode); texts with the string of a special token
    are left to the JSON file's tokenizer, which gives it that token's id."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


def pieces(docs: DataFrame, capacity: int, end_id: int, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and `ids` (array<int>) on request.

    A document is its ids and end_id. One of more than `capacity` ids is cut into pieces of exactly `capacity`, except the
    first, which has what remains. A null text is an empty one: one piece, end_id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(json_path, ranks_path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                start, k, doc = 0, 0, doc.as_py()
                while start < len(ids):
                    part = ids[start : start + (capacity if k else first)]
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), part.astype("i4") if with_ids else None))
                    start, k = start + len(part), k + 1
            columns = list(zip(*out, strict=True)) or [[]] * 6
            arrays = [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), *(pa.array(columns[i], pa.int64()) for i in (2, 3, 4))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(columns[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset (long, gapless from 0 in each sequence) to rows of 1 to `capacity` tokens, packed by
    best-fit decreasing over the whole table. Rows of equal length are interchangeable to the packing and are ranked in
    hashed order. An empty table gives an empty result. items is read three times: give a written table.
    """
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # at most `capacity` rows
    runs, _ = best_fit_decreasing(counts, capacity)
    h = F.xxhash64(*[c for c in items.columns if items.schema[c].dataType.typeName() not in ("map", "array")])
    # whole sequences are the most frequent length by far, so their ranks are found in more buckets
    bucket = F.shiftrightunsigned(h, 52).cast("int")
    bucket = F.when(F.col(length) == capacity, bucket).otherwise(F.shiftright(bucket, 4))
    # the hash is unsigned in the bucket, so it is ordered as unsigned as well
    out = ranked(items, [length], [F.shiftrightunsigned(h, 1), h], bucket, "rank_")
    ranges = spark.createDataFrame(runs, "length_of long, lo_ long, hi_ long, bin_ long, offset long")
    if len(runs) <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    out = out.join(ranges, (F.col(length) == F.col("length_of")) & (F.col("rank_") >= F.col("lo_")) & (F.col("rank_") < F.col("hi_")))
    return out.withColumn("sequence_id", F.col("bin_") + F.col("rank_") - F.col("lo_")).select(*items.columns, "sequence_id", "offset")


def packed(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """The pieces of all docs (doc_id, text) with their place in sequences of 1024 tokens, and their ids on request.

    A null or empty text is one piece, its end alone; long texts are cut, never shortened; repeated rows are packed each; an
    empty table gives an empty result. Pieces of equal length are interchangeable. Other columns of docs are left out.
    """
    import public_tokenizers

    cut_up = pieces(docs, 1024, 2, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=with_ids)
    return pack(cut(cut_up, "pieces"), 1024)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
