"""Duplicate word windows by relative Lempel-Ziv parsing.

The segments of texts that can share a window meet in shards (see repeats). A shard's segments, put in a row, are its
reference block, indexed by an array of all its suffixes with the number of words that neighbours share. Each segment is
parsed against the block greedily: the next factor is the longest stretch that also starts elsewhere in the block, or a
single word if none does, and the one after it begins where it ends. Factors of at least WINDOW words are duplicate spans;
windows that lie over a boundary between factors are looked up in the index by themselves.

A stretch of WINDOW words whose anchor occurs nowhere else can't be a factor that counts in any block, so it is parsed
against none; one whose anchor does is parsed against the block that holds every other stretch with that anchor. Together
that is the parse of each document against all blocks, as far as factors of WINDOW words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm.common import cut, table
from quillbook.llm.neardup import text_key
from quillbook.llm.repeats import Units, by_windows, covered, distinct_texts, shared_windows, starts_in
from quillbook.llm.shingles import window_hashes, word_hashes

WINDOW = 35


class Block:
    """Segments in a row as a reference block, with the index that a parse asks."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.sizes, self.begin = sizes, np.cumsum(sizes) - sizes
        n, longest = len(words), int(sizes.max(initial=1))
        left = np.repeat(self.begin + sizes, sizes) - np.arange(n)  # words to the segment's end
        # names[k]: a number for the 2**k words from each place, unlike all others where the segment ends before
        names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while (h := 1 << (len(names) - 1)) < longest:
            last = names[-1]
            after = np.where(left > h, last[np.minimum(np.arange(n) + h, n - 1)], -1 - np.arange(n))
            names.append(np.unique(last * (2 * n + 1) + after + n, return_inverse=True)[1].astype(np.int64))
        self.order = np.argsort(names[-1], kind="stable")  # suffixes that share words are neighbours
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        shared = np.zeros(len(a), dtype=np.int64)
        live = np.ones(len(a), dtype=bool)
        for k in range(len(names) - 1, -1, -1):
            same = live & (names[k][np.minimum(a, n - 1)] == names[k][np.minimum(b, n - 1)])
            step = np.where(same, np.minimum(1 << k, np.minimum(left[np.minimum(a, n - 1)], left[np.minimum(b, n - 1)])), 0)
            shared, a, b = shared + step, a + step, b + step
            live &= (shared < left[self.order[:-1]]) & (shared < left[self.order[1:]])
        one = np.concatenate(([0], shared))
        other = np.concatenate((shared, [0]))
        self.longest, self.source = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.longest[self.order] = np.maximum(one, other)
        self.source[self.order] = np.where(one >= other, np.concatenate(([-1], self.order[:-1])), np.concatenate((self.order[1:], [-1])))

    def match(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest stretch from each place that also starts elsewhere in the block, and where."""
        return self.longest[place], self.source[place]


def parse(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of all segments: start, length and source, as places in the block. Those of a segment follow each
    other without gaps; one without a match is a single word with source -1."""
    at, end = block.begin.copy(), block.begin + block.sizes
    out = []
    open_ = np.flatnonzero(at < end)
    while len(open_):  # the next factor of every segment
        length, source = block.match(at[open_])
        source = np.where(length > 0, source, -1)
        length = np.maximum(length, 1)
        out.append((at[open_], length, source))
        at[open_] += length
        open_ = open_[at[open_] < end[open_]]
    start, length, source = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3
    order = np.argsort(start)
    return start[order], length[order], source[order]


def elsewhere(words: np.ndarray, sizes: np.ndarray, low: np.ndarray, route: np.ndarray) -> np.ndarray:
    """1 for each window of each segment that also starts elsewhere in the block: it lies within a factor, or over a boundary
    of factors and the index has it. Else 0."""
    block = Block(words, sizes)
    start, length, _ = parse(block)
    wins = sizes - WINDOW + 1
    places = np.repeat(block.begin, wins) + np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    factor = np.searchsorted(start, places, side="right") - 1
    within = places + WINDOW <= start[factor] + length[factor]
    found = within.copy()
    over = np.flatnonzero(~within)
    found[over] = block.match(places[over])[0] >= WINDOW
    return found.astype(np.int64)


def without_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, kept (the words that stay, joined by one space) and spans (the removed
    runs of words, from and to).

    A word goes if a window of WINDOW words that covers it also starts anywhere else, in its own document too. A null, empty
    or blank text has no words, and an empty table gives an empty result; texts are read whole, however long. Rows of one
    text repeat all of each other's windows. Ids may be of any type, null or repeated: they are only passed on. Other
    columns of docs, whatever their names, are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = distinct_texts(docs.select("id", F.coalesce("text", F.lit("")).alias("text")), "id", "text")
    units = Units(WINDOW, 6, "<u8", word_hashes, lambda w: window_hashes(w, 6), lambda w: window_hashes(w, WINDOW), within=True)
    found = shared_windows(texts.withColumn("least", F.lit(0).cast("long")), units, elsewhere, np.maximum, lambda there, ids, times: (there > 0) | (times > 1))

    span = "array<struct<from:bigint,to:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, blobs in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                a, b = covered(starts_in(blobs), WINDOW)
                sizes.append(len(words))
                kept.append(b" ".join(w for x, y in zip([0, *b.tolist()], [*a.tolist(), len(words)], strict=True) for w in words[x:y]).decode())
                spans.append([{"from": x, "to": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            yield pa.record_batch([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], names=["node", "least", "n_words", "kept", "spans"])

    spaced = F.translate("text", "\t\n\x0b\x0c\r", " " * 5)
    spaced = F.trim(F.when(F.instr(spaced, "  ") > 0, F.regexp_replace(spaced, "  +", " ")).otherwise(spaced))
    n_words = F.when(F.col("kept") == "", 0).otherwise(F.char_length("kept") - F.char_length(F.replace(F.col("kept"), F.lit(" "))) + 1).cast("long")
    none = F.expr(f"cast(array() as {span})")
    # a text of one row is that row; copies are found by their text, in a join that can split a large group
    cut_up, whole = by_windows(texts.where("n = 1"), found)
    alone = cut_up.select("node", "least", "text", "blobs").mapInArrow(run, f"node binary, least {kind}, n_words long, kept string, spans {span}").select("least", "n_words", "kept", "spans")
    alone = alone.unionAll(whole.select("least", spaced.alias("kept")).select("least", n_words, "kept", none))
    several = texts.where("n > 1").select("node", spaced.alias("kept")).select("node", n_words.alias("n_words"), "kept")
    # each window of such a text is in its other rows
    gone = F.col("n_words") >= WINDOW
    several = cut(several.select("node", "n_words", F.when(gone, "").otherwise(F.col("kept")).alias("kept"), F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to")))).otherwise(none).alias("spans")), "copies")
    rows = docs.select(F.col("id").alias("row id"), text_key(F.coalesce("text", F.lit("")), F.col("id")).alias("node"))
    copies = rows.join(several, "node").select(F.col("row id"), "n_words", "kept", "spans")
    return alone.unionAll(copies).toDF(id_col, "n_words", "kept", "spans")


def op10_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_words(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 34], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from win) where c > 1),
word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
near as (select word.*, max(a.i) over (partition by word.doc_id order by p) as last from word left join again a on a.doc_id = word.doc_id and a.i = p),
kept as (select doc_id, string_agg(word, ' ' order by p) as k, count(*) as n from near where last is null or p - last >= 35 group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256 from d left join kept using (doc_id)
"""
