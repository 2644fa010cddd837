"""Near-duplicate classes: DartMinHash signatures of weighted shingle sets, banded; candidates are checked exactly.

A shingle that a text has c times weighs 1 + ln c, so the similarity of two texts, the weighted Jaccard similarity, is that of
their sets unless shingles repeat. DartMinHash throws darts at the region of each element: weight along one side, rank along
the other, in unit cells that hold a Poisson number of darts made from the cell's hash alone. Darts beyond the element's
weight or the rank bound miss. Each dart falls to one of K coordinates, and the one of least rank is that coordinate's
value. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity; the rank bound shrinks with
a set's total weight, so the work per text is about K log K darts plus its size.

Texts that are equal are one node, and buckets of a band with the same nodes are one bucket. In each bucket the nodes are
compared with one of them, in ROUNDS rounds: buckets that the links found so far leave in several pieces pick anew, and what
is in the pick's own piece isn't compared again. So a large group of copies is connected by a few stars. Buckets that are
still in pieces then are compared in full, piece against piece, in bounded units that give no pairs but the links that join
pieces. Only nodes that share a bucket ever meet in a unit, never those that unchecked candidates connect.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm.common import cut, in_small_batches, scratch, table
from quillbook.llm.components import components
from quillbook.llm.shingles import chunks, mix, shingle_sets

BANDS, ROWS = 25, 5
#: Comparisons with a pick of each bucket before those still in pieces are compared in full.
ROUNDS = 2
K = BANDS * ROWS
SIMILARITY = 0.8
SHINGLE = 5
#: Texts sketched at once; a text of a few words takes about 100 kB of darts.
SKETCH_BYTES = 400_000
#: Nodes in a chunk of a group that is compared all with all; a unit of two chunks is held by one task.
CHUNK = 256
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_U = np.uint64


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _darts(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, rank, hash) of every dart that hits an element's region below its document's rank bound."""
    wide, high = np.ceil(weight).astype(np.int64), np.ceil(bound[doc]).astype(np.int64)
    cells = wide * high
    of = np.repeat(np.arange(len(element)), cells)
    k = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    w, r = k // high[of], k % high[of]
    with np.errstate(over="ignore"):
        cell = mix(element[of] + mix(((w.astype(np.uint64) << _U(32)) | r.astype(np.uint64)) * _U(0x9E3779B97F4A7C15) + _U(1)))
    n = np.searchsorted(_POISSON, _unit(cell), side="right")
    at = np.repeat(np.arange(len(of)), n)
    j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        dart = mix(cell[at] + (j.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93))
    rank = r[at] + _unit(mix(dart ^ _U(0xA5A5A5A5A5A5A5A5)))
    of = of[at]
    hit = rank < bound[doc[of]]
    if wide.max(initial=1) > 1 or (weight < 1).any():
        hit &= w[at] + _unit(mix(dart ^ _U(0x5A5A5A5A5A5A5A5A))) < weight[of]
    return doc[of[hit]], rank[hit], dart[hit]


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """DartMinHash of each document's weighted set (n_docs x k, uint64); documents without elements have zeros."""
    total = np.bincount(doc, weight, n_docs)
    out, open_ = np.zeros((n_docs, k), dtype=np.uint64), total > 0
    darts_wanted = k * (math.log(k) + 3)
    while open_.any():
        bound = np.where(open_, darts_wanted / np.where(total > 0, total, 1), 0)
        use = open_[doc]
        d, rank, dart = _darts(element[use], doc[use], weight[use], bound)
        key = d * k + (mix(dart) % _U(k)).astype(np.int64)
        best = np.full(n_docs * k, np.inf)
        np.minimum.at(best, key, rank)
        first = rank == best[key]
        values = np.zeros(n_docs * k, dtype=np.uint64)
        values[key[first]] = dart[first]
        full = np.isfinite(best.reshape(n_docs, k)).all(1) & open_
        out[full] = values.reshape(n_docs, k)[full]
        open_ &= ~full  # a coordinate without a dart: throw more
        darts_wanted *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        out = np.full((len(signature), bands), _U(0)) + np.arange(1, bands + 1, dtype=np.uint64)
        for r in range(rows):
            out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def text_key(text: Column, id_col: Column) -> Column:
    """16 bytes that stand for a text. A null text is like no other row's, unless that row has the same id."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.concat(F.lit("n"), id_col.cast("string")), F.lit("n"))))


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node, bands (array of BANDS longs; empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            bands: list[list[int]] = []
            for lo, hi in chunks(texts, SKETCH_BYTES):
                element, doc, times = shingle_sets(texts[lo:hi], SHINGLE)
                some = np.bincount(doc, minlength=hi - lo) > 0
                found = band_hashes(signatures(element, doc, 1 + np.log(times), hi - lo)).view(np.int64)
                bands += [row.tolist() if s else [] for row, s in zip(found, some, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], names=["id", "node", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    side = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col), F.col(id_col)).alias("node"), F.col(text_col).alias("text"))
    return in_small_batches(side).mapInArrow(run, f"id {kind}, node binary, bands array<long>")


def layered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements, text numbers and weights, where a shingle's k-th occurrence is an element of its own of weight ln k - ln(k - 1),
    the first of weight 1. What two texts have in common then weighs the same in both, and is found as a plain intersection."""
    element, doc, times = shingle_sets(texts, SHINGLE)
    of = np.repeat(np.arange(len(element)), times)
    k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(divide="ignore", over="ignore"):
        weight = np.where(k > 0, np.log1p(1 / np.maximum(k, 1)), 1.0)
        return np.where(k > 0, mix(element[of] + k.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), element[of]), doc[of], weight


def near_enough(both: np.ndarray | float, a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | bool:
    return both >= SIMILARITY * (a + b - both) - 1e-9


@lru_cache(maxsize=64)
def _set(text: str) -> tuple[np.ndarray, np.ndarray]:
    element, _, weight = layered([text.encode()])
    order = np.argsort(element)
    return element[order], weight[order]


def compared(pairs: DataFrame) -> DataFrame:
    """a, b and whether their texts (text_a, text_b) are alike: the exact similarity of their weighted shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                (x, wx), (y, wy) = _set(x.as_py()), _set(y.as_py())
                _, at, _ = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                near.append(bool(near_enough(wx[at].sum(), wx.sum(), wy.sum())))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return in_small_batches(pairs.select("a", "b", "text_a", "text_b")).mapInArrow(run, "a long, b long, near boolean")


def alike(texts: list[bytes], columns: int = 4096) -> np.ndarray:
    """Which of these texts are similar enough (a square matrix): exact, by products of slices of their incidence matrix.
    Elements of one text only add nothing to an intersection and are left out of it."""
    element, doc, weight = layered(texts)
    size = np.bincount(doc, weight, minlength=len(texts))
    _, back, n = np.unique(element, return_inverse=True, return_counts=True)
    shared = n[back] > 1
    number = np.cumsum(n > 1) - 1
    doc, back, weight = doc[shared], number[back[shared]], weight[shared]
    order = np.argsort(back, kind="stable")
    doc, back, root = doc[order], back[order], np.sqrt(weight[order])
    both = np.zeros((len(texts), len(texts)))
    for lo in range(0, int((n > 1).sum()), columns):
        at = slice(*np.searchsorted(back, [lo, lo + columns]))
        part = np.zeros((len(texts), columns), dtype=np.float32 if (root[at] == 1).all() else np.float64)
        part[doc[at], back[at] - lo] = root[at]
        both += part @ part.T
    return near_enough(both, size[:, None], size)


def linked_in_units(members: DataFrame) -> DataFrame:
    """Edges among the texts of each unit (unit, node, label, text) that join different labels, as few as connect them."""

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        nodes, labels = unit.column("node").to_pylist(), unit.column("label").to_pylist()
        top = {x: x for x in labels}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        near, out = alike([t.encode() for t in unit.column("text").to_pylist()]), []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
            x, y = root(labels[i]), root(labels[j])
            if x != y:
                top[x] = y
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        columns = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return members.select("unit", "node", "label", "text").groupBy("unit").applyInArrow(run, "a long, b long")


def in_pieces(buckets: DataFrame, near: DataFrame) -> DataFrame:
    """g, node and label of the buckets (g, node) that near leaves in several pieces; buckets of two nodes are settled."""
    both = buckets.join(components(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = both.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi and n > 2").select("g")
    return cut(both.select("g", "node", "label").join(groups, "g", "left_semi"), "pieces")


def open_units(both: DataFrame) -> DataFrame:
    """node, unit and label for buckets in pieces (g, node, label).

    A bucket is cut into chunks of about CHUNK nodes, large pieces into chunks of their own, and each two chunks that hold
    different pieces make a unit, where all are compared with all in one matrix product.
    """
    parts = both.groupBy("g", "label").agg(F.count(F.lit(1)).alias("size"))
    small = parts.groupBy("g").agg(F.sum(F.when(F.col("size") < CHUNK, F.col("size")).otherwise(0)).alias("small"))
    parts = parts.join(small, "g").withColumn("own", F.col("size") >= CHUNK)
    parts = parts.select("g", "label", "own", F.ceil(F.when(F.col("own"), F.col("size")).otherwise(F.greatest("small", F.lit(1))) / CHUNK).alias("cuts"))
    dealt = both.join(parts, ["g", "label"])
    chunk = F.when(F.col("own"), F.xxhash64("label", F.pmod(F.xxhash64("node"), "cuts"))).otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("label"), "cuts")))
    dealt = cut(dealt.select("g", "node", "label", chunk.alias("chunk"), F.when(F.col("own"), F.col("label")).alias("pure")), "chunks")
    chunks_ = dealt.select("g", "chunk", "pure").distinct()
    other = chunks_.select("g", F.col("chunk").alias("chunk 2"), F.col("pure").alias("pure 2"))
    # two chunks of one piece are settled between them; a mixed chunk is a unit with itself as well
    units = chunks_.join(other, "g").where((F.col("chunk") <= F.col("chunk 2")) & ~F.coalesce(F.col("pure") == F.col("pure 2"), F.lit(False)))
    units = units.select("g", F.xxhash64("g", "chunk", "chunk 2").alias("unit"), F.explode(F.array_distinct(F.array("chunk", "chunk 2"))).alias("chunk"))
    return dealt.join(units, ["g", "chunk"]).select("node", "unit", "label")


def filled_buckets(nodes: DataFrame) -> DataFrame:
    """g and node of the buckets of two nodes or more, one of those that hold the same nodes."""
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("g"), "node")
    print_ = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min("node").alias("lo"), F.max("node").alias("hi")]
    sets = buckets.groupBy("g").agg(*print_).where("n > 1").groupBy("n", "x", "y", "lo", "hi").agg(F.min("g").alias("g")).select("g")
    return cut(buckets.join(sets, "g", "left_semi").distinct(), "buckets")


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) between nodes (node, bands) of similarity SIMILARITY or more that share a band: enough of them to
    connect all that are connected. texts (node, text) is asked for the nodes of filled buckets only."""
    with scratch(nodes.sparkSession) as keep:
        buckets = filled_buckets(nodes)
        texts = cut(texts(buckets.select("node").distinct()), "texts")
        members, near = buckets.withColumn("label", F.lit(None).cast("long")), None
        for turn in range(ROUNDS):
            # one order for all buckets: most of a node's picks are the same
            order = F.struct(F.xxhash64(F.lit(turn), "node").alias("o"), "node", "label")
            picks = members.groupBy("g").agg(F.min(order).alias("pick")).select("g", F.col("pick.node").alias("pick"), F.col("pick.label").alias("its"))
            pairs = members.join(picks, "g").where("pick <> node and (its is null or its <> label)")
            pairs = cut(pairs.select(F.least("pick", "node").alias("a"), F.greatest("pick", "node").alias("b")).distinct(), "pairs")
            with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            found = cut(compared(with_both).where("near").select("a", "b"), "near")
            near = found if near is None else cut(near.union(found), "near")
            members = in_pieces(members.select("g", "node"), near)
        return keep(cut(near.union(linked_in_units(open_units(members).join(texts, "node"))), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node (16 bytes, equal for equal texts) and class_id, the smallest id in its class, one row for each row of docs.

    Classes are the connected components of: equal texts, and texts of which the weighted sets of five-word shingles (see
    above) have a Jaccard similarity of 0.8 or more. A text of one to four words is one shingle; empty texts and others
    without words are alike only if equal; null texts are alike only in rows of the same id. Null ids are never the
    smallest, unless a class has no other. Repeated rows are rows of one class. Texts are read whole, however long; an
    empty table gives an empty result. Other columns of docs, whatever their names, are left out.
    """
    found = cut(sketched(docs, id_col, text_col), "sketches")
    by_text = found.groupBy(F.col("node").alias("text_key")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = cut(by_text.withColumn("node", F.monotonically_increasing_id()), "nodes")
    key = text_key(F.col(text_col), F.col(id_col))

    def texts(wanted: DataFrame) -> DataFrame:
        # one row of each wanted text, so that copies don't meet: the row of the smallest id
        asked = nodes.join(wanted, "node", "left_semi").select("node", "text_key", "least")
        rows = docs.select(key.alias("text_key"), F.col(id_col).alias("least"), F.col(text_col).alias("text"))
        return rows.join(asked, (rows.text_key == asked.text_key) & rows.least.eqNullSafe(asked.least)).select("node", "text").dropDuplicates(["node"])

    labels = components(links(nodes.select("node", "bands"), texts))
    sized = nodes.select("node", "text_key", "least", "n")
    with_label = labels.join(sized, "node")
    smallest = with_label.groupBy("label").agg(F.min("least").alias("class_id"))
    linked = with_label.select("node", "label").join(smallest, "label").select("node", "class_id")
    sized = sized.join(linked, "node", "left").where("n > 1 or class_id is not null")
    classes = sized.select(F.col("text_key").alias("node"), F.coalesce("class_id", "least").alias("class_id"))
    out = found.select("id", "node").join(classes, "node", "left")
    return out.select("id", "node", F.coalesce("class_id", "id").alias("class_id"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id")
