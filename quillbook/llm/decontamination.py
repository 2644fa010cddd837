"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Scores are divided by what the item's own text would score, so one threshold fits all items. A passage is a window of twice
`step` words at steps of `step`, where an item's step depends on its own length alone (the next power of two, 64 at least):
an item that lies in a document lies whole in a passage, and what else is in the benchmark, or in the same index, changes
neither its passages nor its verification. What the search retrieves is verified: the item's question and its answer must
both overlap the passage in word n-grams.

The index is broadcast, so documents are read once. It holds INDEX_BYTES of items at most; a larger benchmark takes one
pass over the documents for each such part. Document frequencies are counted over all items, whatever the parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quillbook.llm.common import in_small_batches, table

#: Text of the test items in one index, which every executor holds; about ten times that in memory.
INDEX_BYTES = 16_000_000
THETA = 0.5
OVERLAP = 0.5
GRAM = 5
K1, B = 1.2, 0.75
POSTINGS_PER_BLOCK = 32
LEAST_STEP = 64
_TERM = re.compile(r"\w+")
_ANSWER = re.compile(r"(?:^|\n)\s*(?:answer|solution)\s*:|(?:^|\n)\s*a\s*:|\?", re.I)


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def step_of(n_terms: int) -> int:
    return max(LEAST_STEP, 1 << (n_terms - 1).bit_length())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The terms before and after a question mark or an answer's label; without either, the last sentence is the answer,
    and of a single sentence its last third."""
    m = next((m for m in _ANSWER.finditer(text) if terms(text[: m.start()]) and terms(text[m.end() :])), None)
    if m:
        return terms(text[: m.start()]), terms(text[m.end() :])
    sentences = [s for s in (terms(s) for s in re.split(r"[.!?\n]+", text)) if s]
    if len(sentences) > 1:
        return sum(sentences[:-1], []), sentences[-1]
    words = terms(text)
    at = len(words) - max(1, len(words) // 3)
    return words[:at], words[at:]


def overlap(part: list[str], window: list[str], gram: int = GRAM) -> float:
    """The share of part's n-grams that window has; a part shorter than an n-gram is one. Of no terms: 1."""
    if not part:
        return 1.0
    n = min(gram, len(part))
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own = grams(part)
    return len(own & grams(window)) / len(own)


def passages(words: list[str], step: int) -> list[tuple[int, list[str]]]:
    """(number, words) of the passages of a text; the last ones may be short."""
    return [(p, words[p * step : (p + 2) * step]) for p in range(-(-len(words) // step))]


class Postings:
    """The items of one step: by term, in item order, normalised BM25 weights with list and block maxima."""

    def __init__(self, step: int, weighted: list[tuple[object, tuple[list[str], list[str]], dict[int, float]]], n_terms: int):
        self.step = step
        self.ids, self.parts = [x[0] for x in weighted], [x[1] for x in weighted]
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        need: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, _, weight) in enumerate(weighted):
            rest = 0.0
            for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
                lists[t].append((k, w))
                # the lightest terms together stay under half the threshold: heavier ones must bring the other half
                rest += w
                if rest >= THETA / 2:
                    need[t].append((k, w))
        flat = lambda d: (np.cumsum([0, *(len(d[t]) if t in d else 0 for t in range(n_terms))]), np.array([k for t in sorted(d) for k, _ in d[t]], dtype=np.int32), np.array([w for t in sorted(d) for _, w in d[t]], dtype=np.float64))
        self.first, self.item, self.weight = flat(lists)
        self.need_from, self.need_item, self.need_weight = flat(need)
        self.read: dict[int, tuple[list[int], list[float], float, list[float]]] = {}

    def of(self, t: int) -> tuple[list[int], list[float], float, list[float]]:
        """Items and weights of a term, the largest weight, and the largest of each block."""
        if t not in self.read:
            at = slice(self.first[t], self.first[t + 1])
            w = self.weight[at]
            self.read[t] = (self.item[at].tolist(), w.tolist(), float(w.max()), [float(w[i : i + POSTINGS_PER_BLOCK].max()) for i in range(0, len(w), POSTINGS_PER_BLOCK)])
        return self.read[t]

    def search(self, query: list[int], theta: float = THETA) -> list[tuple[int, float]]:
        """(item, score) of all items that score theta or more on the distinct terms of query: block-max WAND."""
        theta -= 1e-9
        lists = {t: self.of(t) for t in query if self.first[t + 1] > self.first[t]}
        at = dict.fromkeys(lists, 0)
        out = []

        def seek(t: int, item: int) -> None:
            at[t] = bisect_left(lists[t][0], item, at[t])
            if at[t] == len(lists[t][0]):
                del at[t]

        while at:
            order = sorted(at, key=lambda t: lists[t][0][at[t]])
            bound, pivot = 0.0, None
            for r, t in enumerate(order):
                bound += lists[t][2]
                if bound >= theta:
                    pivot = r
                    break
            if pivot is None:
                break
            item = lists[order[pivot]][0][at[order[pivot]]]
            while pivot + 1 < len(order) and lists[order[pivot + 1]][0][at[order[pivot + 1]]] == item:
                pivot += 1
            bound, past = 0.0, len(self.ids)
            for t in order[: pivot + 1]:
                items, _, _, blocks = lists[t]
                k = bisect_left(items, item, at[t])
                if k < len(items):
                    b = k // POSTINGS_PER_BLOCK
                    bound += blocks[b]
                    past = min(past, items[min((b + 1) * POSTINGS_PER_BLOCK, len(items)) - 1] + 1)
            if bound < theta:  # no item before the first of these blocks ends can do it
                if pivot + 1 < len(order):
                    past = min(past, lists[order[pivot + 1]][0][at[order[pivot + 1]]])
                past = max(past, item + 1)
                for t in order[: pivot + 1]:
                    seek(t, past)
            elif lists[order[0]][0][at[order[0]]] == item:
                score = sum(lists[t][1][at[t]] for t in order[: pivot + 1])
                if score >= theta:
                    out.append((item, score))
                for t in order[: pivot + 1]:
                    seek(t, item + 1)
            else:
                seek(order[0], item)
        return out

    def passages_worth_a_search(self, found: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Codes (document << 32 | passage number) of the passages that some item can reach the threshold in: the terms
        that its score can't do without reach half of it there. Exact: what is left out can't be retrieved."""
        use = found >= 0
        use[use] = (self.need_from[found[use] + 1] - self.need_from[found[use]]) > 0
        found, doc, place = found[use], doc[use], place[use] // self.step
        pair = np.concatenate([(doc << 32) | place, ((doc << 32) | (place - 1))[place > 0]])  # each word lies in two passages
        term = np.concatenate([found, found[place > 0]])
        order = np.lexsort((term, pair))
        pair, term = pair[order], term[order]
        first = np.ones(len(pair), dtype=bool)
        first[1:] = (pair[1:] != pair[:-1]) | (term[1:] != term[:-1])
        pair, term = pair[first], term[first]
        size = self.need_from[term + 1] - self.need_from[term]
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.need_from[term], size)
        codes, number = np.unique(pair, return_inverse=True)
        key, back = np.unique(np.repeat(number, size) * len(self.ids) + self.need_item[flat], return_inverse=True)
        score = np.bincount(back, self.need_weight[flat], len(key))
        return codes[np.unique(key[score >= THETA / 2 - 1e-9] // max(1, len(self.ids)))]


class Index:
    """Items (id, text) by step, over one vocabulary. Items without a term are left out."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[str, int], n_items: int, mean_length: float):
        self.vocabulary: dict[str, int] = {}
        by_step: dict[int, list[tuple[object, tuple[list[str], list[str]], dict[int, float]]]] = defaultdict(list)
        for item_id, text in items:
            c = Counter(terms(text))
            if not c:
                continue
            length = c.total()
            weight = {t: np.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean_length)) for t, f in c.items()}
            total = sum(weight.values())
            by_step[step_of(length)].append((item_id, question_and_answer(text), {self.vocabulary.setdefault(t, len(self.vocabulary)): w / total for t, w in weight.items()}))
        self.postings = [Postings(step, by_step[step], len(self.vocabulary)) for step in sorted(by_step)]

    def hits(self, words: list[list[str]]) -> list[tuple[int, object, float, float, float]]:
        """(number of the text, item id, score, question overlap, answer overlap) of what is retrieved and verified in these
        texts' terms; the values are those of the best passage."""
        get = self.vocabulary.get
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        found = np.array([get(t, -1) for w in words for t in w], dtype=np.int64)
        doc = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = []
        for p in self.postings:
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for code in p.passages_worth_a_search(found, doc, place).tolist():
                d, k = code >> 32, code & 0xFFFFFFFF
                window = words[d][k * p.step : (k + 2) * p.step]
                for item, score in p.search(sorted({t for t in map(get, window) if t is not None})):
                    q, a = (overlap(part, window) for part in p.parts[item])
                    if q >= OVERLAP and a >= OVERLAP:
                        best[d, item] = max(best.get((d, item), (0, 0, 0)), (score, q, a))
            out += [(d, p.ids[item], *v) for (d, item), v in sorted(best.items())]
        return out


def searched(docs: DataFrame, index: Index, item_type: DataType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, item_id, score, question_overlap, answer_overlap of each document and item that pass search and verification."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.select(id_col).schema.add("item_id", item_type).add("score", "double").add("question_overlap", "double").add("answer_overlap", "double")
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 256):
                ids = batch.column(0)[lo : lo + 256].to_pylist()
                out += [(ids[d], *hit) for d, *hit in index.hits([terms(t.as_py() or "") for t in batch.column(1)[lo : lo + 256]])]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return in_small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)


def _terms_of(items: DataFrame) -> DataFrame:
    """mark, term: the distinct terms of each item, with the number of all its terms as n on one of them (else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, t, n if k == 0 else 0) for m, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, c in [(len(terms(text)), sorted(set(terms(text))))] for k, t in enumerate(c)]
            m, t, n = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.record_batch([pa.array(m, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], names=["mark", "term", "n"])

    return items.select("mark", "text").mapInArrow(run, "mark long, term string, n long")


def contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES, id_col: str = "doc_id") -> DataFrame:
    """One row for each document and benchmark item (item_id of any plain type, text) that it contains: id_col, item_id,
    score, question_overlap, answer_overlap.

    Null, empty and wordless texts, of documents or items, are never retrieved; either table may be empty. Texts are read
    whole, however long. Rows of docs with equal ids give rows of their own; an item_id that occurs twice is two items.
    All items at or above the threshold are given, ties too. Other columns of either table, whatever their names, are not
    looked at; id_col must not be called as one of the new columns is.
    """
    if id_col.lower() in ("item_id", "score", "question_overlap", "answer_overlap"):
        raise ValueError(f"{id_col} is a column of the result")
    item_type = benchmark.schema["item_id"].dataType
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    items = items.withColumn("size", F.octet_length("text").cast("long")).withColumn("mark", F.xxhash64(F.col("item_id").cast("string"), "text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts, found = max(1, -(-size // index_bytes)), None
    words = _terms_of(items)
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n_terms = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for b in range(parts):
        mine = F.pmod(F.col("mark"), F.lit(parts)) == b
        rows = [(r[0], r[1]) for r in items.where(mine).select("item_id", "text").orderBy("item_id", "text").collect()]
        own = frequency.join(words.where(mine).select("term").distinct(), "term", "left_semi") if parts > 1 else frequency
        part = searched(docs, Index(rows, {r[0]: r[1] for r in own.collect()}, n, n_terms / max(n, 1)), item_type, id_col)
        found = part if found is None else found.unionAll(part)
    return found


def op7_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
