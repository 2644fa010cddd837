"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone. A letter n-gram is the product of its
letters' vectors, each permuted (rolled) by its distance from the end; a text is the sum of its n-grams. A language's
prototype is the sum of the unit vectors of its learning texts, and the prediction is the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm.common import in_small_batches, table

DIMENSIONS = 1024
N = 3
#: Prototypes are learned from about so many rows of each language, taken by a hash; more add nothing measurable.
LEARN_ROWS = 4000
UNDECIDED = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def letter_vectors(points: np.ndarray, dims: int = DIMENSIONS) -> np.ndarray:
    """Rows of +1 and -1 (float32), a pure function of the code points (splitmix64 of point and word number)."""
    with np.errstate(over="ignore"):
        z = (points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dims // 64, dtype=np.uint64) + np.uint64(1)) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


_LETTER = np.zeros(0x110000, dtype=np.int8)  # -1 no letter, 1 letter, 0 not asked yet


def letters_only(text: str) -> np.ndarray:
    """Code points in lower case; each stretch of other characters is one 0, also before and after the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    kinds = _LETTER[points]
    if (kinds == 0).any():
        for p in np.unique(points[kinds == 0]):
            _LETTER[p] = 1 if chr(p).isalpha() else -1
        kinds = _LETTER[points]
    out = np.zeros(len(points) + 2, dtype=np.int64)
    out[1:-1] = np.where(kinds > 0, points, 0)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed in 21 bits a letter, and their counts."""
    s = letters_only(text)
    if len(s) < N or not s.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    key = s[: len(s) - N + 1].copy()
    for i in range(1, N):
        key = (key << 21) | s[i : len(s) - N + 1 + i]
    return np.unique(key, return_counts=True)


def gram_vectors(keys: np.ndarray) -> np.ndarray:
    out = None
    for i in range(N):
        points, back = np.unique((keys >> (21 * (N - 1 - i))) & 0x1FFFFF, return_inverse=True)
        bound = np.roll(letter_vectors(points), N - 1 - i, axis=1)[back]
        out = bound if out is None else out * bound
    return out


def text_vectors(texts: list[str], block: int = 32) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, unit vectors of a block of texts); a text without a letter has the zero vector."""
    for at in range(0, len(texts), block):
        found = [grams(t) for t in texts[at : at + block]]
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        if not len(keys):
            yield at, np.zeros((len(found), DIMENSIONS), dtype=np.float32)
            continue
        counts = np.zeros((len(found), len(keys)), dtype=np.float32)
        counts[np.repeat(np.arange(len(found)), [len(k) for k, _ in found]), back] = np.concatenate([c for _, c in found])
        out = np.zeros((len(found), DIMENSIONS), dtype=np.float32)
        for lo in range(0, len(keys), 16384):  # a text in many scripts has many n-grams
            out += counts[:, lo : lo + 16384] @ gram_vectors(keys[lo : lo + 16384])
        size = np.linalg.norm(out, axis=1, keepdims=True)
        yield at, out / np.where(size > 0, size, 1)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = LEARN_ROWS, by: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Prototypes from about `rows` rows of each language in labelled, chosen by a hash of `by` and the text, or all of its
    rows where it has no more. Rows with a null text or label, and texts without letters, teach nothing. The sizes of the
    languages that have more, and at most 16 partial sums a language, reach the driver."""
    labelled = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).collect()}
    if sizes:
        size = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair]), F.col(lang))
        labelled = labelled.where(size.isNull() | (F.pmod(F.xxhash64(F.lit(17), F.col(by), F.col(text)), size) < rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, vectors in text_vectors(batch.column(0).to_pylist()):
                for k, v in enumerate(vectors):
                    if v.any():
                        sums[langs[at + k]] = sums.get(langs[at + k], 0) + v.astype(np.float64)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "total"])

    parts = in_small_batches(labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).repartition(16)).mapInArrow(run, "lang string, total array<double>").collect()
    names = sorted({r.lang for r in parts})
    found = np.zeros((len(names), DIMENSIONS))
    for r in sorted(parts, key=lambda r: (r.lang, r.total)):
        found[names.index(r.lang)] += r.total
    return names, (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with lang_pred and score (cosine, 0 to 1). text may be a field of a struct column.

    A null text, one without a letter, or any text when nothing was learned, is `und` with score 0. Ties go to the first
    language in alphabetical order. Texts are read whole, however long; repeated rows get the same answer; an empty table
    gives an empty result. Columns named lang_pred or score give way to the new ones.
    """
    docs = docs.drop("lang_pred", "score")
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    outer, _, inner = text.partition(".")
    side = docs.select(*keep, *([] if outer in keep else [F.col(text).alias("text to read")]))
    place = keep.index(outer) if outer in keep else len(keep)
    out_schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place).field(inner) if inner else batch.column(place)
            langs, scores = [], []
            for lo in range(0, len(column), 256):
                for _, vectors in text_vectors([t or "" for t in column.slice(lo, 256).to_pylist()]):
                    near = vectors @ prototypes.T if names else np.zeros((len(vectors), 1))
                    best = near.argmax(axis=1)
                    known = vectors.any(axis=1) & bool(names)
                    langs += [names[b] if k else UNDECIDED for b, k in zip(best, known, strict=True)]
                    scores += np.where(known, np.clip(near[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=out_schema.names)

    return in_small_batches(side).mapInArrow(run, out_schema)


def letters(text: Column) -> Column:
    """How many letters a text has."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", ""))


def third(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, prototypes = learn(docs.where(third(F.col("doc_id")) != 1))
    held_out = F.coalesce(third(F.col("doc_id")) == 1, F.lit(False))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), names, prototypes, keep=["doc_id", "held_out"])
