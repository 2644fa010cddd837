"""SentencePiece encoding and decoding (BPE models with byte fallback) by vectorised merge rounds.

A batch's words that weren't met before lie in flat numpy arrays of symbols, cut into segments that no piece can span. In a
round, every segment finds the least rank of its pairs, all segments merge the pairs of that rank from the left at once, and
the arrays are compacted; segments without a pair are done. A segment merges several places in a round only as far as one at
a time, the leftmost of the best, would do the same: up to the first merge that makes a pair as good or better. Words that
were met before are looked up, and the ids of whole texts, their bytes and their digests come from flat tables.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillbook.llm.common import in_small_batches, table

SPACE = "▁"
#: A word is what stands between spaces with the spaces before it. What a task keeps of them it forgets behind a word of so many
#: characters, or when it has so many symbols.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
KEPT_CHARS, KEPT_SYMBOLS = 10_000, 4_000_000
_NO_PAIR = np.int64(1 << 40)


class Places:
    """The place of each of many keys in a list of distinct ones, or -1. Two hash tables: what two keys fall on in the first
    is looked up in the second, where none do."""

    _MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)

    def __init__(self, keys: np.ndarray):
        self.keys, rest, self.tables = keys, np.arange(len(keys)), []
        size = max(8, int(len(keys)).bit_length() + 3)
        for mix in self._mixes():
            spot = self._spot(keys[rest], mix, size)
            table = np.full(1 << size, -1, dtype=np.int32)
            table[spot] = rest  # the last of those that fall on one spot
            left = rest[table[spot] != rest]
            if len(self.tables) == 0 or not len(left):
                self.tables.append((mix, size, table))
                rest = left
                if not len(rest):
                    return

    def _mixes(self) -> Iterator[np.uint64]:
        at = self._MIX[0]
        while True:
            yield at
            at = np.uint64((int(at) * int(self._MIX[1]) + int(self._MIX[2])) % (1 << 64) | 1)

    @staticmethod
    def _spot(keys: np.ndarray, mix: np.uint64, size: int) -> np.ndarray:
        return (keys.astype(np.uint64) * mix >> np.uint64(64 - size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        for mix, size, table in self.tables:
            at = table[self._spot(keys, mix, size)]
            out = np.where((at >= 0) & (self.keys[at] == keys), at, out)
        return out


class Model:
    """The tables of a model file. Symbols are numbered: pieces by their ids, then characters that only stand in longer pieces;
    any other character is -1 - its code point, and in no pair."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, proto.SentencePiece
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are known here")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces aren't known here")
        self.pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        find = lambda kind: next(k for k, p in enumerate(proto.pieces) if p.type == kind)
        self.byte = np.zeros(256, dtype=np.int64)
        for k, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:-1], 16)] = k
        control = {k for k, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(self.pieces) + len(symbols) - len(normal))
        self.size = len(self.pieces) + len(symbols) - len(normal)
        # code points of symbols, and the adjacent characters that some piece has: no segment is cut between such
        self.points = np.full(0x110000, -1, dtype=np.int32)
        for p, k in symbols.items():
            if len(p) == 1:
                self.points[ord(p)] = k
        self.adjacent = Places(np.unique([(ord(a) << 21) | ord(b) for p in normal for a, b in zip(p, p[1:], strict=False)]))
        # ranks: equal scores have equal ranks
        _, rank = np.unique([-proto.pieces[k].score for k in normal.values()], return_inverse=True)
        rank_of = dict(zip(normal.values(), rank.tolist(), strict=True))
        pairs = {(symbols[p[:i]] * self.size + symbols[p[i:]]): k for p, k in normal.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols}
        self.pairs = Places(np.array(sorted(pairs), dtype=np.int64))
        self.merged = np.array([pairs[x] for x in self.pairs.keys.tolist()], dtype=np.int64)
        self.rank = np.array([rank_of[k] for k in self.merged.tolist()], dtype=np.int64)
        # runs of spaces may be cut behind every longest piece if all of them have one rank, the worst
        runs = {len(p): k for p, k in normal.items() if len(p) > 1 and set(p) == {SPACE}}
        worst = {rank_of[k] for k in runs.values()}
        others = max((rank_of[k] for p, k in normal.items() if len(p) > 1 and set(p) != {SPACE}), default=-1)
        plain = SPACE in normal and len(worst) == 1 and min(worst) > others and _cuttable(set(runs))
        self.run_rank, self.run_length = (min(worst), max(runs)) if plain else (None, 0)
        self.space = normal.get(SPACE, -1)
        # what each id is decoded to: control pieces to nothing, bytes to themselves, others to their text
        out = [b"" if k in control else bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for k, p in enumerate(proto.pieces)]
        self.out_len = np.array([len(x) for x in out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.is_byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        self.unknown, self.control = find(kinds.UNKNOWN), np.array([k in control for k in range(len(self.pieces))])
        self.starts_with_space = np.array([p.startswith(SPACE) for p in self.pieces])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the tables, or -1."""
        return np.where((left >= 0) & (right >= 0), self.pairs.find(left * self.size + right), -1)


def _cuttable(lengths: set[int]) -> bool:
    """Whether merging a run of spaces from the left, into pieces of these lengths, takes it apart into longest pieces and a
    rest that is merged as if it stood alone."""

    def merged(n: int) -> list[int]:
        run, k = [1] * n, 0
        while k < len(run) - 1:
            if run[k] + run[k + 1] in lengths:
                run[k : k + 2] = [run[k] + run[k + 1]]
                k = 0
            else:
                k += 1
        return run

    longest = max(lengths)
    return all(merged(n) == [longest] * (n // longest) + merged(n % longest) for n in range(1, 4 * longest))


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def merge_rounds(m: Model, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words of text that begin at `starts` (ascending, the first 0), and how many each word has."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not len(points):
        return points, np.zeros(0, dtype=np.int64)
    symbol = m.points[points].astype(np.int64)
    symbol = np.where(symbol < 0, -1 - points, symbol)
    begins = np.zeros(len(points), dtype=bool)
    begins[starts] = True
    begins[1:] |= m.adjacent.find((points[:-1] << 21) | points[1:]) < 0
    begins[0] = True
    done_at, done = [], []  # places (of first characters) and symbols of the segments that are done
    place = np.arange(len(points))
    best, to = _pairs(m, symbol, begins)
    while len(symbol):
        first = np.flatnonzero(begins)
        least = np.minimum.reduceat(best, first)
        sizes = np.diff(np.append(first, len(symbol)))
        alive = np.repeat(least < _NO_PAIR, sizes)
        if not alive.all():
            done_at.append(place[~alive])
            done.append(symbol[~alive])
            place, symbol, begins, best, to = (x[alive] for x in (place, symbol, begins, best, to))
            if not len(symbol):
                break
            sizes, least = sizes[least < _NO_PAIR], least[least < _NO_PAIR]
        if m.run_rank is not None and (least == m.run_rank).any():
            begins, changed = _cut_runs(m, symbol, begins, np.repeat(least == m.run_rank, sizes))
            if changed:
                best, to = _pairs(m, symbol, begins)
                continue
        segment = np.cumsum(begins) - 1
        hit = np.flatnonzero(best == least[segment])
        # from the left, without overlaps: every second of a chain of adjacent ones
        chain = np.append(True, (hit[1:] != hit[:-1] + 1) | (segment[hit[1:]] != segment[hit[:-1]]))
        head = np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
        # as far as the merge of one makes no pair as good: its neighbours are what they are when it is its turn
        made, after = m.merged[to[hit]], hit + 2
        left = np.where(begins[hit], -1, symbol[hit - 1])
        touches = np.append(False, (hit[1:] == hit[:-1] + 2) & ~begins[hit[1:]])
        left = np.where(touches, np.append(-1, made[:-1]), left)
        ends = (after >= len(symbol)) | begins[np.minimum(after, len(symbol) - 1)]
        right = np.where(ends, -1, symbol[np.minimum(after, len(symbol) - 1)])
        low = least[segment[hit]]
        again = (_rank(m, left, made) <= low) | (_rank(m, made, right) <= low)
        turns = np.cumsum(again) - again
        fresh = np.append(True, segment[hit[1:]] != segment[hit[:-1]])
        hit, made = (x[turns == turns[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]] for x in (hit, made))
        symbol = symbol.copy()
        symbol[hit] = made
        stays = np.ones(len(symbol), dtype=bool)
        stays[hit + 1] = False
        moved = np.cumsum(stays) - 1
        place, symbol, begins, best, to = (x[stays] for x in (place, symbol, begins, best, to))
        here = moved[hit]
        for i in (here, here[here > 0] - 1):  # only pairs beside what was merged are new
            _renew(m, symbol, begins, best, to, i)
    places = np.concatenate(done_at)
    order = np.argsort(places)
    places, symbols = places[order], np.concatenate(done)[order]
    return symbols, np.diff(np.append(np.searchsorted(places, starts), len(places)))


def _pairs(m: Model, symbol: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, to = np.full(len(symbol), _NO_PAIR), np.full(len(symbol), -1)
    _renew(m, symbol, begins, best, to, np.arange(len(symbol)))
    return best, to


def _renew(m: Model, symbol: np.ndarray, begins: np.ndarray, best: np.ndarray, to: np.ndarray, at: np.ndarray) -> None:
    """Looks up the pairs of the symbols at these places with the next ones."""
    after = np.minimum(at + 1, len(symbol) - 1)
    inside = (at + 1 < len(symbol)) & ~begins[after]
    found = np.where(inside, m.pair(symbol[at], symbol[after]), -1)
    to[at] = found
    best[at] = np.where(found >= 0, m.rank[found], _NO_PAIR)


def _rank(m: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    found = m.pair(left, right)
    return np.where(found >= 0, m.rank[found], _NO_PAIR)


def _cut_runs(m: Model, symbol: np.ndarray, begins: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, bool]:
    """Cuts long runs of single spaces, where nothing else is left to merge, behind every longest piece: the leftmost spaces
    merge until they are that long, and only then the next."""
    space = last & (symbol == m.space)
    opens = space & np.append(True, ~space[:-1] | begins[1:])
    at = np.arange(len(symbol))
    within = at - np.maximum.accumulate(np.where(opens, at, 0))
    new = begins | (space & (within > 0) & (within % m.run_length == 0))
    return new, bool((new != begins).any())


class Encoder:
    """Texts to ids; keeps the symbols of short words."""

    def __init__(self, path: str):
        self.m = model(path)
        self._clear()

    def _clear(self) -> None:
        # words in the order of their numbers, their ids one after another, and how many each has
        self.words: dict[str, int] = defaultdict(itertools.count().__next__)
        self.flat, self.size = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, how many each has)."""
        split = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        numbers = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64)
        new = list(itertools.islice(self.words, len(self.size), None))
        if new:
            sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            symbols, counts = merge_rounds(self.m, "".join(new), np.cumsum(sizes) - sizes)
            ids, per = self._ids(symbols)
            owner = np.repeat(np.arange(len(new)), counts)
            self.flat = np.concatenate([self.flat, ids])
            self.size = np.concatenate([self.size, np.bincount(owner, weights=per, minlength=len(new)).astype(np.int64)])
        at = np.cumsum(self.size) - self.size
        out = self.flat[_spread(at[numbers], self.size[numbers])]
        ends = np.cumsum([0, *map(len, split)])
        lengths = np.diff(np.concatenate([[0], np.cumsum(self.size[numbers])])[ends])
        if len(self.flat) > KEPT_SYMBOLS or (new and sizes.max() > KEPT_CHARS):
            self._clear()
        if bos or eos:
            whole = np.empty(len(out) + (bos + eos) * len(texts), dtype=np.uint32)
            first = np.cumsum(lengths + bos + eos) - (lengths + bos + eos)
            whole[_spread(first + bos, lengths)] = out
            if bos:
                whole[first] = self.m.bos
            lengths = lengths + bos + eos
            if eos:
                whole[first + lengths - 1] = self.m.eos
            out = whole
        return out.astype("<u4", copy=False), lengths

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each symbol has): a piece is its id, any other character the ids of its bytes."""
        m = self.m
        other = np.flatnonzero((symbols < 0) | (symbols >= len(m.pieces)))
        per = np.ones(len(symbols), dtype=np.int64)
        if not len(other):
            return symbols.astype(np.uint32), per
        lone = {v: chr(p) for p, v in ((int(p), int(m.points[p])) for p in np.flatnonzero(m.points >= len(m.pieces)))}
        raw = [(chr(-1 - int(s)) if s < 0 else lone[int(s)]).encode() for s in symbols[other]]
        per[other] = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out = np.repeat(symbols, per)
        at = (np.cumsum(per) - per)[other]
        out[_spread(at, per[other])] = m.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out.astype(np.uint32), per


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... size[0] numbers, then those from at[1], and so on."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(at - before, size)


def decode(path: str, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The texts of so many ids each, in UTF-8. Control ids are nothing, the first space of a text goes, and bytes that are no
    UTF-8 become U+FFFD, each one of them."""
    m = model(path)
    flat = ids.astype(np.int64)
    if ((flat < 0) | (flat >= len(m.pieces))).any():
        raise ValueError("an id that the model doesn't have")
    size = m.out_len[flat].copy()
    skip = np.zeros(len(flat), dtype=np.int64)
    ends = np.cumsum(lengths)
    seen = np.flatnonzero(~m.control[flat])  # the first id of each text that isn't a control id
    first = np.searchsorted(seen, ends - lengths)
    first = seen[first[first < len(seen)]]
    first = first[m.starts_with_space[flat[first]]]
    skip[first], size[first] = 1, size[first] - 1
    out = m.out[_spread(m.out_at[flat] + skip, size)]
    cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
    whole = out.tobytes()
    texts = [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    has_bytes = m.is_byte[flat]
    if has_bytes.any():
        owner = np.repeat(np.arange(len(lengths)), lengths)
        for k in np.unique(owner[has_bytes]).tolist():
            lo, hi = int(ends[k] - lengths[k]), int(ends[k])
            if not _valid(texts[k]) or m.control[flat[lo + 1 : hi - 1]].any():  # a control id ends a run of bytes
                texts[k] = _repaired(m, flat[lo:hi], size[lo:hi], texts[k])
    return texts


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _repaired(m: Model, ids: np.ndarray, size: np.ndarray, raw: bytes) -> bytes:
    """Runs of byte ids as characters where they are such, and U+FFFD for each other byte; other pieces stand between runs."""
    out, at, k = [], 0, 0
    kind = m.is_byte[ids]
    while k < len(ids):
        end = k + 1
        while end < len(ids) and kind[end] == kind[k]:
            end += 1
        part = raw[at : at + int(size[k:end].sum())]
        at += len(part)
        if kind[k]:
            while part:
                one = next((n for n in (1, 2, 3, 4) if _valid(part[:n]) and n <= len(part)), 0)
                out.append(part[:one] if one else "�".encode())
                part = part[one or 1 :]
        else:
            out.append(part)
        k = end
    return b"".join(out)


KINDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encoded(docs: DataFrame, path: str, outputs: list[str], id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """id_col and, of every text, what is in outputs: n_tokens, ids, decoded (the text that decoding the ids gives), ids_sha256
    (of the ids as little-endian 32-bit numbers), decoded_sha256 (of that text in UTF-8). Digests spare moving what they are of.

    A null text is an empty one: begin and end ids alone. Texts are read whole, however long; repeated rows get the same answer;
    an empty table gives an empty result. Other columns of docs are left out.
    """
    schema = StructType([*docs.select(id_col).schema, *StructType.fromDDL(", ".join(f"{n} {KINDS[n]}" for n in outputs))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, lengths = encoder.encode([t or "" for t in part.column(1).to_pylist()], bos, eos)
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                texts = decode(path, ids, lengths) if any(n.startswith("decoded") for n in outputs) else []
                each = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                made = {
                    "n_tokens": lambda: pa.array(lengths, pa.int64()),  # noqa: B023
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))),  # noqa: B023
                    "decoded": lambda: pa.array([t.decode() for t in texts], pa.string()),  # noqa: B023
                    "ids_sha256": lambda: pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()),  # noqa: B023
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),  # noqa: B023
                }
                yield pa.record_batch([part.column(0), *(made[n]() for n in outputs)], names=schema.names)

    return in_small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded, the text of an array of ids. A null array is an empty one, null ids in it are left out; an id that the
    model doesn't have is an error."""
    schema = rows.select(id_col).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.array([i for i in x or [] if i is not None], dtype=np.int64) for x in batch.column(1).to_pylist()]
            texts = decode(path, np.concatenate([np.empty(0, dtype=np.int64), *each]), np.array([len(x) for x in each], dtype=np.int64))
            yield pa.record_batch([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], names=schema.names)

    return in_small_batches(rows.select(id_col, ids_col)).mapInArrow(run, schema)


def op12_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["n_tokens", "ids_sha256", "decoded_sha256"])
