"""Finds what repeats across documents, for operators that then decide it by a method of their own.

Every window of a fixed number of units (bytes or words) holds an anchor: the first of the least hashes among its k-unit
substrings. Equal windows have equal anchors, so an anchor that occurs once in the corpus rules out all windows around it
that it is the anchor of. In three steps:

1. anchors go to shards by their hash, and each document hears which of its anchors occur elsewhere;
2. the segments around these (all windows of which they are the anchor) go to shards by the same hash, where the caller's
   kernel sees all segments that can share a window. An anchor of more than HOT texts would gather too much in one
   shard: its windows go one by one, by the hash of their whole content, which differs wherever the windows do;
3. the kernel's answers go back to the chunk of texts that asked, and from there to the documents.

What may be hot, the counts of anchors and the windows of hot anchors, is settled in two steps (`in_two_steps`): chunks are
dealt over salts, each salt of a shard merges what its chunks have in common, and only what is distinct there meets by
shard. So a passage in a third of all documents is one record a chunk in its salt, and one a salt in its shard.

Texts that are equal are one row from the start. Within a chunk equal segments are one, so copies don't meet in a shard.
The table of texts is bucketed by their key, so that later joins with it move the answers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import cut, in_small_batches, kept_table, scratch
from quillbook.llm.neardup import text_key
from quillbook.llm.shingles import chunks, mix

HOT = 1000
CHUNK_BYTES = 2_000_000
#: Bytes of all texts for each shard; what repeats of them is a shard's share.
SHARD_BYTES = 4_000_000
#: A chunk sends a row to each shard. Beyond so many shards one holds more texts, up to WIDER times as many, so that the rows
#: of all chunks don't grow with the square of the input.
SHARDS, WIDER = 1024, 8
#: So many bytes of a shard's segments go to the kernel at once.
KERNEL_BYTES = 8 << 20
#: Bytes of all texts for each salt: about a thousand chunks.
SALT_BYTES = 2_000_000_000
#: Bytes of all texts for each shuffle partition, so that tasks don't grow with the input.
TASK_BYTES = 32_000_000
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Units:
    """How texts are read. `sequence(texts)` gives the units of all texts in a row (an array of dtype `raw`) and the text
    of each; `parts(units)` a hash of each k units and `content(units)` of each window, both uint64 and well mixed above
    the lowest 16 bits; `within` says whether windows that repeat within one text only are asked for."""

    window: int
    k: int
    raw: str
    sequence: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    parts: Callable[[np.ndarray], np.ndarray]
    content: Callable[[np.ndarray], np.ndarray]
    within: bool


def least_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive hashes."""
    out, width = h, 1
    while 2 * width <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - width :][: len(h) - w + 1]) if width < w else out[: len(h) - w + 1]


def anchored(units: Units, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor hash: start (of the first window, in units), count, hash, doc (the text's number),
    again (the anchor is twice in the run); besides the units and their texts."""
    raw, unit_doc = units.sequence(texts)
    w = units.window - units.k + 1
    if len(raw) < units.window:
        none = np.empty(0, dtype=np.int64)
        return {"start": none, "count": none, "hash": none.astype(np.uint64), "doc": none, "again": none.astype(bool), "raw": raw, "unit_doc": unit_doc}
    parts = units.parts(raw)
    least = least_in_windows(parts, w)
    n = len(least)
    inside = unit_doc[:n] == unit_doc[units.window - 1 :][:n]
    # a run ends where the anchor or the text changes; cut into pieces of at most w windows, a segment is under two windows
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (unit_doc[1:n] != unit_doc[: n - 1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    first, count = first[inside[first]], count[inside[first]]
    pieces = -(-count // w)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, rest = np.repeat(first, pieces) + k * w, np.repeat(count, pieces) - k * w
    count, h, again = np.minimum(rest, w), least[start], np.zeros(len(start), dtype=bool)
    if units.within and len(start):  # as in stretches that repeat at once
        size = count + w - 1
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        again = np.add.reduceat((parts[flat] == np.repeat(h, size)).astype(np.int64), np.cumsum(size) - size) > 1
    return {"start": start, "count": count, "hash": h, "doc": unit_doc[start], "again": again, "raw": raw, "unit_doc": unit_doc}


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Anchors are least hashes, so their high bits are small: middle bits choose the shard."""
    return ((h >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def _code(h: np.ndarray, shards: int) -> np.ndarray:
    """What tells the anchors of a shard apart: 32 bits that the shard's number doesn't use. Two that have one by chance are
    taken for repeats, and the kernel finds that they aren't."""
    return ((h >> np.uint64(16)) // np.uint64(shards)).astype(np.uint32)


def _named(code: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
    return (code.astype(np.uint64) << np.uint64(32)) | np.asarray(shard).astype(np.uint64)


def _pack(**arrays: np.ndarray) -> bytes:
    return b"".join(np.int64(len(a)).tobytes() + np.dtype(a.dtype).str.encode().ljust(8) + a.tobytes() for a in arrays.values())


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int(np.frombuffer(blob, np.int64, 1, at)[0])
        kind = np.dtype(blob[at + 8 : at + 16].decode().strip())
        out.append(np.frombuffer(blob, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def _home(nodes: list[bytes]) -> int:
    """A number for a chunk of texts, the same whenever it is read again."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b"".join(nodes)) >> 1


_ROWS = "shard long, salt long, home long, blob binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["shard", "salt", "home", "blob"])


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _blobs(group: pa.Table) -> tuple[list[int], list[list[np.ndarray]]]:
    """Homes and unpacked blobs of a group, in the order of their homes, whatever order they came in."""
    rows = sorted(zip(group.column("home").to_pylist(), group.column("blob").to_pylist(), strict=True))
    return [h for h, _ in rows], [_unpack(b) for _, b in rows]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, edge):
        if len(part):
            yield int(shard[part[0]]), part


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each stretch, in a row."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def shards_of(total: int) -> int:
    """The number of shards for so many bytes of texts."""
    fine = max(64, -(-total // SHARD_BYTES))
    return min(fine, max(SHARDS, -(-fine // WIDER)))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a text, as a table bucketed by its key: node, least (smallest id, null ids last), n, text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = docs.select(text_key(F.col(text_col), F.col(id_col)).alias("node"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = one.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    return kept_table(one, "texts", parts, "node")  # the aggregation has dealt the rows to as many parts by the same hash


def in_two_steps(dealt: DataFrame, partial: Callable, judge: Callable, reply: Callable) -> DataFrame:
    """Replies (shard, salt, home, blob) to rows that are dealt by (shard, salt).

    partial(blobs of a salt) gives what the salt sends on; judge(what each salt of the shard sent) a verdict for each; and
    reply(blobs, verdict) an answer for each home. Rows of a negative shard are a home's own and pass through. The rows are
    shuffled once: both readings of them are the same exchange.
    """

    def first(group: pa.Table) -> pa.Table:
        s, salt = group.column("shard")[0].as_py(), group.column("salt")[0].as_py()
        return _table([] if s < 0 else [(s, salt, 0, partial(_blobs(group)[1]))])

    def second(group: pa.Table) -> pa.Table:
        s = group.column("shard")[0].as_py()
        sent = sorted(zip(group.column("salt").to_pylist(), group.column("blob").to_pylist(), strict=True))
        return _table([(s, salt, 0, v) for (salt, _), v in zip(sent, judge([_unpack(b) for _, b in sent]), strict=True)])

    def third(group: pa.Table, verdict: pa.Table) -> pa.Table:
        if not group.num_rows or group.column("shard")[0].as_py() < 0:
            return group
        homes, blobs = _blobs(group)
        s = group.column("shard")[0].as_py()
        return _table([(0, 0, home, b) for home, b in zip(homes, reply(s, blobs, _unpack(verdict.column("blob")[0].as_py())), strict=True) if b])

    sent = dealt.groupBy("shard", "salt").applyInArrow(first, _ROWS)
    verdicts = sent.groupBy("shard").applyInArrow(second, _ROWS)
    return dealt.groupBy("shard", "salt").cogroup(verdicts.groupBy("shard", "salt")).applyInArrow(third, _ROWS)


def _answered(replies: DataFrame, parts: int, per_home: Callable[[list[bytes]], list[tuple[bytes, bytes, bool]]]) -> DataFrame:
    """(node, blob, flag) from all blobs of a home, its own record (of a negative shard) first."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("shard").to_pylist(), group.column("blob").to_pylist(), strict=True), key=lambda x: x[0])
        out = per_home([b for _, b in rows])
        node, blob, flag = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"node": pa.array(node, pa.binary()), "blob": pa.array(blob, pa.binary()), "flag": pa.array(flag, pa.bool_())})

    return replies.repartition(parts, "home").groupBy("home").applyInArrow(run, "node binary, blob binary, flag boolean")


def shared_windows(texts: DataFrame, units: Units, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], settle: Callable[..., np.ndarray]) -> DataFrame:
    """(node, blob) for texts (node, least, text) with windows that the kernel answers for; blob packs their starts. A node
    may have two rows, one for the windows of hot anchors.

    kernel(units of all segments in a row, their lengths, their answers so far, routes) gives for each segment an int64 for
    each of its windows; only segments of one route can share windows. merge(answer, answer so far) is the answer of both.
    At first a segment's answer is its document's id. settle(answers, ids, times) says which of the windows count: each
    with its answer, its document's id, and how often its segment is in the chunk of texts, where equal segments are one.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, salts = shards_of(total), max(1, -(-total // SALT_BYTES))
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    raw_type, hot_above, kernel_bytes = np.dtype(units.raw), HOT, KERNEL_BYTES
    width = raw_type.itemsize

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(found, CHUNK_BYTES):
                a = anchored(units, found[lo:hi])
                home, rows = _home(nodes[lo:hi]), []
                # (hash, text) once each
                order = np.lexsort((a["doc"], a["hash"]))
                h, d = a["hash"][order], a["doc"][order]
                if not len(h):
                    continue
                keep = np.ones(len(h), dtype=bool)
                keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                twice = np.add.reduceat((~keep | a["again"][order]).astype(np.int64), np.flatnonzero(keep)) > 0 if units.within else np.zeros(0, dtype=bool)
                h, d = h[keep], d[keep].astype("<u2" if hi - lo <= 65536 else "<u4")
                code = _code(h, shards)
                for s, part in _by_shard(_shard(h, shards)):
                    rows.append((s, home % salts, home, _pack(h=code[part], d=d[part], twice=twice[part] if units.within else twice)))
                yield _rows([*rows, (-1 - home, 0, home, b"".join(nodes[lo:hi]))])

    def counted(blobs: list[list[np.ndarray]]) -> bytes:
        h, back, n = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True, return_counts=True)
        if units.within:  # twice in one text is as good as two texts
            n = np.maximum(n, 2 * (np.bincount(back, np.concatenate([b[2] for b in blobs]), len(h)) > 0))
        return _pack(h=h, n=np.minimum(n, 65535).astype("<u2"))

    def repeated_ones(sent: list[list[np.ndarray]]) -> list[bytes]:
        h, back = np.unique(np.concatenate([b[0] for b in sent]), return_inverse=True)
        n = np.bincount(back, np.concatenate([b[1] for b in sent]).astype(np.int64), len(h))[back]
        out, at = [], 0
        for b in sent:
            mine = n[at : at + len(b[0])]
            out.append(_pack(h=b[0][mine > 1], hot=(mine > hot_above)[mine > 1]))
            at += len(b[0])
        return out

    def tell(shard: int, blobs: list[list[np.ndarray]], verdict: list[np.ndarray]) -> Iterator[bytes]:
        known, hot = verdict
        for h, d, _ in blobs:
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            use = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
            yield _pack(h=_named(h[use], shard), d=d[use], hot=hot[at[use]]) if use.any() else b""

    def to_documents(blobs: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        if len(blobs) < 2:
            return []
        nodes = [blobs[0][i : i + 16] for i in range(0, len(blobs[0]), 16)]
        h, d, hot = (np.concatenate(x) for x in zip(*map(_unpack, blobs[1:]), strict=True))
        return [(nodes[k], _pack(h=h[part], hot=hot[part]), bool(hot[part].any())) for k, part in _by_shard(d.astype(np.int64))]

    def send(hot_ones: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The segments around anchors that aren't hot, or the single windows around those that are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes, ids, found, said = (batch.column(i).to_pylist() for i in range(4))
                found = [(t or "").encode() for t in found]
                for lo, hi in chunks(found, CHUNK_BYTES):
                    a = anchored(units, found[lo:hi])
                    if not len(a["start"]):
                        continue
                    home, told = _home(nodes[lo:hi]), [_unpack(b) for b in said[lo:hi]]
                    # which runs have an anchor that their document was told of
                    ask = [b[1] == hot_ones for b in told]
                    text = np.repeat(np.arange(len(told)), [int(x.sum()) for x in ask]).astype(np.uint64)
                    if not len(text):
                        continue
                    code = np.sort(mix(np.concatenate([b[0][x] for b, x in zip(told, ask, strict=True)]) + text * np.uint64(0x9E3779B97F4A7C15)))
                    own = mix(_named(_code(a["hash"], shards), _shard(a["hash"], shards)) + a["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    use = code[np.minimum(np.searchsorted(code, own), len(code) - 1)] == own
                    start, count, route, doc = (a[x][use] for x in ("start", "count", "hash", "doc"))
                    if hot_ones:  # windows one by one, by their content
                        one = _places(start, count)
                        start, route, doc, count = one, units.content(a["raw"])[one], np.repeat(doc, count), np.ones(len(one), dtype=np.int64)
                    if not len(start):
                        continue
                    size = count + units.window - 1
                    by_text = np.array([NO_ID if i is None else i for i in ids[lo:hi]], dtype=np.int64)
                    raw_bytes, ends = a["raw"][_places(start, size)].tobytes(), np.cumsum(size)
                    number: dict[tuple[int, bytes], int] = {}
                    of = np.array([number.setdefault((r, raw_bytes[(e - z) * width : e * width]), len(number)) for r, e, z in zip(route.tolist(), ends.tolist(), size.tolist(), strict=True)])
                    low = np.full(len(number), NO_ID, dtype=np.int64)
                    np.minimum.at(low, of, by_text[doc])
                    keys = list(number)
                    routes = np.array([r for r, _ in keys], dtype=np.uint64)
                    rows = [(-1 - home, 0, home, _pack(start=start.astype("<u4"), doc=doc.astype("<u4"), of=of.astype("<u4"), n=count.astype("<u1"), ids=by_text, begins=np.searchsorted(a["unit_doc"], np.arange(hi - lo)), nodes=np.frombuffer(b"".join(nodes[lo:hi]), np.uint8)))]
                    for s, part in _by_shard(_shard(routes, shards)):
                        rows.append((s, home % salts if hot_ones else 0, home, _pack(of=part.astype("<u4"), size=np.array([len(keys[i][1]) // width for i in part], dtype="<u1"), low=low[part], route=_code(routes[part], shards), units=np.frombuffer(b"".join(keys[i][1] for i in part), raw_type))))
                    yield _rows(rows)

        return run

    def asked(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([b[4] for b in blobs]), np.concatenate([b[1] for b in blobs]).astype(np.int64), np.concatenate([b[2] for b in blobs]), np.concatenate([b[3] for b in blobs])

    def answers_by_home(blobs: list[list[np.ndarray]], answers: np.ndarray) -> Iterator[bytes]:
        at = np.cumsum([0, *(int(b[1].astype(np.int64).sum()) - (units.window - 1) * len(b[1]) for b in blobs)])
        for k, b in enumerate(blobs):
            part = answers[at[k] : at[k + 1]]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))  # neighbours mostly have one answer
            yield _pack(of=b[0], size=b[1], answer=part[first], times=np.diff(np.append(first, len(part))).astype("<u4"))

    def in_parts(raw: np.ndarray, size: np.ndarray, low: np.ndarray, route: np.ndarray) -> np.ndarray:
        """The kernel's answers, asked for some of the routes at a time."""
        n = -(-len(raw) * width // kernel_bytes)
        if n < 2:
            return kernel(raw, size, low, route)
        wins = size - units.window + 1
        begins, at = np.cumsum(size) - size, np.cumsum(wins) - wins
        out = np.empty(int(wins.sum()), dtype=np.int64)
        for _, part in _by_shard((route % np.uint32(n)).astype(np.int64)):
            out[_places(at[part], wins[part])] = kernel(raw[_places(begins[part], size[part])], size[part], low[part], route[part])
        return out

    def run_kernel(group: pa.Table) -> pa.Table:
        if group.column("shard")[0].as_py() < 0:
            return group
        homes, blobs = _blobs(group)
        return _table([(0, 0, home, b) for home, b in zip(homes, answers_by_home(blobs, in_parts(*asked(blobs))), strict=True)])

    def distinct_windows(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The kinds of single windows in these blobs: a place of each, and the kind of each window, in order."""
        raw = np.concatenate([b[4] for b in blobs]).tobytes()
        step, number = units.window * width, {}
        of = np.array([number.setdefault(raw[i : i + step], len(number)) for i in range(0, len(raw), step)], dtype=np.int64)
        one = np.empty(len(number), dtype=np.int64)
        one[of] = np.arange(len(of))
        return one, of

    def windows_of_salt(blobs: list[list[np.ndarray]]) -> bytes:
        raw, sizes, low, route = asked(blobs)
        one, _ = distinct_windows(blobs)
        return _pack(units=raw.reshape(-1, units.window)[one].ravel(), low=kernel(raw, sizes, low, route)[one], route=route[one])

    def windows_of_shard(sent: list[list[np.ndarray]]) -> list[bytes]:
        raw, low, route = (np.concatenate(x) for x in zip(*sent, strict=True))
        answers = merge(kernel(raw, np.full(len(low), units.window, dtype=np.int64), low, route), low)
        return [_pack(answer=a) for a in np.split(answers, np.cumsum([len(b[1]) for b in sent])[:-1])]

    def tell_windows(shard: int, blobs: list[list[np.ndarray]], verdict: list[np.ndarray]) -> Iterator[bytes]:
        return answers_by_home(blobs, verdict[0][distinct_windows(blobs)[1]])

    def to_windows(blobs: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        start, doc, of, n, ids, begins, nodes = _unpack(blobs[0])
        got = [_unpack(b) for b in blobs[1:]]
        if not got:
            return []
        start, doc, n = start.astype(np.int64), doc.astype(np.int64), n.astype(np.int64)
        number, size, answer, times = (np.concatenate(x) for x in zip(*got, strict=True))
        answer = np.repeat(answer, times)
        wins = size.astype(np.int64) - units.window + 1
        first = np.zeros(int(number.max()) + 1, dtype=np.int64)
        first[number] = np.cumsum(wins) - wins
        counts = settle(answer[_places(first[of], n)], np.repeat(ids[doc], n), np.repeat(np.bincount(of)[of], n))
        at, owner = _places(start, n)[counts], np.repeat(doc, n)[counts]
        raw_nodes = nodes.tobytes()
        return [(raw_nodes[16 * k : 16 * k + 16], _pack(at=np.sort(at[part]) - begins[k]), False) for k, part in _by_shard(owner)]

    with scratch(texts.sparkSession) as keep:
        anchors = in_small_batches(texts.select("node", "text")).mapInArrow(send_anchors, _ROWS).repartition(parts, "shard", "salt")
        mine = cut(_answered(in_two_steps(anchors, counted, repeated_ones, tell), parts, to_documents), "repeated")
        told = texts.join(mine, "node")
        cold = told.select("node", "least", "text", "blob").mapInArrow(send(False), _ROWS).repartition(parts, "shard").groupBy("shard").applyInArrow(run_kernel, _ROWS)
        with_hot = told.where("flag").select("node", "least", "text", "blob")
        hot = in_two_steps(with_hot.mapInArrow(send(True), _ROWS).repartition(parts, "shard", "salt"), windows_of_salt, windows_of_shard, tell_windows)
        # a home's records of the two kinds are apart, since each has its own numbering of segments
        return keep(cut(_answered(cold, parts, to_windows).unionAll(_answered(hot, parts, to_windows)).select("node", "blob"), "windows"))


def by_windows(texts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that found has blobs of (one or two a node), with them as an array, and all others. The table of texts is
    bucketed, so that only blobs move."""
    once = found.groupBy("node").agg(F.collect_list("blob").alias("blobs"))  # two at most
    return texts.join(once, "node"), texts.join(once.select("node"), "node", "left_anti")


def starts_in(blobs: list[bytes]) -> np.ndarray:
    """Sorted distinct starts of windows from a text's blobs."""
    return np.unique(np.concatenate([_unpack(b)[0] for b in blobs]))


def covered(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) of units that windows at the sorted starts cover."""
    if not len(starts):
        return starts, starts
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > starts[:-1] + window
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:] - 1, len(starts) - 1)] + window
