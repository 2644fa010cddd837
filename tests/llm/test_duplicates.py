import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillbook.llm import neardup, relative_lz, repeats, shingles, suffixes
from quillbook.llm.components import components
from tests.llm.helpers import SF, WORD, documents, empty, odd


def shingle_weights(text):
    """A shingle that occurs c times weighs 1 + ln c."""
    w = WORD.findall(text or "")
    found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    return {g: 1 + math.log(c) for g, c in found.items()}


def brute_links(rows):
    """All pairs of similarity 0.8 or more."""
    sets, index = {i: shingle_weights(t) for i, t in rows}, defaultdict(list)
    total = {i: sum(s.values()) for i, s in sets.items()}
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    both = Counter()
    for g, v in index.items():
        for k, a in enumerate(v):
            for b in v[k + 1 :]:
                both[a, b] += min(sets[a][g], sets[b][g])
    return {(a, b) for (a, b), c in both.items() if c >= 0.8 * (total[a] + total[b] - c) - 1e-9}


def brute_classes(rows):
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    by_text = {}
    same = [(i, by_text.setdefault(t, i)) for i, t in rows if t is not None]
    for a, b in [*same, *brute_links(rows)]:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def edited(rng, words, n):
    out = list(words)
    for p in rng.sample(range(len(out)), n):
        out[p] = f"edit{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_classes_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert {r.doc_id: r.class_id for r in neardup.op5_dart_minhash(spark, SF).collect()} == brute_classes(rows)


def test_recall_of_near_copies(spark):
    """Copies with so many edits that their similarities lie on both sides of 0.8, some with repeated lines: of the pairs at
    or above it, the share that ends in one class."""
    rng, rows = random.Random(12), []
    for g in range(60):
        words = [f"g{g}w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 400))]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 5):
            rows.append((10 * g + k, edited(rng, words, rng.randint(1, max(2, len(words) // 25)))))
        line = " ".join(words[:12])
        rows += [(10 * g + 5, " ".join(words) + ("\n" + line) * rng.randint(1, 9)), (10 * g + 6, (line + "\n") * rng.randint(2, 30) + " ".join(words))]
    got = {r.id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = brute_links(rows)
    assert len(pairs) > 300 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    want = brute_classes(rows)
    assert all(want[i] == want[c] for i, c in got.items())


def test_groups_near_the_threshold(spark):
    """Copies of one text with a few edits each: some pairs reach 0.8, most fall short."""
    rng, rows = random.Random(8), []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(120)]
        rows += [(g * 1000 + k, edited(rng, base, rng.randint(1, 4))) for k in range(60)]
    rows += [(5000 + k, " ".join(f"s{k}x{j}" for j in range(50)) + " " + " ".join(f"common{j}" for j in range(60))) for k in range(50)]
    got = {r.id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_classes_of_odd_rows(spark):
    rows = neardup.near_duplicates(odd(spark)).collect()
    assert len(rows) == 11
    by = defaultdict(set)
    for r in rows:
        by[r.id].add(r.class_id)
    assert by[4] == by[5] == {4} and by[1] == {1} and by[2] == {2} and by[None] == {4, None}
    assert neardup.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("weighted", [False, True])
def test_darts_estimate_weighted_similarity(weighted):
    rng = np.random.default_rng(2)
    n = 300
    e = shingles.mix(np.arange(1, n + 101, dtype=np.uint64))
    x, y = np.zeros(n + 100), np.zeros(n + 100)
    x[:n] = rng.integers(1, 4, n) * rng.random(n) if weighted else 1
    y[100:] = x[100:] if not weighted else np.where(x[100:] > 0, x[100:] * 1.3, 0.7)
    y[100:] = np.where(y[100:] > 0, y[100:], 1)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    el = np.concatenate([e[x > 0], e[y > 0]])
    doc = np.repeat([0, 1], [(x > 0).sum(), (y > 0).sum()])
    sig = neardup.signatures(el, doc, np.concatenate([x[x > 0], y[y > 0]]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_what_is_not_needed_is_removed(spark):
    from quillbook.llm import common

    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(60)) + f" {i % 3}") for i in range(9)], "doc_id long, text string")
    before = set(common._there)
    out = neardup.near_duplicates(df)
    left = {p.split("/")[-1].split("-")[0] for p in set(common._there) - before}
    assert left == {"sketches", "nodes", "links", "labels"} and out.count() == 9
    suffixes.without_copied_bytes(df).count()
    common.release(spark)
    assert not common._there and not [t for t in spark.catalog.listTables() if t.name.startswith("quillbook_")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[root(a)] = root(b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert len({(root(n), got[n]) for n in nodes}) == len({root(n) for n in nodes}) == len({got[n] for n in nodes})


def brute_bytes(rows):
    first, out = {}, {}
    key = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, (True, 0)), key(i))
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                m[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out[i, t] = (len(b), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest())
    return out


def brute_words(rows):
    count, out = Counter(), {}
    words = [WORD.findall(t or "") for _, t in rows]
    for w in words:
        count.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    for (i, t), w in zip(rows, words, strict=True):
        m = bytearray(len(w))
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                m[p : p + 35] = b"\1" * 35
        kept = " ".join(x for x, y in zip(w, m, strict=True) if not y)
        out[i, t] = (len(w), sum(m), hashlib.sha256(kept.encode()).hexdigest())
    return out


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "ñandú", "a"]) if rng.random() < 0.4 else f"w{rng.randint(0, 400)}"
    passages = [" ".join(word() for _ in range(n)) for n in (12, 36, 60, 90, 35, 34)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(word() for _ in range(rng.randint(0, 30)))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "x" * 500), (201, "x" * 300), (202, "z " * 90), (203, ("one two three " * 40)), (204, rows[5][1]), (205, rows[5][1]), (3000, passages[3] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=["plain", "hot", "salted"])
def routes(request, monkeypatch):
    """Anchors go by their segments, or by single windows, or by those over many salts and chunks."""
    if request.param != "plain":
        monkeypatch.setattr(repeats, "HOT", 3)
    if request.param == "salted":
        for name, size in (("CHUNK_BYTES", 3000), ("SHARD_BYTES", 1000), ("SALT_BYTES", 15_000)):
            monkeypatch.setattr(repeats, name, size)


def spans_fit(raw, kept, spans, join):
    out, at = [], 0
    for s in spans:
        assert s["from"] >= at and s["to"] > s["from"]
        out.append(raw[at : s["from"]])
        at = s["to"]
    return join([*out, raw[at:]]) == kept


def by_bytes(df, texts):
    out = {}
    for r in suffixes.without_copied_bytes(df).collect():
        assert spans_fit((texts[r.doc_id] or "").encode(), bytes(r.kept), r.spans, b"".join)
        out[r.doc_id] = (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
    return out


def by_words(df, texts):
    out = {}
    for r in relative_lz.without_repeated_words(df).collect():
        assert spans_fit(WORD.findall(texts[r.doc_id] or ""), r.kept, r.spans, lambda parts: " ".join(w for p in parts for w in p))
        out[r.doc_id] = (r.n_words, sum(s["to"] - s["from"] for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest())
    return out


def test_bytes_against_brute_force(spark, routes):
    rows = planted()
    assert by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), dict(rows)) == {i: v for (i, _), v in brute_bytes(rows).items()}


def test_words_against_brute_force(spark, routes):
    rows = planted(4)
    assert by_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), dict(rows)) == {i: v for (i, _), v in brute_words(rows).items()}


def test_ids_that_are_strings(spark):
    rows = [(f"d{i}", t) for i, t in planted(4)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert by_words(df, dict(rows)) == {i: v for (i, _), v in brute_words([(i, t) for i, t in rows]).items()}
    with pytest.raises(ValueError):
        suffixes.without_copied_bytes(df)


def test_byte_and_word_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for query, sql in ((suffixes.op6_induced_suffixes, suffixes.OP6_SQL), (relative_lz.op10_relative_lz, relative_lz.OP10_SQL)):
        df = query(spark, SF)
        want = con.sql(f"select {', '.join(df.columns)} from ({sql})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)


def test_removal_from_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    small = [(i, t) for i, t in rows if i != 3]
    df = odd(spark).where("doc_id is null or doc_id <> 3")
    bytes_, words = brute_bytes(small), brute_words(small)
    assert sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans)) for r in suffixes.without_copied_bytes(df).collect()) == sorted(bytes_[i, t][:3] for i, t in small)
    assert sorted((r.n_words, hashlib.sha256(r.kept.encode()).hexdigest()) for r in relative_lz.without_repeated_words(df).collect()) == sorted((words[i, t][0], words[i, t][2]) for i, t in small)
    assert suffixes.without_copied_bytes(odd(spark)).count() == relative_lz.without_repeated_words(odd(spark)).count() == 11
    assert suffixes.without_copied_bytes(empty(spark)).collect() == [] and relative_lz.without_repeated_words(empty(spark)).collect() == []


@pytest.mark.parametrize("memory,block", [(10**9, 1 << 17), (500, 64)])
def test_suffix_order_and_shared_bytes(monkeypatch, memory, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = np.random.default_rng(1)
    for trial in range(8):
        parts = [rng.integers(1, 2 + trial % 4, rng.integers(1, 200)) for _ in range(5)]
        parts += [parts[0], parts[1][:50], np.full(90, 2), np.full(60, 2)]
        t = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint8)
        got = list(suffixes.induced_order(t, 50, memory))
        order, shared = (np.concatenate(x).tolist() for x in zip(*got, strict=True))
        assert sorted(order) == list(range(len(t) - 1))
        cut = [t.tobytes()[i : i + 50] for i in order]
        assert cut == sorted(cut, reverse=True)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared == [0, *(common(a, b) for a, b in zip(cut, cut[1:], strict=False))]


def test_a_shard_of_ten_times_the_memory():
    rng = np.random.default_rng(2)
    sizes = rng.integers(50, 90, 6000)
    pool = rng.integers(97, 123, (40, 90)).astype(np.uint8)
    units = np.concatenate([np.roll(pool[rng.integers(40)], -rng.integers(9))[:n] if rng.random() < 0.5 else rng.integers(97, 123, n).astype(np.uint8) for n in sizes])
    low = rng.permutation(6000)
    limit = int(sizes.sum()) // 10
    queue, made = suffixes.SuffixQueue, []

    class Watched(queue):
        def __init__(self, memory):
            super().__init__(memory)
            made.append(self)

        def push(self, *args):
            super().push(*args)
            assert self.held <= limit

    suffixes.SuffixQueue = Watched
    try:
        few = suffixes.sorted_least(units, sizes, low, limit)
    finally:
        suffixes.SuffixQueue = queue
    assert sum(q.spills for q in made) > 3
    assert (few == suffixes.sorted_least(units, sizes, low)).all()
    first, want = {}, []
    at = np.cumsum(sizes) - sizes
    strings = [units[a + k : a + k + 50].tobytes() for a, n in zip(at, sizes, strict=True) for k in range(n - 49)]
    owner = np.repeat(low, sizes - 49)
    for s, o in zip(strings, owner.tolist(), strict=True):
        first[s] = min(o, first.get(s, o))
    want = [first[s] for s in strings]
    assert few.tolist() == want


def test_factors_are_greedy_and_windows_over_their_ends_are_found():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 10**6, 400).astype(np.uint64)
    segments = [base[:100], base[20:90], base[200:300], base[150:280], base[60:100], np.concatenate([base[80:100], base[200:230]]), base[330:380], np.tile(base[390:393], 20)]
    block, sizes = np.concatenate(segments), np.array([len(s) for s in segments])
    index = relative_lz.Block(block, sizes)
    start, length, source = relative_lz.parse(index)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    assert start[0] == 0 and (start[1:] == start[:-1] + length[:-1]).all() and start[-1] + length[-1] == len(block)

    def longest(p):
        best = 0
        for q in range(len(block)):
            n = 0
            while q != p and max(p, q) + n < len(block) and owner[p + n] == owner[p] and owner[q + n] == owner[q] and block[p + n] == block[q + n]:
                n += 1
            best = max(best, n)
        return best

    for a, n, s in zip(start.tolist(), length.tolist(), source.tolist(), strict=True):
        want = longest(a)
        assert n == max(1, want) and (s == -1) == (want == 0)
        assert s == -1 or (s != a and (block[a : a + n] == block[s : s + n]).all())
    windows = [tuple(s[k : k + 35].tolist()) for s in segments for k in range(len(s) - 34)]
    count = Counter(windows)
    assert relative_lz.elsewhere(block, sizes, None, None).tolist() == [int(count[w] > 1) for w in windows]
