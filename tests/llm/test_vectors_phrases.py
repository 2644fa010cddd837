import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillbook.llm import collocations, sentencepieces, whitening
from tests.llm.helpers import SF, documents, empty, odd

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_whitening(rows):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(distinct), distinct.sum(axis=0)
    covariance = np.cov(distinct.T.astype(float), bias=True)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1][:4], columns[:, ::-1][:, :4]
    return {i: (n, int(((n * np.array(x) - sums) ** 2).sum()), ((np.array(x) - sums / n) @ columns) / np.sqrt(values), values / np.trace(covariance)) for i, x in kept}


def check_whitening(got, rows, dims=4):
    want = brute_whitening(rows)
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert set(by) == set(want)
    for c in range(dims):
        ours, theirs = (np.array(x) for x in zip(*[(by[i][c + 1].whitened, want[i][2][c]) for i in want], strict=True))
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-9
    for i, (n, deviation, _, explained) in want.items():
        assert [(by[i][c + 1].n, by[i][c + 1].deviation) for c in range(dims)] == [(n, deviation)] * dims
        assert np.allclose([by[i][c + 1].explained for c in range(dims)], explained[:dims], rtol=1e-10)
        assert by[i][1].identity_error < 1e-10


def test_whitening_is_that_of_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(whitening.op11_whitening(spark, SF).collect(), rows)


def test_whitening_drops_odd_vectors_and_fits_each_copy_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]
    bad = [(2000, None), (2001, [float("nan")] + [1.0] * 5), (2002, [None] + [1.0] * 5), (2003, [float("inf")] * 6), (2004, []), (2005, [1.0, 2.0])]
    got = whitening.whitened(vectors(spark, rows + bad)).collect()
    check_whitening(got, rows)
    assert len(got) == 500 * 4


def test_whitening_of_large_entries_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(3) * 3e5]) for i in range(50)]
    distinct = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*distinct, strict=True)]
    want = {i: sum((50 * x - s) ** 2 for x, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, distinct, strict=True)}
    got = {r.vec_id: r.deviation for r in whitening.whitened(vectors(spark, rows)).collect()}
    assert got == want and max(want.values()) > 1 << 62 or all(v is None or v == want[k] for k, v in got.items())
    huge = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])]
    assert {r.vec_id: r.deviation for r in whitening.whitened(vectors(spark, huge)).collect()} == {1: None, 2: None, 3: 589825}


def test_whitening_has_as_many_components_as_the_vectors_directions(spark):
    flat = [(i, [float(i), float(2 * i), 1.0]) for i in range(20)]
    got = whitening.whitened(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert whitening.whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    assert whitening.whitened(vectors(spark, [])).collect() == []
    clash = vectors(spark, flat).selectExpr("vec_id", "embedding", "1 as N", "'x' as vector_", "2 as `whitened`")
    assert len(whitening.whitened(clash).collect()) == 20 and "vector_" in whitening.whitened(clash).columns


@pytest.mark.parametrize("values", [[9, 9, 9, 9, 9, 1, 1, 0, 0, 0], [5, 0, 0, 0, 0, 0, 0, 0, 0, 0], list(range(10)), [1e12, 1, 1e-6, 0, 0, 0, 0, 0, 0, 0]])
def test_lanczos_restarts_on_breakdown(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((10, 10)))
    operator = q @ np.diag(np.array(values, dtype=float)) @ q.T
    found, columns = whitening.block_lanczos(lambda b: operator @ b, 10, 4)
    assert np.allclose(found, sorted(values, reverse=True)[:4], atol=1e-12 * max(values))
    assert np.allclose(columns.T @ columns, np.eye(4), atol=1e-12)
    assert np.linalg.norm(operator @ columns - columns * found) < 1e-11 * max(values)


def test_lanczos_of_a_wide_operator_needs_few_passes():
    rng, passes = np.random.default_rng(2), []
    x = rng.standard_normal((500, 400)) * np.geomspace(50, 0.1, 400)
    found, columns = whitening.block_lanczos(lambda b: passes.append(1) or x.T @ (x @ b), 400, 4)
    want, directions = np.linalg.eigh(x.T @ x)
    assert np.allclose(found, want[::-1][:4], rtol=1e-12) and len(passes) < 40
    assert np.allclose(np.abs((columns * directions[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-12)


# sentence pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def encode(texts):
    ids, lengths = sentencepieces.Encoder(PIECES).encode(texts)
    ends = np.cumsum(lengths)
    return [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)], sentencepieces.decode(PIECES, ids, lengths)


def same_as_library(library, texts):
    got, back = encode(texts)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert got == want
    assert [b.decode() for b in back] == [library.decode(w) for w in want]


def test_pieces_of_odd_texts(library):
    same_as_library(library, ["", " ", "a", "  a  b ", "▁ x▁▁y", "a\x00b\U0010ffff�", "<s></s><unk><0x41>", "\r\n\t\n", "日本語テキスト", "x" * 3000, "ab" * 3000, " ".join("long words" for _ in range(3000))])
    same_as_library(library, [" " * k + "the" * (k % 2) + " " * (200 - k) for k in range(0, 200, 3)])


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=60), st.text("abcdeéABC 01\n▁", max_size=80), st.lists(st.sampled_from(["the", "and", " ", "  ", "in", "er", "▁", "ing", "1", "é", "日"]), max_size=40).map("".join)), min_size=1, max_size=8))
def test_pieces_are_the_librarys(library, texts):
    same_as_library(library, texts)


def test_joined_pieces_are_encoded_as_the_library_does(library):
    rnd = random.Random(7)
    pieces = [library.id_to_piece(k) for k in range(259, 32000)]
    same_as_library(library, ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(2000)])


def test_any_ids_are_decoded_as_the_library_does(library):
    rnd = random.Random(9)
    kinds = (lambda: rnd.randrange(0, 3), lambda: rnd.randrange(3, 259), lambda: rnd.randrange(195, 250), lambda: rnd.randrange(259, 32000), lambda: 259)
    rows = [[rnd.choice(kinds)() for _ in range(rnd.randint(0, 12))] for _ in range(5000)]
    got = sentencepieces.decode(PIECES, np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]))
    assert [g.decode() for g in got] == [library.decode(r) for r in rows]


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_SYMBOLS", 20)
    encoder = sentencepieces.Encoder(PIECES)
    for texts in (["one two three four", "two"], ["two five six seven eight nine ten", ""], ["one"]):
        ids, lengths = encoder.encode(texts)
        ends = np.cumsum(lengths)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == library.encode(texts, add_bos=True, add_eos=True)


def test_pieces_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    for r in sentencepieces.op12_sentencepieces(spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark, library):
    rows = sentencepieces.encoded(odd(spark), PIECES, ["n_tokens", "ids", "decoded"]).collect()
    assert len(rows) == 11
    assert sorted(str((r.doc_id, r.ids)) for r in rows) == sorted(str((r.doc_id, library.encode(r.text or "", add_bos=True, add_eos=True))) for r in odd(spark).collect())
    assert sentencepieces.encoded(empty(spark), PIECES, ["ids"]).collect() == []
    back = sentencepieces.decoded(spark.createDataFrame([(1, [1, 450, None, 2]), (2, None), (3, [])], "doc_id long, ids array<int>"), PIECES).collect()
    assert sorted((r.doc_id, r.decoded) for r in back) == [(1, library.decode([1, 450, 2])), (2, ""), (3, "")]


# collocations


def brute_collocations(rows, least, longest=5, top=2000):
    """Counts every phrase of every piece one by one."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def collocated(df, **more):
    return sorted(map(tuple, collocations.collocations(df, **more).collect()))


def made_up(seed):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "time", "é", "x1", "a", "b", "c"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "\r\n", "\x1c"]) for _ in range(rnd.randint(0, 60)))
    return [(text(), rnd.choice(["en", "en", None, "de"])) for _ in range(150)] + [("boiler plate of the time. " * 9, "en")] * 30


@pytest.mark.parametrize("block", [64, 1000, 16 << 20])
def test_collocations_are_those_counted_one_by_one(spark, block):
    rows = made_up(block)
    got = collocated(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=10, block_bytes=block)
    assert got == brute_collocations(rows, 10) and len({r[0] for r in got}) == 3


def test_first_of_each_language(spark):
    rows = made_up(1)
    assert collocated(spark.createDataFrame(rows, "text string, lang string"), least=5, top=3) == brute_collocations(rows, 5, top=3)


def test_collocations_of_odd_rows(spark):
    rows = [(r.text, r.lang) for r in odd(spark).collect()]
    assert collocated(odd(spark), least=30) == brute_collocations(rows, 30)
    assert collocated(empty(spark)) == []
    assert collocated(spark.createDataFrame([("one two", "en")], "text string, lang string")) == []


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", ["a"], 4_000_000_000_000), ("en", ["b"], 3_000_000_000_001), ("en", ["a", "b"], 2_999_999_999_999)], "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000_000)], "lang string, n long")
    (r,) = collocations.scored(found, totals).collect()
    assert r.score == 1000 * 2_999_999_999_999 * 9_000_000_000_000_000 // (4_000_000_000_000 * 3_000_000_000_001)
