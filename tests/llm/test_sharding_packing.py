import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillbook.llm import packing, sharding
from tests.llm.helpers import SF, documents, empty, odd


def check_shards(rows, n):
    sizes = Counter(r.shard for r in rows)
    assert not rows or (set(sizes) <= set(range(n)) and max(sizes.values()) - min(sizes[k] for k in range(n)) <= 1)
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_shards_match_the_mixture(spark):
    rows = sharding.interleave(documents(spark).select("doc_id", "source"), 8).collect()
    check_shards(rows, 8)
    for source, n in Counter(r.source for r in rows).items():
        per = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(per[k] - n / 8) <= 2 for k in range(8))


def test_shards_of_odd_rows(spark):
    rows = sharding.interleave(odd(spark), 4).collect()
    assert len(rows) == 11
    check_shards(rows, 4)
    assert sharding.interleave(empty(spark), 4).collect() == []
    again = sharding.interleave(odd(spark).repartition(3), 4).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_query_columns(spark):
    df = sharding.op1_stratified_shards(spark, SF)
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in df.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def naive(counts, capacity):
    bins = []
    for n in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits, key=lambda b: b[0])[0] -= n
        else:
            bins.append([capacity - n])
    return sorted(b[0] for b in bins)


@pytest.mark.parametrize("counts", [{}, {5: 3}, {10: 4, 7: 3, 3: 5, 1: 2}, {6: 5, 4: 5, 5: 3, 2: 7, 1: 9}, {10: 2, 9: 1, 1: 1}])
def test_best_fit_decreasing_leaves_what_one_by_one_does(counts):
    runs, bins = packing.best_fit_decreasing(counts, 10)
    left = [10] * bins
    seen, spans = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, offset in runs:
        for r in range(lo, hi):
            seen[length].append(r)
            left[first + r - lo] -= length
            spans[first + r - lo].append((offset, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in counts.items()}
    assert sorted(left) == naive(counts, 10)
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length


def packed_ok(rows, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        start, k = 0, 0
        while start < len(ids):
            n = (len(ids) % 1024 or min(1024, len(ids))) if k == 0 else 1024
            part = b"".join(i.to_bytes(4, "little") for i in ids[start : start + n])
            want[doc_id, k, start, n, zlib.crc32(part)] += 1
            start, k = start + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_packing_round_trip(spark):
    rows = packing.op9_best_fit_packing(spark, SF).collect()
    packed_ok(rows, [(r.doc_id, r.text) for r in documents(spark).collect()])
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_ids_are_those_of_the_json_tokenizer():
    """On random Unicode, stretches of white space, code and every kind of special token's string."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.tokenizer(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    special = [x.content for x in t.get_added_tokens_decoder().values()]

    @settings(max_examples=600, deadline=None)
    @given(st.text() | st.text(alphabet=" \t\n\r\xa0\u2003\u200b\u0301\ufeffa1'’sßÅ") | st.lists(st.sampled_from([*special, "<|", "|>", "'s", "'LL", "don't", "  ", "\n\n", "x1", "١٢", "漢字", "é", "e\u0301", "🙂👍🏽", "\x00", "\U0010ffff"])).map("".join))
    def same(text):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids

    same()


def test_packing_of_odd_rows(spark):
    df = odd(spark).unionByName(odd(spark).limit(1).selectExpr("99L as doc_id", "'a<|endoftext|>b' as text", *[f"`{c}`" for c in odd(spark).columns if c not in ("doc_id", "text")]))
    packed_ok(packing.packed(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert packing.packed(empty(spark)).collect() == []
