import itertools
import math
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np

from quillbook.llm import decontamination as dc
from quillbook.llm import extraction, html_tree, langid
from tests.llm.helpers import SF, documents, empty, odd


def test_language_of_held_out_texts(spark):
    langs = {r.doc_id: r.lang for r in documents(spark).collect()}
    rows = langid.op8_language_id(spark, SF).collect()
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.97


def test_language_of_odd_rows(spark):
    names, p = langid.learn(documents(spark))
    rows = langid.identify(odd(spark), names, p).collect()
    und = {r.text for r in rows if r.lang_pred == "und"}
    assert len(rows) == 11 and und == {None, "", "   \n\t"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.identify(empty(spark), names, p).collect() == []
    names, p = langid.learn(empty(spark))
    assert names == [] and {r.lang_pred for r in langid.identify(odd(spark), names, p).collect()} == {"und"}


def test_rare_languages_are_learned_in_full_beside_large_ones(spark):
    large = [(None if i % 2 else i, f"the {i} of {i * 7} hills was at place {chr(97 + i % 26)}{i}", ("en", "de")[i % 2]) for i in range(3000)]
    rare = [(9001, "Ο ήλιος ανατέλλει πάνω από τη θάλασσα", "el"), (9002, "Καλημέρα στην πόλη και στη θάλασσα", "el")]
    df = spark.createDataFrame(large + rare, "doc_id long, text string, lang string")
    names, p = langid.learn(df, rows=40)
    all_names, all_p = langid.learn(df)
    assert names == all_names == ["de", "el", "en"]
    assert np.allclose(p[1], all_p[1]) and not np.allclose(p[0], all_p[0]) and not np.allclose(p[2], all_p[2])  # large ones are still sampled
    assert langid.identify(df.where("doc_id = 9001"), names, p).first().lang_pred == "el"


def test_bundles_are_sums_of_bound_letters():
    v = dict(zip("abc", langid.letter_vectors(np.array([97, 98, 99])), strict=True))
    want = np.roll(v["a"], 2) * np.roll(v["b"], 1) * v["c"]
    assert (langid.gram_vectors(np.array([(97 << 42) | (98 << 21) | 99])) == want).all()
    assert abs(np.dot(v["a"], v["b"])) / langid.DIMENSIONS < 0.15


def naive_vector(text):
    """The same profile by loops over letters: n-gram by n-gram, rolled and multiplied."""
    s, out = "\0", np.zeros(langid.DIMENSIONS)
    for c in text.lower():
        c = c if c.isalpha() else "\0"
        s += c if c != "\0" or s[-1] != "\0" else ""
    s += "" if s[-1] == "\0" else "\0"
    if s == "\0":
        return out
    vector = {c: langid.letter_vectors(np.array([ord(c)]))[0].astype(float) for c in set(s)}
    for i in range(len(s) - 2):
        out += np.roll(vector[s[i]], 2) * np.roll(vector[s[i + 1]], 1) * vector[s[i + 2]]
    return out / max(np.linalg.norm(out), 1e-12)


def test_predictions_are_those_of_naive_profiles(spark):
    df = documents(spark).limit(60).unionByName(spark.createDataFrame([(900, "a", None), (901, "12 34", "en"), (902, None, "en"), (903, "İstanbul'da ǅ ñ é", "tr")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    rows = df.collect()
    sums = {}
    for r in rows:
        if r.text and r.lang:
            sums[r.lang] = sums.get(r.lang, 0) + naive_vector(r.text)
    names, p = langid.learn(df)
    assert names == sorted(k for k, v in sums.items())
    for k, n in enumerate(names):
        assert np.allclose(p[k], sums[n] / max(np.linalg.norm(sums[n]), 1e-12), atol=1e-4)
    got = {r.doc_id: r for r in langid.identify(df, names, p).collect()}
    for r in rows:
        v = naive_vector(r.text or "")
        cosines = [float(v @ sums[n]) / max(np.linalg.norm(sums[n]), 1e-12) for n in names]
        if not v.any():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
        else:
            best = cosines[names.index(got[r.doc_id].lang_pred)]
            assert best >= max(cosines) - 1e-4 and abs(got[r.doc_id].score - max(0, best)) < 1e-4


def article(html):
    a = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split())


def test_extraction_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = extraction.op3_boosted_extraction(spark, SF).collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert np.mean([r.text == want[r.page_id] for r in rows]) >= 0.98


def test_extraction_of_unseen_made_up_pages():
    rng, ok = random.Random(4711), 0
    model = extraction.trained()
    for _ in range(100):
        page = html_tree.read(extraction.synthetic_page(rng))
        main = [False] * len(page.tag)
        for k in range(1, len(page.tag)):
            y = page.attrs[k].get("data-y")
            main[k] = y == "1" if y is not None else main[page.parent[k]]
        want = extraction.main_text(page, [m and not s for m, s in zip(main, page.silent, strict=True)])
        ok += want == extraction.main_text(page, extraction.decode(page, model.predict(extraction.features(page))))
    assert ok >= 93


def test_decoding_is_the_likeliest_consistent_labelling():
    """Against all labellings of small trees, on arbitrary chances."""
    rng = random.Random(3)
    for _ in range(60):
        page, n = html_tree.Page(), rng.randint(2, 9)
        for k in range(1, n):
            page.tag.append("div")
            page.parent.append(rng.randrange(k))
            page.attrs.append({})
            page.silent.append(False)
        page.chunks = [(k, "x") for k in range(n) if rng.random() < 0.7] or [(0, "x")]
        chance = np.array([rng.random() for _ in range(n)])
        filled = {k for k, _ in page.chunks}
        for k in range(n - 1, 0, -1):
            if k in filled:
                filled.add(page.parent[k])
        like = lambda keep: sum(math.log(chance[k] if keep[k] else 1 - chance[k]) for k in filled if k)
        every = [(True, *x) for x in itertools.product([False, True], repeat=n - 1)]
        best = max(like(x) for x in every if all(x[page.parent[k]] for k in range(1, n) if x[k]))
        kept = extraction.decode(page, chance)
        assert all(kept[page.parent[k]] for k in range(1, n) if kept[k]) and abs(like(kept) - best) < 1e-9


def text_of(html):
    page = html_tree.read(html)
    return extraction.main_text(page, extraction.decode(page, extraction.trained().predict(extraction.features(page))))


def test_ordinary_flaws_of_pages():
    prose = " ".join(f"Word{k} of a sentence that goes on, and ends." for k in range(25))
    article = lambda inner: f'<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><article><h1>Title</h1>{inner}</article><footer>&copy; Site</footer></body></html>'
    want = f"Title {prose}"
    assert text_of(article(f'<p class="x>{prose}</p>')) == want
    assert text_of(article(f"<p class='x>{prose}</p><p title=\"a > b\">more of it.</p>")) == f"{want} more of it."
    assert text_of(article(f'<p>{prose} <span class="ad">Buy this now</span></p>')) == want
    assert text_of(article(f'<p>{prose} <span class="note">kept</span></p>')) == f"{want} kept"
    assert text_of(f'<html><body><form method="post" action="/x"><div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div><div class="content"><h1>Title</h1><p>{prose}</p><p>{prose}</p></div></form></body></html>') == f"{want} {prose}"


def test_names_of_articles_may_hold_any_word():
    prose = " ".join(f"Word{k} of a sentence that goes on, and ends." for k in range(25))
    for name in ("ad-free story", "tag-python post", "post author-bob", "rating-5", "form entry", "share search"):
        for tag in ("article", "div"):
            page = f'<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><{tag} class="{name}"><h1>T</h1><p>{prose}</p><p>{prose}</p></{tag}><footer><p>&copy; x</p></footer></body></html>'
            assert text_of(page) == f"T {prose} {prose}"


def test_reading_takes_linear_time():
    import time

    def took(make, n):
        page = make(n)
        at = time.perf_counter()
        html_tree.read(page)
        return time.perf_counter() - at

    for make in (lambda n: "<div>" * n + "</span>" * n, lambda n: "<b>" * n + "<div>x" * n, lambda n: "<b>" * n + "<hr><p>" * n, lambda n: "<div><table>" + "<td><i>" * n + "</div>" * n, lambda n: "<li>x<ul>" * n, lambda n: "<p class='x>" * n, lambda n: f"<p {'a' * n}>", lambda n: "<p " + "a " * n + ">", lambda n: "<p " + 'a="' * n + ">", lambda n: "<p a" + " " * n + "b>"):
        took(make, 500)
        small = min(took(make, 4000) for _ in range(2))
        assert took(make, 32_000) < 8 * 4 * small + 0.3


def test_extraction_of_odd_pages(spark):
    html = [None, "", "plain", "<p>a<p>b &amp; c", "<div>" * 3000 + "x", "<script>if(a<b)", "<!-- open", "<b>x</b>y", "<table><tr><td>1<td>2</table>", "<p " * 50]
    df = spark.createDataFrame([(i, h, "x", "y") for i, h in enumerate(html)], "page_id long, html string, Text string, n_chars string")
    rows = {r.page_id: r for r in extraction.extract(df).collect()}
    assert len(rows) == len(html) and rows[0].text == rows[1].text == rows[5].text == "" and all(r.n_chars == len(r.text) for r in rows.values())
    assert extraction.extract(df.limit(0)).collect() == []
    page = html_tree.read("<p>a<b>b</b>c<br>d &eacute;\n  e<p>f")
    assert extraction.main_text(page, [True] * len(page.tag)) == "abc d é e f"


def items():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("ana", "olo", "iti", "um")] + ["the", "of", "a"] * 3
    return [(k, " ".join(rng.choices(words, k=rng.randint(8, 40))) + "? " + " ".join(rng.choices(words, k=rng.randint(1, 6)))) for k in range(80)], rng, words


def indexed(bench):
    frequency = Counter(t for _, x in bench for t in set(dc.terms(x)))
    return dc.Index(bench, frequency, len(bench), np.mean([len(dc.terms(x)) for _, x in bench]))


def brute_hits(docs, bench):
    """Every passage against every item, by BM25's formula and the definition of the overlaps."""
    tf = {k: Counter(dc.terms(x)) for k, (_, x) in enumerate(bench)}
    df = Counter(t for c in tf.values() for t in c)
    mean, out = sum(c.total() for c in tf.values()) / len(bench), set()
    for k, (item, text) in enumerate(bench):
        if not tf[k]:
            continue
        n = tf[k].total()
        w = {t: math.log(1 + (len(bench) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) for t, f in tf[k].items()}
        parts = dc.question_and_answer(text)
        for doc, body in docs:
            for _, window in dc.passages(dc.terms(body or ""), dc.step_of(n)):
                there = set(window)
                if sum(x for t, x in w.items() if t in there) >= 0.5 * sum(w.values()) - 1e-9:
                    if all(dc.overlap(p, window) >= 0.5 for p in parts):
                        out.add((doc, item))
    return out


def test_search_finds_what_scoring_everything_finds():
    bench, rng, words = items()
    index = indexed(bench)
    (postings,) = index.postings
    for _ in range(150):
        text = rng.choices(words, k=60)
        if rng.random() < 0.6:
            text += dc.terms(rng.choice(bench)[1])[: rng.randint(4, 40)]
        query = sorted({index.vocabulary[t] for t in text if t in index.vocabulary})
        want = []
        for k in range(len(postings.ids)):
            s = sum(w for t in query for i, w in zip(*postings.of(t)[:2], strict=True) if i == k)
            if s >= dc.THETA - 1e-9:
                want.append(k)
        assert sorted(k for k, _ in postings.search(query)) == want
        found = np.array([index.vocabulary.get(t, -1) for t in text])
        postings.step = 10**6
        worth = postings.passages_worth_a_search(found, np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64))
        assert not want or len(worth) == 1


def with_leaks():
    bench, rng, _ = items()
    filler = lambda n: " ".join(f"q{rng.randint(0, 999)}" for _ in range(n))
    bench.append((900, filler(700) + "? " + filler(20)))  # a long item has its own passages
    clean = [(i, filler(200)) for i in range(20)]
    dirty = [(100 + k, clean[k % 20][1] + " " + bench[k][1].upper() + "! " + clean[3][1]) for k in range(30)]
    half = [(200 + k, clean[k][1] + " " + bench[k][1].split("?")[0]) for k in range(5)]
    apart = [(300 + k, bench[40 + k][1].split("?")[0] + "? " + filler(900) + bench[40 + k][1].split("?")[1]) for k in range(5)]
    return bench, clean + dirty + half + apart + [(400, filler(900) + bench[-1][1] + filler(50)), (401, None), (402, "")]


def test_hits_depend_on_document_and_item_only(spark):
    bench, rows = with_leaks()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = lambda items, size=dc.INDEX_BYTES: sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), size).collect())
    want = hits(bench)
    assert set(want) == brute_hits(rows, bench) and len(want) == len(set(want))
    assert {(100 + k, k) for k in range(30)} <= set(want) and (400, 900) in want and not any(d < 100 for d, _ in want)
    # an answer of several words, out of the passage's reach, doesn't count
    assert not any(d == 300 + k and i == 40 + k for d, i in want for k in range(5) if len(dc.terms(bench[40 + k][1].split("?")[1])) > 2)
    for size in (300, 2000, 10_000):  # many indexes, several, two
        assert hits(bench, size) == want
    assert hits([b for b in bench if b[0] != 900]) == [x for x in want if x[1] != 900]
    assert hits([b for b in bench if b[0] % 2 == 0]) == [x for x in want if x[1] % 2 == 0]


def test_items_with_ids_of_any_type(spark):
    bench, rows = with_leaks()
    df = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(f"set-{k}", x) for k, x in bench], "item_id string, text string"))
    assert {(r.doc_id, r.item_id) for r in df.collect()} == {(d, f"set-{k}") for d, k in brute_hits(rows, bench)}


def test_verbatim_leaks_of_the_tables(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in documents(spark).collect() for b in bench if b.text in d.text}
    assert {(r.doc_id, r.item_id) for r in dc.op7_benchmark_hits(spark, SF).collect()} == want


def test_hits_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "copy0 copy1 copy2 copy3 copy4 copy5 copy6? copy7 copy8"), (2, None), (3, ""), (4, "?"), (1, "unrelated words here? yes")], "item_id long, text string")
    assert {r.doc_id for r in dc.contaminated(odd(spark), bench).collect()} == {4, 5, None}
    assert dc.contaminated(odd(spark), bench.limit(0)).collect() == [] and dc.contaminated(empty(spark), bench).collect() == []
