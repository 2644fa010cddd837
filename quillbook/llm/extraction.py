"""Main-text extraction: boosted trees over DOM nodes, decoded so that no node is kept whose ancestor is dropped.

The trees give each block element the chance that it holds main text. A labelling is consistent if below a dropped node
everything is dropped; the likeliest consistent labelling is found exactly, from the leaves to the root.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillbook.llm.boosting import Boosted
from quillbook.llm.common import in_small_batches, table
from quillbook.llm.html_tree import Page, read

#: Bound of the synthetic pages that the trees learn from.
LEARN_PAGES = 1000
#: Attribute tokens that tell of main text or of something else.
GOOD = "article post entry content main story body text blog hentry page prose".split()
BAD = "nav menu sidebar side footer foot header masthead ad ads advert advertisement sponsor sponsored banner promo cookie cookies notice consent gdpr alert comment comments respond reply disqus share social related recommended widget breadcrumb breadcrumbs newsletter subscribe signup modal popup login search form toolbar pager pagination tags tag copyright legal skip teaser outbrain taboola meta byline author rating".split()
TAGS = "article main section div p h1 h2 h3 nav header footer aside ul ol li table tr td th blockquote pre figure figcaption dl form body html address details".split()
WITHIN = "article main nav header footer aside ul table li blockquote".split()
_WORDS = re.compile(r"[a-z]+")
_GOOD, _BAD, _TAG = frozenset(GOOD), frozenset(BAD), {t: i for i, t in enumerate(TAGS)}
_WITHIN = {t: i for i, t in enumerate(WITHIN)}


@lru_cache(maxsize=65536)
def tokens(value: str) -> tuple[float, float]:
    found = set(_WORDS.findall(value))
    return float(len(found & _GOOD)), float(len(found & _BAD))


def features(page: Page) -> np.ndarray:
    """A row for each node: its tag, depth, attribute tokens, subtree text, density and links, place among its siblings."""
    n, parent = len(page.tag), page.parent
    own, stops, paragraphs = [0.0] * n, [0.0] * n, [0.0] * n
    for node, chunk in page.chunks:
        if chunk is not None:
            s = chunk.strip()
            if s:
                own[node] += len(s)
                stops[node] += s.count(". ") + s.count(",") + (s[-1] in ".!?")
    size, links, count, stop = own[:], [float(x) for x in page.links], [1.0] * n, stops[:]
    kids, silent_kids = [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        size[p] += size[k]
        links[p] += links[k]
        count[p] += count[k]
        stop[p] += stop[k]
        paragraphs[k] += page.tag[k] == "p" and own[k] > 0
        paragraphs[p] += paragraphs[k]
        kids[p] += 1
        silent_kids[p] += page.tag[k] in ("form", "input", "button", "label")
    depth, good, bad, over_good, over_bad, place = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    seen, within, hidden = [0] * n, [0] * n, [0.0] * n
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        a = page.attrs[k]
        if a:
            good[k], bad[k] = tokens(" ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""), a.get("itemprop", ""))))
            hidden[k] = float("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""))
        over_good[k], over_bad[k] = over_good[p] + good[p], over_bad[p] + bad[p]
        hidden[k] = max(hidden[k], hidden[p])
        place[k] = seen[p]
        seen[p] += 1
        within[k] = within[p] | (1 << _WITHIN[page.tag[p]] if page.tag[p] in _WITHIN else 0)
    out = np.zeros((n, len(TAGS) + len(WITHIN) + 21))
    for k in range(n):
        i = _TAG.get(page.tag[k])
        if i is not None:
            out[k, i] = 1
    at = len(TAGS)
    w = np.array(within)
    for i in range(len(WITHIN)):
        out[:, at + i] = (w >> i) & 1
    at += len(WITHIN)
    par = np.array(parent)
    par[0] = 0
    size, links, count, own, stop, paragraphs, place, kids = (np.array(x, dtype=float) for x in (size, links, count, own, stop, paragraphs, place, kids))
    siblings = kids[par]
    around = (size[par] - size) / np.maximum(siblings - 1, 1)
    columns = [depth, good, bad, over_good, over_bad, hidden, np.log1p(size), np.log1p(own), size / count, links / np.maximum(size, 1), stop / np.maximum(size, 1) * 100, np.log1p(paragraphs), paragraphs / np.maximum(count, 1), siblings, place, place / np.maximum(siblings, 1), size / np.maximum(size[par], 1), size / max(size[0], 1), np.log1p(around), links[par] / np.maximum(size[par], 1), np.array(silent_kids) / np.maximum(kids, 1)]
    for i, c in enumerate(columns):
        out[:, at + i] = c
    return out


def decode(page: Page, chance: np.ndarray) -> list[bool]:
    """The likeliest labelling in which every node below a dropped one is dropped. Nodes without text weigh nothing."""
    n = len(page.tag)
    filled = [False] * n
    for node, chunk in page.chunks:
        if chunk is not None and not filled[node] and not chunk.isspace() and chunk:
            filled[node] = True
    for k in range(n - 1, 0, -1):
        if filled[k]:
            filled[page.parent[k]] = True
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    yes, no = np.log(chance), np.log1p(-chance)
    keep, drop = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if filled[k]:
            keep[k] += yes[k]
            drop[k] += no[k]
        if k:
            p = page.parent[k]
            keep[p] += max(keep[k], drop[k])
            drop[p] += drop[k]
    kept = [False] * n
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[page.parent[k]] and keep[k] > drop[k] and not page.silent[k]
    return kept


def main_text(page: Page, kept: list[bool]) -> str:
    return " ".join("".join(" " if chunk is None else chunk for node, chunk in page.chunks if chunk is None or kept[node]).split())


def _prose(rng: random.Random, words: int) -> str:
    """Made-up sentences: random letters, so that the trees can't learn words."""
    out = []
    while words > 0:
        n = min(words, rng.randint(4, 18))
        s = " ".join("".join(rng.choices("etaoinshrdluéñü", k=rng.randint(1, 9))) for _ in range(n))
        out.append(s.capitalize() + rng.choice([".", ".", ".", "!", "?", ",", "!!", " ***", ""]))
        words -= n
    return " ".join(out)


def synthetic_page(rng: random.Random) -> str:
    """A page of random make. data-y is 1 on elements of the main text and 0 on all others; it is no feature."""
    pick, chance = rng.choice, lambda p: rng.random() < p

    def wrap(tag: str, names: list[str], inner: str, y: int) -> str:
        name = pick(names) if names and chance(0.85) else ""
        if name and chance(0.3):
            name += pick(["-1", " wide", "__inner", "-wrap", " block", "-box"])
        attr = f' {pick(["class", "class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    def link_list(n: int) -> str:
        items = "".join(f'<li><a href="/{i}">{_prose(rng, rng.randint(1, 4))}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>" if chance(0.8) else "".join(f'<a href="/{i}">{_prose(rng, 2)}</a> ' for i in range(n))

    def advert() -> str:
        inner = pick([_prose(rng, rng.randint(2, 25)), f"<p>{_prose(rng, rng.randint(3, 20))}</p>", f'<a href="/x">{_prose(rng, 6)}</a>'])
        return wrap(pick(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "ad_box"], inner, 0)

    def notice() -> str:
        return wrap(pick(["div", "section", "aside"]), ["notice", "cookie", "cookie-consent", "alert", "gdpr", "consent"], pick(["", "<p>"]) + _prose(rng, rng.randint(4, 40)) + pick(["", '<a href="/ok">ok</a>', "<button>ok</button>"]), 0)

    def form() -> str:
        return wrap("div", ["newsletter", "subscribe", "search", "login", "signup"], f"<p>{_prose(rng, rng.randint(2, 14))}</p><form><label>{_prose(rng, 2)}</label><input><button>{_prose(rng, 1)}</button></form>", 0)

    def related() -> str:
        return wrap(pick(["div", "aside", "section"]), ["related", "recommended", "share", "social", "tags", "breadcrumb", "pagination", "toolbar", "widget"], (f"<h3>{_prose(rng, 2)}</h3>" if chance(0.5) else "") + link_list(rng.randint(2, 8)), 0)

    def sidebar() -> str:
        inner = (f"<h3>{_prose(rng, 2)}</h3>" if chance(0.6) else "") + pick([link_list(rng.randint(3, 9)), f"<p>{_prose(rng, rng.randint(5, 40))}</p>", "".join(f"<div>{_prose(rng, 8)}</div>" for _ in range(3))])
        return wrap(pick(["aside", "aside", "div"]), ["sidebar", "side", "sidebar-right", "widget"], inner, 0)

    def comments() -> str:
        one = lambda: pick(["<div>{}</div>", "<li>{}</li>", '<div class="comment">{}</div>', "<article>{}</article>"]).format(f"<p>{_prose(rng, rng.randint(3, 60))}</p>")
        inner = (f"<h2>{_prose(rng, 2)}</h2>" if chance(0.6) else "") + "".join(one() for _ in range(rng.randint(1, 6)))
        return wrap(pick(["section", "div", "ol", "aside"]), ["comments", "comment-list", "disqus", "respond", "replies comments"], inner, 0)

    def nav() -> str:
        return wrap(pick(["nav", "nav", "div", "ul"]), ["nav", "menu", "navbar", "main-menu", "top-nav"], link_list(rng.randint(3, 10)), 0)

    def header() -> str:
        inner = pick([f"<h1>{_prose(rng, 3)}</h1>", f"<p>{_prose(rng, 5)}</p>", f'<a href="/">{_prose(rng, 2)}</a>', ""]) + (nav() if chance(0.5) else "")
        return wrap(pick(["header", "header", "div"]), ["header", "masthead", "site-header", "top"], inner, 0)

    def footer() -> str:
        inner = pick([f"&copy; {_prose(rng, rng.randint(2, 30))}", f"<p>&copy; {_prose(rng, rng.randint(3, 20))}</p>", link_list(4) + f"<p>{_prose(rng, 9)}</p>"])
        return wrap(pick(["footer", "footer", "div"]), ["footer", "site-footer", "copyright", "legal", "foot"], inner, 0)

    def paragraph() -> str:
        body = _prose(rng, max(1, int(rng.lognormvariate(3.2, 1.0))))
        if chance(0.15):
            body = f"<b>{body}</b>" if chance(0.5) else f'{body} <a href="/y">{_prose(rng, 2)}</a> {_prose(rng, 4)}'
        if chance(0.06):
            body = f'{body} {wrap(pick(["span", "span", "a", "em"]), ["ad", "ads", "sponsored", "promo", "notice", "advert"], _prose(rng, rng.randint(1, 12)), 0)} {_prose(rng, 5)}'
        kind = rng.random()
        if kind < 0.8:
            return f"<p>{body}</p>" if chance(0.85) else f"<p>{body}<br>{_prose(rng, 8)}"
        if kind < 0.86:
            return f"<h2>{_prose(rng, rng.randint(1, 7))}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{_prose(rng, rng.randint(2, 15))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote>{pick(['', '<p>'])}{body}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{_prose(rng, 2)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<pre>{body}</pre>"
        return f"<div>{body}</div>"

    def holder(tag: str, names: list[str], inner: str) -> str:
        """Main text, whose name may have a word in it that stands for something else elsewhere."""
        odd = pick(["ad-free", "tag-news", "tags-a", "meta-full", "author-jane", "rating-5", "form-post", "search-hit", "share-on", "social", "legal-news", "side-story"])
        if not chance(0.3):
            return wrap(tag, names, inner, 1)
        return wrap(tag, [pick([odd, f"{odd} {pick(names)}", f"{pick(names)} {odd}"]) if names else odd], inner, 1)

    blocks = [paragraph() for _ in range(max(1, int(rng.lognormvariate(1.5, 0.8))))]
    for extra in (advert, related, form, notice):
        if chance(0.12):
            blocks.insert(rng.randint(0, len(blocks)), extra())
    title = f"<h1>{_prose(rng, rng.randint(1, 10))}</h1>" if chance(0.8) else ""
    if title and chance(0.15):
        title = f"<header>{title}</header>"
    inner = title + "".join(blocks)
    style = rng.random()
    if style < 0.4:
        main = holder("article", ["post", "article", "hentry"] if chance(0.5) else [], inner)
        if chance(0.4):
            main = holder("main", ["content", "main"], main)
    elif style < 0.6:
        main = holder("main", ["content", "main"], inner)
    elif style < 0.92:
        main = holder("div", ["content", "post", "entry-content", "article-body", "story", "main", "post-text"], inner)
    else:
        main = wrap(pick(["div", "section"]), [], inner, 1)
    before = [f() for f, p in ((header, 0.5), (nav, 0.6), (notice, 0.2), (advert, 0.4), (related, 0.15), (form, 0.1)) if chance(p)]
    after = [f() for f, p in ((related, 0.25), (comments, 0.35), (sidebar, 0.4), (advert, 0.25), (form, 0.2), (footer, 0.75), (notice, 0.15)) if chance(p)]
    if chance(0.25):
        side = [f() for f in (sidebar,) if chance(0.8)]
        main = f'<div data-y="1">{main}{"".join(side)}</div>'
    if chance(0.2):
        rng.shuffle(before)
    body = f"{''.join(before)}{main}{''.join(after)}"
    if chance(0.08):  # a page that is one form, as some servers make them
        body = f'<form method="post" action="/" data-y="1">{body}</form>'
    return f"<html><head><title>{_prose(rng, 4)}</title><style>p{{}}</style></head><body data-y=\"1\">{body}</body></html>"


@lru_cache(maxsize=1)
def trained(seed: int = 11, pages: int = LEARN_PAGES) -> Boosted:
    """A node's class is whether it holds main text. The pages are made here, so nothing of the input is learned from."""
    rng, rows, labels = random.Random(seed), [], []
    for _ in range(pages):
        page = read(synthetic_page(rng))
        n = len(page.tag)
        main, holds = [0] * n, [0] * n
        for k in range(1, n):
            y = page.attrs[k].get("data-y")
            main[k] = int(y) if y is not None else main[page.parent[k]]
        filled = [0] * n
        for node, chunk in page.chunks:
            if chunk and chunk.strip():
                filled[node] = 1
                holds[node] |= main[node]
        for k in range(n - 1, 0, -1):
            holds[page.parent[k]] |= holds[k]
            filled[page.parent[k]] |= filled[k]
        use = np.array(filled, dtype=bool)
        rows.append(features(page)[use])
        labels.append(np.array(holds)[use])
    return Boosted().fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def extract(pages: DataFrame, model: Boosted | None = None, source: str = "html") -> DataFrame:
    """pages without its html, with text and n_chars (code points). A null or empty html, and one without main text, has
    the text ''. Pages are read whole, however long or badly nested, in linear time; repeated rows are read alike, and an
    empty table gives an empty result. Columns named text or n_chars give way to the new ones; nulls in other columns, and
    columns of any other name, are passed on."""
    model = model or trained()
    keep = [c for c in pages.columns if c.lower() not in ("text", "n_chars", source.lower())]
    side = pages.select(*keep, source)
    schema = side.drop(source).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, texts = batch.num_columns - 1, []
            column = batch.column(last)
            for at in range(0, len(column), 200):
                read_pages = [read(h.as_py() or "") for h in column[at : at + 200]]
                found = [features(p) for p in read_pages]
                chances = np.split(model.predict(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1])
                texts += [main_text(p, decode(p, c)) for p, c in zip(read_pages, chances, strict=True)]
            yield pa.record_batch([*batch.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return in_small_batches(side).mapInArrow(run, schema)


def op3_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
