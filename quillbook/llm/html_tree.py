"""A forgiving HTML reader: block elements as nodes of a tree, with the text chunks in page order. Time is linear in the page,
however its tags are nested or left open."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr acronym nobr ruby rb rt rp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SILENT = frozenset("script style template noscript iframe object svg math head title select option optgroup button textarea datalist canvas audio video map input".split())
#: Their content isn't markup: it ends at their own end tag.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: What a start tag closes on its own: elements of the first set, up to the nearest of the second.
_P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Class and id tokens that make an inline element a node, which the trees can drop: what is printed within running text.
INLINE_NODES = frozenset("ad ads advert advertisement sponsor sponsored promo banner notice cookie cookies consent".split())
# a quoted value may hold > or, if a delimiter follows its end, anything; a quote without an end doesn't hide the tag's own >
_VALUE = r"\"[^\"<]*\"|'[^'<]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|{_VALUE})*+(?:[\"'][^>]*)?)(?:>|$)", re.S)
# names are taken whole, and only from where they begin, so a long one without a value is looked at once
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[a-z]+")


class Page:
    """Nodes by number, in page order: tag, parent, attrs, silent; chunks: (node, text), where None is a block's edge."""

    __slots__ = ("attrs", "chunks", "links", "parent", "silent", "tag")

    def __init__(self):
        self.tag, self.parent, self.attrs, self.silent = ["#root"], [-1], [{}], [False]
        self.chunks: list[tuple[int, str | None]] = []
        self.links: list[int] = [0]  # length of link text in each node's own text


def _attributes(source: str) -> dict[str, str]:
    attrs: dict[str, str] = {}
    if source and not source.isspace():
        for a in _ATTR.finditer(source):
            attrs.setdefault((a[1] or a[5]).lower(), (a[2] or a[3] or a[4] or "").lower())
    return attrs


def read(source: str) -> Page:
    page, stack, at, links = Page(), [(0, "#root")], 0, 0
    chunks = page.chunks
    #: places on the stack, in order: of each tag, and of all blocks
    where: dict[str, list[int]] = defaultdict(list)
    blocks = [0]

    def text(raw: str) -> None:
        if raw:
            node = stack[-1][0]
            if not page.silent[node]:
                raw = html.unescape(raw) if "&" in raw else raw
                chunks.append((node, raw))
                if links:
                    page.links[node] += len(raw.strip())

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            _, tag = stack.pop()
            where[tag].pop()
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                blocks.pop()
                chunks.append((stack[-1][0], None))

    def last(tags: frozenset[str] | set[str]) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[1]:
            text(html.escape(m[1]))
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if where[tag] and (tag == "table" or where[tag][-1] > last({"table"})):
                close(where[tag][-1])
            continue
        if tag == "br" or tag == "hr":
            chunks.append((stack[-1][0], " "))
            continue
        if tag in VOID:
            continue
        if tag in _P_CLOSERS:
            if stack[blocks[-1]][1] == "p":
                close(blocks[-1])
        elif tag in _CLOSES:
            inner, outer = _CLOSES[tag]
            over = last(outer)
            found = [where[t][k] for t in inner if (k := bisect_right(where[t], over)) < len(where[t])]
            if found:
                close(min(found))
        node, block = stack[-1][0], tag not in INLINE
        attrs = _attributes(m[4])
        if block:
            chunks.append((node, None))
        if block or (attrs and not INLINE_NODES.isdisjoint(_NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}"))):
            page.tag.append(tag)
            page.parent.append(node)
            page.attrs.append(attrs)
            page.silent.append(page.silent[node] or tag in SILENT)
            page.links.append(0)
            node = len(page.tag) - 1
        if m[4].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag == "a":
            links += 1
        where[tag].append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append((node, tag))
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            raw_end = end.start() if end else len(source)
            if tag == "textarea" or tag == "xmp":
                text(source[at:raw_end])
            at = raw_end
    close(1)
    return page


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
