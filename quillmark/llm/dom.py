"""A forgiving HTML reader: a tree of elements from raw markup, and the text of its blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
#: A start tag of the first kind ends an open element of the second kind (not beyond the third).
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "thead": (("tr", "td", "th", "thead", "tbody"), ("table",)),
    "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",)), "body": (("head",), ("html",)),
}
_FENCE = frozenset("table td th caption button object body html article section div nav aside main header footer form".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"\s+")


class Node:
    """An element; ``parts`` holds its texts (str) and child elements in order."""

    __slots__ = ("attrs", "name", "parts")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.parts = name, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if self.attrs else {}

    def children(self):
        return [p for p in self.parts if not isinstance(p, str)]


def parse(source: str) -> Node:
    """The tree.  Comments and doctypes go, unclosed elements end where their parents end, stray end tags are skipped, and a
    script, style or title holds raw text up to its own end tag.

    Any depth is read; where the open elements of a name stand is kept, so that no tag searches all of them."""
    root = top = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements, by name
    fences: list[int] = []
    at, n = 0, len(source)

    def last(names) -> int:
        return max((places[k][-1] for k in names if places.get(k)), default=0)

    def close(place: int) -> None:
        while len(stack) > place:
            name = stack.pop().name
            places[name].pop()
            if name in _FENCE:
                fences.pop()

    while at < n:
        m = _MARK.search(source, at)
        if m is None:
            top.parts.append(source[at:])
            break
        if m.start() > at:
            top.parts.append(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            own = places.get(name)
            if own and not (name in INLINE and fences and fences[-1] > own[-1]):
                close(own[-1])
                top = stack[-1]
            continue
        if name in _ENDS_P:
            own = places.get("p")
            if own and not (fences and fences[-1] > own[-1]):
                close(own[-1])
        if name in _IMPLIED:
            ends, stop = _IMPLIED[name]
            above = last(stop)
            inner = [own[i] for k in ends if (own := places.get(k)) and (i := bisect_right(own, above)) < len(own)]
            if inner:
                close(min(inner))
        top = stack[-1]
        node = Node(name, m[3])
        top.parts.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            node.parts.append(source[at : end.start()] if end else source[at:])
            at = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in _FENCE:
                fences.append(len(stack))
            stack.append(node)
            top = node
    return root


def clean(text: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    return _BLANKS.sub(" ", html.unescape(text)).strip()
