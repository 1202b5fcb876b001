"""HTML extraction: gradient-boosted trees over DOM-node features with hierarchical decoding.

Every block element and run of inline content is a node.  Trees fitted here, on pages that a seeded generator writes in
many layouts with known main text, give each node a log-odds of being or holding main text from the densities of text, links and
tags in its subtree, the hashed tokens of its class, id and role and of those of the elements around it, its depth, its
place and its siblings.  The names on half of the training pages tell nothing, so that density, place and shape must do.
Decoding walks the page from the root and chooses, for each subtree as a whole, between leaving it out and going down, so
that nothing inside a subtree that was left out is taken.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.dom import INLINE, RAW, Node, clean, parse

#: Elements without text of a reader's, whatever their place.
NEVER = RAW | frozenset("head script style svg math object canvas select option button input datalist".split())
#: Elements of a form, which are counted, and elements that hold an article by their meaning.
CONTROLS, ARTICLES = frozenset("button input select textarea".split()), frozenset("article main".split())
#: Buckets that attribute tokens are hashed into: those of the element, and of all elements around it.
OWN, AROUND = 96, 96
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "#run")
_TAG = {t: i + 1 for i, t in enumerate(TAGS)}
#: Flags: the element's tag and its parent's (0: another one), then the buckets.
TAGGED = 2 * (len(TAGS) + 1)
FLAGS = TAGGED + OWN + AROUND
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol menu dl nav".split())


@lru_cache(maxsize=100_000)
def _bucket(token: str) -> int:
    return TAGGED + zlib.crc32(token.encode()) % OWN


class Block:
    """A block element, or (``#run``) inline content between block elements, with the sums over its subtree."""

    __slots__ = ("bars", "blocks", "chars", "controls", "flags", "kids", "links", "name", "own", "paragraphs", "rights", "stops", "tags", "text", "words", "x")

    def __init__(self, name: str):
        self.name, self.kids, self.text, self.own = name, [], "", ()
        self.chars = self.words = self.links = self.tags = self.stops = self.paragraphs = self.blocks = self.controls = self.rights = self.bars = 0

    def shape(self) -> tuple[str, ...]:
        return (self.name, *(k.name for k in self.kids[:4]))


def _plain(root: Node) -> set[int]:
    """The ids of the inline elements that hold no block element."""
    order = [root]
    for node in order:  # grows
        order += [p for p in node.parts if not isinstance(p, str) and p.name not in NEVER]
    plain: set[int] = set()
    for node in reversed(order):
        if node.name in INLINE and all(isinstance(p, str) or p.name in NEVER or id(p) in plain for p in node.parts):
            plain.add(id(node))
    return plain


def _inline(node: Node, linked: bool, out: list[str]) -> int:
    """Append the text of a plain inline element; the characters of it that are links."""
    links, stack = 0, [(iter(node.parts), linked)]
    while stack:
        parts, linked = stack[-1]
        for part in parts:
            if isinstance(part, str):
                out.append(part)
                if linked:
                    links += len(part.strip())
            elif part.name in NEVER:
                continue
            elif part.name == "br":
                out.append(" ")
            else:
                stack.append((iter(part.parts), linked or part.name == "a"))
                break
        else:
            stack.pop()
    return links


class _Open:
    """An element whose block is being filled: the parts to come, and the run of inline content so far."""

    __slots__ = ("block", "linked", "links", "node", "parts", "run")

    def __init__(self, node: Node, linked: bool):
        self.node, self.linked, self.parts, self.run, self.links = node, linked, iter(node.parts), [], 0
        block = self.block = Block(node.name)
        if node.name != "#run":
            found = node.attributes() if node.attrs else {}
            block.own = tuple(sorted({_bucket(t.lower()) for key in ("class", "id", "role") for t in _TOKEN.findall(found.get(key, ""))}))

    def flush(self) -> None:
        text = clean("".join(self.run))
        if text:
            kid = Block("#run")
            kid.text, kid.chars, kid.words, kid.links, kid.stops, kid.blocks = text, len(text), text.count(" ") + 1, min(self.links, len(text)), sum(map(text.count, ".,;!?")), 1
            kid.rights, kid.bars = "\u00a9" in text, sum(map(text.count, "|\u00b7\u2022\u00bb"))
            self.block.kids.append(kid)
        self.run.clear()
        self.links = 0

    def next_block(self, plain: set[int]) -> _Open | None:
        """Read on to the next block element; None at the end, with the sums over the subtree done."""
        block, run, linked = self.block, self.run, self.linked
        for part in self.parts:
            if isinstance(part, str):
                run.append(part)
                if linked:
                    self.links += len(part.strip())
            elif part.name in NEVER:
                block.controls += part.name in CONTROLS
            elif part.name == "br":
                run.append(" ")
            elif id(part) in plain:
                self.links += _inline(part, linked or part.name == "a", run)
                block.tags += 1
            else:
                self.flush()
                return _Open(part, linked or part.name == "a")
        self.flush()
        for kid in block.kids:
            for name in ("chars", "words", "links", "tags", "stops", "paragraphs", "blocks", "controls", "rights", "bars"):
                setattr(block, name, getattr(block, name) + getattr(kid, name))
        block.tags += 1
        block.paragraphs += self.node.name == "p"
        return None


def blocks_of(node: Node, linked: bool = False) -> Block:
    """The tree of blocks below an element, of any depth."""
    plain = _plain(node)
    stack = [_Open(node, linked)]
    while True:
        inner = stack[-1].next_block(plain)
        if inner:
            stack.append(inner)
            continue
        block = stack.pop().block
        if not stack:
            return block
        if block.kids:
            stack[-1].block.kids.append(block)


def features(root: Block) -> list[Block]:
    """All blocks in page order, each with its feature row ``x`` and its ``flags``."""
    order: list[Block] = []
    whole = max(1, root.chars)
    shell = Block("#root")
    shell.kids, shell.chars = [root], root.chars
    articles, titled, past = 0, False, 0  # articles begun, whether a first heading was met, and where the last article ended
    stack = [(root, shell, 0, 0, (), 0, 0, 1, 1, 0)]
    while stack:
        b, parent, depth, place, around, inside, before, alike, shaped, under = stack.pop()
        n = max(1, b.chars)
        near = parent.kids
        left, right = near[place - 1].chars if place else 0, near[place + 1].chars if place + 1 < len(near) else 0
        only = b.kids[0].name if len(b.kids) == 1 else ""
        if b.name in ARTICLES:
            articles += 1
            inside, past = inside + 1, max(past, before + b.chars)
        titled = titled or b.name == "h1"
        b.x = [
            b.chars, b.words, b.chars / whole, b.links / n, b.links, b.chars / max(1, b.tags), b.tags, b.stops / max(1, b.words), b.chars / max(1, b.words), b.paragraphs, b.blocks, b.chars / max(1, b.blocks),
            depth, place, len(near), alike / len(near), b.chars / max(1, parent.chars), left, right, before / whole, len(b.kids), any(k.name in _HEADINGS for k in b.kids), only == "#run",
            shaped / len(near), b.controls, b.rights > 0, b.bars / max(1, b.words), inside, articles, bool(articles and not inside and before >= past), titled, parent.links / max(1, parent.chars), parent.controls, under,
            parent.paragraphs, parent.words / max(1, parent.blocks), (whole - before - b.chars) / whole,
        ]
        b.flags = (_TAG.get(b.name, 0), _TAG.get(parent.name, 0) + len(TAGS) + 1, *b.own, *around)
        order.append(b)
        names, shapes, at, inner = Counter(k.name for k in b.kids), Counter(k.shape() for k in b.kids), before, []
        below = tuple(sorted({*around, *(t + OWN for t in b.own)})) if b.own else around
        for i, k in enumerate(b.kids):
            inner.append((k, b, depth + 1, i, below, inside, at, names[k.name], shapes[k.shape()], b.links / n if b.name in _LISTS else under))
            at += k.chars
        stack += reversed(inner)
    total = articles
    for b in order:
        b.x.append(total)  # of the whole page, those to come too
    return order


def matrix(order: list[Block], columns: np.ndarray | None = None) -> np.ndarray:
    """The blocks' feature rows, and behind them a column for each flag (or for those of ``columns``)."""
    dense = np.array([b.x for b in order], float)
    columns = np.arange(FLAGS) if columns is None else columns
    place = np.full(FLAGS, -1)
    place[columns] = np.arange(len(columns))
    out = np.zeros((len(order), len(columns)))
    at = place[np.fromiter((f for b in order for f in b.flags), np.int64)]
    row = np.repeat(np.arange(len(order)), [len(b.flags) for b in order])
    out[row[at >= 0], at[at >= 0]] = 1
    return np.hstack([dense, out])


class Trees:
    """Gradient-boosted regression trees for the logistic loss, with histogram splits (numpy)."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 20.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, flags: int = 0) -> Trees:
        """``flags``: so many columns at the end are 0 or 1 and mostly 0; only the rows that have them are looked at."""
        n, d = x.shape[0], x.shape[1] - flags
        has, flag = np.nonzero(x[:, d:])
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(d)]
        code = np.stack([np.searchsorted(cuts[k], x[:, k], "left") for k in range(d)], 1)  # code > c: x above cut c
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z = np.full(n, self.base)
        shape = (d, self.bins)
        flat = code + np.arange(d) * self.bins
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            leaf = np.zeros(n, int)
            for node in range(size):
                rows = np.flatnonzero(leaf == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = gs / (hs + self.ridge) * self.rate
                if node >= 2**self.depth - 1 or hs < self.least / 4:
                    continue
                bins = flat[rows].ravel()
                gl = np.cumsum(np.bincount(bins, np.repeat(g[rows], d), d * self.bins).reshape(shape), 1)
                hl = np.cumsum(np.bincount(bins, np.repeat(h[rows], d), d * self.bins).reshape(shape), 1)
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                k, c = np.unravel_index(gain.argmax(), shape)
                own = leaf[has] == node
                gf, hf = np.bincount(flag[own], g[has[own]], flags), np.bincount(flag[own], h[has[own]], flags)
                with_flag = gf**2 / (hf + self.ridge) + (gs - gf) ** 2 / (hs - hf + self.ridge) - gs**2 / (hs + self.ridge)
                with_flag[(hf < 0.5) | (hs - hf < 0.5)] = 0
                if flags and with_flag.max() > max(gain[k, c], 1e-6):
                    k = d + int(with_flag.argmax())
                    feature[node], cut[node] = k, 0.5
                    leaf[rows] = np.where(x[rows, k] > 0.5, 2 * node + 2, 2 * node + 1)
                    continue
                if gain[k, c] <= 1e-6 or c >= len(cuts[k]):
                    continue
                feature[node], cut[node] = k, cuts[k][c]
                leaf[rows] = np.where(code[rows, k] > c, 2 * node + 2, 2 * node + 1)
            z += value[leaf]
            self.trees.append((feature, cut, value))
        # of the flags only those that a tree asks for are made later on
        self.columns = np.unique(np.concatenate([f[f >= d] for f, _, _ in self.trees] + [np.empty(0, int)]).astype(int)) - d
        moved = np.concatenate([np.arange(d), np.searchsorted(self.columns, np.arange(flags)) + d])
        self.trees = [(np.where(f < 0, f, moved[f]), c, v) for f, c, v in self.trees]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), int)
            for _ in range(self.depth):
                k = feature[leaf]
                inner = k >= 0
                above = x[np.arange(len(x)), np.maximum(k, 0)] > cut[leaf]
                leaf = np.where(inner, 2 * leaf + 1 + above, leaf)
            z += value[leaf]
        return z


def decode(order: list[Block], z: np.ndarray) -> list[str]:
    """Texts of the chosen runs in page order.

    From the leaves up, a subtree's gain is the better of leaving it out (0) and of its children's gains together with its
    own log-odds (weighted down, as the leaves decide); a subtree without a positive gain is left out as a whole.
    """
    score = {id(b): float(v) for b, v in zip(order, z, strict=True)}
    gain: dict[int, float] = {}
    for b in reversed(order):
        own = score[id(b)]
        weight = min(b.words, 60)
        if b.name == "#run":
            gain[id(b)] = max(0.0, own) * weight
        else:
            inner = sum(gain[id(k)] for k in b.kids)
            gain[id(b)] = inner if inner and inner + min(0.0, own) * weight * 0.5 > 0 else 0.0
    out: list[str] = []

    stack = [order[0]]
    while stack:
        b = stack.pop()
        if gain[id(b)] <= 0:
            continue
        if b.name == "#run":
            out.append(b.text)
        stack += reversed(b.kids)
    return out


def _training_page(r: random.Random) -> tuple[str, set[str]]:
    """A page in a random layout, and the texts of its main blocks."""
    letters = "abcdefghijklmnoprstuvwyéüñß"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    serial = iter(range(10**6))

    def sentence(lo: int, hi: int) -> str:
        words = [word() for _ in range(r.randint(lo, hi))]
        return f"{' '.join(words).capitalize()} {next(serial)}{r.choice(['.', '.', '!', '', ' |', '***'])}"

    prose = lambda: " ".join(sentence(1, r.choice([3, 12, 25])) for _ in range(r.choice([1, 1, 2, 4, 9])))
    main: set[str] = set()

    def keep(text: str) -> str:
        main.add(clean(text))
        return text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{sentence(1, 3)}</a></li>' for _ in range(n))

    telling = r.random() < 0.5  # whether names say what a part is
    semantic = r.random() < 0.6  # and whether elements do

    def neutral() -> str:
        return r.choice([f"{r.choice('abcdkmqx')}{r.randint(1, 99)}", word(), r.choice(["box", "wrap", "inner", "outer", "block", "row", "col", "section", "item", "group", "unit"]), f"{word()}-{r.randint(1, 9)}"])

    def attr(names: list[str]) -> str:
        if not telling:
            return r.choice(["", f' class="{neutral()}"', f' id="{neutral()}"', f' class="{neutral()} {neutral()}"'])
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"', f' class="{word()}-{name}"', f' class="{name}-{neutral()}"', f' class="{neutral()} {name}"'])

    def tag(name: str) -> str:
        return name if semantic else "div"

    def paragraph() -> str:
        text = keep(prose())
        return r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p><b>{text}<br>", f"<p>{text}</p>"]) if r.random() < 0.8 else f"<p>{text[:0]}<a href='/x'>{text}</a></p>" if r.random() < 0.1 else f"<div>{text}</div>"

    def article() -> str:
        title = r.choice(["h1", "h1", "h1", "h1", "h2"])
        parts = [f"<{title}>{keep(sentence(2, 9))}</{title}>"] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 9, 15])):
            parts.append(paragraph())
            if r.random() < 0.12:
                parts.append(f"<h2>{keep(sentence(1, 5))}</h2>")
            if r.random() < 0.08:
                parts.append("<ul>" + "".join(f"<li>{keep(sentence(2, 12))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            if r.random() < 0.06:
                parts.append(f"<blockquote>{keep(prose())}</blockquote>")
            if r.random() < 0.05:
                parts.append(f"<pre>{keep(sentence(2, 12))}</pre>")
            if r.random() < 0.04:
                parts.append("<table>" + "".join(f"<tr><td>{keep(sentence(1, 4))}</td><td>{keep(sentence(1, 4))}</td></tr>" for _ in range(3)) + "</table>")
            if r.random() < 0.07:
                parts.append(f"<div{attr(['ad', 'advert', 'promo', 'sponsored'])}>{prose()}</div>")
        return "".join(parts)

    def nav() -> str:
        n, names = r.randint(3, 9), ["menu", "nav", "navbar", "navigation", "breadcrumbs", "topbar"]
        row = "".join(r.choice([f'<a href="/{word()}">{sentence(1, 3)}</a> ', f'<span><a href="/{word()}">{sentence(1, 2)}</a></span>']) for _ in range(n))
        bars = r.choice([" | ", " &middot; ", " &raquo; "]).join(f'<a href="/{word()}">{sentence(1, 2)}</a>' for _ in range(n))
        each = "".join(f'<div{attr(["item", "link"])}><a href="/{word()}">{sentence(1, 3)}</a></div>' for _ in range(n))
        inner = r.choice([f"<ul>{links(n)}</ul>", f"<ul>{links(n)}</ul>", row, bars, each])
        outer = r.choice([tag("nav"), "div"])
        return r.choice([f"<{outer}{attr(names)}>{inner}</{outer}>", f"<{outer}{attr(names)}><div>{inner}</div></{outer}>", f"<ul{attr(names)}>{links(n)}</ul>"])

    def ad() -> str:
        inner = r.choice([prose(), f"<p>{prose()}</p>", f'<a href="/{word()}">{prose()}</a>', f'<p>{sentence(2, 9)}</p><a href="/{word()}">{sentence(1, 3)}</a>'])
        return f"<div{attr(['ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'promo'])}>{inner}</div>"

    def side() -> str:
        inner = f"<h3>{sentence(1, 3)}</h3>" + r.choice([f"<ul>{links(r.randint(2, 7))}</ul>", f"<p>{prose()}</p>", "".join(f'<div><a href="/{word()}">{sentence(2, 6)}</a></div>' for _ in range(r.randint(2, 6)))])
        outer = tag("aside")
        return f"<{outer}{attr(['sidebar', 'related', 'widget', 'recommended', 'popular', 'rail', 'trending'])}>{inner}</{outer}>"

    def comments() -> str:
        one = r.choice(["div", "li", "p", "article" if semantic and r.random() < 0.1 else "div"])
        who = lambda: r.choice([f"<b>{word()}</b>", f"<span>{word()}</span>", f"<b>{word()}</b><span>{r.randint(1, 28)}.{r.randint(1, 12)}.</span>", f'<a href="/u">{word()}</a>', f"<h4>{word()}</h4>"])
        said = lambda: r.choice([f"{who()}<p>{prose()}</p>", f"{who()}<div>{prose()}</div>", f"{who()} {prose()}", f"<p>{prose()}</p>"]) if one != "p" else f"<b>{word()}</b>: {prose()}"
        inner = "".join(f"<{one}{attr(['comment', 'reply', 'response'])}>{said()}</{one}>" for _ in range(r.randint(1, 7)))
        inner = f"<{r.choice(['ul', 'ol'])}>{inner}</ul>" if one == "li" else inner
        head = r.choice([f"<h3>{sentence(1, 2)}</h3>", f"<h2>{r.randint(1, 40)} {sentence(1, 2)}</h2>", ""])
        outer = r.choice(["div", "section"])
        return f"<{outer}{attr(['comments', 'discussion', 'commentlist', 'responses', 'replies', 'feedback', 'disqus'])}>{head}{inner}</{outer}>"

    def notice() -> str:
        ask = r.choice([f"<button>{sentence(1, 2)}</button>", f"<button>{word()}</button><button>{word()}</button>", f'<a href="/{word()}">{sentence(1, 2)}</a>', ""])
        outer = r.choice(["div", "div", tag("section"), tag("aside")])
        return f"<{outer}{attr(['cookie', 'notice', 'newsletter', 'consent', 'alert', 'gdpr', 'subscribe', 'overlay'])}>{r.choice([f'<p>{prose()}</p>', sentence(4, 14), f'<h4>{sentence(1, 3)}</h4><p>{prose()}</p>'])}{ask}</{outer}>"

    def form() -> str:
        return f"<form{r.choice(['', attr(['search', 'subscribe', 'login', 'signup'])])}><label>{sentence(1, 3)}</label><input name=q>{r.choice([f'<p>{sentence(1, 9)}</p>', ''])}{r.choice([f'<button>{word()}</button>', ''])}</form>"

    def footer() -> str:
        text = r.choice([f"&copy; {word()}.example &middot; {sentence(1, 12)}", f"&copy; {r.randint(1999, 2030)} {sentence(1, 9)}", f"Copyright {r.randint(1999, 2030)} {sentence(1, 6)}", sentence(2, 9)])
        outer = tag("footer")
        return r.choice([f"<{outer}{attr(['footer', 'copyright', 'bottom', 'legal'])}>{text}</{outer}>", f"<{outer}{attr(['footer', 'foot'])}><p>{text}</p></{outer}>", f"<div{attr(['footer', 'copyright'])}><p>{text}</p><ul>{links(3)}</ul></div>"])

    def header() -> str:
        outer = tag("header")
        return r.choice([f"<{outer}{attr(['header', 'masthead', 'branding', 'logo'])}><div>{sentence(1, 4)}</div></{outer}>", f"<div{attr(['header', 'masthead', 'logo'])}><a href='/'>{sentence(1, 3)}</a></div>", f"<{outer}><h2>{sentence(1, 4)}</h2>{nav()}</{outer}>"])

    def cards() -> str:
        return "".join(f"<article{attr(['card', 'teaser'])}><h3><a href='/{word()}'>{sentence(2, 6)}</a></h3>{r.choice(['', f'<p>{sentence(3, 9)}</p>'])}</article>" for _ in range(r.randint(2, 4)))

    some = lambda make, p: make() if r.random() < p else ""
    kind = r.choice(["article", "article", "article", "main", "main", "div", "section", "plain"] if semantic else ["div", "div", "plain"])
    if kind in ("article", "main") and r.random() < 0.2:  # hardly any text
        body = f"<h1>{keep(sentence(1, 3))}</h1>" + "".join(f"<p>{keep(sentence(1, 3))}</p>" for _ in range(r.randint(1, 2)))
    else:
        body = article()
    if kind == "article" and r.random() < 0.2:
        body = f"<header>{body[: body.find('</h1>') + 5]}</header>{body[body.find('</h1>') + 5 :]}" if "</h1>" in body else body
    if kind in ("article", "main", "section"):
        # remarks of readers, and other parts, sometimes stand inside
        mixed = f' class="{r.choice(["content", "main", "post", "entry"])} {r.choice(["related", "widget", "banner", "more", "popular"])}"' if telling and r.random() < 0.2 else r.choice(["", attr(["content", "post", "entry", "story"])])
        body = f"<{kind}{mixed}>{body}{some(comments, 0.15)}{some(side, 0.06)}</{kind}>"
    elif kind == "div":
        own = f' class="{r.choice(["main", "post", "entry", "article"])}-content {r.choice(["related", "widget", "banner", "sidebar", "footer", "comments"])}"' if telling and r.random() < 0.2 else attr(["content", "post", "entry", "story", "article", "main"])
        body = f"<div{own}>{body}</div>"
    elif r.random() < 0.5:
        body = f"<div>{body}</div>"
    rest = [some(comments, 0.35), some(side, 0.3), some(ad, 0.2), some(notice, 0.2), some(form, 0.2)]
    if kind in ("main", "section", "div") and r.random() < 0.1 and semantic:
        rest.append(cards())
    r.shuffle(rest)
    start = [some(header, 0.4), some(nav, 0.8), some(ad, 0.6), some(notice, 0.3), some(form, 0.15), some(side, 0.15)]
    if r.random() < 0.4:
        r.shuffle(start)
    page = f"{''.join(start)}{body}{''.join(rest)}{some(footer, 0.9)}"
    if r.random() < 0.25:
        page = f"<div{attr(['page', 'wrapper', 'container'])}>{page}</div>"
    return f"<html><head><title>{sentence(2, 5)}</title></head><body>{page}{r.choice(['</body></html>', ''])}", main


@lru_cache(maxsize=2)
def fitted(pages: int = 1000, seed: int = 11) -> Trees:
    """The trees, fitted on generated pages (deterministic; the size does not depend on the data)."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        source, main = _training_page(r)
        order = features(blocks_of(parse(source)))
        rows.append(matrix(order))
        share: dict[int, int] = {}
        for b in reversed(order):
            share[id(b)] = b.chars * (b.text in main) if b.name == "#run" else sum(share[id(k)] for k in b.kids)
        labels += [share[id(b)] > 0 for b in order]  # a container counts if any main text is inside
    return Trees().fit(np.concatenate(rows), np.array(labels, float), FLAGS)


def extract(source: str | None, trees: Trees) -> list[str]:
    """The main text's blocks in page order."""
    if not source:
        return []
    root = blocks_of(parse(source))
    if not root.kids:
        return []
    order = features(root)
    return decode(order, trees.log_odds(matrix(order, trees.columns)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page from its whole html, blocks joined by one ``\\n``.

    One row per input row, repeated rows included; a null, empty or textless html gives an empty text; null page_id and url
    pass; other columns are ignored; malformed markup is read as far as it goes.  Map-only; the trees (some tens of KB) go
    with the task.
    """
    trees = fitted()

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            found = []
            for source in batch.column(2):
                html_ = source.as_py()
                root = blocks_of(parse(html_)) if html_ else None
                found.append(features(root) if root is not None and root.kids else [])
                if sum(map(len, found)) > 20_000:
                    texts += _decoded(found)
                    found = []
            texts += _decoded(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def _decoded(found: list[list[Block]]) -> list[str]:
        every = [b for order in found for b in order]
        z = trees.log_odds(matrix(every, trees.columns)) if every else np.empty(0)
        out, at = [], 0
        for order in found:
            out.append("\n".join(decode(order, z[at : at + len(order)])) if order else "")
            at += len(order)
        return out

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
