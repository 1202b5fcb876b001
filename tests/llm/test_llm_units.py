"""The operators' parts against plain models, without Spark."""

from __future__ import annotations

import hashlib
import io
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import bitplanes, chunk_bpe, chunk_dedup, html_extract, ogg, pieces, rtree, shingles, toxicity
from quillmark.llm.dom import parse
from quillmark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODDS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "###", "ß", "ﬁ", "日本", "́", " ", "\x1c", "<|endoftext|>", "<|startoftext|>", "Σ", "ς", "İ", "-", "\r\n", "😀", "word", "Hello"]
texts = st.lists(st.sampled_from(ODDS), max_size=30).map("".join)


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@settings(max_examples=80, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_shingle_sets(some):
    got = list(shingles.shingle_sets([t.encode() for t in some]))
    assert [len(g) for g in got] == [len(plain_set(t)) for t in some]
    for (a, x), (b, y) in itertools.combinations(zip(some, got), 2):
        assert len(np.intersect1d(x, y)) == len(plain_set(a) & plain_set(b))


def test_long_words_and_texts():
    long = "x" * 9000 + " " + "y z " * 200_000
    one, two = shingles.shingle_sets([long.encode(), ("x" * 8999 + "w " + "y z " * 10).encode()])
    assert len(one) == len(plain_set(long)) and len(np.intersect1d(one, two)) == 2


def sets_like_copies(seed):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(40):
        base = r.integers(0, 2**63, r.integers(1, 300)).astype(np.uint64)
        for _ in range(5):
            own = np.unique(np.concatenate([base[r.random(len(base)) > r.choice([0, 0.05, 0.12, 0.2])], r.integers(0, 2**63, int(len(base) * r.choice([0, 0.1]))).astype(np.uint64)]))
            if len(own):
                out.append(own)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rtree_loses_no_link(seed):
    sets = sets_like_copies(seed)
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - o)}
    i, j = rtree.join([rtree.counts_of(rtree.point(s)) for s in sets], np.array([len(s) for s in sets]), np.arange(len(sets)))
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert true <= found and len(found) < len(sets) ** 2 / 20
    same = rtree.join([rtree.counts_of(rtree.point(s)) for s in sets], np.array([len(s) for s in sets]), np.zeros(len(sets), int))
    assert not len(same[0])


@pytest.mark.parametrize("seed", [4, 5])
def test_rtree_search_loses_no_link(seed):
    sets = sets_like_copies(seed)
    points, sizes = [rtree.counts_of(rtree.point(s)) for s in sets], np.array([len(s) for s in sets])
    met = 0
    for k in range(0, len(sets), 7):
        true = {i for i, s in enumerate(sets) if 100 * (o := len(np.intersect1d(s, sets[k]))) >= 75 * (len(s) + len(sets[k]) - o)}
        found = set(rtree.search(points, sizes, points[k], len(sets[k])).tolist())
        assert true <= found
        met += len(found)
    assert met < len(sets) ** 2 / 70


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(name):
    enc, r = pieces.PieceEncoder(tokenizer_path(name)), random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(ODDS) for _ in range(r.randint(0, 25)))
        assert enc.encode(text) == enc.whole(text), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 200)
    enc, r = pieces.PieceEncoder(tokenizer_path(name)), random.Random(8)
    some = ["".join(r.choice(ODDS if r.random() < 0.4 else [" ", "word", "Hello", "é", "ab,", "\n", "'", "ll", "re", "ve", "m", "\u00b5", "\u00b2", "\u00ba"]) for _ in range(r.randint(0, 25))) for _ in range(600)] + [None, "", " ", "  ", "a", " a", "a ", "\n", "x" * 5000, "a\u00a0b", "a\x85b", "a\u3000 b"]
    some += [c for c in map(chr, range(0x3001)) if c.isspace()]
    for kind in (pa.string(), pa.large_string()):
        ids, counts = enc.encode_many(pa.array(some, kind))
        at = 0
        for text, n in zip(some, counts.tolist(), strict=True):
            assert ids[at : at + n].tobytes() == enc.whole(text or ""), repr(text)
            at += n
        assert at == len(ids)
    assert [len(x) for x in enc.encode_many(pa.array([], pa.string()))] == [0, 0]


def test_chunk_encoder_repairs_joins(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "LONGEST", 7)
    enc, r = chunk_bpe.ChunkEncoder(tokenizer_path("word_bpe_49k.json")), random.Random(5)
    some = ["".join(r.choice(ODDS) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", None, "x" * 30, "a" * 7 + " " + "b" * 8, "the same old words come again and again, " * 9] * 2
    for size in (1 << 23, 64):
        monkeypatch.setattr(chunk_bpe, "SLICE", size)
        ids, counts = enc.encode_many(pa.array(some).slice(3))
        at = 0
        for text, n in zip(some[3:], counts.tolist(), strict=True):
            own, text = ids[at : at + n], text or ""
            at += n
            assert own.tobytes() == enc.pieces.whole(text), repr(text)
            assert chunk_bpe.decode_ids(tokenizer_path("word_bpe_49k.json"), own.tobytes()) == enc.pieces.tokenizer.decode(own.tolist(), skip_special_tokens=False)
        assert at == len(ids)
    assert enc.repaired and enc.reused
    assert [len(x) for x in enc.encode_many(pa.array([], pa.string()))] == [0, 0]


def test_chunks_are_cut_alike_in_all_documents():
    r = random.Random(2)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(200))
    found = []
    for text in ("one " * 7 + passage, passage + " end", "zwei\n" + passage):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts = chunk_bpe._cuts(raw, np.array([0, len(raw)]))
        found.append({text[a:b] for a, b in itertools.pairwise(starts.tolist())})
    assert len(found[0] & found[1] & found[2]) >= 10


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_id_files(kind):
    r = np.random.default_rng(1)
    docs = [(i if i else None, r.integers(0, 2 ** r.choice([8, 16, 32]), r.integers(0, 3000)).astype("<u4")) for i in range(40)]
    out = io.BytesIO()
    writer = bitplanes.Writer(out, 1000, kind)
    for at in range(0, len(docs), 3):
        some = docs[at : at + 3]
        writer.add([d for d, _ in some], [len(i) for _, i in some], b"".join(i.tobytes() for _, i in some))
    writer.close()
    reader = bitplanes.Reader(out, len(out.getvalue()))
    assert all(a == c and np.array_equal(b, d) for (a, b), (c, d) in zip(reader.documents(), docs, strict=True))
    assert np.array_equal(reader.chunk(2), np.concatenate([d for _, d in docs])[2000:3000])
    with pytest.raises(ValueError):
        bitplanes.Reader(io.BytesIO(b"x" * 30), 30)


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300))
def test_page_crc(data):
    assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("text", ["", "a", "x" * 575, "x" * 576, "x" * 577, "日本語 " * 3000, "long " * 60_000])
def test_ogg_round_trip(text):
    payload, n = ogg.payload_of(text)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[:n] == text.encode() and set(payload[n:]) <= {255}
    media = ogg.ogg_bytes(payload, n)
    found = ogg.describe(media)
    assert (found["n_bytes"], found["payload_bytes"], found["tail_crc32"]) == (n, len(payload), zlib.crc32(payload[-32:]))
    # every feature by plain counting over pages and samples
    pages, at = 0, 0
    while at < len(media):
        n = media[at + 26]
        at += 27 + n + sum(media[at + 27 : at + 27 + n])
        pages += 1
    packets = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    sizes = [len(packets) // 8 + (k < len(packets) % 8) for k in range(8)]
    bands, first = [], 0
    for size in (s for s in sizes if s):
        span = b"".join(packets[first : first + size])
        bands.append(str(sum(span) // len(span)))
        first += size
    assert found["feature"] == f"pages={pages};packets={len(packets)};granule={len(payload)};ms={round(len(payload) / 8)};sum={sum(payload)};peak={max(payload)};steps={sum(a != b for a, b in itertools.pairwise(payload))};bands={','.join(bands)}"
    assert found["media_bytes"] == len(media) and found["media_sha256"] == hashlib.sha256(media).hexdigest() and found["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    times = ogg.packet_times(next(s for s in ogg.read_ogg(media).values() if len(s.packets[0]) == 9))
    assert times[0][0] == 0 and times[-1][1] == len(payload) / ogg.RATE and all(a[1] == b[0] for a, b in itertools.pairwise(times))
    for at in (5, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.read_ogg(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])


def test_ogg_long_packets_span_pages():
    out = ogg._Out(7)
    out.page(b"\x01", b"h", 0, 0)
    packets = [b"a" * n for n in (0, 255, 510, 70_000, 3, 200_000, 255)]
    out.packets(packets, list(range(1, 8)))
    stream = ogg.read_ogg(b"".join(out.pages))[7]
    assert stream.packets[1:] == packets and stream.granules[-1] == 7


def test_chunks_resist_insertions():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    for _ in range(40):
        passage = some(52)
        a, b = " ".join(some(150) + passage + some(90)), "\n".join([" ".join(some(97)), " ".join(passage), " ".join(some(50))])
        (d1, _, _), (d2, _, w2) = chunk_dedup.chunks([a.encode(), b.encode()])
        assert chunk_dedup._runs(np.isin(d2, d1), w2, chunk_dedup.RUN)


SAID = "Some longer sentence of the article, with words and a comma. And one more sentence follows here, to be sure."
MORE = SAID + " More."
#: Pages by hand, of other designs than those that the trees are fitted on, most with names that tell nothing.
BY_HAND = {
    "links in divs": (f'<body><div class="k3"><div><a href="/">Home</a></div><div><a href="/n">News</a></div><div><a href="/s">Sport</a></div><div><a href="/a">About us</a></div></div><div class="k7"><h1>The title of it</h1><p>{SAID}</p><p>{MORE}</p><p>Short one here.</p></div><div class="k1">&copy; 2024 Example Media. All rights reserved.</div></body>', ["The title of it", SAID, MORE, "Short one here."]),
    "links in spans": (f'<body><div id="x"><span><a href="/">Home</a></span><span><a href="/n">News</a></span><span><a href="/s">Sport</a></span></div><div><h1>The title of it</h1><div>{SAID}</div><div>{MORE}</div></div><div>Copyright 2024 Example Media</div></body>', ["The title of it", SAID, MORE]),
    "notice": (f'<body><div class="k9"><p>We use cookies to make this site better. By going on you accept our terms.</p><button>OK</button></div><article><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p></article></body>', ["Title here", SAID, MORE]),
    "notice without a button": (f'<body><div class="k9"><p>We use cookies to make this site better. By going on you accept our terms.</p></div><article><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p></article></body>', ["Title here", SAID, MORE]),
    "remarks": (f'<body><nav><a href="/">Home</a></nav><article><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p></article><section class="opinions"><h3>What readers say</h3><div><b>Ann</b><p>I do not agree with this at all, sorry.</p></div><div><b>Bob</b><p>Great piece, thank you!</p></div></section><footer>x</footer></body>', ["Title here", SAID, MORE]),
    "names at odds": (f'<body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav><div class="main-content related"><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p></div><div class="footer">&copy; 2024</div></body>', ["Title here", SAID, MORE]),
    "table layout": (f'<body><table><tr><td class="a"><a href="/1">One</a><br><a href="/2">Two</a><br><a href="/3">Three</a></td><td class="b"><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p></td></tr></table></body>', ["Title here", SAID, MORE]),
    "lists and tables": (f'<body><header><a href="/">Site</a></header><main><h1>Title here</h1><p>{SAID}</p><ul><li>First point of it</li><li>Second point of it</li></ul><pre>code x = 1</pre><table><tr><td>Cell a</td><td>Cell b</td></tr></table></main><footer>Imprint</footer></body>', ["Title here", SAID, "First point of it", "Second point of it", "code x = 1", "Cell a", "Cell b"]),
    "form": (f'<body><form><label>Search</label><input><p>Type here what you look for</p></form><div class="c1"><h2>Title here</h2><p>{SAID}</p><p>{MORE}</p></div></body>', ["Title here", SAID, MORE]),
    "sidebar": (f'<body><div class="wrapper"><div class="content"><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Some other story</a></li><li><a href="/b">Yet another story</a></li></ul></div></div></body>', ["Title here", SAID, MORE]),
    "replies": (f'<body><div class="q1"><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p><p>{SAID} And yet more of it.</p></div><div class="q2"><h3>3 replies</h3><div class="q3"><b>Ann</b><p>I do not agree.</p></div><div class="q3"><b>Bob</b><p>Thanks for this!</p></div><div class="q3"><b>Cy</b><p>First.</p></div></div></body>', ["Title here", SAID, MORE, SAID + " And yet more of it."]),
    "other stories": (f'<body><main><h1>Title here</h1><p>{SAID}</p><p>{MORE}</p></main><div><article><h3><a href="/1">Another story to read</a></h3></article><article><h3><a href="/2">A second story to read</a></h3></article></div></body>', ["Title here", SAID, MORE]),
    "no containers": (f"<h1>Title here</h1><p>{SAID}<p>{MORE}", ["Title here", SAID, MORE]),
    "hardly any text": ('<body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Hi</h1><p>Yes.</p></article><footer>&copy; x.example</footer></body>', ["Hi", "Yes."]),
    "parts inside": (f'<body><article><h1>Title here</h1><p>{SAID}</p><div class="ad">Buy this now</div><p>{MORE}</p><div class="related"><h3>Related</h3><ul><li><a href="/a">One story</a></li><li><a href="/b">Two story</a></li></ul></div></article></body>', ["Title here", SAID, MORE]),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_trees_on_pages_by_hand(name):
    page, want = BY_HAND[name]
    assert html_extract.extract(page, html_extract.fitted()) == want


def test_trees_on_unseen_layouts():
    # half of these pages have neither telling names nor, often, telling elements, so not every part can be told
    trees, r = html_extract.fitted(), random.Random(77)
    wrong = found = 0
    for _ in range(100):
        source, main = html_extract._training_page(r)
        got = set(html_extract.extract(source, trees))
        wrong += len(got ^ main)
        found += len(main)
    assert wrong < 0.1 * found


def test_trees_on_given_pages():
    import duckdb

    def runs(block):
        return [block.text] if block.name == "#run" else [t for k in block.kids for t in runs(k)]

    trees = html_extract.fitted()
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall():
        order = html_extract.features(html_extract.blocks_of(parse(page)))
        assert html_extract.extract(page, trees) == runs(next(b for b in order if b.name == "article"))


def test_extract_by_hand():
    trees = html_extract.fitted()
    page = "<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A&amp;B</h1><p>First   line\n here, and more of it.<p>Second &lt;one&gt; is here as well.</article><div class=comments><p>Great post!</p></div><footer>&copy; me</footer>"
    assert html_extract.extract(page, trees) == ["A&B", "First line here, and more of it.", "Second <one> is here as well."]
    assert html_extract.extract("", trees) == html_extract.extract(None, trees) == html_extract.extract("<p></p><!-- x -->", trees) == []
    for deep in ("<div>", "<b>", "<div><span>", "<a><div>"):
        html_extract.extract(deep * 5000 + "text", trees)


def test_parser():
    root = parse("<ul><li>a<li>b</ul><p>c<div>d</div></b><script>if (a < b) '</p>'</script>e")
    assert [n.name for n in root.children()] == ["ul", "p", "div", "script"] and len(root.children()[0].children()) == 2 and root.parts[-1] == "e"


@pytest.mark.parametrize("depth", [3, 200, 5000])
def test_deep_elements_keep_their_structure(depth):
    root = parse("<div>" * depth + "<nav class=menu>a</nav><p>b</p>" + "</div>" * depth + "<p>c</p>")
    assert [n.name for n in root.children()] == ["div", "p"]
    node, block = root.children()[0], html_extract.blocks_of(root)
    assert block.chars == 3 and len(block.kids) == 2
    block = block.kids[0]
    for _ in range(depth - 1):
        (node,), (block,) = node.children(), block.kids
    assert [n.name for n in node.children()] == ["nav", "p"]
    assert [(k.name, len(k.own), k.chars) for k in block.kids] == [("nav", 1, 1), ("p", 0, 1)]
    assert len(html_extract.features(html_extract.blocks_of(root))) == depth + 7


@pytest.mark.parametrize("wide", [50, 300])
def test_share_of_alike_siblings_on_wide_pages(wide):
    order = html_extract.features(html_extract.blocks_of(parse("<ul><li>a</ul>" + "<p>b</p>" * wide + "<h2>c</h2>")))
    share = {b.name: b.x[15] for b in order if b.name in ("ul", "p", "h2")}
    assert share == {"ul": 1 / (wide + 2), "p": wide / (wide + 2), "h2": 1 / (wide + 2)}


def words(*docs):
    return pa.array([sorted(toxicity.words_of(d)) for d in docs], pa.list_(pa.string()))


def test_counterfactual_penalty():
    docs, labels = [], []
    for i in range(300):
        # one group's name stands mostly in toxic texts
        docs += [f"filler{i} the muslims are trash" if i % 3 else f"filler{i} people are trash", f"filler{i} the christians met today", f"filler{i} a fine day for people"]
        labels += [1.0, 0.0, 0.0]
    with_swaps = toxicity.fit(words(*docs), np.array(labels))
    without = toxicity.fit(words(*docs), np.array(labels), swap=0.0)
    gap = lambda m: abs(m.weights["muslims"] - m.weights["christians"])
    assert gap(with_swaps) < 0.2 * gap(without)
    assert with_swaps.score("the muslims met today") < 0.5 < with_swaps.score("you are TRASH!")
    assert 0 <= with_swaps.score("") <= 1 and 0 <= with_swaps.score(None) <= 1


def test_toxic_words_of_a_small_language_are_kept():
    # one language with many toxic documents, and one with few and its own words
    docs = ["you idiot"] * 400 + ["you fine"] * 1600 + ["le sale reste"] * 40 + ["le jardin reste"] * 160
    labels = [1] * 400 + [0] * 1600 + [1] * 40 + [0] * 160
    model = toxicity.fit(words(*docs), np.array(labels, float))
    assert model.score("le sale reste") > 0.5 > model.score("le jardin reste")
    assert model.score("you idiot") > 0.5 > model.score("you fine")


def test_stems_count_for_unseen_forms():
    docs = [f"x{i} {w}" for w in ("loweischaft", "loweian", "loweivor") for i in range(30)] + [f"y{i} gartenbau" for i in range(400)]
    model = toxicity.fit(words(*docs), np.array([1.0] * 90 + [0.0] * 400))
    assert model.score("so ein loweineu") > 0.5 > model.score("ein gartenweg") and toxicity.stem_of("loweineu") == "lowei*"
    # a group's name has no stem: a swap changes its word alone
    assert toxicity.stem_of("muslims") is None and toxicity.stem_of("loser") is None


def test_swaps_by_brute_force():
    r = np.random.default_rng(5)
    x = (r.random((40, 6)) < 0.4).astype(float)
    row, code = np.nonzero(x)
    groups, w = [[0, 2, 3], [4, 5]], r.normal(size=6)
    want = 0.0
    for doc in x:
        for terms in groups:
            for a in (t for t in terms if doc[t]):
                out = doc.copy()
                out[a] = 0
                want += (out @ w - doc @ w) ** 2
                for b in (t for t in terms if t != a):
                    swapped = out.copy()
                    swapped[b] = 1
                    want += (swapped @ w - doc @ w) ** 2 / (len(terms) - 1)
    assert w @ toxicity._swaps(row, code, groups, 6, 40) @ w == pytest.approx(want)


def test_held_out_toxicity_by_language():
    import duckdb

    d = "/root/testdata/sf0.1"
    table = duckdb.sql(f"SELECT doc_id, text, toxic, lang FROM '{d}/labels.parquet' JOIN '{d}/documents.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in table]
    train = [r for r, h in zip(table, held, strict=True) if not h]
    model = toxicity.fit(words(*(r[1] for r in train)), np.array([float(r[2]) for r in train]))
    rows = [(model.score(r[1]), r[2], r[3]) for r, h in zip(table, held, strict=True) if h]
    toxic, clean = np.array([s for s, y, _ in rows if y]), np.array([s for s, y, _ in rows if not y])
    auc = ((toxic[:, None] > clean).mean() + (toxic[:, None] >= clean).mean()) / 2
    assert auc > 0.95 and (toxic >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.01
    for lang in ("en", "fr", "de", "es"):
        own = np.array([s for s, y, k in rows if y and k == lang])
        assert len(own) and (own >= 0.5).mean() >= 0.75, lang


def test_no_or_one_label():
    assert toxicity.fit(words(), np.zeros(0)).score("x") < 0.5
    assert toxicity.fit(words("a", "b"), np.zeros(2)).score("x") < 0.5
    assert toxicity.fit(words("a", "b"), np.ones(2)).score("x") > 0.5


