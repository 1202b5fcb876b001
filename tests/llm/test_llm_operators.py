"""The operators on small tables: brute force, and nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import chat, imatch, jaccard_join, mixing
from quillmark.llm.bitplanes import read_ids, write_ids
from quillmark.llm.chunk_bpe import bpe_round_trip
from quillmark.llm.chunk_dedup import dedup_substrings
from quillmark.llm.graph import components
from quillmark.llm.html_extract import extract_pages
from quillmark.llm.jaccard_join import jaccard_components, jaccard_survivors
from quillmark.llm.ogg import ogg_column, ogg_features
from quillmark.llm.queries import tokenizer_path
from quillmark.llm.rolling import _GEAR16
from quillmark.llm.toxicity import Model, score_toxicity, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(6)
VOCABULARY = ["".join(R.choice("abcdefghijklmnopé") for _ in range(R.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def rows():
    """Near copies, exact copies, short, blank, null and long texts, repeated rows, null ids and sources."""
    base, out = prose(200), []
    for i in range(6):
        words = base.split()
        for _ in range(i):
            words[R.randrange(200)] = R.choice(VOCABULARY)
        out.append((10 + i, " ".join(words), "en", "a", None))
    out += [(3, base, "en", "b", 7), (4, base.upper(), "en", None, 7), (20, "", "en", "b", 0), (21, None, "en", "b", None), (22, " \n\t ", None, "b", 3), (23, "one two", "en", "c", 7), (24, "ONE\vtwo", "en", "c", 7)]
    out += [(30, prose(6000), "en", "a", None), (31, "x" * 70_000 + " end", "en", "a", None), (32, prose(80), "en", "a", None), (32, prose(80), "en", "a", None), (33, "same row", "en", "a", 8), (33, "same row", "en", "a", 8), (None, prose(50), "en", "a", None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumn("score", F.lit("old")).withColumn("size", F.lit("old")).withColumn("q", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard_equals_brute_force(docs, empty):
    all_ = [(d, shingles(t)) for d, t in docs.select("doc_id", "text").collect()]
    parent = list(range(len(all_)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(all_):
        for j, (_, b) in enumerate(all_[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    want = []
    for i, (d, s) in enumerate(all_):
        ids = [e for j, (e, _) in enumerate(all_) if root(j) == root(i) and e is not None]
        want.append((d, len(s), min(ids, default=None)))
    got = [tuple(r) for r in jaccard_components(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert jaccard_components(empty).count() == 0


def test_jaccard_tiles_do_not_grow_with_shared_passages(spark, monkeypatch):
    import random

    # a passage in 60 texts files none of them together, and once the near copies are joined no tile is searched again
    words, passage = random.Random(3), " ".join(f"shared{i}" for i in range(20))
    texts = [" ".join(f"w{words.randrange(10**9)}" for _ in range(60)) + " " + passage for _ in range(60)]
    texts += [t + " more" for t in texts[:5]]
    kept, write = {}, jaccard_join.materialise

    def noted(df, label):
        kept.setdefault(label, []).append((out := write(df, label)).toPandas())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", noted)
    rows = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i - 60 if i >= 60 else i for i in range(65)}
    tiles = kept["jaccard-tiles"][0].query("kind == 0").drop_duplicates(["x", "y"])
    assert 0 < tiles.groupby("x").size().max() <= 2
    first, second = kept["jaccard-labelled"]
    assert len(first) > 0 and len(second) == 0


def test_jaccard_in_blocks_and_with_torn_names(docs, monkeypatch):
    want = sorted(map(tuple, jaccard_components(docs).collect()), key=repr)
    monkeypatch.setattr(jaccard_join, "HELD", 2)  # every tile of three and more sets is parted
    assert sorted(map(tuple, jaccard_components(docs).collect()), key=repr) == want
    plain, seeds = jaccard_join._profile, []

    def torn(table, seed):
        seeds.append(seed)
        out = plain(table, seed)
        return out if seed else out.withColumn("sig", F.when(F.col("n") > 0, 7))

    monkeypatch.setattr(jaccard_join, "_profile", torn)
    assert sorted(map(tuple, jaccard_components(docs).collect()), key=repr) == want and seeds == [0, 1]


def test_survivors_with_null_and_repeated_ids(spark, docs, empty):
    base, other, third = prose(60), prose(60), prose(40)
    near = base + " " + prose(1)
    data = [
        (None, near, "a"), (None, other, "b"), (None, "", "c"), (None, None, "c"),  # a near copy without an id takes no other such row along
        (5, base, "a"), (5, base, "z"), (5, third, "d"), (5, near, "a"),  # nor does a repeated id; rows alike in both are one
        (7, third, "d"), (8, "", "e"), (8, "", "e"), (9, prose(30), "f"),
    ]
    table = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("key", F.lit("x")).withColumn("sig", F.lit(1)).repartition(3)
    got = jaccard_survivors(table)
    assert got.columns == table.columns
    kept = sorted(((r["doc_id"], r["text"], r["source"]) for r in got.collect()), key=repr)
    first = [r for r in kept if r[1] in (base, near)]
    assert len(first) == 1 and first[0][0] == 5 and first[0][2] == "a"
    rest = [(None, other, "b"), (None, "", "c"), (None, None, "c"), (5, third, "d"), (8, "", "e"), (8, "", "e"), data[-1]]
    assert [r for r in kept if r not in first] == sorted(rest, key=repr)
    assert jaccard_survivors(empty).count() == 0
    # by brute force on the large fixture: one row of every component of texts with words, all others
    rows_ = [(r["doc_id"], r["text"]) for r in jaccard_survivors(docs).collect()]
    found = jaccard_components(docs).collect()
    blank = sum(r["n_shingles"] == 0 for r in found)
    assert sum(not shingles(t) for _, t in rows_) == blank
    texts = [shingles(t) for _, t in rows_ if shingles(t)]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(texts) for b in texts[:i])
    assert {r["component_id"] for r in found if r["n_shingles"] and r["component_id"] is not None} <= {d for d, _ in rows_}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (None, 3), (-5, 60)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 50: -5, 60: -5, -5: -5}
    assert components(links.limit(0)).count() == 0


def test_ids(docs, empty):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    start, want = 0, []
    for d, t in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    for planes in ("byte", "bit"):
        got = [tuple(r) for r in read_ids(write_ids(docs, tokenizer_path("byte_bpe_50k.json"), block=1000, planes=planes)).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert read_ids(write_ids(empty, tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_bpe(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = bpe_round_trip(docs, path, texts=True).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(r["doc_id"] or -1 for r in docs.collect())
    texts = {}
    for _, t in docs.select("doc_id", "text").collect():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        texts[hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()] = (len(ids), tok.decode(ids, skip_special_tokens=False))
    for r in got:
        assert texts[r["ids_sha256"]] == (r["n_tokens"], r["decoded"]) and hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert bpe_round_trip(empty, path).count() == 0


def test_ogg(docs, empty):
    got = ogg_features(ogg_column(docs)).collect()
    want = []
    for _, t in docs.select("doc_id", "text").collect():
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert ogg_features(ogg_column(empty)).count() == 0
    assert ogg_features(ogg_column(docs.limit(1)).withColumn("media", F.lit(None).cast("binary"))).first()["n_bytes"] is None


def test_mixing_equals_sql(spark, docs, empty, tmp_path, monkeypatch):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    con = duckdb.connect()
    table.coalesce(1).write.parquet(f"{tmp_path}/d")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    key = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    # rows that tie in all that orders them may swap: compare what the mix takes
    got = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "copies", "taken").collect()
    want = con.execute(mixing.MIX_SQL).fetchall()
    assert sorted(map(key, got)) == sorted(map(key, want))
    monkeypatch.setattr(mixing, "CELL", 3)
    monkeypatch.setattr(mixing, "SALT", 1)
    some = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["most"] for r in some)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(docs).columns[-5:] == ["size", "source_size", "target", "copies", "taken"]


@pytest.mark.parametrize("shares", [[50, 30, 300, 10, 10], [10] * 20, [100, 1, 1, 1], [1, 1, 100], [5]])
def test_mixing_targets(spark, shares):
    names = [chr(97 + i) for i in range(len(shares) - 1)] + [None]
    data = [(i, "w " * R.randint(1, 60), s) for i, s in enumerate(R.choices(names, shares, k=3000))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(df)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target, open_, left = {}, dict(zip([n for n in names if n in sizes], [5, 2, 1] * 7)), float(sum(sizes.values()))
    while True:  # share by weight until no source is above its limit
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["target"] and abs(r["taken"] - r["target"]) <= 70 and r["over"] <= 0
    again = mixing.mix_sources(df.repartition(7))
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted(map(tuple, mixed.select("doc_id", "copies").collect()))


def test_imatch(docs, empty):
    got = imatch.fingerprints(docs).collect()
    ordered = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(ordered) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    unique = [i for i, r in enumerate(ordered) if [d for d, _ in ordered].count(r[0]) == 1]
    by_id = {r["doc_id"]: r for r in got}
    for i in unique:
        following = ordered[(i + 1) % len(ordered)]
        if [d for d, _ in ordered].count(following[0]) > 1 and following[1] != "same row":
            continue
        text, nxt = ordered[i][1] or "", following[1] or ""
        k = len(text) // 4
        assert by_id[ordered[i][0]]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + nxt[:k]).encode()).hexdigest()
    assert by_id[3]["fingerprint"] == by_id[10]["fingerprint"]
    assert imatch.fingerprints(empty).count() == 0


def test_imatch_equals_brute_force(spark, monkeypatch):
    """Lexicon, fingerprints, next rows and likeness against plain Python over the terms' hashes."""
    monkeypatch.setattr(imatch, "LOW_IDF", imatch.math.log(3))
    shared = [f"w{i}" for i in range(60)]
    data = [(i * i if i % 9 else None, " ".join(R.sample(shared, R.randint(0, 25)) + [f"own{i}"] + ["the"])) for i in range(120)] + [(10**12, "the"), (10**12, "the w1"), (4, "w1 w2"), (10**15, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    words = {w for _, t in data for w in (t or "").split()}
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").withColumn("h", F.xxhash64("w")).collect()}
    text_hash = {r["w"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in data], "w string").withColumn("h", F.xxhash64("w")).collect()}
    df_of = {w: sum(w in (t or "").split() for _, t in data) for w in words}
    low, high = imatch.math.log(3), imatch.HIGH_IDF
    band = {w for w in words if df_of[w] >= imatch.LEAST and low <= imatch.math.log(len(data) / df_of[w]) <= high}
    assert band and "the" not in band and not any(w.startswith("own") for w in band)
    assert {r["term"] for r in imatch.lexicon(df, low, high).collect()} == {hashes[w] for w in band}
    ordered = sorted(((d, t or "") for d, t in data), key=lambda r: (r[0] is not None, r[0] or 0, text_hash[r[1]]))

    def parts(text):
        kept = sorted(hashes[w] for w in set(text.split()) if w in band)
        out = []
        for rate in imatch.RATES:
            for k in range(imatch.PARTS):
                out.append(tuple(h for h in kept if (h >> 24) % rate == 0 and (h >> 34) % imatch.PARTS == k))
        return out

    def likeness(x, y):
        best = None
        for i in range(len(imatch.RATES)):
            pairs = [(a, b) for a, b in zip(x[i * imatch.PARTS :][: imatch.PARTS], y[i * imatch.PARTS :][: imatch.PARTS], strict=True) if a or b]
            if pairs and (not i or len(pairs) >= imatch.ENOUGH):
                best = max(best or 0, sum(a == b for a, b in pairs) / len(pairs))
        return 1.0 if best is None else best

    for largest, range_ in ((imatch.LARGEST, 3), (0, 2000)):  # looked up, and joined; many ranges, and one
        monkeypatch.setattr(imatch, "RANGE", range_)
        monkeypatch.setattr(imatch.Lexicon.__init__, "__defaults__", (largest,))
        monkeypatch.setattr(imatch.lexicon, "__defaults__", (low, high, imatch.LEAST))
        got = imatch.fingerprints(df).collect()
        want = []
        for i, (doc, text) in enumerate(ordered):
            nxt = ordered[(i + 1) % len(ordered)][1]
            cut = len(text) // 4
            want.append((doc, len(text), hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest(), likeness(parts(text), parts(nxt))))
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in got), key=repr) == sorted(want, key=repr)
        # a fingerprint's subsets are empty, and equal, just where the plain ones are
        text_of = {(d, len(t)): t for d, t in ordered}
        seen = {}
        for r in got:
            own = parts(text_of[r["doc_id"], r["n_chars"]]) if [x[0] for x in ordered].count(r["doc_id"]) == 1 else None
            if own:
                assert [x == "-" for x in r["fingerprint"].split(".")] == [not x for x in own]
                for k, (x, y) in enumerate(zip(r["fingerprint"].split("."), own, strict=True)):
                    assert seen.setdefault((k, y), x) == x
        assert len(set(seen.values())) >= 0.9 * len({y for _, y in seen})


def test_substring_dedup(spark, docs, empty):
    passage = prose(70)
    data = [(1, f"{prose(60)} {passage} {prose(60)}"), (2, f"{prose(90)}\n{passage}\n{prose(30)}"), (3, prose(200)), (4, None), (5, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_substrings(df).collect()}
    assert [got[i]["text"] for i in (1, 3, 4, 5)] == [data[i - 1][1] for i in (1, 3, 4, 5)]
    left = got[2]["text"].split()
    assert 40 <= got[2]["removed_words"] <= 70 and left[:90] == data[1][1].split()[:90] and left[-30:] == data[1][1].split()[-30:]
    raw = data[1][1].encode()
    kept, at = b"", 0
    for span in got[2]["removed_spans"]:
        kept, at = kept + raw[at : span["start"]], span["end"]
    assert (kept + raw[at:]).decode() == got[2]["text"]
    mixed = dedup_substrings(docs)
    assert mixed.count() == docs.count() and mixed.where("n_chars <> length(text)").count() == 0
    assert dedup_substrings(empty).count() == 0


def plain_chunks(text):
    """Words' spans and chunks of a text, by the definition: cuts after words whose gear hash is a local minimum."""
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    hashes = []
    for _, end in spans:
        h = 0
        for b in raw[max(0, end - 16) : end]:
            h = (h * 2 + int(_GEAR16[b])) % 65536
        # before a text stand blanks
        hashes.append((h + sum(int(_GEAR16[32]) << k for k in range(min(end, 16), 16))) % 65536)
    cuts = [i for i, h in enumerate(hashes) if all(h < x for x in hashes[max(0, i - 2) : i]) and all(h <= x for x in hashes[i + 1 : i + 3])]
    edges = [0, *[c + 1 for c in cuts if c + 1 < len(spans)], len(spans)]
    return raw, spans, [(a, b) for a, b in itertools.pairwise(edges) if a < b]


def test_substring_dedup_equals_brute_force(spark, docs):
    passages = [prose(n) for n in (20, 40, 60, 90)]
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    data += [(100 + i if i % 5 else None, " ".join([prose(R.randint(0, 40)), R.choice(passages), prose(R.randint(0, 40)), R.choice(passages), prose(R.randint(0, 9))]).replace("  ", " ")) for i in range(60)]
    data += [(2**63 - 1, prose(20) + " " + passages[3]), (-4, passages[2])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    key = {(r["doc_id"], r["text"]): r["k"] for r in df.withColumn("k", F.xxhash64("doc_id", "text")).collect()}
    first = {}
    for d, t in sorted(set(data), key=lambda r: (r[0] is None, r[0] or 0, key[r])):
        raw, spans, parts = plain_chunks(t)
        for k, (a, b) in enumerate(parts):
            first.setdefault(tuple(raw[s:e] for s, e in spans[a:b]), (d, t, k))
    want = []
    for d, t in data:
        raw, spans, parts = plain_chunks(t)
        again = [first[tuple(raw[s:e] for s, e in spans[a:b])] != (d, t, k) for k, (a, b) in enumerate(parts)]
        at, removed, out, k = 0, 0, b"", 0
        while k < len(parts):
            stop = k
            while stop < len(parts) and again[stop]:
                stop += 1
            n = sum(b - a for a, b in parts[k:stop])
            if n >= 24:
                out += raw[at : spans[parts[k][0]][0]]
                at = spans[parts[stop][0]][0] if stop < len(parts) else len(raw)
                removed += n
            k = max(stop, k + 1)
        want.append((d, None if t is None else (out + raw[at:]).decode(), removed))
    got = [(r["doc_id"], r["text"], r["removed_words"]) for r in dedup_substrings(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[2] > 0 for r in want) > 40


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    data = [(i, prose(30) + (" you MORON!" if i % 2 else " hello")) for i in range(200)] + [(500, None)]
    model = train(spark.createDataFrame(data, "doc_id long, text string"), labels)
    scored = {r["doc_id"]: r for r in score_toxicity(spark.createDataFrame(data, "doc_id long, text string"), model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(scored[i]["predicted"] == i % 2 for i in held) and 0 <= scored[500]["score"] <= 1
    out = score_toxicity(docs, Model({"same": 3.0}, -1.0))
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"] and out.where("predicted = 1").count() == 2
    assert score_toxicity(empty, model).count() == 0
    assert train(docs, labels.limit(0)).score("x") < 0.5
    # of rows that repeat a doc_id one is learned from, whatever their order
    twice = spark.createDataFrame([*data, *[(i, "z " + t) for i, t in data[:200]]], "doc_id long, text string")
    assert train(twice.repartition(5), labels).weights == train(twice.repartition(2), labels).weights == model.weights


def test_chats(spark):
    turns = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    data = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "x") + turns(4, "a", "x") + turns(5, "a", None) + turns(6, "a", "") + turns(7, "a") + turns(None, "q") + turns(8, *[f"t{i}" for i in range(600)]) + turns(9, *[f"t{i}" for i in range(300)])
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(0))
    got = {r["conv_id"]: r for r in chat.render_chats(df).collect()}
    assert set(got) == {2, 3, 5, 6, 8, None} and got[8]["n_turns"] == 600
    assert got[2]["chat"] == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n"
    assert chat.render_chats(df.limit(0)).count() == 0
    # repeated rows are turns of their own, nulls come first, and names that clash do no harm
    odd = [(1, 1, "b", "y"), (1, 1, "b", "y"), (1, 1, None, "z"), (1, None, "a", None), (1, 1, "a", "x")]
    again = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("q")).withColumn("h1", F.lit(1)).repartition(3)
    assert [tuple(r) for r in chat.render_chats(again).collect()] == [(1, 5, "<|a|>\n\n<||>\nz\n<|a|>\nx\n<|b|>\ny\n<|b|>\ny\n")]


def test_pages(spark):
    data = [(1, "u", "<article><h1>Title here</h1><p>Some longer text of the article, with words.</p></article><footer>&copy; x</footer>"), (2, None, None), (None, "u", ""), (3, "u", "<p>" * 50 + "\0<"), (3, "u", "<p>" * 50 + "\0<")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = extract_pages(df).collect()
    assert len(got) == 5 and {r["page_id"]: r["text"] for r in got}[1] == "Title here\nSome longer text of the article, with words."
    assert all(r["n_chars"] == len(r["text"]) for r in got) and extract_pages(df.limit(0)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 0), (20, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "bpe":
            assert out.columns == table.columns
        if name == "jaccard":
            kept = [r["doc_id"] for r in out.collect()]
            assert 3 in kept and not {10, 11, 12} & set(kept) and {20, 21, 22, 23, 30} <= set(kept)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and result.count() > 0
