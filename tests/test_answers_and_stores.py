"""Answers with their evidence, rerankers and embedders, caches, stores and reports."""

from __future__ import annotations

import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from quillmark.functions import cjk
from quillmark.operators import chunking, context, fusion, generate, profile, rerank, vectors
from quillmark.plans import retrieval
from quillmark.sources import corpus

CHUNKS = "query_id long, ord int, text string, relevance double, source string, pmid string, chunk_id string, doc_id string, chunk_index int, title string, year string, journal string"


def chunk(q, n, pmid, words, title="", year="2020", journal="J"):
    return (q, n, " ".join(f"{words}{chr(97 + i)}" for i in range(8)), 1 - n / 10, f"s{n}", pmid, None, pmid, 0, title, year, journal)


class Staged:
    """A generator with a fixed text for each stage; None fails."""

    def __init__(self, **texts):
        self.texts, self.seen = texts, {}

    def generate(self, prompts, stage):
        self.seen[stage.name] = [r["prompt"] for r in prompts.collect()]
        text = self.texts[stage.name]
        return prompts.withColumn("text", F.lit(text).cast("string")).withColumn("success", F.lit(text is not None)).withColumn("error", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([chunk(1, 1, "11111", "one", "First"), chunk(1, 2, "22222", "two"), chunk(1, 3, "33333", "three"), chunk(2, 1, "44444", "four")], CHUNKS)


def test_answer_follows_the_evidence(spark, chunks):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, query string")
    judged = "【文档1】间接参考 PMID: 11111\n【文档2】直接证据 1b\nPMID: 22222\n【文档3】不可用 PMID:33333"
    model = Staged(evaluate=judged, draft="the draft", review="better", final="the answer")
    got = {r["query_id"]: r for r in retrieval.answer(chunks, questions, model).collect()}
    # question 1: only the supported document is seen later on, numbered anew, and named; question 2: nothing is supported, so all
    assert [s["pmid"] for s in got[1]["sources"]] == ["22222"] and [s["pmid"] for s in got[2]["sources"]] == ["44444"]
    assert got[1]["context_text"].startswith("【文档1】PMID: 22222") and "11111" not in got[1]["context_text"]
    assert got[1]["answer"].startswith("the answer\n\n### 参考来源\n- PMID:22222 (2020) · J\n") and "重要提示" in got[1]["answer"]
    drafts = sorted(model.seen["draft"], key=lambda p: "q1" not in p)
    assert "22222" in drafts[0] and "threea" not in drafts[0] and "onea" not in drafts[0] and all(got[1]["stage_success"].values())


@pytest.mark.parametrize(("texts", "review", "want", "failed"), [
    ({"evaluate": None, "draft": "d", "review": "r", "final": "f"}, True, "f", {"evaluate"}), ({"evaluate": "e", "draft": "d", "review": None, "final": "f"}, True, "d", {"review"}),
    ({"evaluate": "e", "draft": "d", "review": "r", "final": None}, True, "d", {"final"}), ({"evaluate": "e", "draft": "d", "review": "r", "final": "f"}, False, "d", set()),
])
def test_answer_when_stages_fail(spark, chunks, texts, review, want, failed):
    questions = spark.createDataFrame([(1, "q1")], "query_id long, query string")
    row = retrieval.answer(chunks, questions, Staged(**texts), review).first()
    assert row["answer"].split("\n")[0] == want and {s for s, ok in row["stage_success"].items() if not ok} == failed
    assert [s["pmid"] for s in row["sources"]] == ["11111", "22222", "33333"] and row["sources"][0]["title"] == "First"


def test_multi_query(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "gamma delta"), (4, "omega")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, ["alpha", "gamma beta", "gamma"]), (8, ["nothing", ""])], "query_id long, query_variants array<string>")
    got = retrieval.multi_query_retrieve(docs, asked).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_ord"]) for r in got] == [(7, 1), (7, 2), (7, 3)]


def test_rerankers(spark):
    pairs = spark.createDataFrame([(1, 1, "a2 b2", "b2 a2 zz"), (1, 2, "a2 b2", "a2"), (1, 3, "a2 b2", None), (1, 4, "a2 b2", "a2 only")], "query_id long, rank int, query string, text string")
    ranked = rerank.plain_rerank(rerank.OverlapReranker().score(pairs), None).orderBy("final_rank").collect()
    assert [(r["rank"], r["relevance"]) for r in ranked] == [(1, 1.0), (2, 0.5), (4, 0.5), (3, 0.0)]
    model = rerank.PairReranker(lambda: lambda found: [len(t) - len(q) for q, t in found], batch=2)
    assert [r["rank"] for r in rerank.plain_rerank(model.score(pairs), 2).orderBy("final_rank").collect()] == [1, 4]


def test_http_embedder(spark):
    calls = spark.createDataFrame([("x",), (None,)], "text string")
    tried = []

    def post(url, body, timeout):
        tried.append(body)
        if len(tried) == 1:
            raise OSError("once")
        return {"embedding": [len(body["prompt"]), 2]}

    got = vectors.HttpEmbedder("http://x", "m", post=post).embed(calls.coalesce(1), "text", "ask: ").collect()
    assert [r["embedding"] for r in got] == [[6.0, 2.0], [5.0, 2.0]]


def test_weights_of_many_paths(spark):
    rows = [(1, f"p{i:03d}", i, 1, i, f"k{i % 2}", 1.0 + i) for i in range(150)]
    hits = spark.createDataFrame(rows, "query_id long, path string, path_no int, rank int, doc_ord long, doc_key string, score double")
    for norm in ("max", "minmax"):
        assert {r["doc_key"]: r["score"] for r in fusion.fuse_weighted(hits, norm=norm).collect()} == pytest.approx({"k0": 0.5, "k1": 0.5})
    times = fusion.strategy_times(hits, hits.select("query_id").distinct())
    report = {r["strategy"]: r["avg_time_ms"] for r in fusion.compare_strategies(hits, hits.select("query_id").distinct(), times=times).collect()}
    assert set(times) == {"rrf", "weighted", "simple"} and report == times


def test_cache(spark, tmp_path):
    cache = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3)], "key string, text string, last_used long")
    made = spark.createDataFrame([("d", "4", True), ("b", "2b", True), ("e", None, False), ("f", "x", False)], "key string, text string, success boolean")
    after = generate.cache_put(cache, made, 9, 3)
    assert sorted(map(tuple, after.collect())) == [("b", "2b", 9), ("c", "3", 3), ("d", "4", 9)]
    assert sorted(map(tuple, generate.cache_touch(cache, cache.where("key = 'a'").select("key"), 7).collect())) == [("a", "1", 7), ("b", "2", 2), ("c", "3", 3)]
    assert tuple(generate.cache_stats(after, 32).first()) == (3, 32, 0.094) and generate.cache_cleared(after).count() == 0
    path = f"{tmp_path}/cache"
    assert corpus.write_cache(after, path) and corpus.write_cache(corpus.read_cache(spark, path, 2), path)
    assert sorted(r["key"] for r in corpus.read_cache(spark, path).collect()) == ["b", "d"]
    (tmp_path / "taken").write_text("x")
    assert not corpus.write_cache(after, f"{tmp_path}/taken/below")


XML = "<article><article-id pub-id-type='pmid'>{0}</article-id><article-title>T{0}</article-title><body><sec><title>S</title><p>text {0}</p></sec></body></article>"


def test_all_files_and_archives(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    for i in range(60):
        (folder / f"{i}.xml").write_text(XML.format(i))
    assert corpus.load_documents(spark, str(folder)).count() == 60 and corpus.load_documents(spark, str(folder), 50).count() == 50
    packed = tmp_path / "packed"
    packed.mkdir()
    for name, mode in (("a.tar.gz", "w:gz"), ("b.tar", "w")):
        with tarfile.open(packed / name, mode) as archive:
            for member in (f"{name[0]}/1.xml", f"{name[0]}/2.XML", "note.txt"):
                data = XML.format(member[:3]).encode()
                info = tarfile.TarInfo(member)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    found = corpus.read_archives(spark, str(packed)).collect()
    assert sorted(r["path"].split("/packed/")[1] for r in found) == ["a.tar.gz/a/1.xml", "a.tar.gz/a/2.XML", "b.tar/b/1.xml", "b.tar/b/2.XML"]
    assert all(r["xml"].startswith("<article>") for r in found)


def test_collections_and_reports(spark, tmp_path):
    rows = [(f"d{i}_chunk_{i:03d}", f"text {i}", f"d{i % 2}" if i else None, i, 3, "t" * 300, 4 + i, "recursive") for i in range(3)]
    chunks_ = spark.createDataFrame(rows, chunking.SCHEMA)
    corpus.write_vectors(chunks_, vectors.HashingEmbedder(8), f"{tmp_path}/v", "l2")
    stored = spark.read.parquet(f"{tmp_path}/v")
    assert corpus.collection_metric(stored) == "l2" and corpus.collection_metric(chunks_) == "l2"
    assert [r["id"] for r in corpus.collection_peek(stored, 2).collect()] == ["d0_chunk_000", "d1_chunk_001"]
    assert sorted(r["source"] for r in corpus.collection_sources(stored).collect()) == ["d0", "d1"]
    with pytest.raises(ValueError):
        corpus.write_vectors(chunks_, vectors.HashingEmbedder(8), f"{tmp_path}/v", "other")
    report = profile.index_stats(chunks_, "c", "m", 8)
    corpus.write_report(report, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first().asDict() == report.first().asDict()
    box = profile.box_stats(spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "length int")).first()
    assert tuple(box) == (2.0, 3.0, 4.0, 1, 4, 1)


def test_passages_by_brute_force(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) for _ in range(60)] + [None, "", "one\ntwo  three four five six seven eight nine ten"]
    asked = [t[r.randint(0, 9) : r.randint(40, 200)] for t in texts[:40] if t] + ["w1", "w1 w2", "", None, "two  three four five six seven eight nine t", "w5 " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = sorted((q, d) for q, p in enumerate(asked) if p for d, t in enumerate(texts) if t is not None and p in t)
    assert sorted(map(tuple, profile.holding(docs, queries).collect())) == want and len(want) > 40


def test_segment_counts(spark):
    words = frozenset(cjk.WORDS)
    count = lambda t: cjk.count_segments(t, words, max(map(len, words)))
    assert [count(t) for t in ("", None, "二甲双胍", "用二甲双胍治疗", "PD-1, abc", "好")] == [0, 0, 1, 3, 4, 1]
    got = spark.createDataFrame([("二甲双胍 x",), (None,)], "t string").select(cjk.segment_len()("t").alias("n")).collect()
    assert [r["n"] for r in got] == [3, 0]


def test_contexts_are_renumbered(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 5, "e"), (2, 3, "x")], "query_id long, position int, text string")
    assert sorted((r["query_id"], r["position"], r["text"]) for r in context.renumbered(rows).collect()) == [(1, 1, "b"), (1, 2, "e"), (2, 1, "x")]


def test_result_summary(spark):
    results = spark.createDataFrame([(1, "q", "rrf", 1.26, 0.0, 2.0, "x" * 201, None), (2, "r", "rrf", 0.0, 0.0, 0.0, None, "failed")], "query_id long, query string, strategy string, retrieval_ms double, generation_ms double, total_ms double, answer string, error string")
    docs = spark.createDataFrame([(1, 2, "s", None, "j", "9", "b\nc" * 60), (1, 1, None, "2020", "j", "8", "a")], "query_id long, position int, source string, year string, journal string, pmid string, text string")
    got = {r["query_id"]: r for r in retrieval.result_summary(results, docs).collect()}
    assert got[1]["retrieved_count"] == 2 and got[1]["retrieval_ms"] == 1.3 and got[1]["answer"] == "x" * 200 + "..." and [s["pmid"] for s in got[1]["sources"]] == ["8", "9"]
    assert got[1]["sources"][1]["preview"] == ("b\nc" * 60)[:100].replace("\n", " ") and got[1]["sources"][1]["year"] == ""
    assert got[2]["retrieved_count"] == 0 and got[2]["answer"] == "" and got[2]["error"] == "failed"


def test_equal_questions_are_read_once(spark):
    from quillmark.operators import enhance

    asked = spark.createDataFrame([(1, "mi 近五年"), (2, "mi 近五年"), (3, None)], "query_id long, query string").withColumn("own", F.col("query_id") * 10)
    got = {r["query_id"]: r for r in enhance.enhance(asked, 2026).collect()}
    assert set(got) == {1, 2, 3} and got[1]["synonyms"] == got[2]["synonyms"] == ["myocardial infarction", "heart attack"] and got[3]["cleaned"] == "" and got[2]["own"] == 20


def test_model_lengths_for_chunks(spark):
    text = "alpha beta gamma delta " * 40
    by_words = chunking.split_text(text, 10, 2, lambda t: len(t.split()))
    assert all(len(c.split()) <= 10 for c in by_words) and set(" ".join(by_words).split()) == {"alpha", "beta", "gamma", "delta"}
