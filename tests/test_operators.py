from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark.operators import bm25, chunking, clean, context, fusion, generate, profile, rerank, vectors
from quillmark.plans import retrieval
from quillmark.sources import corpus
from quillmark.streaming.ingest import chunk_stream, stream_articles


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, "Statins lower LDL cholesterol in adults."), (1, "Statins and exercise: statins reduce cardiac events."), (2, "Exercise improves sleep."), (3, "X-ray imaging of the chest.")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("q", "want"), [("statins exercise", {1: 1.49712, 2: 0.858766, 0: 0.651279}), ("statins statins", {1: 1.788767, 0: 1.302558}), ("x-ray", {3: 1.230337}), ("  ", {}), ("unknown", {})])
def test_bm25(spark, texts, q, want):
    asked = spark.createDataFrame([(7, q)], "query_id long, query string")
    for found in (bm25.search_corpus(texts, asked), bm25.search(bm25.fit(texts), asked)):
        rows = found.orderBy("rank").collect()
        assert {r["doc_ord"]: r["score"] for r in rows} == pytest.approx(want, abs=1e-6)
        assert [r["doc_ord"] for r in rows] == list(want)


def test_bm25_empty_corpus(spark, texts):
    asked = spark.createDataFrame([(7, "statins")], "query_id long, query string")
    assert bm25.search_corpus(texts.limit(0), asked).count() == 0


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(1, "a", 0, 1, 1, "p1", 8.0), (1, "a", 0, 2, 2, "p2", 4.0), (1, "b", 1, 1, 2, "p2", 0.9), (1, "b", 1, 2, 3, "p3", 0.45)]
    return spark.createDataFrame(rows, "query_id long, path string, path_no int, rank int, doc_ord long, doc_key string, score double")


def scores(df):
    return [(r["doc_key"], pytest.approx(r["score"], abs=1e-5)) for r in df.orderBy("rank").collect()]


def test_fusion(spark, hits):
    assert scores(fusion.fuse_rrf(hits)) == [("p2", 0.032522), ("p1", 0.016393), ("p3", 0.016129)]
    assert scores(fusion.fuse_weighted(hits, {"a": 0.4, "b": 0.6})) == [("p2", 0.8), ("p1", 0.4), ("p3", 0.3)]
    assert scores(fusion.fuse_simple(hits)) == [("p1", 8.0), ("p2", 4.0), ("p3", 0.45)]
    twice = hits.where("path = 'a'").withColumn("doc_key", F.lit("p1"))
    assert scores(fusion.fuse_rrf(twice)) == [("p1", 0.032522)]
    assert fusion.path_overlap(hits, "a", "b").first().asDict() == {"query_id": 1, "both": 1, "only_a": 1, "only_b": 1}
    # weights are relative
    assert fusion.fuse_weighted(hits, {"a": 2.0, "b": 3.0}).collect() == fusion.fuse_weighted(hits, {"a": 0.4, "b": 0.6}).collect()
    with pytest.raises(ValueError):
        fusion.fuse(hits, "other")


def test_rerank(spark):
    rows = [(1, 1, 0.8, "2026", "unknown", "s1"), (1, 2, 0.9, "2016", "NEJM", "s2"), (1, 3, 0.6, "", "Cell Reports", "s3"), (1, 4, 0.1, "", "", "s1"), (1, 5, 0.1, "", "", ""), (1, 6, 0.1, "", "", "")]
    cands = spark.createDataFrame(rows, "query_id long, rank int, relevance double, year string, journal string, source string")
    three = rerank.rerank(cands.where("rank <= 3"), 2026).orderBy("final_rank").collect()
    assert [(r["rank"], pytest.approx(r["final_score"], abs=1e-6)) for r in three] == [(1, 0.813333), (2, 0.75), (3, 0.645)]
    assert [r["rank"] for r in rerank.rerank(cands, 2026, top_n=9).orderBy("final_rank").collect()] == [1, 2, 3, 5, 6]
    negative = cands.withColumn("relevance", F.lit(-1.0)).where("rank = 1")
    assert rerank.rerank(negative, 2026).first()["final_score"] == pytest.approx(-0.6 + 0.25 + 0.15)
    with pytest.raises(ValueError):
        rerank.checked_weights({"relevance": 1.0})
    with pytest.raises(TypeError):
        rerank.checked_weights([1.0])
    assert [r["rank"] for r in rerank.best_per_source(cands).orderBy("final_rank").collect()] == [2, 1, 3]


def test_knn(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    rows = vectors.knn(vecs, asked, 2).orderBy("rank").collect()
    assert [(r["doc_ord"], r["distance"], r["score"]) for r in rows] == [(1, 0.0, 1.0), (3, 0.0, 1.0)]
    assert vectors.knn(vecs, asked.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        vectors.knn(vecs, asked, 2, "other")


@pytest.mark.parametrize("most", [1, 3, 4, 11, 12])
def test_knn_beyond_one_block(spark, monkeypatch, most):
    vecs = spark.createDataFrame([(i, [float(i % 5), float(i % 7) - 3]) for i in range(40)], "vec_id long, embedding array<float>").repartition(3)
    # ids out of order, some of them with several vectors
    ids = [5, 5, 9, -2, 7, 7, 7, 7, 1, 30, 12, None]
    asked = spark.createDataFrame([(q, [float(i), 2.0]) for i, q in enumerate(ids)], "query_id long, embedding array<float>")
    for metric in ("cosine", "l2"):
        want = sorted(map(tuple, vectors.knn(vecs, asked, 3, metric).collect()))
        assert {r[0] for r in want} == set(ids) - {None}
        with monkeypatch.context() as m:
            m.setattr(vectors, "MOST", most)
            assert sorted(map(tuple, vectors.knn(vecs, asked, 3, metric).collect())) == want


def test_clean(spark):
    rows = [("1", "t", "a", None, "b"), ("1", "t2", "a", "j", "a"), ("2", " ", None, "j", "c")]
    got = clean.clean_articles(spark.createDataFrame(rows, "doc_id string, title string, abstract string, journal string, path string")).collect()
    assert [(r["doc_id"], r["title"], r["journal"]) for r in got] == [("1", "t2", "j")]


def test_chunks(spark):
    docs = spark.createDataFrame([("a", "short text", "t"), ("b", "word " * 2000, "t"), ("c", None, None)], "doc_id string, text string, title string")
    rows = chunking.chunk_recursive(docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r["chunk_id"], r["split_method"]) for r in rows if r["doc_id"] != "b"] == [("a", "no_split"), ("c", "no_split")]
    own = [r for r in rows if r["doc_id"] == "b"]
    assert own[0]["chunk_id"] == "b_chunk_000" and all(r["token_count"] <= 400 and r["total_chunks"] == len(own) for r in own)
    assert {r["split_method"]: r["documents"] for r in chunking.chunk_counts(chunking.chunk_recursive(docs)).collect()} == {"no_split": 2, "recursive": 1}
    windows = chunking.chunk_windows(docs.where("doc_id = 'b'"), 256, 50).collect()
    assert len(windows) == 10 and windows[-1]["token_count"] == 2000 - 9 * 206


def test_context(spark):
    rows = [(1, 1, "a b c d", 0.9, "s", "1"), (1, 2, "a b c d", 0.8, "s", "2"), (1, 3, "e f", 0.7, "s", "3"), (1, 4, "g h", 0.6, "s", "4"), (1, 5, "i j", 0.5, "s", "5")]
    chunks = spark.createDataFrame(rows, "query_id long, ord int, text string, relevance double, source string, pmid string").withColumn("chunk_id", F.col("pmid"))
    unique = context.dedup(chunks)
    assert sorted(r["ord"] for r in unique.collect()) == [1, 3, 4, 5]
    diverse = context.diversify(chunks.withColumn("relevance", F.lit(0.9))).orderBy("diverse_rank").collect()
    assert [r["diverse_score"] for r in diverse] == [pytest.approx(x) for x in (0.9, 0.765, 0.65025, 0, 0)]
    packed = context.pack(context.diversify(unique), 2)
    assert packed.agg(F.sum("tokens")).first()[0] <= 2
    assert "【文档1】PMID: 1 | 来源: s | 相关性: 0.900" in context.render(packed).first()["context_text"]
    whole = context.assemble(chunks).first()
    assert (whole["total_chunks_retrieved"], whole["unique_chunks_after_dedup"], whole["chunk_sources"]) == (5, 4, {"s": 4})
    questions = spark.createDataFrame([(1, "why?")], "query_id long, query string")
    done = retrieval.answer(chunks.withColumn("doc_id", F.col("pmid")).withColumn("chunk_index", F.lit(0)), questions).first()
    assert done["answer"].startswith("### final") and "重要提示" in done["answer"] and all(done["stage_success"].values())


def test_evidence_filter(spark):
    text = "【文档1】\n直接证据 1b\nPMID: 11111\n【文档2】间接参考 PMID: 22222\n【文档3】不可用 PMID:33333"
    chunks = spark.createDataFrame([(1, "11111"), (1, "22222"), (2, "22222")], "query_id long, pmid string")
    evals = spark.createDataFrame([(1, text), (2, "nothing")], "query_id long, evaluation string")
    assert sorted(map(tuple, generate.filter_by_evaluation(chunks, evals).collect())) == [(1, "11111"), (2, "22222")]


def test_evidence_filter_long_numbers(spark):
    text = "【文档1】直接证据 PMID: 1234567890【文档2】间接参考 PMID: 22222【文档3】直接证据 PMID:33333"
    rows = [(1, "1234567890"), (1, "123456789"), (1, "22222"), (1, "33333"), (2, "1234567890"), (2, "22222"), (3, "123456789"), (3, "22222")]
    chunks = spark.createDataFrame(rows, "query_id long, pmid string")
    evals = spark.createDataFrame([(1, text), (2, text), (3, text)], "query_id long, evaluation string")
    # 1: both supported ones, not the one that the first nine digits spell; 2: none of four to nine digits; 3: none at all
    assert sorted(map(tuple, generate.filter_by_evaluation(chunks, evals).collect())) == sorted([rows[0], rows[3], *rows[4:]])


def test_generators(spark):
    calls = generate.MapGenerator(lambda prompt, stage: 1 / 0 if "bad" in prompt else prompt.upper(), retries=1)
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "bad"), (4, "")], "id long, prompt string")
    rows = {r["id"]: (r["out"], r["out_ok"]) for r in generate.generate(df, "prompt", generate.STAGES["draft"], calls, "out").collect()}
    assert rows == {1: ("X", True), 2: ("X", True), 3: (None, False), 4: (None, False)}
    key = generate.cache_key(F.col("prompt"), generate.STAGES["draft"])
    cache = df.where("id = 1").select(key.alias("key"), F.lit("cached").alias("text"))
    assert generate.generate(df.where("id < 3"), "prompt", generate.STAGES["draft"], calls, "out", cache).select("out").distinct().collect() == [("cached",)]


def test_postprocess(spark):
    df = spark.createDataFrame([("a\n\n\n\nb",), ("",), ("x ### 参考来源 重要提示",)], "t string")
    refs = F.array(F.lit("- PMID:1"))
    got = [r[0] for r in df.select(generate.postprocess(F.col("t"), refs)).collect()]
    assert got[0].startswith("a\n\nb\n\n### 参考来源\n- PMID:1\n\n---") and got[1] == "" and got[2] == "x ### 参考来源 重要提示"


@pytest.mark.parametrize(("lengths", "want"), [([100, 200, 300, 400, 450], ("no split", 512, 0)), ([1000, 1200, 1500, 1800, 2000], ("sections and window", 300, 50)), ([500, 600, 700], ("sliding window", 462, 92))])
def test_split_strategy(spark, lengths, want):
    df = spark.createDataFrame([(n,) for n in lengths], "length int")
    assert tuple(profile.split_strategy(profile.length_stats(df)).first()) == want


XML = """<?xml version="1.0"?><!DOCTYPE article PUBLIC "x" "y.dtd"><article><front><journal-meta><journal-title>J One</journal-title></journal-meta><article-meta>
<article-id pub-id-type="pmid">%s</article-id><title-group><article-title>A <i>title</i></article-title></title-group><abstract><p>Short &amp; sweet.</p></abstract><pub-date><year>2020</year></pub-date></article-meta></front>
<body><sec><title>Intro</title><p>One.</p><sec><title>Inner</title><p>Two.</p></sec></sec><p>Loose.</p></body></article>"""


def test_xml_sources(spark, tmp_path):
    (tmp_path / "b.xml").write_text(XML % "")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.XML").write_text(XML % "77")
    (tmp_path / "c.xml").write_text("<article><unclosed>")
    (tmp_path / "d.txt").write_text("no")
    rows = {r["doc_id"]: r for r in corpus.load_articles(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"b", "77", "c"}
    assert (rows["77"]["title"], rows["77"]["abstract"], rows["77"]["journal"], rows["77"]["year"]) == ("A title", "Short & sweet.", "J One", "2020")
    assert rows["77"]["body_text"] == "Short & sweet. One. Two. Loose." and rows["c"]["error"]
    docs = {r["pmid"]: r for r in corpus.load_documents(spark, f"file://{tmp_path}").where("error is null").collect()}
    assert docs["77"]["content"] == "# A title\n\n## Abstract\nShort & sweet.\n\n## Intro\nOne.\nTwo.\n\n## Inner\nTwo."
    assert corpus.scan_xml(spark, f"file://{tmp_path}", 1).count() == 1


def test_sinks_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", "short text"), ("b", "t", "word " * 2000)], "doc_id string, title string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    chunks = chunking.chunk_recursive(docs)
    corpus.write_chunks(chunks, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/chunks.parquet").count() == spark.read.json(f"{tmp_path}/out/chunks.jsonl").count() > 2
    corpus.write_vectors(chunks, vectors.HashingEmbedder(8), f"{tmp_path}/vec")
    assert corpus.collection_summary(spark.read.parquet(f"{tmp_path}/vec")).first()["dim"] == 8
    assert corpus.append_metrics(spark.createDataFrame([(1.234567,)], "s double"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first()[0] == 1.2346
    (tmp_path / "cache.jsonl").write_text('{"key": "a", "text": "x", "last_used": 1}\nbroken\n{"key": "b", "text": "y", "last_used": 2}\n')
    assert [r["key"] for r in corpus.read_cache(spark, f"{tmp_path}/cache.jsonl", 1).collect()] == ["b"]
    query = chunk_stream(stream_articles(spark, f"{tmp_path}/in"), f"{tmp_path}/stream", f"{tmp_path}/cp")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/stream").count() == chunks.count()
