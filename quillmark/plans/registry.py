"""The operators' queries over the driver's tables, each beside its SQL.

``documents`` stand for articles (``source`` for the journal, ``2000 + doc_id % 25`` for the year, the first 40 characters for
the title), ``benchmark`` for questions, ``embeddings`` for vectors (``vec_id`` = doc_id; a question's vector is the one of
its item_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import ranking, text
from quillmark.operators import bm25, chunking, clean, context, enhance, fusion, generate, profile, rerank, vectors
from quillmark.plans import retrieval
from quillmark.sources import corpus

YEAR = 2026
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cut_sql(n: int) -> str:
    region = f"substring(text, {n - n // 10 + 1}, {n // 10})"
    cases = []
    for mark in text.SENTENCE_ENDS:
        lit = "'" + mark.replace("\n", "' || chr(10) || '") + "'"
        at = f"strpos(reverse({region}), reverse({lit}))"
        cases.append(f"WHEN {at} > 0 THEN substring(text, 1, {n + 1} - {at}::INT)")
    return f"CASE WHEN length(text) <= {n} THEN text {' '.join(cases)} ELSE regexp_replace(substring(text, 1, {n}), '[\\s\\x0b\\x1c-\\x1f\\x85\\x{{A0}}\\x{{2003}}]+$', '') END"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(
        "doc_id", "text", F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("source_id"), F.col("source").alias("journal"),
        F.expr("cast(2000 + doc_id % 25 as string)").alias("year"), F.substring("text", 1, 40).alias("title"),
    )


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _question_vectors(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return _t(spark, d, "embeddings").join(items, F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")


DOCS = "docs AS (SELECT doc_id, text, source AS journal, CAST(2000 + doc_id % 25 AS VARCHAR) AS year, substring(text, 1, 40) AS title FROM documents)"
BM25_TOKENS = r"""
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+') AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
terms AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats)"""
BM25_SCORES = BM25_TOKENS + r""",
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+')) AS term FROM benchmark) GROUP BY query_id, term),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM asked JOIN terms USING (term) JOIN post USING (term), stats GROUP BY query_id, doc_id)"""
_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


@_query(f"WITH {BM25_TOKENS} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus_stats(spark, d):
    return bm25.corpus_stats(_docs(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@_query(f"WITH {BM25_TOKENS} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, d):
    return bm25.fit(_docs(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _top(sql_from: str, k: int) -> str:
    return f"SELECT query_id, rank, doc_id AS doc_ord, round(score, 6) AS score FROM (SELECT *, {_BEST} AS rank FROM {sql_from}) WHERE rank <= {k}"


@_query(f"WITH {BM25_SCORES} {_top('scored', 20)}")
def bm25_topk(spark, d):
    return bm25.search_corpus(_docs(spark, d), _questions(spark, d), 20).select("query_id", "rank", "doc_ord", F.round("score", 6).alias("score"))


@_query(f"WITH {DOCS}, {BM25_SCORES}, kept AS (SELECT s.* FROM scored s JOIN docs USING (doc_id) WHERE year >= '2010' AND year <> '' AND lower(journal) LIKE '%src1%') {_top('kept', 10)}")
def bm25_filtered_topk(spark, d):
    ok = ranking.year_predicate("year", {"$gte": "2010"}) & ranking.journal_predicate("journal", {"$in": ["SRC1"]})
    return bm25.search_corpus(_docs(spark, d), _questions(spark, d), 10, ok).select("query_id", "rank", "doc_ord", F.round("score", 6).alias("score"))


_DIST = "round(1 - list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 9) + 0::DOUBLE"


def _knn_sql(k: int, where: str = "TRUE") -> str:
    return f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_ord, {_DIST} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_ord) AS rank FROM d)
SELECT query_id, rank, doc_ord, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM r WHERE rank <= {k}"""


def _near(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "doc_ord", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@_query(_knn_sql(5))
def knn_cosine_topk(spark, d):
    return _near(vectors.knn(_t(spark, d, "embeddings"), _asked(spark, d), 5))


@_query(_knn_sql(5, "(v.label IN (1, 3, 5) OR v.label >= 8)"))
def knn_filtered(spark, d):
    ok = ranking.where({"$or": [{"label": {"$in": [1, 3, 5]}}, {"label": {"$gte": 8}}]})
    return _near(vectors.knn(_t(spark, d, "embeddings"), _asked(spark, d), 5, condition=ok))


@_query(_knn_sql(5).replace(_DIST, "round(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) + list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) - 2 * list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) + 0::DOUBLE"))
def knn_l2_topk(spark, d):
    return _near(vectors.knn(_t(spark, d, "embeddings"), _asked(spark, d), 5, "l2"))


@_query(f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_ord, {_DIST} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_ord) AS rank FROM d)
SELECT count(*)::BIGINT AS n, sum((doc_ord = query_id)::INT)::BIGINT AS passed, round(avg((doc_ord = query_id)::INT), 6) AS pass_rate FROM r WHERE rank = 1""")
def self_retrieval(spark, d):
    vecs = _t(spark, d, "embeddings")
    return vectors.self_retrieval(vecs, vecs.where("vec_id % 20 = 0").select("vec_id", "embedding"))


@_query("SELECT count(*)::BIGINT AS vectors, count(DISTINCT label)::BIGINT AS sources, max(len(embedding))::INT AS dim FROM embeddings")
def collection_summary(spark, d):
    return corpus.collection_summary(_t(spark, d, "embeddings"), "label")


HITS = f"""{DOCS}, {BM25_SCORES},
words AS (SELECT query_id, 'bm25' AS path, 0 AS path_no, rank, doc_id AS doc_ord, score FROM (SELECT *, {_BEST} AS rank FROM scored) WHERE rank <= 30),
dist AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_ord, {_DIST} AS distance FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v),
near AS (SELECT query_id, 'vector' AS path, 1 AS path_no, rank, doc_ord, 1 / (1 + distance) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_ord) AS rank FROM dist) WHERE rank <= 30),
hits AS (SELECT h.*, 'pmid:' || doc_ord AS doc_key FROM (SELECT * FROM words UNION ALL SELECT * FROM near) h JOIN documents ON doc_ord = doc_id)"""


def _hits(spark, d) -> DataFrame:
    return retrieval.path_hits(_docs(spark, d), _questions(spark, d), _t(spark, d, "embeddings"), _question_vectors(spark, d))


def _fused(df: DataFrame, k: int = 20) -> DataFrame:
    return df.where(F.col("rank") <= k).select("query_id", "rank", "doc_ord", "doc_key", F.round("score", 6).alias("score"))


_SEEN = "min(path_no * 1000 + rank)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM fused)"
_OUT = "SELECT query_id, rank, doc_ord, doc_key, round(score, 6) AS score FROM ranked WHERE rank <= 20"
RRF = f"fused AS (SELECT query_id, doc_key, min(doc_ord) AS doc_ord, {_SEEN} AS seen, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM hits GROUP BY query_id, doc_key)"
WEIGHTED = f"""norm AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY query_id, path) > 0 THEN score / max(score) OVER (PARTITION BY query_id, path) ELSE 0 END AS s FROM hits),
fused AS (SELECT query_id, doc_key, min(doc_ord) AS doc_ord, {_SEEN} AS seen, round(sum(s * CASE path WHEN 'bm25' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END), 9) AS score FROM norm GROUP BY query_id, doc_key)"""
SIMPLE = f"fused AS (SELECT query_id, doc_key, min(doc_ord) AS doc_ord, {_SEEN} AS seen, arg_min(score, path_no * 1000 + rank) AS score FROM hits GROUP BY query_id, doc_key)"


@_query(f"WITH {HITS}, {RRF}, {_RANKED} {_OUT}")
def fuse_rrf(spark, d):
    return _fused(fusion.fuse_rrf(_hits(spark, d)))


@_query(f"WITH {HITS}, {RRF.replace('sum(1.0::DOUBLE / (60 + rank))', 'sum(CASE path WHEN ' + chr(39) + 'bm25' + chr(39) + ' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END / (60 + rank - 1))')}, {_RANKED} {_OUT}")
def fuse_rrf_legacy(spark, d):
    return _fused(fusion.fuse_rrf(_hits(spark, d), rank_base=0, weights={"vector": 0.6, "bm25": 0.4}))


@_query(f"WITH {HITS}, {WEIGHTED}, {_RANKED} {_OUT}")
def fuse_weighted(spark, d):
    return _fused(fusion.fuse_weighted(_hits(spark, d), {"bm25": 0.4, "vector": 0.6}))


@_query(f"""WITH {HITS}, lim AS (SELECT *, min(score) OVER (PARTITION BY query_id, path) AS lo, max(score) OVER (PARTITION BY query_id, path) AS hi FROM hits),
fused AS (SELECT query_id, doc_key, min(doc_ord) AS doc_ord, {_SEEN} AS seen, round(sum(CASE WHEN hi - lo > 1e-9 THEN (score - lo) / (hi - lo) ELSE 1 END * CASE path WHEN 'bm25' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END), 9) AS score FROM lim GROUP BY query_id, doc_key), {_RANKED} {_OUT}""")
def fuse_weighted_minmax(spark, d):
    return _fused(fusion.fuse_weighted(_hits(spark, d), {"bm25": 0.4, "vector": 0.6}, "minmax"))


@_query(f"WITH {HITS}, {SIMPLE}, {_RANKED} {_OUT}")
def fuse_simple(spark, d):
    return _fused(fusion.fuse_simple(_hits(spark, d)))


@_query(f"WITH {HITS}, {SIMPLE}, {_RANKED.replace('score DESC, seen', 'seen')} {_OUT}")
def fuse_simple_legacy(spark, d):
    return _fused(fusion.fuse_simple(_hits(spark, d), sort=False))


@_query(f"""WITH {HITS}, flags AS (SELECT query_id, doc_key, max((path = 'bm25')::INT) AS a, max((path = 'vector')::INT) AS b FROM hits GROUP BY query_id, doc_key)
SELECT query_id, sum((a = 1 AND b = 1)::INT)::BIGINT AS both, sum((a = 1 AND b = 0)::INT)::BIGINT AS only_a, sum((a = 0 AND b = 1)::INT)::BIGINT AS only_b FROM flags GROUP BY query_id""")
def path_overlap(spark, d):
    return fusion.path_overlap(_hits(spark, d), "bm25", "vector")


@_query(f"""WITH {HITS}, n AS (SELECT item_id, least(count(DISTINCT doc_key), 5) AS n FROM benchmark LEFT JOIN hits ON query_id = item_id GROUP BY item_id)
SELECT strategy, count(*)::BIGINT AS queries, round(avg((n > 0)::INT) * 100, 6) AS success_pct, round(avg(n), 6) AS avg_returned, max(n)::BIGINT AS max_returned, min(n)::BIGINT AS min_returned
FROM n, (VALUES ('rrf'), ('weighted'), ('simple')) s(strategy) GROUP BY strategy""")
def fusion_compare(spark, d):
    return fusion.compare_strategies(_hits(spark, d), _questions(spark, d), 5, {"bm25": 0.4, "vector": 0.6})


@_query(f"""WITH {HITS}, {RRF.replace('sum(1.0::DOUBLE / (60 + rank))', 'sum(CASE path WHEN ' + chr(39) + 'bm25' + chr(39) + ' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank))')}, {_RANKED} {_OUT}""")
def hybrid_ensemble(spark, d):
    return _fused(retrieval.hybrid_legacy(_hits(spark, d)))


CANDS = f"""{HITS}, {RRF}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM fused),
cands AS (SELECT r.query_id, r.rank, r.doc_ord, d.journal, d.year, d.journal AS source,
  coalesce(round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-9), 9), 0) AS relevance
  FROM ranked r JOIN docs d ON d.doc_id = r.doc_ord LEFT JOIN embeddings v ON v.vec_id = r.doc_ord LEFT JOIN embeddings q ON q.vec_id = r.query_id WHERE r.rank <= 60)"""
_REC = f"CASE WHEN TRY_CAST(year AS INT) IS NULL THEN 0.5::DOUBLE ELSE greatest(0, 1 - ({YEAR} - TRY_CAST(year AS INT)) / 10.0::DOUBLE) END"
_REC_OLD = f"CASE WHEN TRY_CAST(year AS INT) IS NULL THEN 0.5::DOUBLE ELSE greatest(0.1::DOUBLE, 1 - greatest(0, {YEAR} - TRY_CAST(year AS INT)) * 0.1::DOUBLE) END"


def _authority_sql(column: str) -> str:
    cases = []
    for names, weight in ranking.JOURNAL_WEIGHTS:
        tests = [f"regexp_matches(lower({column}), '\\b{n}\\b')" if len(n) <= 5 else f"contains(lower({column}), '{n}')" for n in names]
        cases.append(f"WHEN {' OR '.join(tests)} THEN {weight}::DOUBLE")
    return f"CASE {' '.join(cases)} ELSE 1.0::DOUBLE END"


# The driver's sources are no journals: these names stand for them where the rules are to be seen at work.
_NAMES = ["N Engl J Med", "JAMA", "Nature Communications", "Nature Medicine", "Nature Genetics", "Nature", "The Lancet", "Science", "Cell Reports", "Cell", "BMJ", "Circulation", "JCO", "Ann Oncol", "European Heart Journal", "PLoS Medicine", "Cellular Notes", "", "Unknown Letters", "Jamaica Review"]
_NAMED_SQL = f"list_extract([{', '.join(repr(n) for n in _NAMES)}], (doc_id % {len(_NAMES)} + 1)::INT)"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("journal", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % len(_NAMES) + 1).cast("int")))


@_query(f"SELECT doc_id, round({_authority_sql('j')}, 6) AS authority FROM (SELECT doc_id, {_NAMED_SQL} AS j FROM documents)")
def authority_score(spark, d):
    return _named(_docs(spark, d)).select("doc_id", F.round(ranking.authority("journal"), 6).alias("authority"))


@_query(f"SELECT doc_id, round({_REC}, 6) AS recency, round({_REC_OLD}, 6) AS recency_legacy FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'n/a' ELSE CAST(1990 + doc_id % 40 AS VARCHAR) END AS year FROM documents)")
def recency_score(spark, d):
    years = _docs(spark, d).select("doc_id", F.expr("case when doc_id % 7 = 0 then 'n/a' else cast(1990 + doc_id % 40 as string) end").alias("year"))
    return years.select("doc_id", F.round(ranking.recency("year", YEAR), 6).alias("recency"), F.round(ranking.recency("year", YEAR, "legacy"), 6).alias("recency_legacy"))


FINAL = f"""crit AS (SELECT *, {_REC} AS rec, {_authority_sql('journal')} AS auth FROM cands),
pool AS (SELECT *, max(relevance) OVER w AS mr, max(rec) OVER w AS mc, max(auth) OVER w AS ma FROM crit WINDOW w AS (PARTITION BY query_id)),
final AS (SELECT *, round(relevance / CASE WHEN mr > 0 THEN mr ELSE 1 END * 0.6::DOUBLE + CASE WHEN mc > 0 THEN rec / mc ELSE 0 END * 0.25::DOUBLE + CASE WHEN ma > 0 THEN auth / ma ELSE 0 END * 0.15::DOUBLE, 9) AS fs FROM pool),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY fs DESC, rank) AS nth FROM final),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, rank) AS final_rank FROM once WHERE nth = 1)"""


@_query(f"WITH {CANDS}, {FINAL} SELECT query_id, final_rank, doc_ord, round(relevance, 6) AS relevance, round(rec, 6) AS recency, round(auth, 6) AS authority, round(fs, 6) AS final_score FROM top WHERE final_rank <= 5")
def hybrid_retrieve(spark, d):
    docs, vecs, asked = _docs(spark, d), _t(spark, d, "embeddings"), _question_vectors(spark, d)
    best = retrieval.retrieve(docs, _questions(spark, d), vecs, asked, YEAR)
    return best.select("query_id", "final_rank", "doc_ord", F.round("relevance", 6).alias("relevance"), F.round("recency", 6).alias("recency"), F.round("authority", 6).alias("authority"), F.round("final_score", 6).alias("final_score"))


def _knn_cands(spark, d) -> DataFrame:
    near = vectors.knn(_t(spark, d, "embeddings"), _asked(spark, d), 30)
    docs = _named(_docs(spark, d)).select(F.col("doc_id").alias("doc_ord"), "journal", "year", F.col("source_id").alias("source"), "title", "text")
    return near.select("query_id", "rank", "doc_ord", F.round(1 - F.col("distance"), 9).alias("relevance")).join(docs, "doc_ord")


KNN_CANDS = f"""d0 AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_ord, {_DIST} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_ord) AS rank FROM d0),
cands AS (SELECT query_id, rank, doc_ord, round(1 - distance, 9) AS relevance, {_NAMED_SQL} AS journal, CAST(2000 + doc_id % 25 AS VARCHAR) AS year, source, substring(text, 1, 40) AS title, text FROM r0 JOIN documents ON doc_id = doc_ord WHERE rank <= 30)"""


@_query(f"WITH {KNN_CANDS}, {FINAL} SELECT query_id, final_rank, doc_ord, round(fs, 6) AS final_score FROM top WHERE final_rank <= 5")
def rerank_multicriteria(spark, d):
    return rerank.rerank(_knn_cands(spark, d), YEAR).select("query_id", "final_rank", "doc_ord", F.round("final_score", 6).alias("final_score"))


def _legacy_authority_sql() -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(journal), '{k}') THEN {v / 10}::DOUBLE" for k, v in ranking.LEGACY_AUTHORITY.items()) + " ELSE 0.4::DOUBLE END"


@_query(f"""WITH {KNN_CANDS}, crit AS (SELECT *, {_REC_OLD} AS rec, {_legacy_authority_sql()} AS auth, min(relevance) OVER (PARTITION BY query_id) AS lo, max(relevance) OVER (PARTITION BY query_id) AS hi FROM cands),
final AS (SELECT *, round(CASE WHEN hi - lo > 1e-9 THEN (relevance - lo) / (hi - lo) ELSE 1 END * 0.6::DOUBLE + rec * 0.25::DOUBLE + auth * 0.15::DOUBLE, 9) AS fs FROM crit)
SELECT query_id, final_rank, doc_ord, round(fs, 6) AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, rank) AS final_rank FROM final) WHERE final_rank <= 5""")
def rerank_legacy(spark, d):
    return rerank.rerank(_knn_cands(spark, d), YEAR, preset="legacy").select("query_id", "final_rank", "doc_ord", F.round("final_score", 6).alias("final_score"))


@_query(f"""WITH {KNN_CANDS}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY relevance DESC, rank) AS nth FROM cands WHERE source <> '')
SELECT query_id, final_rank, doc_ord, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS final_rank FROM best WHERE nth = 1) WHERE final_rank <= 5""")
def best_per_source(spark, d):
    return rerank.best_per_source(_knn_cands(spark, d)).select("query_id", "final_rank", "doc_ord", "source")


@_query(f"""WITH {BM25_SCORES}, top AS ({_top('scored', 5)}), truth AS (SELECT item_id AS query_id, doc_id AS doc_ord FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT t.query_id, max((top.doc_ord IS NOT NULL)::INT) AS hit FROM truth t LEFT JOIN top ON top.query_id = t.query_id AND top.doc_ord = t.doc_ord GROUP BY t.query_id)
SELECT count(*)::BIGINT AS queries, coalesce(sum(hit), 0)::BIGINT AS hits, round(avg(hit), 6) AS hit_rate FROM f""")
def hit_at_k(spark, d):
    docs, asked = _docs(spark, d), _questions(spark, d)
    # the passages' own occurrences are the ground truth
    return profile.hit_at_k(bm25.search_corpus(docs, asked, 5), profile.holding(docs, asked), 5)


@_query(f"""WITH {BM25_SCORES}, top AS ({_top('scored', 5)}), n AS (SELECT item_id, count(top.doc_ord) AS n FROM benchmark LEFT JOIN top ON query_id = item_id GROUP BY item_id)
SELECT count(*)::BIGINT AS queries, sum((n > 0)::INT)::BIGINT AS with_docs, round(avg(n), 6) AS avg_returned, min(n)::BIGINT AS min_returned, max(n)::BIGINT AS max_returned, round(avg(item_id % 50), 1) AS avg_latency_ms FROM n""")
def evaluation_report(spark, d):
    asked = _questions(spark, d)
    got = profile.per_query(asked, bm25.search_corpus(_docs(spark, d), asked, 5))
    return profile.evaluation(got.select("query_id", "n_returned", (F.col("query_id") % 50).alias("latency_ms")))


@_query(f"""WITH {BM25_SCORES}, top AS ({_top('scored', 5)})
SELECT item_id AS query_id, count(top.doc_ord)::BIGINT AS n_returned, min(CASE WHEN rank = 1 THEN top.doc_ord END) AS top1 FROM benchmark LEFT JOIN top ON query_id = item_id GROUP BY item_id""")
def evaluation_per_query(spark, d):
    asked = _questions(spark, d)
    return profile.per_query(asked, bm25.search_corpus(_docs(spark, d), asked, 5))


@_query(f"""WITH {KNN_CANDS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS final_rank, doc_ord, round(relevance, 6) AS relevance FROM cands""")
def rerank_plain(spark, d):
    return rerank.plain_rerank(_knn_cands(spark, d), None).select("query_id", "final_rank", "doc_ord", F.round("relevance", 6).alias("relevance"))


@_query(f"""WITH {KNN_CANDS}, sets AS (SELECT query_id, rank, doc_ord, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9][a-z0-9\-]+')) AS q, regexp_extract_all(lower(c.text), '[a-z0-9][a-z0-9\-]+') AS t FROM cands c JOIN benchmark b ON b.item_id = c.query_id)
SELECT query_id, rank, doc_ord, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t))::DOUBLE / len(q) ELSE 0 END, 6) AS relevance FROM sets""")
def rerank_by_overlap(spark, d):
    pairs = _knn_cands(spark, d).drop("relevance").join(_questions(spark, d), "query_id")
    return rerank.OverlapReranker().score(pairs).select("query_id", "rank", "doc_ord", F.round("relevance", 6).alias("relevance"))


@_query(f"""WITH halves AS (SELECT item_id, unnest([0, 1]) AS no, text FROM benchmark), variants AS (SELECT item_id * 2 + no AS item_id, item_id AS parent, no, CASE no WHEN 0 THEN substring(text, 1, 60) ELSE substring(text, 61) END AS text FROM halves),
{BM25_TOKENS.strip()}, {BM25_SCORES.split("asked AS", 1)[1].join(["asked AS", ""]).replace("FROM benchmark)", "FROM variants)")},
hits AS ({_top('scored', 10)}), met AS (SELECT parent AS query_id, doc_ord, min(no * 1000 + rank) AS seen FROM hits JOIN variants ON item_id = hits.query_id GROUP BY parent, doc_ord)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_ord) AS rank, doc_ord FROM met""")
def multi_query(spark, d):
    asked = _questions(spark, d).select("query_id", F.array(F.substring("query", 1, 60), F.expr("substring(query, 61)")).alias("query_variants"))
    return retrieval.multi_query_retrieve(_docs(spark, d), asked, 10)


@_query(f"""WITH {KNN_CANDS}, listed AS (SELECT query_id, count(*)::INT AS n, string_agg(coalesce(source, '') || '|' || year || '|' || journal || '|' || doc_ord || '|' || replace(substring(text, 1, 100), chr(10), ' '), '#' ORDER BY rank) AS s FROM cands GROUP BY query_id)
SELECT item_id AS query_id, coalesce(n, 0) AS retrieved_count, round(item_id / 7.0::DOUBLE, 1) AS total_ms, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS answer, md5(coalesce(s, '')) AS sources FROM benchmark LEFT JOIN listed ON query_id = item_id""")
def result_summary(spark, d):
    results = _questions(spark, d).select("query_id", "query", F.lit("rrf").alias("strategy"), *[(F.col("query_id") / 7.0).alias(f"{c}_ms") for c in ("retrieval", "generation", "total")], F.col("query").alias("answer"), F.lit(None).cast("string").alias("error"))
    docs = _knn_cands(spark, d).withColumnRenamed("rank", "position").withColumn("pmid", F.col("doc_ord").cast("string"))
    short = retrieval.result_summary(results, docs)
    flat = F.array_join(F.transform("sources", lambda r: F.concat_ws("|", r["source"], r["year"], r["journal"], r["pmid"], r["preview"])), "#")
    return short.select("query_id", "retrieved_count", "total_ms", "answer", F.md5(F.coalesce(flat, F.lit(""))).alias("sources"))


# Cleaning -----------------------------------------------------------------------------------------------------------
_DIRTY = "CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE substring(text, 1, 40) END"


def _dirty(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.expr("case when doc_id % 11 = 0 then '  ' else substring(text, 1, 40) end").alias("title"), F.expr("case when doc_id % 22 = 0 then cast(null as string) else text end").alias("abstract"), F.col("source").alias("journal"))


@_query(f"SELECT doc_id, title FROM (SELECT doc_id, {_DIRTY} AS title, CASE WHEN doc_id % 22 = 0 THEN NULL ELSE text END AS abstract FROM documents) WHERE NOT (trim(title) = '' AND trim(coalesce(abstract, '')) = '')")
def drop_blank(spark, d):
    return clean.drop_blank(_dirty(spark, d)).select("doc_id", "title")


@_query("SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(65533), ''), '\\s+', ' ', 'g')) AS text FROM documents")
def clean_documents(spark, d):
    return clean.clean_columns(_t(spark, d, "documents").select("doc_id", "text"), ("text",))


@_query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_keep_first(spark, d):
    return clean.keep_first(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@_query("SELECT conv_id, turn, trim(regexp_replace(translate(text, '„‚‘', '\"'''''), '\\s+', ' ', 'g')) AS cleaned FROM conversations WHERE role = 'user'")
def query_clean(spark, d):
    return _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.clean_query("text").alias("cleaned"))


@_query("SELECT doc_id, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url FROM documents")
def source_urls(spark, d):
    return _docs(spark, d).select("doc_id", text.source_url("pmid").alias("url"))


# Profiles -----------------------------------------------------------------------------------------------------------
@_query("""WITH n AS (SELECT count(*) AS n, sum((trim(coalesce(t, '')) <> '')::INT) AS title, sum((trim(coalesce(a, '')) <> '')::INT) AS abstract, sum((trim(coalesce(j, '')) <> '')::INT) AS journal
  FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE substring(text, 1, 40) END AS t, CASE WHEN doc_id % 22 = 0 THEN NULL ELSE text END AS a, source AS j FROM documents))
SELECT f.field, f.present::BIGINT AS present, round((n - f.present) * 100.0::DOUBLE / n, 2) AS missing_pct FROM (SELECT n, unnest([struct_pack(field := 'title', present := title), struct_pack(field := 'abstract', present := abstract), struct_pack(field := 'journal', present := journal)]) AS f FROM n)""")
def field_completeness(spark, d):
    return profile.completeness(_dirty(spark, d), ["title", "abstract", "journal"])


@_query("SELECT sum((length(trim(substring(text, 1, 20) || substring(text, 21, 60))) < 50)::INT)::BIGINT AS short_texts, sum(contains(text, chr(65533))::INT)::BIGINT AS encoding_issues FROM documents")
def short_and_encoding(spark, d):
    docs = _t(spark, d, "documents").select(F.substring("text", 1, 20).alias("title"), F.expr("substring(text, 21)").alias("abstract"))
    return profile.short_and_encoding(docs)


@_query("SELECT source AS value, count(*)::BIGINT AS n FROM documents WHERE trim(source) <> '' GROUP BY source ORDER BY n DESC, value LIMIT 5")
def top_sources(spark, d):
    return profile.top_values(_t(spark, d, "documents"), "source")


@_query(f"WITH {DOCS} SELECT min(year::INT) AS min_year, max(year::INT) AS max_year, round(avg(length(text)), 6) AS mean_length FROM docs")
def year_and_length(spark, d):
    return profile.year_and_length(_docs(spark, d))


@_query(f"""SELECT value, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS value FROM documents)
WHERE regexp_full_match(value, '[A-Z]{{3,}}') AND value NOT IN ({', '.join(repr(w) for w in profile.NO_ABBREVIATION)}) GROUP BY value ORDER BY n DESC, value LIMIT 15""")
def abbreviation_topk(spark, d):
    return profile.abbreviations(_t(spark, d, "documents"))


@_query("""WITH s AS (SELECT (contains(t, 'background') OR contains(t, 'introduction') OR contains(t, '目的'))::INT + (contains(t, 'method') OR contains(t, 'approach') OR contains(t, '材料与方法') OR contains(t, '方法'))::INT
 + (contains(t, 'result') OR contains(t, 'finding') OR contains(t, '结果'))::INT + (contains(t, 'conclusion') OR contains(t, '结论'))::INT AS s FROM (SELECT lower(text || CASE doc_id % 3 WHEN 0 THEN ' Methods and results' WHEN 1 THEN ' Background, approach, findings, conclusions' ELSE '' END) AS t FROM documents))
SELECT round(avg(s), 6) AS mean_score, sum((s = 4)::INT)::BIGINT AS "full", sum((s = 0)::INT)::BIGINT AS "none" FROM s""")
def imrad_score(spark, d):
    tail = F.expr("case doc_id % 3 when 0 then ' Methods and results' when 1 then ' Background, approach, findings, conclusions' else '' end")
    return profile.imrad(_t(spark, d, "documents").select(F.concat("text", tail).alias("abstract")))


LENGTHS = "lens AS (SELECT doc_id, (length(regexp_replace(text, '[^一-鿿]', '', 'g')) + greatest(1, (length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) // 4))::INT AS length FROM documents)"
STATS = "stats AS (SELECT min(length)::BIGINT AS min_len, max(length)::BIGINT AS max_len, round(avg(length), 6) AS mean_len, round(quantile_cont(length, 0.5), 6) AS median_len, round(quantile_cont(length, 0.9), 6) AS p90, round(quantile_cont(length, 0.95), 6) AS p95, round(quantile_cont(length, 0.99), 6) AS p99, round(avg((length > 512)::INT) * 100, 6) AS over_pct FROM lens)"


def _lengths(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.token_len("text").alias("length"))


@_query("SELECT doc_id, (length(regexp_replace(text, '[^一-鿿]', '', 'g')) + greatest(1, (length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) // 4))::INT AS mixed, floor(length(text) / 1.5::DOUBLE)::INT AS chars FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.token_len("text").alias("mixed"), text.token_len("text", "chars").alias("chars"))


@_query(f"WITH {LENGTHS}, {STATS} SELECT * FROM stats")
def length_quantiles(spark, d):
    return profile.length_stats(_lengths(spark, d))


@_query(f"""WITH {LENGTHS}, {STATS} SELECT CASE WHEN p95 <= 512 THEN 'no split' WHEN p99 <= 1024 THEN 'sliding window' ELSE 'sections and window' END AS strategy,
CASE WHEN p95 <= 512 THEN 512 WHEN p99 <= 1024 THEN least(462, floor(p95)::INT) ELSE 300 END::INT AS chunk_size, CASE WHEN p95 <= 512 THEN 0 WHEN p99 <= 1024 THEN floor(least(462, floor(p95)::INT) * 0.2::DOUBLE)::INT ELSE 50 END::INT AS chunk_overlap FROM stats""")
def split_strategy(spark, d):
    return profile.split_strategy(profile.length_stats(_lengths(spark, d)))


@_query(f"""WITH {LENGTHS}, q AS (SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS q3 FROM lens),
f AS (SELECT length, q1, median, q3, length BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM lens, q)
SELECT q1, median, q3, min(CASE WHEN ok THEN length END)::BIGINT AS low, max(CASE WHEN ok THEN length END)::BIGINT AS high, sum((NOT ok)::INT)::BIGINT AS outliers FROM f GROUP BY q1, median, q3""")
def length_box(spark, d):
    return profile.box_stats(_lengths(spark, d))


@_query(f"WITH {LENGTHS} SELECT (length // 100 * 100)::BIGINT AS bucket, count(*)::BIGINT AS n FROM lens GROUP BY bucket")
def length_histogram(spark, d):
    return profile.histogram(_lengths(spark, d))


@_query("""WITH r AS (SELECT doc_id, length(text) AS length, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT share, doc_id, length::INT AS length FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) s(share) WHERE k = least(floor(n * share), n - 1)""")
def quantile_sample(spark, d):
    return profile.quantile_sample(_t(spark, d, "documents"))


# Chunks -------------------------------------------------------------------------------------------------------------
WINDOWS = r"""w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS t FROM documents),
w1 AS (SELECT doc_id, t, greatest(1, ceil((len(t) - 50) / 206.0::DOUBLE))::INT AS n FROM w0),
windows AS (SELECT doc_id, i::INT AS chunk_index, n AS total_chunks, len(t[i * 206 + 1 : i * 206 + 256])::INT AS token_count, array_to_string(t[i * 206 + 1 : i * 206 + 256], ' ') AS text FROM (SELECT *, unnest(range(n)) AS i FROM w1))"""


@_query(f"WITH {WINDOWS} SELECT doc_id, chunk_index, total_chunks, token_count, md5(text) AS digest FROM windows")
def chunk_windows(spark, d):
    return chunking.chunk_windows(_t(spark, d, "documents")).select("doc_id", "chunk_index", "total_chunks", "token_count", F.md5("text").alias("digest"))


def _titled_windows(spark, d) -> DataFrame:
    titled = _t(spark, d, "documents").withColumn("source_title", F.substring("text", 1, 10))
    return chunking.chunk_windows(titled, keep=("source_title",))


@_query(f"""WITH {WINDOWS}, c AS (SELECT w.*, substring(d.text, 1, 10) AS source_title FROM windows w JOIN documents d USING (doc_id))
SELECT count(*)::BIGINT AS total_chunks, sum((token_count > 512)::INT)::BIGINT AS over_limit, round(avg((token_count > 512)::INT) * 100, 2) AS over_limit_pct, sum((trim(text) = '')::INT)::BIGINT AS empty_chunks, sum((length(text) < 50)::INT)::BIGINT AS very_short,
sum((total_chunks > 1 AND chunk_index = 0 AND source_title <> '' AND contains(text, source_title))::INT)::BIGINT AS first_with_title, sum((total_chunks > 1 AND chunk_index = 0)::INT)::BIGINT AS first_total,
sum(regexp_matches(trim(text), '[.。?？!！]$')::INT)::BIGINT AS ending_properly, min(token_count)::BIGINT AS min_tokens, max(token_count)::BIGINT AS max_tokens, round(avg(token_count), 1) AS mean_tokens,
round(quantile_cont(token_count, 0.95), 1) AS p95_tokens, round(quantile_cont(token_count, 0.99), 1) AS p99_tokens, sum((chunk_index = 0 AND total_chunks > 1)::INT)::BIGINT AS multi_chunk_docs, sum((chunk_index = 0 AND total_chunks = 1)::INT)::BIGINT AS single_chunk_docs FROM c""")
def chunk_quality(spark, d):
    return profile.chunk_quality(_titled_windows(spark, d))


@_query(f"WITH {WINDOWS} SELECT 'windows' AS collection_name, 'hashing' AS embedding_model, 64 AS embedding_dimension, count(*)::BIGINT AS total_chunks, round(avg(token_count), 6) AS mean_tokens, max(token_count)::BIGINT AS max_tokens, min(token_count)::BIGINT AS min_tokens FROM windows")
def index_stats(spark, d):
    return profile.index_stats(chunking.chunk_windows(_t(spark, d, "documents")), "windows", "hashing", 64)


@_query(f"WITH {WINDOWS} SELECT count(DISTINCT doc_id)::BIGINT AS documents, count(*)::BIGINT AS chunks, round(count(*)::DOUBLE / count(DISTINCT doc_id), 2) AS chunks_per_doc FROM windows")
def corpus_counts(spark, d):
    return profile.corpus_counts(chunking.chunk_windows(_t(spark, d, "documents")))


@_query()
def chunk_recursive(spark, d):
    return chunking.chunk_recursive(_docs(spark, d))


@_query()
def chunk_two_pass(spark, d):
    return chunking.chunk_recursive(_docs(spark, d), no_split=0, second_pass=(400, 50))


@_query(f"""WITH {WINDOWS}, pairs AS (SELECT doc_id, chunk_index, text, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS after FROM windows),
cut AS (SELECT doc_id, chunk_index, right(text, 200) AS tail, left(after, 200) AS head FROM pairs WHERE after IS NOT NULL),
off AS (SELECT doc_id, chunk_index, greatest(length(tail), length(head)) AS n, list_position(list_transform(range(1, greatest(length(tail), length(head)) + 1), lambda i: i <= length(tail) AND i <= length(head) AND tail[i] = head[i]), FALSE) AS first_off FROM cut)
SELECT doc_id, chunk_index, coalesce(first_off - 1, n)::BIGINT AS common FROM off""")
def neighbour_overlap(spark, d):
    return profile.neighbour_overlap(chunking.chunk_windows(_t(spark, d, "documents")))


# Questions ----------------------------------------------------------------------------------------------------------
_ASKS = ["Recent 5 years of aspirin in NEJM", "statin therapy since 2020", "metformin in 2019", "latest 3 years of EGFR", "lung cancer in 1998", "past decade of PLoS ONE reports", "Nature Medicine and The Lancet on HIV", "Science of the brain", "past 3 years hypertension", "plain question", "Cell reports on stem-cell therapy", "single cell atlas", "stem-cell published", "a cell is a unit", "近五年 二甲双胍 治疗 糖尿病 心肌梗死", "中华内科杂志 阿司匹林", "BMC genomics PLoS Genetics"]
_ASKS_SQL = f"asks AS (SELECT doc_id AS query_id, list_extract([{', '.join(repr(a) for a in _ASKS)}], (doc_id % {len(_ASKS)} + 1)::INT) AS query FROM documents)"


def _asks(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.element_at(F.array(*[F.lit(a) for a in _ASKS]), (F.col("doc_id") % len(_ASKS) + 1).cast("int")).alias("query"))


def _year_sql() -> str:
    cases = []
    for pattern, value in ranking.YEAR_RULES:
        year = f"CASE WHEN regexp_extract(query, '(20\\d{{2}})', 1) <> '' THEN regexp_extract(query, '(20\\d{{2}})', 1) ELSE '{YEAR}' END" if value is None else f"'{YEAR + value if value < 0 else value}'"
        cases.append(f"WHEN regexp_matches(query, '(?i){pattern}') THEN {year}")
    return f"CASE {' '.join(cases)} END"


@_query(f"WITH {_ASKS_SQL} SELECT query_id, {_year_sql()} AS year_gte FROM asks")
def year_filter(spark, d):
    return _asks(spark, d).select("query_id", ranking.year_gte("query", YEAR).alias("year_gte"))


def _no_lookaround(pattern: str) -> str:
    """The pattern for an engine without lookaround: what stands around is matched too, which is the same to a test."""
    return pattern.replace("(?<![a-zA-Z-])", "(?:^|[^a-zA-Z-])").replace("(?=", "(?:")


@_query(f"WITH {_ASKS_SQL} SELECT query_id, CASE " + " ".join(f"WHEN regexp_matches(query, '(?i){p}') THEN '{n}'" for n, p in ranking.JOURNAL_RULES for p in [_no_lookaround(p)]) + " END AS journal_keyword FROM asks")
def journal_filter(spark, d):
    return _asks(spark, d).select("query_id", ranking.journal_keyword("query").alias("journal_keyword"))


@_query(f"WITH {_ASKS_SQL}, found AS (" + " UNION ALL ".join(f"SELECT query_id, '{k}' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(query, '(?i){p}'), lambda x: lower(x)))) AS mention FROM asks" for k, p in enhance.ENTITIES.items()).replace("'s)", "''s)") + "".join(f" UNION ALL SELECT query_id, '{k}' AS kind, unnest(list_filter({words!r}, lambda w: contains(query, w))) AS mention FROM asks" for k, words in enhance.ENTITY_WORDS.items()) + ") SELECT kind, mention, count(*)::BIGINT AS n FROM found GROUP BY kind, mention")
def entity_counts(spark, d):
    rows = _asks(spark, d).select(F.explode(enhance.entities("query")).alias("kind", "mentions"))
    return rows.select("kind", F.explode("mentions").alias("mention")).groupBy("kind", "mention").agg(F.count(F.lit(1)).alias("n"))


@_query()
def query_enhance(spark, d):
    found = enhance.enhance(_asks(spark, d), YEAR)
    return found.select("query_id", "cleaned", F.to_json("entities").alias("entities"), F.to_json("synonyms").alias("synonyms"), F.size("query_variants").alias("variants"), "vector_query", "keyword_query", "year_gte", "journal_keyword")


# Context ------------------------------------------------------------------------------------------------------------
def _chunks(spark, d) -> DataFrame:
    return _knn_cands(spark, d).select("query_id", F.col("rank").alias("ord"), "text", "relevance", "source", F.col("doc_ord").cast("string").alias("pmid"), F.col("doc_ord").cast("string").alias("chunk_id"), F.col("doc_ord").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "title", "year", "journal")


CHUNKS = f"{KNN_CANDS}, chunks AS (SELECT query_id, rank AS ord, text, relevance, source, doc_ord::VARCHAR AS pmid, title, year, journal FROM cands)"


def _window_chunks(spark, d) -> DataFrame:
    """All windows of the candidates' whole texts, in order of rank and place."""
    cands = _knn_cands(spark, d)
    windows = chunking.chunk_windows(cands.select(F.struct(*(c for c in cands.columns if c != "text")).alias("q_cand"), "text"), doc_id="q_cand")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_index"))
    pmid = F.col("doc_ord").cast("string")
    rows = windows.select("doc_id.*", "chunk_index", "text")
    return rows.select("query_id", place.alias("ord"), "text", "relevance", "source", pmid.alias("pmid"), F.concat(pmid, F.lit("#"), F.col("chunk_index").cast("string")).alias("chunk_id"), pmid.alias("doc_id"), "chunk_index", "title", "year", "journal")


WINDOW_CHUNKS = f"{KNN_CANDS}, {WINDOWS}, chunks AS (SELECT c.query_id, row_number() OVER (PARTITION BY c.query_id ORDER BY c.rank, w.chunk_index) AS ord, w.text, c.relevance, c.source, c.doc_ord::VARCHAR AS pmid, c.title, c.year, c.journal FROM cands c JOIN windows w ON w.doc_id = c.doc_ord)"


@_query(f"""WITH {CHUNKS}, sets AS (SELECT query_id, ord, list_distinct(regexp_extract_all(text, '[一-鿿]{{2}}|[A-Za-z]+|\\d+')) AS s FROM chunks),
p AS (SELECT x.query_id, x.ord AS a, y.ord AS b, round(len(list_intersect(x.s, y.s))::DOUBLE / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 9) AS jaccard FROM sets x JOIN sets y ON x.query_id = y.query_id AND x.ord < y.ord WHERE len(x.s) > 0 AND len(y.s) > 0)
SELECT query_id, a, b, round(jaccard, 6) AS jaccard FROM p WHERE jaccard >= 0.2""")
def jaccard_pairs(spark, d):
    return context.near_pairs(_chunks(spark, d), 0.2).select("query_id", "a", "b", F.round("jaccard", 6).alias("jaccard"))


DIVERSE = f"""{CHUNKS}, nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY relevance DESC, ord) - 1 AS n FROM chunks),
scored AS (SELECT *, CASE WHEN n >= 3 THEN 0 ELSE round(relevance * pow(0.85::DOUBLE, n), 9) END AS ds FROM nth),
diverse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ds DESC, relevance DESC, ord) AS diverse_rank FROM scored)"""


@_query(f"WITH {DIVERSE} SELECT query_id, ord, round(ds, 6) AS diverse_score, diverse_rank FROM diverse")
def diversity_rank(spark, d):
    return context.diversify(_chunks(spark, d)).select("query_id", "ord", F.round("diverse_score", 6).alias("diverse_score"), "diverse_rank")


PACKED = f"""RECURSIVE {DIVERSE}, sized AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM diverse),
walk AS (SELECT query_id, diverse_rank, ord, source, pmid, text, relevance, tokens, CASE WHEN tokens <= 3000 THEN tokens ELSE 0 END AS used, tokens <= 3000 AS kept FROM sized WHERE diverse_rank = 1
  UNION ALL SELECT s.query_id, s.diverse_rank, s.ord, s.source, s.pmid, s.text, s.relevance, s.tokens, CASE WHEN w.used + s.tokens <= 3000 THEN w.used + s.tokens ELSE w.used END, w.used + s.tokens <= 3000 FROM walk w JOIN sized s ON s.query_id = w.query_id AND s.diverse_rank = w.diverse_rank + 1),
packed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY diverse_rank) AS position FROM walk WHERE kept)"""


def _packed(spark, d) -> DataFrame:
    return context.pack(context.diversify(_chunks(spark, d)))


WINDOW_PACKED = PACKED.replace(CHUNKS, WINDOW_CHUNKS)


def _window_packed(spark, d) -> DataFrame:
    return context.pack(context.diversify(_window_chunks(spark, d)))


@_query(f"WITH {PACKED} SELECT query_id, position::INT AS position, ord, tokens::INT AS tokens FROM packed")
def context_pack(spark, d):
    return _packed(spark, d).select("query_id", "position", "ord", "tokens")


@_query(f"WITH {WINDOW_PACKED} SELECT query_id, position::INT AS position, ord, tokens::INT AS tokens FROM packed")
def context_pack_windows(spark, d):
    return _window_packed(spark, d).select("query_id", "position", "ord", "tokens")


@_query(f"WITH {PACKED} SELECT query_id, md5(string_agg('【文档' || position || '】PMID: ' || pmid || ' | 来源: ' || source || ' | 相关性: ' || printf('%.3f', relevance) || chr(10) || text, chr(10) || chr(10) ORDER BY position)) AS digest FROM packed GROUP BY query_id")
def context_string(spark, d):
    return context.render(_packed(spark, d)).select("query_id", F.md5("context_text").alias("digest"))


@_query(f"WITH {WINDOW_PACKED} SELECT query_id, md5(string_agg('【文档' || position || '】PMID: ' || pmid || ' | 来源: ' || source || ' | 相关性: ' || printf('%.3f', relevance) || chr(10) || text, chr(10) || chr(10) ORDER BY position)) AS digest FROM packed GROUP BY query_id")
def context_string_windows(spark, d):
    return context.render(_window_packed(spark, d)).select("query_id", F.md5("context_text").alias("digest"))


@_query(f"WITH {PACKED} SELECT query_id, source, count(*)::BIGINT AS n FROM packed GROUP BY query_id, source")
def source_counts(spark, d):
    return context.source_counts(_packed(spark, d)).select("query_id", F.explode("chunk_sources").alias("source", "n"))


@_query(f"WITH {WINDOW_PACKED} SELECT query_id, source, count(*)::BIGINT AS n FROM packed GROUP BY query_id, source")
def source_counts_windows(spark, d):
    return context.source_counts(_window_packed(spark, d)).select("query_id", F.explode("chunk_sources").alias("source", "n"))


# Greedy, in order of relevance: a chunk goes if a chunk that stayed is near it.
DEDUP = f"""RECURSIVE {WINDOW_CHUNKS.replace('chunks AS (', 'all_chunks AS (')}, sets AS (SELECT *, list_distinct(regexp_extract_all(text, '[一-鿿]{{2}}|[A-Za-z]+|\d+')) AS s, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, ord) AS k FROM all_chunks),
near AS (SELECT y.query_id, y.k, list(x.k) AS close FROM sets x JOIN sets y ON x.query_id = y.query_id AND x.k < y.k WHERE len(x.s) > 0 AND len(y.s) > 0 AND len(list_intersect(x.s, y.s))::DOUBLE / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.7 GROUP BY y.query_id, y.k),
order_ AS (SELECT s.query_id, s.k, coalesce(n.close, []) AS close FROM sets s LEFT JOIN near n USING (query_id, k)),
greedy AS (SELECT query_id, k, TRUE AS stays, [k] AS kept FROM order_ WHERE k = 1
  UNION ALL SELECT o.query_id, o.k, NOT list_has_any(o.close, g.kept), CASE WHEN list_has_any(o.close, g.kept) THEN g.kept ELSE list_append(g.kept, o.k) END FROM greedy g JOIN order_ o ON o.query_id = g.query_id AND o.k = g.k + 1),
chunks AS (SELECT s.query_id, s.ord, s.text, s.relevance, s.source, s.pmid, s.title, s.year, s.journal FROM sets s JOIN greedy g USING (query_id, k) WHERE g.stays)"""


@_query(f"WITH {DEDUP} SELECT query_id, ord, relevance FROM chunks")
def context_dedup(spark, d):
    return context.dedup(_window_chunks(spark, d)).select("query_id", "ord", "relevance")


@_query(f"""WITH {PACKED.replace('RECURSIVE ' + CHUNKS, DEDUP)}, texts AS (SELECT query_id, string_agg('【文档' || position || '】PMID: ' || pmid || ' | 来源: ' || source || ' | 相关性: ' || printf('%.3f', relevance) || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS text FROM packed GROUP BY query_id),
counts AS (SELECT query_id, '{{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}}' AS chunk_sources FROM (SELECT query_id, source, count(*) AS n FROM packed GROUP BY query_id, source) GROUP BY query_id)
SELECT a.query_id, a.n AS total_chunks_retrieved, u.n AS unique_chunks_after_dedup, p.n AS chunks_selected, p.tokens::BIGINT AS estimated_tokens, chunk_sources, length({_cut_sql(12000)})::INT AS context_chars
FROM (SELECT query_id, count(*)::BIGINT AS n FROM all_chunks GROUP BY query_id) a JOIN (SELECT query_id, count(*)::BIGINT AS n FROM chunks GROUP BY query_id) u USING (query_id)
JOIN (SELECT query_id, count(*)::BIGINT AS n, sum(tokens) AS tokens FROM packed GROUP BY query_id) p USING (query_id) JOIN counts USING (query_id) JOIN texts USING (query_id)""")
def context_assemble(spark, d):
    done = context.assemble(_window_chunks(spark, d))
    return done.select("query_id", "total_chunks_retrieved", "unique_chunks_after_dedup", "chunks_selected", "estimated_tokens", F.to_json("chunk_sources").alias("chunk_sources"), F.length("context_text").alias("context_chars"))


# Generation ---------------------------------------------------------------------------------------------------------
@_query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_extract(spark, d):
    messy = F.concat(F.lit("Answer:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return _t(spark, d, "events").select("event_id", F.try_variant_get(text.extract_json(messy), "$.k", "bigint").alias("k"))


@_query("SELECT event_type AS stage, count(*)::BIGINT AS runs, round(avg((value >= 10)::INT) * 100, 6) AS success_pct FROM events GROUP BY event_type")
def stage_success_summary(spark, d):
    return profile.run_summary(_t(spark, d, "events").select(F.create_map("event_type", F.col("value") >= 10).alias("stage_success")))


@_query("SELECT count(*)::BIGINT AS runs, round(avg(value), 2) AS mean_seconds, round(avg(length(event_type)), 2) AS mean_answer_length, sum(user_id % 7 + 3)::BIGINT AS total_tokens FROM events")
def run_totals(spark, d):
    rows = _t(spark, d, "events").select(F.col("value").alias("total_time_seconds"), F.length("event_type").alias("answer_length"), F.create_map(F.lit("draft"), (F.col("user_id") % 7).cast("int"), F.lit("final"), F.lit(3)).alias("token_counts"))
    return profile.run_totals(rows)


def _cache(spark, d) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select(F.md5("text").alias("key"), "text", F.col("doc_id").alias("last_used")).groupBy("key").agg(F.min("text").alias("text"), F.max("last_used").alias("last_used"))


@_query("""WITH cache AS (SELECT md5(text) AS key, max(doc_id) AS last_used FROM documents WHERE text IS NOT NULL GROUP BY text), fresh AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
merged AS (SELECT key, last_used FROM cache WHERE key NOT IN (SELECT key FROM fresh) UNION ALL SELECT key, 10000000 FROM fresh)
SELECT key, last_used FROM merged ORDER BY last_used DESC, key LIMIT 200""")
def cache_after_put(spark, d):
    made = _t(spark, d, "documents").where("doc_id % 20 = 0").select(F.md5("text").alias("key"), "text", F.lit(True).alias("success"))
    return generate.cache_put(_cache(spark, d), made, 10_000_000, 200).select("key", "last_used")


@_query("SELECT count(DISTINCT text)::BIGINT AS size, 4096::BIGINT AS max_size, round(count(DISTINCT text) / 4096.0::DOUBLE, 3) AS utilization FROM documents")
def cache_stats(spark, d):
    return generate.cache_stats(_cache(spark, d), 4096)


_RULES_SQL = "'" + generate.RULES.replace("'", "''").replace(chr(10), "' || chr(10) || '") + "'"


@_query(f"""WITH {KNN_CANDS}, blocks AS (SELECT query_id, string_agg('【文献 ' || rank || '】PMID: ' || doc_ord || ' | ' || year || ' | ' || CASE WHEN journal = '' THEN '?' ELSE journal END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS b FROM cands WHERE rank <= 3 GROUP BY query_id)
SELECT item_id AS query_id, md5({_RULES_SQL} || chr(10) || chr(10) || '【文献片段】' || chr(10) || coalesce(b, '') || chr(10) || chr(10) || '【用户问题】' || chr(10) || text || chr(10) || chr(10) || '【回答】') AS digest FROM benchmark LEFT JOIN blocks ON query_id = item_id""")
def single_prompt(spark, d):
    docs = _knn_cands(spark, d).where("rank <= 3").withColumnRenamed("rank", "position").withColumn("pmid", F.col("doc_ord").cast("string"))
    return generate.answer_prompt(docs, _questions(spark, d)).select("query_id", F.md5("prompt").alias("digest"))


@_query("SELECT doc_id, md5(substring(text, 1, 40) || chr(10) || chr(10) || source || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) || text END) AS digest FROM documents")
def full_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.full_text("title", "source_id", "text")).alias("digest"))


def _evaluations(spark, d) -> DataFrame:
    block = F.expr("concat('【文档', ord, '】', chr(10), case when ord % 3 = 0 then '直接证据 1b' when ord % 3 = 1 then '间接参考' else '不可用 局限性 1a' end, chr(10), 'PMID: 1000', pmid, chr(10))")
    rows = _chunks(spark, d).withColumn("pmid", F.col("pmid")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]), "").alias("evaluation"))
    return rows


@_query(f"WITH {CHUNKS} SELECT query_id, ord, '1000' || pmid AS pmid FROM (SELECT *, max((ord % 3 = 0 AND length('1000' || pmid) BETWEEN 4 AND 9)::INT) OVER (PARTITION BY query_id) AS has_good FROM chunks) WHERE has_good = 0 OR ord % 3 = 0")
def evidence_filter(spark, d):
    chunks = _chunks(spark, d).withColumn("pmid", F.concat(F.lit("1000"), F.col("pmid")))
    return generate.filter_by_evaluation(chunks, _evaluations(spark, d)).select("query_id", "ord", "pmid")


@_query(f"WITH {CHUNKS} SELECT query_id, pmid, source, title, year, journal, round(relevance, 3) AS relevance_score FROM chunks")
def format_sources(spark, d):
    return generate.sources(_chunks(spark, d), "ord").drop("source_order")


@_query(f"""SELECT doc_id, md5(CASE WHEN text = '' THEN '' ELSE trim(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || chr(10) || '### 参考来源' || chr(10) || '- PMID:' || doc_id || ' (' || CAST(2000 + doc_id % 25 AS VARCHAR) || ') · ' || source || chr(10) || '{generate.DISCLAIMER.replace(chr(10), "' || chr(10) || '")}' END) AS digest FROM documents""")
def postprocess_answer(spark, d):
    line = generate.reference_line(F.col("pmid"), F.lit(""), F.col("year"), F.col("journal"))
    return _docs(spark, d).select("doc_id", F.md5(generate.postprocess(F.col("text"), F.array(line))).alias("digest"))


@_query(f"SELECT item_id AS query_id, sha256('u=' || text || chr(10) || 's={generate.STAGES['draft'].system}' || chr(10) || 't=0.3' || chr(10) || 'm=1200' || chr(10) || 'p=0.9' || chr(10) || 'r=1.1' || chr(10) || 'j=0') AS cache_key FROM benchmark")
def cache_keys(spark, d):
    return _questions(spark, d).select("query_id", generate.cache_key(F.col("query"), generate.STAGES["draft"]).alias("cache_key"))


@_query(f"SELECT doc_id, md5({_cut_sql(400)}) AS digest FROM documents")
def truncate_sentence_end(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.truncate_at_sentence("text", 400)).alias("digest"))


@_query()
def answers(spark, d):
    questions = _asked(spark, d).select("query_id", F.concat(F.lit("question "), F.col("query_id")).alias("query"))
    done = retrieval.answer(_window_chunks(spark, d), questions)
    return done.select("query_id", "answer", F.to_json("stage_success").alias("stage_success"), F.to_json("sources").alias("sources"))


@_query()
def embed_hashing(spark, d):
    rows = vectors.HashingEmbedder(16).embed(_questions(spark, d), "query", vectors.QUESTION_INSTRUCTION)
    return rows.select("query_id", F.to_json("embedding").alias("embedding"))
