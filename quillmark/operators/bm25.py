"""BM25 over a corpus, for a batch of questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import is_blank, tokens
from quillmark.plans.sizes import hash_filter, sent_if_small
from quillmark.sources.scratch import materialise

K1, B = 1.5, 0.75


@dataclass
class Bm25:
    """An inverted index: ``postings(doc_ord, term, tf, dl)``, ``terms(term, df, idf)``, ``stats(n, avgdl)`` (one row)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    k1: float = K1
    b: float = B


def _tokenised(docs: DataFrame, doc_ord: str, text: str, lexicon) -> DataFrame:
    return docs.select(F.col(doc_ord).alias("doc_ord"), tokens(text, lexicon).alias("tokens")).withColumn("dl", F.size("tokens"))


def corpus_stats(docs: DataFrame, doc_ord: str = "doc_id", text: str = "text", lexicon=None) -> DataFrame:
    """``n, avgdl``: texts and their mean length in tokens (0 for an empty corpus)."""
    return _stats(_tokenised(docs, doc_ord, text, lexicon))


def _stats(tokenised: DataFrame) -> DataFrame:
    return tokenised.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def fit(docs: DataFrame, doc_ord: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, lexicon=None, only: DataFrame | None = None) -> Bm25:
    """Index ``docs``.  ``only(term)`` keeps the postings of these terms: all that a known set of questions needs.  Each text is
    then tokenised once: what is kept of it (its length, and its tokens that may be asked for) is written, and all else comes
    from there.  Statistics cover the whole corpus either way."""
    base = _tokenised(docs, doc_ord, text, lexicon)
    if only is not None:
        asked = hash_filter(only, "term")
        kept = F.filter("tokens", lambda t: asked(F.xxhash64(t))) if asked else F.col("tokens")
        base = materialise(base.select("doc_ord", kept.alias("tokens"), "dl"), "bm25-tokens")
    stats = _stats(base)
    words, distinct = (base.select("doc_ord", "dl", F.explode(t).alias("term")) for t in ("tokens", F.array_distinct("tokens")))
    if only is not None:
        small = sent_if_small(only)
        words, distinct = words.join(small, "term", "left_semi"), distinct.join(small, "term", "left_semi")
    postings = words.groupBy("doc_ord", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    # stats is one row
    terms = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf.alias("idf"))
    return Bm25(postings, terms, stats, k1, b)


def query_terms(queries: DataFrame, lexicon=None) -> DataFrame:
    """``query_id, term, qtf`` of ``queries(query_id, query)``; blank questions have none."""
    return queries.where(~is_blank("query")).select("query_id", F.explode(tokens("query", lexicon)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scores(index: Bm25, queries: DataFrame, lexicon=None) -> DataFrame:
    """``query_id, doc_ord, score`` of every pair that shares a term (all scores are above 0); repeats in a question count."""
    terms = query_terms(queries, lexicon)
    asked = terms.join(index.terms, "term")
    # a term has one row in the index, so the join has no more rows than the questions' terms, which alone are counted
    asked = F.broadcast(asked) if sent_if_small(terms) is not terms else asked
    tf, dl = F.col("tf"), F.col("dl")
    weight = F.col("qtf") * F.col("idf") * tf * (index.k1 + 1) / (tf + index.k1 * (1 - index.b + index.b * dl / F.col("avgdl")))
    joined = index.postings.join(asked, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    return joined.groupBy("query_id", "doc_ord").agg(F.round(F.sum(weight), 9).alias("score"))


def search(index: Bm25, queries: DataFrame, k: int = 20, docs: DataFrame | None = None, condition: Column | None = None, doc_ord: str = "doc_id", lexicon=None) -> DataFrame:
    """``query_id, path, rank, doc_ord, score``: the best ``k`` per question, ties by the ordinal.

    A ``condition`` on ``docs`` filters after scoring, so corpus statistics stay those of the whole corpus.
    """
    found = scores(index, queries, lexicon)
    if condition is not None:
        found = found.join(docs.where(condition).select(F.col(doc_ord).alias("doc_ord")), "doc_ord", "left_semi")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_ord")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.lit("bm25").alias("path"), "rank", "doc_ord", "score")


def search_corpus(docs: DataFrame, queries: DataFrame, k: int = 20, condition: Column | None = None, doc_ord: str = "doc_id", text: str = "text", lexicon=None) -> DataFrame:
    """Index for these questions only, and search."""
    index = fit(docs, doc_ord, text, lexicon=lexicon, only=query_terms(queries, lexicon).select("term").distinct())
    return search(index, queries, k, docs, condition, doc_ord, lexicon)
