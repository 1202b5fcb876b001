"""Multi-criteria reranking of candidate lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.ranking import authority, recency
from quillmark.functions.text import ascii_tokens, filled

WEIGHTS = {"relevance": 0.6, "recency": 0.25, "authority": 0.15}


class Reranker(Protocol):
    """Adds ``relevance double`` to candidates that have the question's and the document's text."""

    def score(self, cands: DataFrame, query: str = "query", text: str = "text") -> DataFrame: ...


class OverlapReranker:
    """A deterministic stand-in for a model (column functions): the share of the question's distinct tokens that a text has."""

    def score(self, cands: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
        asked, own = F.array_distinct(ascii_tokens(query)), ascii_tokens(text)
        return cands.withColumn("relevance", F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, own)) / F.size(asked)).otherwise(F.lit(0.0)))


class PairReranker:
    """A model of pairs: ``predict([(question, text), ...]) -> scores``, made once a Python worker by ``make`` and called with a
    batch of pairs at a time; nulls are empty texts."""

    def __init__(self, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 64):
        self.make, self.batch = make, batch

    def score(self, cands: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
        make, batch = self.make, self.batch

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            predict = make()
            for questions, texts in parts:
                pairs = list(zip(questions.fillna(""), texts.fillna(""), strict=True))
                yield pd.Series([float(s) for at in range(0, len(pairs), batch) for s in predict(pairs[at : at + batch])], dtype=float)

        return cands.withColumn("relevance", run(F.col(query), F.col(text)))


def plain_rerank(cands: DataFrame, top_n: int | None = 5) -> DataFrame:
    """``cands`` (query_id, rank, relevance) with ``final_rank`` by relevance, ties by ``rank``; ``top_n=None`` keeps all."""
    ranked = cands.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "rank")))
    return ranked if top_n is None else ranked.where(F.col("final_rank") <= top_n)


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """The three criteria's weights, or an error."""
    if not isinstance(weights, dict):
        raise TypeError("weights are a dict")
    if set(weights) != set(WEIGHTS):
        raise ValueError(f"weights need exactly {sorted(WEIGHTS)}")
    return weights


def rerank(cands: DataFrame, current_year: int, weights: dict[str, float] | None = None, top_n: int = 5, preset: str = "current", journal_rules=None) -> DataFrame:
    """``cands`` (query_id, rank, relevance, year, journal, source) with ``recency, authority, final_score, final_rank``.

    ``current``: each criterion is divided by its greatest value among the question's candidates (relevance by 1 if that is
    not above 0, the others give 0); after sorting, the best row of every source stays (rows without one all stay), then the
    best ``top_n``.  ``legacy``: relevance by min and max, recency and authority as they are, no dedup.
    """
    w = checked_weights(weights or WEIGHTS)
    if preset not in ("current", "legacy"):
        raise ValueError(f"unknown preset {preset}")
    pool = Window.partitionBy("query_id")
    scored = cands.withColumn("recency", recency("year", current_year, preset)).withColumn("authority", authority("journal", journal_rules, preset))
    if preset == "current":
        top = F.max("relevance").over(pool)
        rel = F.col("relevance") / F.when(top > 0, top).otherwise(F.lit(1.0))
        rest = {c: F.when(F.max(c).over(pool) > 0, F.col(c) / F.max(c).over(pool)).otherwise(F.lit(0.0)) for c in ("recency", "authority")}
    else:
        low, high = F.min("relevance").over(pool), F.max("relevance").over(pool)
        rel = F.when(high - low > 1e-9, (F.col("relevance") - low) / (high - low)).otherwise(F.lit(1.0))
        rest = {c: F.col(c) for c in ("recency", "authority")}
    final = F.round(rel * w["relevance"] + rest["recency"] * w["recency"] + rest["authority"] * w["authority"], 9)
    scored = scored.withColumn("final_score", final)
    order = [F.col("final_score").desc(), "rank"]
    if preset == "current":
        own = Window.partitionBy("query_id", F.coalesce(filled("source"), F.concat(F.lit("\0"), F.col("rank").cast("string")))).orderBy(*order)
        scored = scored.withColumn("q_nth", F.row_number().over(own)).where("q_nth = 1").drop("q_nth")
    return scored.withColumn("final_rank", F.row_number().over(pool.orderBy(*order))).where(F.col("final_rank") <= top_n)


def best_per_source(cands: DataFrame, top_n: int = 5) -> DataFrame:
    """The older retriever's end: the best chunk of every named source (rows without a source are dropped), best first."""
    own = Window.partitionBy("query_id", "source").orderBy(F.col("relevance").desc(), "rank")
    best = cands.where(filled("source").isNotNull()).withColumn("q_nth", F.row_number().over(own)).where("q_nth = 1").drop("q_nth")
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "rank")
    return best.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_n)
