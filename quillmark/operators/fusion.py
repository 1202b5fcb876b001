"""Fusion of the hit lists of several paths.

Hits are rows ``query_id, path, path_no, rank, doc_ord, doc_key, score``; ``path_no`` orders the paths (the first one's
hit represents a key), ``rank`` is 1-based.  Results are ``query_id, rank, doc_ord, doc_key, score``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60

def _seen():
    return F.struct("path_no", "rank")


def _ordered(fused: DataFrame, by_score: bool = True) -> DataFrame:
    order = [F.col("score").desc()] if by_score else []
    best = Window.partitionBy("query_id").orderBy(*order, "first")
    return fused.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", F.col("first_ord").alias("doc_ord"), "doc_key", "score")


def fuse_rrf(hits: DataFrame, k: int = RRF_K, rank_base: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal ranks: each occurrence of a key adds ``weight / (k + rank)``, also several in one path.  ``rank_base=0``
    with weights is the older variant."""
    weight = F.lit(1.0)
    if weights:
        weight = F.lit(0.0)
        for path, w in weights.items():
            weight = F.when(F.col("path") == path, F.lit(float(w))).otherwise(weight)
    part = weight / (F.lit(k) + F.col("rank") - F.lit(1 - rank_base))
    fused = hits.groupBy("query_id", "doc_key").agg(F.round(F.sum(part), 9).alias("score"), F.min(_seen()).alias("first"), F.min_by("doc_ord", _seen()).alias("first_ord"))
    return _ordered(fused)


def fuse_weighted(hits: DataFrame, weights: dict[str, float] | None = None, norm: str = "max") -> DataFrame:
    """Weighted sum of scores normalised per path.

    ``max``: by the path's greatest score (0 if that is not above 0); a key that a path repeats keeps its last score; weights
    are scaled to sum 1 and a path without the key adds 0.  ``minmax``: to 0..1 (1 if all are equal), repeats add up, weights
    as given.
    """
    if norm not in ("max", "minmax"):
        raise ValueError(f"unknown normalisation {norm}")
    if weights is None:
        # equal ones for however many paths there are (one row)
        hits = hits.crossJoin(F.broadcast(hits.agg((1 / F.count_distinct("path")).alias("q_weight"))))
        weight = F.col("q_weight")
    else:
        total = sum(weights.values()) if norm == "max" else 1.0
        weight = F.lit(0.0)
        for path, w in weights.items():
            weight = F.when(F.col("path") == path, F.lit(float(w) / total)).otherwise(weight)
    pool = Window.partitionBy("query_id", "path")
    if norm == "max":
        top = F.max("score").over(pool)
        scaled = F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0))
        own = hits.withColumn("scaled", scaled).withColumn("q_share", weight).groupBy("query_id", "path", "doc_key").agg(F.max_by("scaled", "rank").alias("scaled"), F.first("q_share").alias("q_share"), F.min(_seen()).alias("first"), F.min_by("doc_ord", _seen()).alias("first_ord"))
    else:
        low, high = F.min("score").over(pool), F.max("score").over(pool)
        own = hits.withColumn("scaled", F.when(high - low > 1e-9, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))).withColumn("first", _seen()).withColumn("first_ord", F.col("doc_ord")).withColumn("q_share", weight)
    fused = own.groupBy("query_id", "doc_key").agg(F.round(F.sum(F.col("scaled") * F.col("q_share")), 9).alias("score"), F.min("first").alias("first"), F.min_by("first_ord", "first").alias("first_ord"))
    return _ordered(fused)


def fuse_simple(hits: DataFrame, sort: bool = True) -> DataFrame:
    """First occurrences with their raw scores, sorted by score, or in the order seen."""
    fused = hits.groupBy("query_id", "doc_key").agg(F.min_by("score", _seen()).alias("score"), F.min(_seen()).alias("first"), F.min_by("doc_ord", _seen()).alias("first_ord"))
    return _ordered(fused, sort)


def fuse(hits: DataFrame, strategy: str = "rrf", weights: dict[str, float] | None = None) -> DataFrame:
    if strategy == "rrf":
        return fuse_rrf(hits)
    if strategy == "weighted":
        return fuse_weighted(hits, weights)
    if strategy == "simple":
        return fuse_simple(hits)
    raise ValueError(f"unknown strategy {strategy!r}: rrf, weighted or simple")


def path_overlap(hits: DataFrame, a: str, b: str) -> DataFrame:
    """``query_id, both, only_a, only_b``: keys that two paths share or have alone."""
    flags = hits.groupBy("query_id", "doc_key").agg(F.max((F.col("path") == a).cast("int")).alias("a"), F.max((F.col("path") == b).cast("int")).alias("b"))
    return flags.groupBy("query_id").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))


def strategy_times(hits: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None) -> dict[str, float]:
    """Milliseconds a question that each strategy takes: it is run over all hits, and nothing is kept."""
    out, n = {}, max(1, queries.count())
    for strategy in ("rrf", "weighted", "simple"):
        began = time.monotonic()
        fuse(hits, strategy, weights).write.format("noop").mode("overwrite").save()
        out[strategy] = round((time.monotonic() - began) * 1000 / n, 1)
    return out


def compare_strategies(hits: DataFrame, queries: DataFrame, top_k: int = 5, weights: dict[str, float] | None = None, times: dict[str, float] | None = None) -> DataFrame:
    """``strategy, queries, success_pct, avg_returned, max_returned, min_returned`` (rows returned, not recall), and
    ``avg_time_ms`` if ``times`` (see ``strategy_times``) are given."""
    out = None
    for strategy in ("rrf", "weighted", "simple"):
        got = fuse(hits, strategy, weights).where(F.col("rank") <= top_k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        per = queries.select("query_id").join(got, "query_id", "left").select(F.lit(strategy).alias("strategy"), F.coalesce("n", F.lit(0)).alias("n"))
        out = per if out is None else out.unionByName(per)
    report = out.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("n") > 0).cast("double")) * 100, 6).alias("success_pct"), F.round(F.avg("n"), 6).alias("avg_returned"),
        F.max("n").cast("long").alias("max_returned"), F.min("n").cast("long").alias("min_returned"),
    )
    if times is None:
        return report
    own = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(float(t))) for s, t in times.items()], F.lit(None).cast("double"))
    return report.withColumn("avg_time_ms", own)
