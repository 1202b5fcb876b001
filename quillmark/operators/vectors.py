"""Exact nearest neighbours of a set of query vectors, and embedders."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are multiplied at once, and the most that go to the tasks as one matrix.
BLOCK, MOST = 256, 20_000
# What is put before a text by the two embedders.
SENTENCE_INSTRUCTION = "Represent this sentence for searching relevant passages: "
QUESTION_INSTRUCTION = "Represent this question for searching relevant passages: "


class Embedder(Protocol):
    """Adds ``embedding array<float>`` to a table of texts; ``instruction`` is put before every text."""

    def embed(self, df: DataFrame, text: str, instruction: str = "") -> DataFrame: ...


class HashingEmbedder:
    """A deterministic stand-in without a model: signed counts of hashed tokens, L2-normalised (column functions)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, df: DataFrame, text: str, instruction: str = "") -> DataFrame:
        from quillmark.functions.text import ascii_tokens

        hashed = F.transform(ascii_tokens(F.concat(F.lit(instruction), F.coalesce(F.col(text), F.lit("")))), lambda t: F.xxhash64(t))
        counts = df.withColumn("q_h", hashed).withColumn(
            "embedding", F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.aggregate("q_h", F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(self.dim)) == i, F.when(F.shiftright(h, 32) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0))))
        return counts.withColumn("embedding", l2_normalised(F.col("embedding"))).drop("q_h")


class HttpEmbedder:
    """Asks a service for every text: ``post(url, {"model", "prompt"})`` answers ``{"embedding": [...]}``.  One request a text, in
    Arrow batches; a request that fails after ``retries`` more tries fails its task, which runs again."""

    def __init__(self, url: str, model: str, retries: int = 2, timeout: float = 60.0, post=None):
        self.url, self.model, self.retries, self.timeout, self.post = url, model, retries, timeout, post

    def embed(self, df: DataFrame, text: str, instruction: str = "") -> DataFrame:
        url, model, retries, timeout, post = self.url, self.model, self.retries, self.timeout, self.post or _post

        @F.pandas_udf("array<float>")
        def ask(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                for left in range(retries, -1, -1):
                    try:
                        out.append([float(x) for x in post(url, {"model": model, "prompt": instruction + (t or "")}, timeout)["embedding"]])
                        break
                    except OSError:
                        if not left:
                            raise
            return pd.Series(out)

        return df.withColumn("embedding", ask(F.col(text)))


def _post(url: str, body: dict, timeout: float) -> dict:
    import json
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, (x.cast("double") / norm)).otherwise(F.lit(0.0)).cast("float"))


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """Cosine similarity with ``epsilon`` in the denominator; null if either vector is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(epsilon))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", condition: Column | None = None, vec_id: str = "vec_id") -> DataFrame:
    """``query_id, path, rank, doc_ord, distance, score``: the ``k`` nearest of ``vectors(vec_id, embedding)`` to each of
    ``queries(query_id, embedding)``; ``score = 1 / (1 + distance)``.

    The queries go to every task as matrices of at most ``MOST`` (further ones, by ranges of query_id, in further passes over
    the vectors); a task multiplies its vectors with blocks of them and sends on only its own ``k`` best of each, so what is
    shuffled does not depend on the number of vectors.  Ties go by
    id.  Vectors and queries that are null are left out.  ``metric`` is ``cosine`` or ``l2`` (squared).
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long"), "embedding")
    schema = "query_id long, doc_ord long, distance double"
    source = vectors.where(condition) if condition is not None else vectors
    source = source.where(f"`{vec_id}` is not null and embedding is not null").select(F.col(vec_id).cast("long").alias("doc_ord"), "embedding")
    found = [_nearest(source, block, k, metric, schema) for block in _blocks(asked)]
    return _ranked(reduce(DataFrame.union, found) if found else source.sparkSession.createDataFrame([], schema), k)


def _blocks(asked: DataFrame):
    """The queries in ranges of query_id with at most ``MOST`` rows each (more only if one id has more)."""
    while True:
        part = asked.orderBy("query_id").limit(MOST + 1).toArrow()
        if part.num_rows <= MOST:
            if part.num_rows:
                yield part
            return
        ids = part.column(0).to_numpy()
        n = int(np.searchsorted(ids, ids[-1]))  # the last id may go on, so it opens the next block
        yield part.slice(0, n) if n else asked.where(F.col("query_id") == int(ids[-1])).toArrow()
        asked = asked.where(F.col("query_id") >= int(ids[-1]) if n else F.col("query_id") > int(ids[-1]))


def _nearest(source: DataFrame, asked: pa.Table, k: int, metric: str, schema: str) -> DataFrame:
    """Each task's own ``k`` best of every query of the block."""
    names = asked.column(0).to_numpy()
    matrix = _matrix(asked.column(1).combine_chunks())

    def run(batches):
        best_d = np.full((len(names), 0), 0.0)
        best_i = np.full((len(names), 0), 0)
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), _matrix(batch.column(1))
            new_d, new_i = [], []
            for at in range(0, len(names), BLOCK):
                d = np.round(_distances(matrix[at : at + BLOCK], own, metric), 9) + 0.0  # no negative zero
                i = np.broadcast_to(ids, d.shape)
                d, i = np.concatenate([best_d[at : at + BLOCK], d], 1), np.concatenate([best_i[at : at + BLOCK], i], 1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                new_d.append(np.take_along_axis(d, order, 1))
                new_i.append(np.take_along_axis(i, order, 1))
            best_d, best_i = np.concatenate(new_d), np.concatenate(new_i)
        if best_d.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_d.shape[1])), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["query_id", "doc_ord", "distance"])

    return source.mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "doc_ord")
    near = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return near.select("query_id", F.lit("vector").alias("path"), "rank", "doc_ord", "distance", (1 / (1 + F.col("distance"))).alias("score"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]) - 2 * a @ b.T
    norms = np.sqrt((a**2).sum(1))[:, None] * np.sqrt((b**2).sum(1))[None, :]
    return 1 - (a @ b.T) / np.where(norms > 0, norms, 1)


def self_retrieval(vectors: DataFrame, sample: DataFrame) -> DataFrame:
    """``n, passed, pass_rate``: how many of the sampled vectors are their own nearest neighbour."""
    top = knn(vectors, sample.select(F.col("vec_id").alias("query_id"), "embedding"), 1)
    hit = (F.col("doc_ord") == F.col("query_id")).cast("long")
    return top.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("passed"), F.round(F.avg(hit), 6).alias("pass_rate"))
