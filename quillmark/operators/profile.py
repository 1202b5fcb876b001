"""Profiles of corpora, chunks and indexes, and evaluation reports (one row or a few rows each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import is_blank, present
from quillmark.plans.sizes import sent_if_small, value_filter

#: Token limit of the embedder, and words that a passage is looked for by.
LIMIT, PROBE = 512, 6
# What abstracts' parts are recognised by, and capital words that are no abbreviations of the field.
IMRAD = {"background": ("background", "introduction", "目的"), "methods": ("method", "approach", "材料与方法", "方法"), "results": ("result", "finding", "结果"), "conclusion": ("conclusion", "结论")}
NO_ABBREVIATION = ("THE", "AND", "FOR", "WITH", "FROM", "THAT", "THIS", "WERE", "BEEN", "HAVE", "HAS", "WAS", "ARE", "BUT", "NOT", "ALL", "CAN", "USA", "DNA", "RNA", "PCR")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, present, missing_pct`` (2 places)."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~is_blank(F.col(c).cast("string"))).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns])).alias("p")
    rows = counts.select("n", pairs).select("p.field", "p.present", "n")
    return rows.select("field", "present", F.when(F.col("n") > 0, F.round((F.col("n") - F.col("present")) * 100.0 / F.col("n"), 2)).otherwise(F.lit(0.0)).alias("missing_pct"))


def short_and_encoding(df: DataFrame, title: str = "title", abstract: str = "abstract", least: int = 50) -> DataFrame:
    """``short_texts, encoding_issues``: title and abstract under ``least`` characters together; U+FFFD in either."""
    both = F.trim(F.concat(present(title), present(abstract)))
    return df.agg(F.count_if(F.length(both) < least).alias("short_texts"), F.count_if(F.contains(F.concat(present(title), present(abstract)), F.lit("�"))).alias("encoding_issues"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """``value, n``: the most frequent non-blank values, ties by value."""
    counts = df.where(~is_blank(column)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(k)


def year_and_length(df: DataFrame, year: str = "year", body: str = "text") -> DataFrame:
    """``min_year, max_year, mean_length`` (years of digits only; mean to 6 places)."""
    known = F.when(F.col(year).rlike(r"^\d{1,9}$"), F.col(year)).cast("int")
    return df.agg(F.min(known).alias("min_year"), F.max(known).alias("max_year"), F.round(F.avg(F.length(present(body))), 6).alias("mean_length"))


def quantile_sample(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """``share, doc_id, length``: the rows at these shares of the order by length (ties by id).

    Ranks come from counts per length (few rows), so no window runs over the whole table.
    """
    lengths = df.select(F.col(doc_id).alias("doc_id"), F.length(present(text)).alias("length"))
    counts = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    at = F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1)
    chosen = placed.select("length", "n", "upto", "total", wanted).withColumn("at", at).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
    chosen = chosen.select("share", "length", (F.col("at") - (F.col("upto") - F.col("n")) + 1).alias("nth"))
    own = Window.partitionBy("share").orderBy("doc_id")
    rows = lengths.join(F.broadcast(chosen), "length").withColumn("k", F.row_number().over(own)).where("k = nth")
    return rows.select("share", "doc_id", "length")


def imrad(df: DataFrame, abstract: str = "abstract") -> DataFrame:
    """``mean_score, full, none``: how many of the four parts abstracts name."""
    text = F.lower(present(abstract))
    score = F.lit(0)
    for words in IMRAD.values():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        score = score + hit.cast("int")
    return df.select(score.alias("s")).agg(F.round(F.avg("s"), 6).alias("mean_score"), F.count_if(F.col("s") == 4).alias("full"), F.count_if(F.col("s") == 0).alias("none"))


def abbreviations(df: DataFrame, text: str = "text", k: int = 15) -> DataFrame:
    """``value, n``: frequent words of three and more capitals, ties by word.  A letter, digit or underscore of any script
    beside it makes it a part of a longer word."""
    words = df.select(F.explode(F.regexp_extract_all(present(text), F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{2,}(?![\p{L}\p{N}_])"), F.lit(0))).alias("value"))
    kept = words.where((F.length("value") >= 3) & ~F.col("value").isin(*NO_ABBREVIATION))
    return kept.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def length_stats(lengths: DataFrame, column: str = "length", limit: int = LIMIT) -> DataFrame:
    """``min, max, mean, median, p90, p95, p99`` (linear interpolation) and ``over_pct``, the share above ``limit``."""
    c = F.col(column)
    at = lambda q: F.round(F.percentile(c, q), 6)
    return lengths.agg(F.min(c).cast("long").alias("min_len"), F.max(c).cast("long").alias("max_len"), F.round(F.avg(c), 6).alias("mean_len"), at(0.5).alias("median_len"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.round(F.avg((c > limit).cast("double")) * 100, 6).alias("over_pct"))


def split_strategy(stats: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``strategy, chunk_size, chunk_overlap`` from p95 and p99: whole texts, sliding windows, or by sections."""
    window = F.least(F.lit(limit - 50), F.floor("p95").cast("int"))
    whole, sliding = F.col("p95") <= limit, F.col("p99") <= 2 * limit
    size = F.when(whole, F.lit(limit)).when(sliding, window).otherwise(F.lit(300))
    lap = F.when(whole, F.lit(0)).when(sliding, F.floor(window * 0.2).cast("int")).otherwise(F.lit(50))
    return stats.select(F.when(whole, F.lit("no split")).when(sliding, F.lit("sliding window")).otherwise(F.lit("sections and window")).alias("strategy"), size.alias("chunk_size"), lap.alias("chunk_overlap"))


def histogram(lengths: DataFrame, column: str = "length", width: int = 100) -> DataFrame:
    """``bucket, n``: counts by multiples of ``width``."""
    return lengths.groupBy((F.floor(F.col(column) / width) * width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(lengths: DataFrame, column: str = "length") -> DataFrame:
    """``q1, median, q3, low, high, outliers``: quartiles (linear interpolation), the least and greatest value within 1.5 times the
    quartiles' distance of them, and how many values lie beyond."""
    c = F.col(column)
    box = lengths.agg(*[F.percentile(c, q).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (c >= F.col("q1") - reach) & (c <= F.col("q3") + reach)
    both = lengths.select(c).crossJoin(F.broadcast(box))  # one row
    return both.groupBy("q1", "median", "q3").agg(F.min(F.when(inside, c)).cast("long").alias("low"), F.max(F.when(inside, c)).cast("long").alias("high"), F.count_if(~inside).alias("outliers"))


def index_stats(chunks: DataFrame, name: str, model: str, dim: int) -> DataFrame:
    """One row about an index: its name, model and dimension, ``total_chunks`` and the token counts' mean, greatest and least."""
    counts = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.max("token_count").cast("long").alias("max_tokens"), F.min("token_count").cast("long").alias("min_tokens"))
    return counts.select(F.lit(name).alias("collection_name"), F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dimension"), *counts.columns)


def chunk_quality(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row about ``doc_id, chunk_index, total_chunks, token_count, text, source_title``."""
    text = present("text")
    ends = F.regexp_replace(text, r"(?U)^\s+|\s+$", "").rlike(r"[.。?？!！]$")
    titled = (F.col("total_chunks") > 1) & (F.col("chunk_index") == 0)
    n = F.count(F.lit(1))
    return chunks.agg(
        n.alias("total_chunks"), F.count_if(F.col("token_count") > limit).alias("over_limit"), F.round(F.avg((F.col("token_count") > limit).cast("double")) * 100, 2).alias("over_limit_pct"),
        F.count_if(is_blank(text)).alias("empty_chunks"), F.count_if(F.length(text) < 50).alias("very_short"), F.count_if(titled & (present("source_title") != "") & F.contains(text, present("source_title"))).alias("first_with_title"),
        F.count_if(titled).alias("first_total"), F.count_if(ends).alias("ending_properly"), F.min("token_count").cast("long").alias("min_tokens"), F.max("token_count").cast("long").alias("max_tokens"),
        F.round(F.avg("token_count"), 1).alias("mean_tokens"), F.round(F.percentile("token_count", 0.95), 1).alias("p95_tokens"), F.round(F.percentile("token_count", 0.99), 1).alias("p99_tokens"),
        F.count_if((F.col("chunk_index") == 0) & (F.col("total_chunks") > 1)).alias("multi_chunk_docs"), F.count_if((F.col("chunk_index") == 0) & (F.col("total_chunks") == 1)).alias("single_chunk_docs"),
    )


def neighbour_overlap(chunks: DataFrame, reach: int = 200) -> DataFrame:
    """``doc_id, chunk_index, common``: leading characters that the last ``reach`` of a chunk and the first of the next share,
    place by place."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    pairs = chunks.withColumn("q_next", F.lead("text").over(order)).where("q_next is not null")
    tail, head = F.split(F.right(present("text"), F.lit(reach)), ""), F.split(F.left(F.col("q_next"), F.lit(reach)), "")
    same = F.zip_with(tail, head, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_off = F.array_position(same, False)
    return pairs.select("doc_id", "chunk_index", F.when(first_off > 0, first_off - 1).otherwise(F.size(same)).cast("long").alias("common"))


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """``documents, chunks, chunks_per_doc`` (2 places)."""
    return chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks")).withColumn("chunks_per_doc", F.round(F.col("chunks") / F.col("documents"), 2))


def per_query(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, n_returned, top1``: of every question how many hits ``hits(query_id, rank, doc_ord)`` it has and the first one."""
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_returned"), F.min_by("doc_ord", "rank").alias("top1"))
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("n_returned", F.lit(0)).alias("n_returned"), "top1")


def evaluation(results: DataFrame) -> DataFrame:
    """One row about ``query_id, n_returned, latency_ms``: totals, success, rows returned (not recall) and latency."""
    return results.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n_returned") > 0).alias("with_docs"), F.round(F.avg("n_returned"), 6).alias("avg_returned"), F.min("n_returned").alias("min_returned"),
        F.max("n_returned").alias("max_returned"), F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
    )


def holding(docs: DataFrame, passages: DataFrame, doc_ord: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, doc_ord``: the documents whose text contains a passage of ``passages(query_id, query)``.

    Candidates share the passage's hash of ``PROBE`` whole words (a literal filter passes over the texts once, and a join finds
    the pairs), and are then searched.  Passages of fewer words are searched for in all texts; null and empty ones in none.
    """
    words = lambda c: F.split(F.col(c), r"\s+")
    # the first and the last word may be parts of longer ones in a text
    asked = passages.where("query is not null and query <> ''").select("query_id", "query", words("query").alias("q_words"))
    long = asked.where(F.size("q_words") >= PROBE + 2).select("query_id", "query", F.xxhash64(F.slice("q_words", 2, PROBE)).alias("q_probe"))
    own = docs.where(F.col(text).isNotNull()).select(F.col(doc_ord).alias("doc_ord"), F.col(text).alias("q_text"))
    split = own.withColumn("q_words", words("q_text"))
    probes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("q_words") - PROBE + 1)), lambda i: F.xxhash64(F.slice("q_words", i, PROBE)))
    named = long.withColumnRenamed("q_probe", "q_value")
    known = value_filter(named, "q_value")
    kept = F.array_distinct(F.filter(probes, known) if known else probes)
    met = split.select("doc_ord", "q_text", F.explode(kept).alias("q_value")).join(sent_if_small(named), "q_value")
    found = met.where(F.contains("q_text", F.col("query"))).select("query_id", "doc_ord")
    short = sent_if_small(asked.where(F.size("q_words") < PROBE + 2).select("query_id", "query"))
    rest = own.join(short, F.contains(F.col("q_text"), F.col("query"))).select("query_id", "doc_ord")
    return found.unionByName(rest).distinct()


def hit_at_k(hits: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """``queries, hits, hit_rate``: questions of ``truth(query_id, doc_ord)`` with a true document among their best ``k``."""
    top = hits.where(F.col("rank") <= k).select("query_id", "doc_ord").distinct()
    found = truth.join(top.withColumn("hit", F.lit(1)), ["query_id", "doc_ord"], "left").groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return found.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.round(F.avg("hit"), 6).alias("hit_rate"))


def run_totals(metrics: DataFrame) -> DataFrame:
    """``runs, mean_seconds, mean_answer_length, total_tokens`` of rows ``total_time_seconds, answer_length, token_counts
    map<string,int>`` (a null map counts nothing)."""
    tokens = F.aggregate(F.map_values(F.coalesce("token_counts", F.create_map().cast("map<string,int>"))), F.lit(0).cast("long"), lambda s, v: s + v)
    return metrics.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("total_time_seconds"), 2).alias("mean_seconds"), F.round(F.avg("answer_length"), 2).alias("mean_answer_length"), F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """``stage, runs, success_pct``: from rows with ``stage_success map<string,boolean>``."""
    rows = metrics.select(F.explode("stage_success").alias("stage", "ok"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("ok").cast("double")) * 100, 6).alias("success_pct"))
