"""The corpus pipeline: documents through five of the operators, each stage's result written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.chunk_bpe import bpe_round_trip
from quillmark.llm.chunk_dedup import dedup_substrings
from quillmark.llm.jaccard_join import jaccard_survivors
from quillmark.llm.mixing import mix_sources
from quillmark.llm.queries import tokenizer_path
from quillmark.llm.toxicity import score_toxicity, train
from quillmark.sources.scratch import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go; it is fitted on the labels of the training folds.  Every
    row is judged by its own text: null and repeated ids and repeated rows change nothing, a null text is empty."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked texts one row stays: the smallest doc_id's, null last.  Rows are told apart by doc_id and
    text, so null and repeated ids lose no text of their own; texts without words all stay; an empty table stays empty."""
    return jaccard_survivors(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts (of rows with a null id, the largest, each is judged by its
    own text).  Every row stays, a text of which nothing is left as an empty one; null texts stay null."""
    return dedup_substrings(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is repeated as often as the mix of its source takes it (also not at all); a null source is a source of its own,
    rows that tie are ordered by a hash of the text, and a text without words is taken like any other."""
    mixed = mix_sources(docs).where("copies > 0")
    return mixed.withColumn("q_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix, repeats included; a null text is empty."""
    return bpe_round_trip(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("chunk_dedup", cut_repeats), ("mixing", mix), ("bpe", encode)]

#: Learned scores and rolling hashes have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
