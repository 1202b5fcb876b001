"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import chat, mixing, toxicity
from quillmark.llm.bitplanes import read_ids, write_ids
from quillmark.llm.chunk_bpe import bpe_round_trip
from quillmark.llm.chunk_dedup import dedup_substrings
from quillmark.llm.html_extract import extract_pages
from quillmark.llm.imatch import fingerprints
from quillmark.llm.jaccard_join import jaccard_components
from quillmark.llm.ogg import ogg_column, ogg_features
from quillmark.sources.scratch import materialise


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a file (the default of every tokenizer parameter here)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op3_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the streams are stored, and what is described is read back from there
    return ogg_features(materialise(ogg_column(_table(spark, sf_dir, "documents")), "ogg"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(_table(spark, sf_dir, "conversations"))


def op10_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_trees, op2_bitplane_ids, op3_jaccard_rtree, op4_mix_sources, op5_ogg, op6_imatch, op7_chunk_dedup, op8_toxicity, op9_chat_snapshots, op10_chunk_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.MIX_SQL, "op9_chat_snapshots": chat.CHAT_SQL}
