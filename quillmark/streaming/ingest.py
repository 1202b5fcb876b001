"""Incremental ingestion: new rows of a folder of articles become chunk rows as they arrive (structured streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.chunking import chunk_recursive


def stream_articles(spark: SparkSession, folder: str, schema: str = "doc_id string, title string, text string") -> DataFrame:
    """A stream of article rows from Parquet files that are added to ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def chunk_stream(articles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of new articles to ``out``; each batch that is there is processed once, then the query ends."""
    return chunk_recursive(articles).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
