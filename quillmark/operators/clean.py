"""Cleaning of article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import clean_text, is_blank, present


def drop_blank(df: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Rows with a blank title and a blank abstract go."""
    return df.where(~(is_blank(title) & is_blank(abstract)))


def fill_missing(df: DataFrame, columns: tuple[str, ...] = ("title", "abstract", "pmid", "journal", "year")) -> DataFrame:
    return df.withColumns({c: present(F.col(c).cast("string")) for c in columns if c in df.columns})


def clean_columns(df: DataFrame, columns: tuple[str, ...] = ("title", "abstract", "body_text")) -> DataFrame:
    return df.withColumns({c: clean_text(c) for c in columns if c in df.columns})


def keep_first(df: DataFrame, key: str = "doc_id", order: str = "path") -> DataFrame:
    """One row per key: the first in ``order`` (``dropDuplicates`` would keep any)."""
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("q_nth", F.row_number().over(first)).where("q_nth = 1").drop("q_nth")


def clean_articles(df: DataFrame) -> DataFrame:
    """Drop blank rows, fill nulls, clean texts, keep the first row of every doc_id by ``path``."""
    return keep_first(clean_columns(fill_missing(drop_blank(df))))
