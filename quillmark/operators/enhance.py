"""Understanding of questions: entities, synonyms, variants, time and journal filters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.ranking import journal_keyword, year_gte
from quillmark.functions.text import clean_query, present
from quillmark.operators.lexicon import ENTITIES, ENTITY_WORDS, SYNONYMS
from quillmark.operators.vectors import QUESTION_INSTRUCTION


def entities(query: Column | str, patterns: dict[str, str] | None = None, words: dict[str, list[str]] | None = None) -> Column:
    """Map of entity type to the distinct lower-case mentions, in order of the first; types without any are left out.
    ``words`` are types whose mentions are found by containment (Chinese; sorted)."""
    text = present(query)
    pairs = []
    for kind, pattern in (ENTITIES if patterns is None else patterns).items():
        pairs += [F.lit(kind), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(0)), lambda w: F.lower(w)))]
    for kind, names in (ENTITY_WORDS if words is None else words).items():
        known = F.array(*[F.lit(n) for n in sorted(names)])
        pairs += [F.lit(kind), F.filter(known, lambda w: F.contains(text, w))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def expand(query: str, synonyms: dict[str, list[str]]) -> list[str]:
    """Expansions of the keys in a question: English keys as words, the longest first, each character used once; then Chinese
    keys by containment, in the dictionary's order."""
    import re

    found, used = [], [False] * len(query)
    english = sorted((k for k in synonyms if k.isascii()), key=len, reverse=True)
    for key in english:
        for m in re.finditer(rf"\b{re.escape(key)}\b", query, re.IGNORECASE):
            if not any(used[m.start() : m.end()]):
                used[m.start() : m.end()] = [True] * (m.end() - m.start())
                found += synonyms[key]
    for key, values in synonyms.items():
        if not key.isascii() and key in query:
            found += values
    return list(dict.fromkeys(f for f in found if f))


def synonyms(table: dict[str, list[str]] | None = None):
    """A pandas UDF: array of a question's expansions."""
    known = SYNONYMS if table is None else table

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda q: expand(q or "", known))

    return run


def variants(cleaned: Column, expansions: Column) -> Column:
    """The question, and the question with each expansion (distinct, sorted)."""
    return F.array_sort(F.array_distinct(F.concat(F.array(cleaned), F.transform(expansions, lambda s: F.concat(cleaned, F.lit(" "), s)))))


def enhance(queries: DataFrame, current_year: int, table: dict[str, list[str]] | None = None, instruction: str = QUESTION_INSTRUCTION) -> DataFrame:
    """``queries(query_id, query)`` with ``cleaned, entities, synonyms, query_variants, vector_query, keyword_query, year_gte,
    journal_keyword, log``.  A null question is empty.  Equal questions are read once."""
    every, queries = queries, queries.select("query").distinct()
    out = queries.withColumn("cleaned", clean_query("query"))
    out = out.withColumn("entities", entities("cleaned")).withColumn("synonyms", synonyms(table)(F.col("cleaned")))
    out = out.withColumn("query_variants", variants(F.col("cleaned"), F.col("synonyms")))
    out = out.withColumn("vector_query", F.concat(F.lit(instruction), F.col("cleaned")))
    out = out.withColumn("keyword_query", F.concat_ws(" ", F.array(F.col("cleaned")), F.col("synonyms")))
    out = out.withColumn("year_gte", year_gte("cleaned", current_year)).withColumn("journal_keyword", journal_keyword("cleaned"))
    log = F.array(
        F.concat(F.lit("query: "), present("query")), F.concat(F.lit("cleaned: "), F.col("cleaned")), F.concat(F.lit("entity types: "), F.size("entities").cast("string")),
        F.concat(F.lit("synonyms: "), F.size("synonyms").cast("string")), F.concat(F.lit("variants: "), F.size("query_variants").cast("string")),
        F.concat(F.lit("year_gte: "), present("year_gte")), F.concat(F.lit("journal: "), present("journal_keyword")),
    )
    done = out.withColumn("log", log).withColumnRenamed("query", "q_query")
    return every.join(done, F.col("query").eqNullSafe(F.col("q_query"))).drop("q_query")
