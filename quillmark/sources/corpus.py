"""Article XML, chunk, vector and metrics tables: sources and sinks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import filled, present

ARTICLE = "doc_id string, pmid string, title string, abstract string, journal string, year string, body_text string, source_file string, path string, error string"
DOCUMENT = "content string, pmid string, journal string, year string, source string, path string, error string"
_DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*(\[.*?\])?\s*>", re.S)


def _root(xml: str) -> ET.Element:
    root = ET.fromstring(_DOCTYPE.sub("", xml, count=1).strip())
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    return root


def _text(e: ET.Element | None) -> str:
    """Descendant strings, each trimmed, joined by blanks."""
    return "" if e is None else " ".join(t for t in (s.strip() for s in e.itertext()) if t)


def _pmid(root: ET.Element) -> str:
    return next((_text(e) for e in root.iter("article-id") if e.get("pub-id-type") == "pmid"), "")


def parse_article(xml: str) -> dict[str, str]:
    """The flat record: first title, abstract, journal and year anywhere; all paragraphs (also the abstract's) are the body."""
    root = _root(xml)
    first = lambda name: _text(next(root.iter(name), None))
    return {"pmid": _pmid(root), "title": first("article-title"), "abstract": first("abstract"), "journal": first("journal-title"), "year": first("year"), "body_text": " ".join(_text(p) for p in root.iter("p"))}


def parse_structured(xml: str) -> dict[str, str]:
    """Markdown of title, abstract and every section (a nested section's paragraphs repeat under its parents; paragraphs
    outside sections are left out), and the year of the first publication date."""
    root = _root(xml)
    date = next(root.iter("pub-date"), None)
    parts = []
    if title := _text(next(root.iter("article-title"), None)):
        parts.append(f"# {title}")
    if abstract := _text(next(root.iter("abstract"), None)):
        parts.append(f"## Abstract\n{abstract}")
    for section in (s for body in [next(root.iter("body"), None)] if body is not None for s in body.iter("sec")):
        paragraphs = [_text(p) for p in section.iter("p")]
        if paragraphs:
            name = "".join(s.strip() for s in t.itertext()) if (t := next(section.iter("title"), None)) is not None else ""
            parts.append((f"## {name}\n" if name else "") + "\n".join(paragraphs))
    return {"content": "\n\n".join(parts), "pmid": _pmid(root), "journal": _text(next(root.iter("journal-title"), None)), "year": _text(next(date.iter("year"), None)) if date is not None else ""}


def scan_xml(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``path, xml``: all ``*.xml`` below a folder (any case); ``max_files`` keeps the first by path."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    files = files.where(F.lower("path").endswith(".xml"))
    return files.orderBy("path").limit(max_files) if max_files else files


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, xml``: the ``*.xml`` members of all tar archives (plain or compressed) below a folder, in place of ``scan_xml``.
    One archive is unpacked by one task, member by member."""
    import io
    import tarfile

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                    for member in archive:
                        if member.isfile() and member.name.lower().endswith(".xml"):
                            yield pd.DataFrame({"path": [f"{name}/{member.name}"], "xml": [archive.extractfile(member).read().decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(r"lower(path) rlike '\\.(tar|tgz|tar\\.gz|tar\\.bz2|tar\\.xz)$'")
    return files.select("path", "content").mapInPandas(run, "path string, xml string")


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, xml in frame.itertuples(index=False):
                row = dict.fromkeys(names, "") | {"path": path, "error": None}
                row["source_file" if "source_file" in row else "source"] = path.rsplit("/", 1)[-1]
                try:
                    row |= parse(xml)
                except ET.ParseError as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def load_articles(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The article table; ``doc_id`` is the PMID or the file's stem; files that do not parse have ``error`` set."""
    rows = _parsed(scan_xml(spark, path, max_files), parse_article, ARTICLE)
    return rows.withColumn("doc_id", F.coalesce(filled("pmid"), F.regexp_replace("source_file", r"(?i)\.xml$", "")))


def load_documents(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Structured documents of all files (``max_files``: of the first by path); blank ones go."""
    return _parsed(scan_xml(spark, path, max_files), parse_structured, DOCUMENT).where("error is not null or trim(content) <> ''")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Parquet, JSON lines and one row of statistics."""
    from quillmark.operators.profile import corpus_counts

    chunks.write.mode("overwrite").parquet(f"{folder}/chunks.parquet")
    chunks.write.mode("overwrite").json(f"{folder}/chunks.jsonl")
    corpus_counts(chunks).write.mode("overwrite").json(f"{folder}/stats.json")


METRICS = ("cosine", "l2")


def write_vectors(chunks: DataFrame, embedder, folder: str, metric: str = "cosine") -> None:
    """The vector collection, made anew: ids, embeddings, texts and metadata (titles up to 200 characters), and the metric that
    its vectors are compared by (``cosine``, or ``l2`` as stores without a stated metric have it)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    embedded = embedder.embed(chunks, "text").withColumn("metric", F.lit(metric))
    embedded.select(F.col("chunk_id").alias("id"), "embedding", F.col("text").alias("document"), "doc_id", "chunk_index", "total_chunks", F.substring(present("source_title"), 1, 200).alias("source_title"), "token_count", "split_method", "metric").write.mode("overwrite").parquet(folder)


def collection_metric(vectors: DataFrame) -> str:
    """The metric that a collection was written for; ``l2`` if it states none."""
    row = vectors.select("metric").limit(1).collect() if "metric" in vectors.columns else []
    return row[0][0] if row else "l2"


def collection_peek(vectors: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    """The first ``n`` entries by key."""
    return vectors.orderBy(key).limit(n)


def collection_sources(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``source``: the distinct sources, null and empty ones left out."""
    return vectors.select(filled(F.col(key).cast("string")).alias("source")).where("source is not null").distinct()


def collection_summary(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``vectors, sources, dim``."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct(key).alias("sources"), F.max(F.size("embedding")).alias("dim"))


def append_metrics(metrics: DataFrame, folder: str) -> bool:
    """Append metrics as JSON lines, maps of doubles to 4 places; a folder that cannot be written does not fail the run."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    rounded = metrics
    for f in metrics.schema.fields:
        if f.dataType.simpleString() == "double":
            rounded = rounded.withColumn(f.name, F.round(f.name, 4))
        elif f.dataType.simpleString() == "map<string,double>":
            rounded = rounded.withColumn(f.name, F.transform_values(f.name, lambda _, v: F.round(v, 4)))
    try:
        rounded.write.mode("append").json(folder)
    except (PySparkException, Py4JJavaError):
        return False
    return True


def write_report(report: DataFrame, folder: str) -> None:
    """A report of one row or a few (quality, evaluation, index) as JSON lines, made anew; nulls are written out."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def write_cache(cache: DataFrame, folder: str) -> bool:
    """A cache ``key, text, last_used`` as JSON lines, made anew (by way of the shared scratch folder, as it may be read from
    there); a folder that cannot be written does not fail the run."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from quillmark.sources.scratch import materialise

    try:
        materialise(cache.select("key", "text", "last_used"), "cache").write.mode("overwrite").json(folder)
    except (PySparkException, Py4JJavaError):
        return False
    return True


def read_cache(spark: SparkSession, path: str, size: int = 32) -> DataFrame:
    """A cache of JSON lines ``key, text, last_used``; corrupt lines are skipped, the last ``size`` entries stay."""
    from quillmark.operators.generate import evicted

    rows = spark.read.schema("key string, text string, last_used long").option("mode", "DROPMALFORMED").json(path)
    return evicted(rows.where("key is not null and text is not null"), size)
