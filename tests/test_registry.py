"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quillmark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, db, name):
    assert rows(registry.QUERIES[name](spark, DIR).toPandas()) == rows(db.execute(registry.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_contexts_hold_later_text(spark, tmp_path):
    from pyspark.sql import functions as F

    # the two texts differ up to character 2000 and are alike after it
    late = " ".join(f"late{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    spark.createDataFrame([(0, "x " * 1100 + late, "a"), (1, "y " * 1100 + late, "b")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r["a"], r["b"]) for r in registry.QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()] == [(1, 2)]
    windows = registry._window_chunks(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["ord"] for r in windows] == list(range(1, len(windows) + 1)) and {w for r in windows for w in r["text"].split()} == {"x", "y", *late.split()}
    row = registry.QUERIES["context_assemble"](spark, str(tmp_path)).collect()[0]
    assert row["total_chunks_retrieved"] == len(windows) and row["chunks_selected"] > 2
    assert registry.QUERIES["context_dedup"](spark, str(tmp_path)).agg(F.max("ord")).first()[0] > 2


def test_truncation_of_all_documents_by_brute_force(spark, tmp_path):
    import hashlib

    def cut(t, n=400):
        if len(t) <= n:
            return t
        region = t[n - n // 10 : n]
        for mark in ["。", "？", "！", ";\n", "!\n", "?\n", ".\n", ". ", "! ", "? "]:
            if mark in region:
                return t[: n - n // 10 + region.rfind(mark) + len(mark)]
        return t[:n].rstrip()

    marks = ["。", "？", "！", ";\n", "!\n", "?\n", ".\n", ". ", "! ", "? "]
    own = ["", "short", "x" * 400, "x" * 401, "y" * 395 + " \t\n\u00a0\u2003" + "z" * 9, "y" * 399 + "\n" + "z", "é😀" * 300, "a. b" * 120, None]
    own += ["x" * at + m + "y" * 100 for m in marks for at in (350, 358, 359, 360, 380, 398, 399, 400)]
    own += ["x" * 365 + m + "b" * 10 + n + "y" * 100 for m in marks for n in marks]
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), DIR):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        got = {r["doc_id"]: r["digest"] for r in registry.QUERIES["truncate_sentence_end"](spark, d).collect()}
        assert got == {i: hashlib.md5(cut(t or "").encode()).hexdigest() for i, t in texts.items()}
        assert any(len(t or "") > 400 for t in texts.values())


def test_damage_is_found_in_the_whole_text(spark, tmp_path):
    own = ["a" * 500 + "\ufffd", "\ufffd", "b" * 20 + "\ufffd" + "c" * 60, "d" * 300, "e" * 49, "f" * 50, ""]
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(registry.SQL["short_and_encoding"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert [tuple(registry.QUERIES["short_and_encoding"](spark, str(tmp_path)).first())] == want == [(3, 3)]


def test_abbreviations_of_all_documents_by_brute_force(spark, tmp_path):
    import re
    from collections import Counter

    from quillmark.operators.profile import NO_ABBREVIATION

    own = [("EEG WHO THE USA", "en"), ("ÉEEG EEGé EEG-WHO (EEG)", "fr"), ("EEG_x xEEG EEG9 9EEG éEEGs", "de"), ("患者EEG检查 WHO。EEG", None), (None, "es"), ("", None)]
    spark.createDataFrame([(i, *t) for i, t in enumerate(own)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), DIR):
        counts = Counter(w for r in spark.read.parquet(f"{d}/documents.parquet").collect() for w in re.findall(r"\b[A-Z]{2,}\b", r["text"] or "") if len(w) >= 3 and w not in NO_ABBREVIATION)
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:15]
        assert [tuple(r) for r in registry.QUERIES["abbreviation_topk"](spark, d).collect()] == want


def test_evidence_of_documents_with_long_ids(spark, tmp_path):
    # with "1000" before them ids from 100000 on have ten digits, and the first nine of some are another document's
    vectors = [(100000, 0, 1), (123456, 1, 2), (100020, 0, 3), (12345, 4, 4), (55, 3, 5), (100040, 0, 6), (7, 2, 7), (123459, 1, 8), (100060, 0, 9)]
    far = [(3000000 + 20 * i, [float(np.cos(i)), float(np.sin(i)), 0.0]) for i in range(1, 8)]
    near = [(i, [1.0, 0.1 * a, 0.013 * b]) for i, a, b in vectors]
    rows = near + far + [(40 + 100 * i + i, [0.2 * i, 1.0 - 0.1 * i, 0.3]) for i in range(1, 25)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i}", f"src{i % 3}") for i, _ in rows], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = rows_of(con.execute(registry.SQL["evidence_filter"]).fetchdf())
    assert rows_of(registry.QUERIES["evidence_filter"](spark, str(tmp_path)).toPandas()) == want
    assert any(len(p) > 9 for _, _, p in want) and any(len(p) <= 9 for _, _, p in want)


def rows_of(frame):
    return sorted(frame[["query_id", "ord", "pmid"]].itertuples(index=False, name=None))
