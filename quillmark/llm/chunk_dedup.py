"""Substring dedup by content-defined chunking.

Texts are cut after words whose 16-bit gear rolling hash (over the last 16 bytes) is the least among the ``REACH`` words on
either side, on average every ``2 * REACH + 1`` words, so a passage is cut alike wherever it stands, an insertion shifts no
later cut, and long stretches without a cut hardly occur.  Chunks are named by a digest of their
words.  Of every digest the first occurrence (smallest doc_id, then place) stays; runs of later occurrences that together
have ``RUN`` words or more are cut out of their texts.  As a run holds several chunks, a chance clash of a 64-bit digest
alone cuts nothing.

Every task settles its own repeats before the shuffle: a digest leaves a task once, however often it occurs there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.rolling import _mix, gear16
from quillmark.llm.shingles import _powers, grouped, raw_texts, word_hashes

REACH, RUN = 2, 24
#: Rows that a task settles at once.
HELD = 2_000_000
_GAP = b" " * 16
_PLACE = _powers(4096)


def _least(h: np.ndarray, text: np.ndarray, reach: int) -> np.ndarray:
    """Words whose hash is the least among ``reach`` words of their text on either side (of equal ones the first)."""
    out = np.ones(len(h), bool)
    for step in range(1, reach + 1):
        near = text[step:] == text[:-step]
        out[step:] &= ~near | (h[step:] < h[:-step])
        out[:-step] &= ~near | (h[:-step] <= h[step:])
    return out


def chunks(texts: list[bytes], reach: int = REACH):
    """For every text: digests, byte starts and word counts of its chunks."""
    for lo, hi in grouped(texts):
        part = texts[lo:hi]
        raw = np.frombuffer(_GAP + _GAP.join(part), np.uint8)
        begin = np.cumsum([16, *(len(t) + 16 for t in part)])
        hashes, starts, ends = word_hashes(raw, lower=False)
        bound = np.searchsorted(starts, begin)
        cut = _least(gear16(raw)[ends - 1], np.repeat(np.arange(len(part)), np.diff(bound)), reach)
        for k, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
            if a == b:
                yield np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            first = np.concatenate([[0], np.flatnonzero(cut[a : b - 1]) + 1])
            words = np.diff(first, append=b - a)
            place = np.arange(b - a) - np.repeat(first, words)
            digest = _mix(np.add.reduceat(hashes[a:b] * _PLACE[place & 4095], first) + words.astype(np.uint64))
            yield digest, starts[a:b][first] - begin[k], words


def repeated_chunks(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``q_row, q_place``: every chunk of ``docs(doc_id, q_row, text)``, by number, that is not the first of its digest.
    ``q_row`` names a document (rows that share it are one); a null doc_id is the largest, equal ones go by ``q_row``."""

    def local(batches):
        held, n = [], 0
        for batch in batches:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids, rows = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for missing, doc, row, (digest, _, _) in zip(none, ids, rows, chunks(raw_texts(batch.column(2)), reach), strict=True):
                if k := len(digest):
                    held.append((digest, np.full(k, missing), np.full(k, doc), np.full(k, row), np.arange(k, dtype=np.int32)))
                    n += k
            if n >= HELD:
                yield from _settled(held)
                held, n = [], 0
        if held:
            yield from _settled(held)

    def _settled(held):
        digest, none, doc, row, place = (np.concatenate([h[k] for h in held]) for k in range(5))
        order = np.lexsort((place, row, doc, none, digest))
        digest, none, doc, row, place = digest[order], none[order], doc[order], row[order], place[order]
        first = np.ones(len(digest), bool)
        first[1:] = digest[1:] != digest[:-1]
        # what is no first here is none at all: it only has to reach its row, whatever the way (rows that repeat a document
        # repeat its first chunk, so that is told by the names)
        at = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        first |= (row == row[at]) & (place == place[at])
        key = np.where(first, digest, _mix(row.view(np.uint64) ^ place.astype(np.uint64))).view(np.int64)
        for a in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (key, none, doc, row, place, ~first)], ["digest", "none", "doc", "q_row", "q_place", "sure"])

    found = docs.select("doc_id", "q_row", "text").mapInArrow(local, "digest long, none boolean, doc long, q_row long, q_place int, sure boolean")
    # a digest has at most a row for each task here, and the window sorts on disk if need be
    order = Window.partitionBy("digest", "sure").orderBy("none", "doc", "q_row", "q_place")
    marked = found.withColumn("first", F.first(F.struct("q_row", "q_place")).over(order))
    return marked.where("sure or first.q_row <> q_row or first.q_place <> q_place").select("q_row", "q_place")


def _runs(again: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs [a, b) of repeated chunks with ``least`` words or more."""
    edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
    total = np.concatenate([[0], np.cumsum(words)])
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if total[b] - total[a] >= least]


def dedup_substrings(docs: DataFrame, reach: int = REACH, run: int = RUN) -> DataFrame:
    """``docs`` with ``text`` cut and ``removed_words long, removed_spans array<struct<start,end>>`` (bytes of the old text)
    appended; existing columns of these names are replaced and an ``n_chars`` column is brought up to date.

    One row per input row, also where nothing of the text stays.  A null text stays null; rows that repeat both doc_id and
    text are one document and keep the same; rows without an id are the last, each by its own text; an empty table gives
    an empty result.
    """
    names = ("removed_words", "removed_spans")
    fields = [f for f in docs.schema.fields if f.name not in names]
    own = docs.select(*(F.col(f"`{f.name}`") for f in fields), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("q_own"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("q_row"), F.col("text").cast("string").alias("text"))
    marks = repeated_chunks(slim, reach).groupBy("q_row").agg(F.collect_set("q_place").alias("q_places"))
    joined = own.join(marks, F.col("q_own") == F.col("q_row"), "left").drop("q_own", "q_row")
    text_at = [f.name for f in fields].index("text")
    chars_at = [f.name for f in fields].index("n_chars") if any(f.name == "n_chars" for f in fields) else None

    def cut(batches):
        for batch in batches:
            texts, out, removed, spans = raw_texts(batch.column(text_at)), [], [], []
            marked = [k for k in range(len(texts)) if batch.column(len(fields))[k].is_valid]
            found = dict(zip(marked, chunks([texts[k] for k in marked], reach), strict=True))
            for k, text in enumerate(texts):
                gone, n = [], 0
                if k in found:
                    digest, starts, words = found[k]
                    place = batch.column(len(fields))[k].values.to_numpy()
                    again = np.zeros(len(digest), bool)
                    again[place[place < len(digest)]] = True
                    edges = np.append(starts, len(text))
                    for a, b in _runs(again, words, run):
                        gone.append({"start": int(edges[a]), "end": int(edges[b])})
                        n += int(words[a:b].sum())
                at, parts = 0, []
                for g in gone:
                    parts.append(text[at : g["start"]])
                    at = g["end"]
                out.append(b"".join([*parts, text[at:]]).decode() if batch.column(text_at)[k].is_valid else None)
                removed.append(n)
                spans.append(gone)
            columns = list(batch.columns[: len(fields)])
            columns[text_at] = pa.array(out, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*(f.name for f in fields), *names])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return joined.mapInArrow(cut, T.StructType([*fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], span)]))
