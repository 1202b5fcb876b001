"""Token-id output: bit-plane shuffled, zstandard-compressed id files with a chunk index.

File format ``.bpl`` (all integers little-endian)::

    b"BPL1"                        magic
    chunk*                         one zstd frame per plane, plane 0 first
    zstd(doc ids, null flags, token counts)   int64[n], uint8[n], int64[n]
    footer JSON                    {"block", "planes", "chunks": [[offset, n_ids, [plane sizes]]...], "docs": [offset, size, n]}
    uint32 footer size, b"BPL1"

A chunk holds ``block`` ids (the last one fewer).  Its ids are transposed into planes: plane *k* of ``planes="byte"``
holds byte *k* of every id, plane *k* of ``planes="bit"`` bit *k* of every id (packed).  High planes are nearly constant
and compress to a few bytes.  Documents may span chunks; a reader decodes only the chunks that it needs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.pieces import encoder
from quillmark.sources.scratch import materialise, new_path

MAGIC = b"BPL1"
BLOCK = 1 << 17


def _planes(ids: np.ndarray, kind: str) -> list[bytes]:
    if kind == "byte":
        return [x.tobytes() for x in np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T)]
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def _ids(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(x, np.uint8) for x in planes]).T).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in planes])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes one file; memory: one block of ids and three numbers a document."""

    def __init__(self, out, block: int = BLOCK, kind: str = "byte", level: int = 3):
        self.out, self.block, self.kind = out, block, kind
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.rest, self.docs, self.counts = 0, [], bytearray(), [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, size: int) -> None:
        planes = [self.zstd.compress(x) for x in _planes(np.frombuffer(bytes(self.rest[:size]), "<u4"), self.kind)]
        del self.rest[:size]
        self.chunks.append([self.at, size // 4, [len(x) for x in planes]])
        for x in planes:
            self._put(x)

    def add(self, doc_ids: list[int | None], counts: list[int], ids: bytes) -> None:
        """Documents in order, the number of ids of each, and all their ids."""
        self.docs += doc_ids
        self.counts += counts
        data = memoryview(ids)
        while data:
            room = 4 * self.block - len(self.rest)
            self.rest += data[:room]
            data = data[room:]
            if len(self.rest) == 4 * self.block:
                self._flush(4 * self.block)

    def close(self) -> None:
        if self.rest:
            self._flush(len(self.rest))
        known = np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs) + np.array(self.counts, "<i8").tobytes()
        index, at = self.zstd.compress(known), self.at
        self._put(index)
        footer = json.dumps({"block": self.block, "planes": self.kind, "chunks": self.chunks, "docs": [at, len(index), len(self.docs)]}).encode()
        self._put(footer + struct.pack("<I", len(footer)) + MAGIC)


class Reader:
    """Reads a seekable file: its documents in order, or the ids of any range."""

    def __init__(self, f, size: int):
        self.f, self.zstd = f, zstandard.ZstdDecompressor()
        tail = self._at(size - 8, 8)
        if tail[4:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a bit-plane id file")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self._at(size - 8 - n, n))
        at, length, docs = self.footer["docs"]
        index = self.zstd.decompress(self._at(at, length), max_output_size=17 * docs) if docs else b""
        flags = index[8 * docs : 9 * docs]
        self.doc_ids = [None if none else int(d) for d, none in zip(np.frombuffer(index[: 8 * docs], "<i8"), flags, strict=True)]
        self.counts = np.frombuffer(index[9 * docs :], "<i8")

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.footer["chunks"][k]
        kind, data, planes = self.footer["planes"], self._at(at, sum(sizes)), []
        most = n if kind == "byte" else (n + 7) // 8
        for size in sizes:
            planes.append(self.zstd.decompress(data[:size], max_output_size=most))
            data = data[size:]
        return _ids(planes, n, kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        k, have = 0, np.empty(0, "<u4")
        for doc, n in zip(self.doc_ids, self.counts, strict=True):
            parts, need = [], int(n)
            while need > len(have):
                parts.append(have)
                need -= len(have)
                have, k = self.chunk(k), k + 1
            parts.append(have[:need])
            have = have[need:]
            yield doc, np.concatenate(parts)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, block: int = BLOCK, planes: str = "byte") -> DataFrame:
    """Encode ``text`` of all ``docs(doc_id, text)``, append ``end_id`` to each and write id files in ascending doc_id order.

    Returns the manifest: ``file_no, path, n_docs, n_tokens`` (one row a file; file order is doc_id order).  The texts are
    range-partitioned by doc_id, one file a partition; a task that runs again writes a file of another name, and only
    the files of tasks that succeeded are in the manifest.  A null text is empty; a null doc_id sorts first; equal doc_ids
    are ordered by text, so reruns agree; an empty table gives an empty manifest; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "ids")

    def write(batches):
        from pyarrow import fs

        out, total, writer, enc = None, [0, 0], None, encoder(tokenizer)
        for batch in batches:
            if writer is None:
                store, top = fs.FileSystem.from_uri(folder)
                store.create_dir(top, recursive=True)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bpl"
                out = store.open_output_stream(f"{top}/{name}")
                writer = Writer(out, block, planes)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, counts = enc.encode_many(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4", copy=False)
                writer.add(part.column(0).to_pylist(), (counts + 1).tolist(), ids.tobytes())
                total = [total[0] + part.num_rows, total[1] + len(ids)]
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([total[0]], pa.int64()), "n_tokens": pa.array([total[1]], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(write, "file_no int, path string, n_docs long, n_tokens long"), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read id files back: ``doc_id, start, n_tokens, ids_crc32`` of every document, from the stored bytes.

    ``start`` is the number of ids of all documents before it (a running sum over the manifest, one row a file).
    """

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _opened(path)
                rows = []
                with store.open_input_file(name) as f:
                    for doc, ids in Reader(f, f.size()).documents():
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    spread = files.repartition(max(2 * manifest.sparkSession.sparkContext.defaultParallelism, 1), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
