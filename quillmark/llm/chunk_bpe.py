"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash over the last bytes says so, always at the end of a word, so a passage is cut
alike in whatever document it stands.  Arrow numbers the distinct chunks of a batch of documents, each of them is encoded
once (``PieceEncoder.encode_many``, whose words are kept over all batches of a Python worker), and the documents' ids are put
together by the chunks' numbers.  Joins are then repaired: a join where white space parts the chunks is exact by the
tokenizer's own pre-tokenizer; around any other join (inside a run without white space that is longer than ``LONGEST``)
the window that is encoded anew is widened, chunk by chunk, until both of its edges are exact joins.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.pieces import encoder, joined_ids
from quillmark.llm.rolling import gear16

#: A word's end is a cut if its 16-bit gear hash is below this: one in ten.
CUT = 65536 // 10
#: Characters after which a run without white space is cut all the same.
LONGEST = 1 << 16
#: Bytes of texts whose chunks are numbered together.
SLICE = 1 << 23


def _cuts(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks start in the UTF-8 bytes of texts that end at ``edges``: at the texts' starts, and before white space."""
    blank = (raw == 32) | (raw == 9) | (raw == 10) | (raw == 13)
    ends = np.flatnonzero(blank[1:] & ~blank[:-1])
    cuts = ends[gear16(raw)[ends] < CUT] + 1
    return np.unique(np.concatenate([cuts, edges[:-1][edges[:-1] < len(raw)]]))


def chunk_ends(text: str) -> list[int]:
    """Content-defined cut positions (in characters) of ``text``, its end included; each lies before white space or, in
    a run of over ``LONGEST`` visible characters, inside it.  The same passage is cut alike wherever it stands."""
    n = len(text)
    if text.isascii():
        raw = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        # low bytes of the code points: positions stay characters
        raw = (np.frombuffer(text.encode("utf-32-le"), "<u4") & 0xFF).astype(np.uint8)
        wide = np.frombuffer(text.encode("utf-32-le"), "<u4") > 0x7F
    blank = (raw == 32) | (raw == 9) | (raw == 10) | (raw == 13)
    if not text.isascii():
        blank &= ~wide
    ends = np.flatnonzero(blank[1:] & ~blank[:-1])
    cuts = ends[gear16(raw)[ends] < CUT] + 1
    edges = np.concatenate([[0], cuts, [n]])
    if n > LONGEST and np.diff(edges).max() > LONGEST:
        stops = np.concatenate([[0], ends + 1, [n]])
        runs = np.flatnonzero(np.diff(stops) > LONGEST)
        forced = [p for k in runs for p in range(int(stops[k]) + LONGEST, int(stops[k + 1]), LONGEST)]
        edges = np.unique(np.concatenate([edges, np.array(forced, edges.dtype)]))
    return edges[1:].tolist()


class ChunkEncoder:
    """``encode_many(texts)``: the ids of whole texts, equal to the library's, and how many each text has."""

    def __init__(self, path: str):
        self.pieces = encoder(path)
        self.reused = self.made = self.repaired = 0

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nulls are empty texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        upto, parts, at = np.cumsum(pc.binary_length(texts).to_numpy()), [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            parts.append(self._slice(texts.slice(at, stop - at)))
            at = stop
        if not parts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.concat_arrays([texts])  # its own buffers, from 0 on
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.empty(0, np.uint8)
        edges = edges - edges[0]
        starts = _cuts(raw, edges) if len(raw) else np.empty(0, np.int64)
        cut = np.append(starts, len(raw))
        first = np.searchsorted(starts, edges)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pc.dictionary_encode(chunks)
        self.reused += len(chunks) - len(coded.dictionary)
        self.made += len(coded.dictionary)
        long = np.unique(np.searchsorted(edges, starts[np.diff(cut) > LONGEST], "right") - 1)
        known, n_known = self.pieces.encode_many(coded.dictionary)
        ids, n = joined_ids(known, n_known, coded.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(n)])
        if not len(long):
            return ids, np.diff(upto[first])
        # texts with runs of over LONGEST characters, one by one
        each = np.split(ids, upto[first[1:-1]])
        for k in long.tolist():
            each[k] = np.frombuffer(self.encode(texts[k].as_py()), "<u4")
        return np.concatenate(each), np.array([len(e) for e in each])

    def encode(self, text: str) -> bytes:
        """One text's ids as bytes, its joins repaired."""
        out, start, open_at = [], 0, -1
        for end in chunk_ends(text) if text else []:
            if end < len(text) and text[end] not in " \t\r\n":
                # an open join: what follows can change the ids on both sides, so the window goes on
                open_at = start if open_at < 0 else open_at
            elif open_at >= 0:
                self.repaired += 1
                out.append(self.pieces.whole(text[open_at:end]))
                open_at = -1
            else:
                out.append(self.pieces.encode(text[start:end]))
            start = end
        return b"".join(out)


@lru_cache(maxsize=4)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


@lru_cache(maxsize=4)
def _spellings(path: str) -> tuple[list[bytes], bool]:
    """For decoding: the token of each id as the library renders it, and whether texts are these tokens joined by blanks."""
    tokenizer = encoder(path).tokenizer
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return [(tokenizer.id_to_token(i) or "").encode() for i in range(size)], tokenizer.decoder is None


def decode_ids(path: str, ids: bytes) -> str:
    """The library's ``decode(ids, skip_special_tokens=False)``.  Without a decoder it joins the tokens with blanks."""
    words, joined = _spellings(path)
    row = np.frombuffer(ids, "<u4")
    if joined:
        return b" ".join(map(words.__getitem__, row.tolist())).decode()
    return encoder(path).tokenizer.decode(row.tolist(), skip_special_tokens=False)


def bpe_round_trip(docs: DataFrame, tokenizer: str, texts: bool = False) -> DataFrame:
    """Encode and decode every whole ``text``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (with ``texts``: also
    ``ids array<int>`` and ``decoded``).  One row per input row, duplicates included; a null text is empty (no ids, empty
    text); other columns are ignored.  Map-only: no shuffle; chunks are shared by the
    documents of a batch, their words by all batches of a worker (bounded)."""

    def run(batches):
        enc = chunk_encoder(tokenizer)
        for batch in batches:
            docs_, hashes, decoded, more = batch.column(0), [], [], []
            every, counts = enc.encode_many(batch.column(1))
            upto = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for a, b in itertools.pairwise(upto):
                ids = every[a:b].tobytes()
                back = decode_ids(tokenizer, ids)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if texts:
                    more.append((np.frombuffer(ids, "<u4").astype(np.int32), back))
            cols = {"doc_id": docs_, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if texts:
                cols |= {"ids": pa.array([m[0] for m in more], pa.list_(pa.int32())), "decoded": pa.array([m[1] for m in more], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
