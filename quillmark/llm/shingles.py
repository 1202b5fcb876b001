"""Word and five-word shingle hashes of texts (numpy, whole texts, bounded working memory)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quillmark.llm.rolling import GEAR, _mix

WORDS = 5
#: Bytes that are hashed at once; longer texts go in pieces that end at white space.
PIECE = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(4096)
_FAR = _powers(4096) ** np.uint64(4096)
_PLACE = _mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def word_hashes(raw: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end (byte offsets) of every word ``[^\\x20\\x09-\\x0D]+``; A-Z fold to a-z if ``lower``."""
    ink = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    hashes = []
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        s, e = starts[at:stop], ends[at:stop]
        lo, hi = s[0], e[-1]
        part = raw[lo:hi][ink[lo:hi]]
        lengths = e - s
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(part)) - np.repeat(first, lengths)
        value = GEAR[_LOWER[part] if lower else part]
        if lengths.max() > 4096:
            value = value * _FAR[(place >> 12) & 4095]
            place &= 4095
        hashes.append(_mix(np.add.reduceat(value * _POWER[place], first) + lengths.astype(np.uint64)))
        at = stop
    return np.concatenate(hashes), starts, ends


def grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order.

    A text of one to four words has its whole word sequence as the one shingle; a text without words has none.
    """
    for lo, hi in grouped(texts):
        part = texts[lo:hi]
        sizes = np.array([len(t) + 1 for t in part])
        hashes, starts, _ = word_hashes(np.frombuffer(b" ".join(part), np.uint8))
        bound = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        n = len(hashes) - WORDS + 1
        rolled = np.zeros(0, np.uint64)
        if n > 0:
            rolled = hashes[:n] * _PLACE[0]
            for k in range(1, WORDS):
                rolled = rolled + hashes[k : n + k] * _PLACE[k]
            rolled = _mix(rolled)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                yield _mix((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null: empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
