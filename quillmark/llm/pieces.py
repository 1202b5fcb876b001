"""Exact, cached encoding with the ``tokenizers`` library.

A text is cut where the tokenizer's own pre-tokenizer always cuts (between a visible character and the white space that
follows it), every distinct piece is encoded once by the library's model, and the ids of the pieces are joined.  Texts
with white space other than blank, tab, CR and LF, and pieces that hold a special token's text, go to the library whole.

``encode_many`` does so for the texts of a batch at once, with the pre-tokenizer's words as pieces: Arrow numbers the
distinct ones, those not met before go to the library's model, and the ids are put together by the words' numbers.  It
takes texts of Latin-1 characters that way; others are encoded one by one as above.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of one cache of a Python worker; a full cache starts anew, so memory stays bounded.
CACHE = 700_000
#: Characters of the texts that are encoded at once.
SLICE = 1 << 22

_RUN = re.compile(r"[ \t\r\n][ \t\r\n]")
_ODD = re.compile(r"[^\S \t\r\n]")
_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: For Arrow: a character beyond Latin-1, or its white space other than blank, tab, CR and LF.
_BEYOND = "[^\\x{00}-\\x{FF}]|[\\x{0B}\\x{0C}\\x{1C}-\\x{1F}\\x{85}\\x{A0}]"
# The two pre-tokenizers' published split patterns.
_BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Classes of the characters of Latin-1 by UTF-8 lead byte (ASCII: 0) and last byte: blank, other white space, letter, number, other.
_BLANK, _WHITE, _LETTER, _NUMBER, _OTHER = range(5)
_SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _class(c: str) -> int:
    if c in " \t\r\n":
        return _BLANK if c == " " else _WHITE
    return _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER


_ASCII = np.array([_class(chr(b)) if b < 128 else _OTHER for b in range(256)], np.uint8)
_PAIRS = np.array([[_class(chr((lead & 1) << 6 | 0x80 | b & 0x3F)) for b in range(256)] for lead in (0xC2, 0xC3)], np.uint8)


def word_starts(raw: np.ndarray, edges: np.ndarray, spaced: bool) -> np.ndarray:
    """Where the pre-tokenizer's words start in the UTF-8 bytes of Latin-1 texts that end at ``edges`` (the same cuts as the split
    patterns).  ``spaced``: a blank belongs to the word behind it; else numbers are cut one by one, and runs of white space,
    which are no words, start at their first character too."""
    n = len(raw)
    kind = _ASCII[raw]
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
    kind[lead] = kind[lead + 1] = _PAIRS[raw[lead] & 1, raw[lead + 1]]
    head = np.zeros(n + 1, bool)  # first bytes of texts
    head[0] = True
    head[edges] = True
    white = kind <= _WHITE
    other = np.ones(n, bool)  # unlike the character before, white space being all alike
    other[1:] = (kind[1:] != kind[:-1]) & ~(white[1:] & white[:-1])
    start = other | head[:n]
    if spaced:
        # the last white space before a visible character starts a word, and that character does not if it is a blank
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~head[1:n])
        start[last] = True
        start[last[kind[last] == _BLANK] + 1] = False
    else:
        start |= kind == _NUMBER
        start[lead + 1] = False
    # 's and the like: behind an apostrophe that starts a word, the letters of the suffix go with it
    quote = np.flatnonzero(start & (raw == 39))
    for suffix in _SUFFIXES:
        fits = quote[quote + len(suffix) < n]
        for i, b in enumerate(suffix):
            fits = fits[(raw[fits + 1 + i] == b) & ~head[fits + 1 + i]]
        start[fits + 1] = False
        after = fits + 1 + len(suffix)
        start[after[after < n]] = True
    return np.flatnonzero(start)


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's printable stand-in of every byte: itself if visible, else the next free code from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self._make(key)
        if len(self) >= CACHE:
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._marks = re.compile("|".join(re.escape(s) for s in self._special)) if self._special else None
        pre, steps = spec.get("pre_tokenizer") or {}, (spec.get("normalizer") or {}).get("normalizers", [])
        plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("post_processor", None)
        spaced = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        lowered = plain and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        self._model = self.tokenizer.model
        self._letters = _byte_letters()
        self._token = _Memo(self._of_token)
        self._bare = _Memo(self._of_lowered if lowered else self._of_piece)
        self._after_blank = _Memo(lambda word: self._of_piece(" " + word))
        self.encode = self._spaced if spaced else self._lowered if lowered else self.whole
        self._plain, self._keeps_blanks = spaced or lowered, spaced
        self._numbers: dict[str, int] = {}  # of words, and their ids one after the other
        self._ids, self._lengths = np.empty(0, "<u4"), np.empty(0, np.int64)

    def whole(self, text: str) -> bytes:
        """The library's own encoding of the whole text."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of_token(self, token: str) -> bytes:
        if token.isascii() and token.isalpha():
            letters = token  # these bytes stand for themselves
        elif token.isascii() and token[0] == " " and token[1:].isalpha():
            letters = "\u0120" + token[1:]
        else:
            letters = token.encode().decode("latin-1").translate(self._letters)
        ids = [t.id for t in self._model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of_piece(self, piece: str) -> bytes:
        if not piece.isascii() or self._marks and self._marks.search(piece):
            if max(piece) > "\xff" or self._marks and self._marks.search(piece):
                return self.whole(piece)
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
            return self._of_token(piece)  # kept as a piece already
        return b"".join(map(self._token.__getitem__, _BYTE_SPLIT.findall(piece)))

    def _of_lowered(self, piece: str) -> bytes:
        if max(piece, default="") > "\xff" or self._marks and self._marks.search(piece):
            return self.whole(piece)
        if piece.isalpha():
            return self._of_token(piece.lower())
        return b"".join(map(self._token.__getitem__, _WORD_SPLIT.findall(piece.lower())))

    def _spaced(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self.whole(text)
        if not _RUN.search(text):
            first, *rest = text.split(" ")
            return (self._bare[first] if first else b"") + b"".join(map(self._after_blank.__getitem__, rest))
        bare, after = self._bare, self._after_blank
        return b"".join(after[p[1:]] if p[0] == " " and p[1:2] not in {" ", "\t", "\r", "\n"} else bare[p] for p in _PIECE.findall(text))

    def _lowered(self, text: str) -> bytes:
        return self.whole(text) if _ODD.search(text) else b"".join(map(self._bare.__getitem__, text.split()))


    def _numbered(self, words: list[str]) -> np.ndarray:
        """The numbers of words; the ids of new ones are added to ``_ids``."""
        known = self._numbers
        numbers = [known.get(w, -1) for w in words]
        new = [w for w, k in zip(words, numbers, strict=True) if k < 0]
        if len(known) + len(new) > CACHE:  # starts anew
            known.clear()
            self._ids, self._lengths, new = self._ids[:0], self._lengths[:0], words
        if new:
            # each word's bytes as the printable letters that stand for them
            letters = "\ue000".join(w if w.isascii() else w.encode().decode("latin-1") for w in new).translate(self._letters).split("\ue000")
            ids, lengths, tokenize = [], [], self._model.tokenize
            for word, given in zip(letters, new, strict=True):
                own = [t.id for t in tokenize(word)] if self._keeps_blanks or not given.isspace() else []
                ids += own
                lengths.append(len(own))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._ids = np.concatenate([self._ids, np.array(ids, "<u4")])
            self._lengths = np.concatenate([self._lengths, np.array(lengths, np.int64)])
            numbers = list(map(known.__getitem__, words))
        return np.array(numbers, np.int64)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order (null: empty) as one array, and how many each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        upto, parts, at = np.cumsum(pc.utf8_length(texts).to_numpy()), [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            parts.append(self._slice(texts.slice(at, stop - at)))
            at = stop
        if not parts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = np.zeros(len(texts), bool)
        if self._plain:
            odd = pc.match_substring_regex(texts, _BEYOND)
            for special in self._special:
                odd = pc.or_(odd, pc.match_substring(texts, special))
            plain = ~odd.to_numpy(zero_copy_only=False)
        own = texts.filter(pa.array(plain))
        own = own if self._keeps_blanks else pc.utf8_lower(own)
        edges = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1] if len(own) else np.zeros(1, np.int64)
        raw = np.frombuffer(own.buffers()[2], np.uint8)[: edges[-1]] if edges[-1] else np.empty(0, np.uint8)
        starts = word_starts(raw, edges, self._keeps_blanks) if len(raw) else np.empty(0, np.int64)
        cut = np.append(starts, len(raw))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(raw))
        coded = pc.dictionary_encode(words)
        number = self._numbered(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, n = joined_ids(self._ids, self._lengths, number)
        upto = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(upto[np.searchsorted(starts, edges)])
        if plain.all():
            return ids, counts
        rest = [np.frombuffer(self.encode(t), "<u4") for t in texts.filter(pa.array(~plain)).to_pylist()]
        both = np.empty(len(texts), np.int64)
        both[plain], both[~plain] = counts, [len(r) for r in rest]
        out, from_words = np.empty(both.sum(), "<u4"), np.repeat(plain, both)
        out[from_words], out[~from_words] = ids, np.concatenate(rest)
        return out, both


def joined_ids(ids: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of numbered parts (``ids`` has those of all parts in order, ``lengths`` how many each has) one after the other, and
    how many each of ``number`` has."""
    first, n = np.cumsum(lengths) - lengths, lengths[number]
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    return ids[np.repeat(first[number] - (upto - n), n) + np.arange(total)], n


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and tokenizer file."""
    return PieceEncoder(path)
