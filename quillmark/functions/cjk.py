"""Word segmentation of Chinese runs: longest dictionary match, two-character words elsewhere."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = re.compile(r"[一-鿿]+")
# The search dictionary's domain words, which are never split.
WORDS = [
    "二甲双胍", "格华止", "阿司匹林", "氯吡格雷", "恩格列净", "利拉鲁肽", "他汀类", "ACEI", "ARB",
    "心血管疾病", "心力衰竭", "高血压", "糖尿病", "二型糖尿病", "心肌梗死", "冠心病", "心律失常", "房颤", "血脂异常", "免疫检查点", "肿瘤免疫", "靶向治疗",
    "免疫疗法", "免疫治疗", "联合用药", "二级预防", "联合治疗", "基因治疗", "细胞治疗",
    "ARNO", "ARF", "PLD", "磷脂酶", "鸟苷酸", "Sec7", "EGFR", "PD-1", "PD-L1", "CAR-T", "HER2", "BCR-ABL", "JAK", "GLP-1", "SGLT2", "TGFβ", "BMP",
]
_PART = re.compile(r"(?P<run>[一-鿿]+)|[A-Za-z0-9]+|.", re.S)


def segment(text: str | None, words: frozenset[str], longest: int) -> list[str]:
    out = []
    for run in _RUN.findall(text or ""):
        at, loose = 0, 0
        while at < len(run):
            size = next((k for k in range(min(longest, len(run) - at), 1, -1) if run[at : at + k] in words), 0)
            if size:
                out += _pairs(run[loose:at])
                out.append(run[at : at + size])
                at += size
                loose = at
            else:
                at += 1
        out += _pairs(run[loose:])
    return out


def _pairs(run: str) -> list[str]:
    """Words of two characters of a run the dictionary does not know; an odd last character is dropped like any single one."""
    return [run[i : i + 2] for i in range(0, len(run) - 1, 2)]


def count_segments(text: str | None, words: frozenset[str], longest: int) -> int:
    """Segments of a mixed text: dictionary words of any script, else two-character words of Chinese runs, runs of ASCII letters
    and digits, and every other character by itself."""
    n, at, text = 0, 0, text or ""
    while at < len(text):
        size = next((k for k in range(min(longest, len(text) - at), 1, -1) if text[at : at + k] in words), 0)
        if not size:
            m = _PART.match(text, at)
            size = min(2, m.end() - at) if m["run"] else m.end() - at
            # a dictionary word inside a Chinese run is not cut into
            if m["run"] and size == 2 and any(text[at + 1 : at + 1 + k] in words for k in range(2, longest + 1)):
                size = 1
        n, at = n + 1, at + size
    return n


def segment_len(lexicon: list[str] | None = None):
    """A pandas UDF: the number of segments, a length in the segmenter's tokens."""
    words = frozenset(WORDS if lexicon is None else lexicon)
    longest = max(map(len, words), default=0)

    @F.pandas_udf(T.IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_segments(t, words, longest)).astype("int32")

    return run


def cjk_words(lexicon: list[str] | None = None):
    """A pandas UDF: array of words of two and more characters."""
    words = frozenset(WORDS if lexicon is None else lexicon)
    longest = max(map(len, words), default=0)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: segment(t, words, longest))

    return run
