"""Column functions over texts: tokens, lengths, cleaning, keys and lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_TOKEN = r"[a-z0-9][a-z0-9\-]+"
SET_TOKEN = r"[一-鿿]{2}|[A-Za-z]+|\d+"
CJK = r"[一-鿿]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """Null as the empty string: a missing field and an empty one are the same."""
    return F.coalesce(_c(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """The empty string as null."""
    return F.nullif(_c(c), F.lit(""))


def ascii_tokens(c: Column | str) -> Column:
    """Lower-case tokens of two and more of a-z, 0-9 and inner hyphens, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(present(c)), F.lit(ASCII_TOKEN), F.lit(0))


def tokens(c: Column | str, lexicon: list[str] | None = None) -> Column:
    """Search tokens: the ASCII ones, then the words of Chinese runs if a lexicon is given (an Arrow UDF)."""
    if lexicon is None:
        return ascii_tokens(c)
    from quillmark.functions.cjk import cjk_words

    return F.concat(ascii_tokens(c), cjk_words(lexicon)(present(c)))


def token_set(c: Column | str) -> Column:
    """Distinct tokens for set similarity (case-sensitive)."""
    return F.array_distinct(F.regexp_extract_all(present(c), F.lit(SET_TOKEN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_len(c: Column | str, kind: str = "mixed") -> Column:
    """Estimated tokens.  ``mixed``: Chinese characters one each, others four a token (one at least; empty: 0); ``chars``:
    characters by 1.5."""
    text = present(c)
    if kind == "chars":
        return F.floor(F.length(text) / 1.5).cast("int")
    if kind != "mixed":
        raise ValueError(f"unknown kind of length: {kind}")
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.when(F.length(text) == 0, 0).otherwise(cjk + F.greatest(F.lit(1), F.floor((F.length(text) - cjk) / 4))).cast("int")


def clean_text(c: Column | str) -> Column:
    """U+FFFD and NUL removed, any white space (also the non-breaking kind) as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(present(c), "�\0", ""), r"(?U)\s+", " "))


def clean_query(c: Column | str) -> Column:
    """Low and reversed quotes as plain ones, white space collapsed, trimmed; closing punctuation stays."""
    return F.trim(F.regexp_replace(F.translate(present(c), "„‚‘", "\"''"), r"(?U)\s+", " "))


def is_blank(c: Column | str) -> Column:
    return F.regexp_replace(present(c), r"(?U)\s+", "") == ""


def full_text(title: str, abstract: str, body: str) -> Column:
    """Title, abstract and (if there is one) body, parted by blank lines."""
    return F.concat_ws("\n\n", present(title), present(abstract), filled(body))


def doc_key(pmid: str, source: str, doc_id: str, doc_ord: str) -> Column:
    """What hits of the paths are matched by: the first of pmid, source, doc_id that is there, else the row's ordinal."""
    named = F.coalesce(*[filled(F.col(c).cast("string")) for c in (pmid, source, doc_id)])
    return F.when(named.isNotNull(), F.concat(F.lit("pmid:"), named)).otherwise(F.concat(F.lit("id:"), F.col(doc_ord).cast("string")))


def source_url(pmid: str) -> Column:
    return F.when(filled(pmid).isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col(pmid), F.lit("/")))


def extract_json(c: Column | str) -> Column:
    """Lenient JSON to VARIANT: the fenced or outermost braces; smart quotes, trailing commas and Python literals mended;
    single quotes as double ones if nothing else parses; null if nothing does."""
    text = present(c)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    body = F.translate(body, "“”‘’", "\"\"''")
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    for name, value in (("None", "null"), ("True", "true"), ("False", "false")):
        body = F.regexp_replace(body, rf"\b{name}\b", value)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    return F.coalesce(parsed, F.try_parse_json(F.nullif(F.replace(body, F.lit("'"), F.lit('"')), F.lit(""))))


# Sentence ends in order of preference.
SENTENCE_ENDS = ["。", "？", "！", ";\n", "!\n", "?\n", ".\n", ". ", "! ", "? "]


def truncate_at_sentence(c: Column | str, target: int) -> Column:
    """Cut to ``target`` characters, after the last of the first kind of sentence end that stands in the last tenth; without
    one a hard cut, right-trimmed."""
    text, window = present(c), max(1, target // 10)
    start = target - window
    region = F.substring(text, start + 1, window)
    out = F.regexp_replace(F.substring(text, 1, target), r"(?U)[\s\x1c-\x1f]+\z", "")
    for mark in reversed(SENTENCE_ENDS):
        # position of the last occurrence, counted from the end of the reversed region
        back = F.instr(F.reverse(region), F.reverse(F.lit(mark)))
        out = F.when(back > 0, F.substring(text, F.lit(1), F.lit(start + window + 1) - back)).otherwise(out)
    return F.when(F.length(text) <= target, text).otherwise(out)


def hex_key(*parts: Column) -> Column:
    """SHA-256 of labelled lines, the key of cached generations."""
    return F.sha2(F.concat_ws("\n", *parts), 256)
