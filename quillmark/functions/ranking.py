"""Column functions of the ranking criteria and the interpretation of questions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import _c, present

# Journal names, the first rule that matches gives the weight.
JOURNAL_WEIGHTS = [
    (["new england journal of medicine", "n engl j med", "nejm"], 5.0),
    (["journal of the american medical association", "jama"], 5.0),
    (["nature communications"], 4.0),
    (["nature medicine", "nat med"], 5.0),
    (["nature genetics", "nature immunology", "nature cell biology", "nature biotechnology", "nature methods"], 4.5),
    (["nature"], 5.0),
    (["lancet"], 5.0),
    (["science"], 5.0),
    (["cell reports", "cell reports medicine"], 4.0),
    (["cell"], 5.0),
    (["british medical journal", "bmj"], 4.5),
    (["circulation"], 4.5),
    (["j clin oncol", "jco"], 4.5),
    (["j natl cancer inst", "jnci"], 4.5),
    (["annals of oncology", "ann oncol"], 4.0),
    (["european heart journal", "european heart"], 4.0),
    (["plos medicine", "plos med"], 3.5),
]
LEGACY_AUTHORITY = {"nature": 10.0, "science": 10.0, "cell": 9.0, "nejm": 9.5, "lancet": 9.0, "jama": 8.5, "plos biology": 6.0, "plos medicine": 6.0, "bmc": 3.0}
DEFAULT_AUTHORITY, LEGACY_DEFAULT = 1.0, 4.0
# What the questions' time and journal phrases are recognised by, in order of precedence.
YEAR_RULES = [
    (r"\b(?:recent(?:ly)?|latest|new(?:est)?|current|modern|past\s+5\s+years?|last\s+5\s+years?|in\s+the\s+past\s+5\s+years?)\b", -5),
    (r"\b(?:past\s+3\s+years?|last\s+3\s+years?|latest\s+3\s+years?)\b", -3),
    (r"\b(?:past\s+10\s+years?|last\s+10\s+years?|past\s+decade|recent\s+decade|over\s+the\s+past\s+decade)\b", -10),
    (r"\b(?:since\s+2020|from\s+2020|after\s+2020|post-2020|in\s+2020s?|2020|2021|2022|2023|2024|2025)\b", 2020),
    (r"\b(?:since\s+2010|from\s+2010|after\s+2010|post-2010)\b", 2010),
    (r"\b(?:since\s+2015|from\s+2015|after\s+2015|post-2015)\b", 2015),
    (r"\b(?:since\s+2000|from\s+2000|after\s+2000|post-2000)\b", 2000),
    (r"\b(?:in\s+(?:19|20)\d{2}|during\s+(?:19|20)\d{2})\b", None),
    (r"近三年|近五年|过去三年|过去五年|近年来|最近|最新|过去一年|近一年", -5),
    (r"年以来|年至今|年之后|年以后", 2020),
]
JOURNAL_RULES = [
    ("nature", r"\bnature(?:\s+(?:medicine|biotechnology|genetics|immunology|cell\s+biology|methods|communications?))?\b"),
    ("science", r"\b(?:science|sci(?:ence)?\s*magazine)\b"),
    ("nejm", r"\b(?:nejm|new\s+england\s+journal\s+of\s+medicine)\b"),
    ("lancet", r"\blancet\b"),
    ("jama", r"\b(?:jama|journal\s+of\s+the\s+american\s+medical\s+association)\b"),
    ("cell", r"(?<![a-zA-Z-])cell(?=\s+(?:published|reports|journal|issued\s+\d|is\s+a|is\s+one|$|[\.,;:]|2020))"),
    ("plos", r"\bplos(?:\s+(?:biology|medicine|one|genetics|computational\s+biology|pathogens))?\b"),
    ("bmc", r"\bbmc(?:\s+\w+)?\b"),
    ("中华医学杂志_cn", r"中华医学杂志|中华内科杂志|中华外科杂志|中国实用内科|中国实用外科"),
]


def recency(year: Column | str, current_year: int, preset: str = "current") -> Column:
    """Linear over ten years from ``current_year``; 0.5 where the year is no number.  ``current`` has floor 0 and no upper
    bound; ``legacy`` is held between 0.1 and 1."""
    known = F.try_to_number(F.when(_c(year).cast("string").rlike(r"^\s*-?\d{1,9}\s*$"), F.trim(_c(year).cast("string"))), F.lit("S999999999")).cast("int")
    if preset == "legacy":
        value = F.greatest(F.lit(0.1), 1.0 - F.greatest(F.lit(0), F.lit(current_year) - known) * 0.1)
    else:
        value = F.greatest(F.lit(0.0), 1.0 - (F.lit(current_year) - known) / 10.0)
    return F.when(known.isNull(), F.lit(0.5)).otherwise(value)


def authority(journal: Column | str, rules=None, preset: str = "current") -> Column:
    """The weight of the first rule that matches the journal's name; names of up to five letters must stand alone."""
    name = F.lower(present(journal))
    if preset == "legacy":
        out = F.lit(LEGACY_DEFAULT / 10)
        for key, weight in reversed(list((rules or LEGACY_AUTHORITY).items())):
            out = F.when(F.contains(name, F.lit(key)), F.lit(weight / 10)).otherwise(out)
        return out
    out = F.lit(DEFAULT_AUTHORITY)
    for names, weight in reversed(rules or JOURNAL_WEIGHTS):
        hit = F.lit(False)
        for key in names:
            hit = hit | (name.rlike(rf"\b{re.escape(key)}\b") if len(key) <= 5 else F.contains(name, F.lit(key)))
        out = F.when(hit, F.lit(weight)).otherwise(out)
    return out


def year_gte(query: Column | str, current_year: int) -> Column:
    """The least year a question asks for (a string, as years are compared as strings); null if it names none.

    The first rule of the list wins.  A single year before 2000 is not understood and gives the current year.
    """
    text = present(query)
    out = F.lit(None).cast("string")
    for pattern, value in reversed(YEAR_RULES):
        if value is None:
            named = F.regexp_extract(text, r"(20\d{2})", 1)
            year = F.when(named != "", named).otherwise(F.lit(str(current_year)))
        else:
            year = F.lit(str(current_year + value if value < 0 else value))
        out = F.when(text.rlike(f"(?i){pattern}"), year).otherwise(out)
    return out


def journal_keyword(query: Column | str) -> Column:
    """The first journal that a question names; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(JOURNAL_RULES):
        out = F.when(present(query).rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def year_predicate(year: Column | str, spec: dict) -> Column:
    """``$gte``, ``$lte``, ``$in`` on years as strings; rows without a year never pass."""
    value = present(_c(year).cast("string"))
    ok = value != ""
    for op, bound in spec.items():
        if op == "$gte":
            ok = ok & (value >= str(bound))
        elif op == "$lte":
            ok = ok & (value <= str(bound))
        elif op == "$in":
            ok = ok & value.isin([str(b) for b in bound])
        else:
            raise ValueError(f"unknown year operator {op}")
    return ok


def journal_predicate(journal: Column | str, spec: dict) -> Column:
    """``$in`` (any) and ``$eq``: both ask whether the name contains the keyword, whatever the case."""
    name = F.lower(present(journal))
    ok = F.lit(True)
    for op, words in spec.items():
        if op not in ("$in", "$eq"):
            raise ValueError(f"unknown journal operator {op}")
        hit = F.lit(False)
        for word in words if op == "$in" else [words]:
            hit = hit | F.contains(name, F.lit(word.lower()))
        ok = ok & hit
    return ok


def where(filter_: dict) -> Column:
    """A nested metadata filter as a predicate: ``$eq $ne $in $nin $gt $gte $lt $lte $and $or``; a bare value is ``$eq``.
    A dict must hold one operator or one field; others are errors."""
    if len(filter_) != 1:
        raise ValueError(f"a filter has one operator or field, not {sorted(filter_)}")
    (key, value), = filter_.items()
    if key in ("$and", "$or"):
        parts = [where(f) for f in value]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if key == "$and" else out | p
        return out
    if not isinstance(value, dict):
        return F.col(key) == F.lit(value)
    if len(value) != 1:
        raise ValueError(f"a field has one operator, not {sorted(value)}")
    (op, bound), = value.items()
    c = F.col(key)
    table = {"$eq": lambda: c == bound, "$ne": lambda: c != bound, "$in": lambda: c.isin(list(bound)), "$nin": lambda: ~c.isin(list(bound)), "$gt": lambda: c > bound, "$gte": lambda: c >= bound, "$lt": lambda: c < bound, "$lte": lambda: c <= bound}
    if op not in table:
        raise ValueError(f"unknown operator {op}")
    return table[op]()
