from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import ranking, text
from quillmark.functions.cjk import segment
from quillmark.operators.chunking import mixed_len, split_text
from quillmark.operators.enhance import expand
from quillmark.operators.lexicon import SYNONYMS


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("t", "want"), [("PD-1 therapy of X", ["pd-1", "therapy", "of"]), ("Étion", ["tion"]), ("I a X", []), ("", []), (None, [])])
def test_tokens(spark, t, want):
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(text.ascii_tokens("t").alias("r")).first()["r"] == want


@pytest.mark.parametrize(("t", "mixed", "chars"), [("abc", 1, 2), ("x" * 200, 50, 133), ("metformin " * 100, 250, 666), ("糖" * 200, 201, 133), ("", 0, 0)])
def test_lengths(spark, t, mixed, chars):
    assert one(spark, text.token_len("t"), t=t) == mixed == mixed_len(t)
    assert one(spark, text.token_len("t", "chars"), t=t) == chars


def test_cleaning(spark):
    assert one(spark, text.clean_text("t"), t=" a  \n b�\0c ") == "a bc"
    assert one(spark, text.clean_query("t"), t="  „a‚  b‘ “c” ?") == "\"a' b' “c” ?"


def test_jaccard(spark):
    sets = [F.array(*[F.lit(x) for x in w]) for w in ("abc", "bcd")]
    assert one(spark, text.jaccard(*sets), t="") == 0.5
    assert one(spark, text.jaccard(sets[0], F.array().cast("array<string>")), t="") == 0


@pytest.mark.parametrize(("year", "now", "old"), [("2026", 1.0, 1.0), ("2021", 0.5, 0.5), ("2016", 0, 0.1), ("1990", 0, 0.1), ("", 0.5, 0.5), ("abc", 0.5, 0.5), ("2028", 1.2, 1.0), ("1970", 0, 0.1)])
def test_recency(spark, year, now, old):
    assert one(spark, ranking.recency("y", 2026), y=year) == pytest.approx(now)
    assert one(spark, ranking.recency("y", 2026, "legacy"), y=year) == pytest.approx(old)


@pytest.mark.parametrize(("name", "weight"), [("New England Journal of Medicine", 5), ("Nature Communications", 4), ("Cell Reports", 4), ("Cell", 5), ("Cellular Notes", 1), ("", 1), (None, 1)])
def test_authority(spark, name, weight):
    df = spark.createDataFrame([(name,)], "j string")
    assert df.select(ranking.authority("j").alias("r")).first()["r"] == weight


@pytest.mark.parametrize(("q", "want"), [("Recent 5 years", "2021"), ("since 2020", "2020"), ("in 2019", "2019"), ("latest 3 years", "2021"), ("in 1998", "2026"), ("none", None), ("past decade", "2016")])
def test_year_filter(spark, q, want):
    assert one(spark, ranking.year_gte("q", 2026), q=q) == want


def test_where_rejects_two_operators():
    with pytest.raises(ValueError):
        ranking.where({"a": {"$gt": 1, "$lt": 2}})
    with pytest.raises(ValueError):
        ranking.where({"a": {"$contains": "x"}})
    with pytest.raises(ValueError):
        ranking.where({"a": 1, "b": 2})


@pytest.mark.parametrize(
    ("t", "want"),
    [('```json\n{"a": 1,}\n```', 1), ('noise {"a": 2} tail', 2), ("{'a': 3}", 3), ('{"a": 4, "b": None}', 4), ("no json", None), ("", None)],
)
def test_extract_json(spark, t, want):
    assert one(spark, F.try_variant_get(text.extract_json("t"), "$.a", "int"), t=t) == want


def test_truncate(spark):
    assert one(spark, text.truncate_at_sentence("t", 100), t="A" * 95 + ". " + "B" * 100) == "A" * 95 + ". "
    assert one(spark, text.truncate_at_sentence("t", 100), t="A" * 200) == "A" * 100
    assert one(spark, text.truncate_at_sentence("t", 100), t="short") == "short"


def test_longest_synonym_first():
    assert expand("pd-1 blockade", SYNONYMS) == SYNONYMS["pd-1"]
    assert expand("pd and pd-1", SYNONYMS) == SYNONYMS["pd-1"] + SYNONYMS["pd"]
    assert expand("二型糖尿病", SYNONYMS)[:1] == ["糖尿病 mellitus"]


def test_segments():
    words = frozenset(["二甲双胍", "糖尿病"])
    assert segment("用二甲双胍治疗糖尿病", words, 4) == ["二甲双胍", "治疗", "糖尿病"]
    assert segment(None, words, 4) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n。；c", max_size=400), st.integers(5, 40))
def test_split_keeps_visible_text(t, size):
    parts = split_text(t, size, 0, len)
    assert all(len(p) <= size for p in parts)
    assert "".join("".join(parts).split()) == "".join(t.split())


def test_idf_is_positive():
    assert all(math.log((10 - df + 0.5) / (df + 0.5) + 1) > 0 for df in range(1, 11))
