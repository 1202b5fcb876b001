"""Document fingerprints: I-Match with randomised lexicons (DataFrame functions only).

The lexicon holds the terms whose inverse document frequency over all texts lies in a band.  A text's distinct lexicon
terms are sorted and dealt, by a hash of the term, to ``PARTS`` lexicon subsets at each of several sampling rates; every
subset's terms are hashed together.  An edit changes the hashes of the few subsets that hold a changed term.

A band from below bounds the lexicon: at most (distinct terms of a text) / (least share of texts) terms can lie in it,
however large the corpus.  Up to ``LARGEST`` terms go with the plan as a literal hash table, so that no text is shuffled for
the lookup: a bitmap answers for most terms outside the band, and the terms' whole hashes, in buckets, for the rest.  A
larger lexicon is joined with the texts' terms instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.scratch import materialise, release

#: The band: least and greatest idf = ln(texts / texts with the term); the least document frequency.
LOW_IDF, HIGH_IDF, LEAST = math.log(12), math.log(2500), 2
#: Subsets at a rate, and the rates: a text's term is used at rate r with probability 1/r.
PARTS, RATES = 10, (2, 8, 32, 128)
#: Subsets that must hold terms of either text before a rate counts.
ENOUGH = 5
#: Most terms of a literal lexicon, bits of its bitmap for each term, and terms of a bucket of its table (2 to 4 on average).
LARGEST, BITS, LOAD = 1 << 20, 32, 4
#: Rows of a range of ids, and most values that a range is searched among at each of two levels.
RANGE, FAN = 2000, 200
#: White space, as in a word's definition.
_BLANKS = " \t\n\x0b\f\r"


def term_hashes(text: str = "text") -> Column:
    """Distinct hashes of the lower-case words of the whole text; null: none."""
    inner = F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_BLANKS))
    hashes = F.transform(F.split(inner, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(hashes))


def lexicon(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF, least: int = LEAST) -> DataFrame:
    """``term, df``: hashes of the terms in the band, counted over all texts (repeated rows count)."""
    total = docs.select(F.count(F.lit(1)).alias("n"))
    counts = docs.select(F.explode(term_hashes()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.col("n") / F.col("df"))
    return counts.where(F.col("df") >= least).crossJoin(F.broadcast(total)).where((idf >= low) & (idf <= high)).select("term", "df")


class Lexicon:
    """A lexicon ``term`` that texts are looked up in."""

    def __init__(self, terms: DataFrame, largest: int = LARGEST):
        self.terms = materialise(terms.select("term"), "imatch-lexicon")  # the corpus is gone through once
        n = self.terms.count()
        self.literal = n <= largest
        if not self.literal:
            return
        self.bits = 1 << max(10, (BITS * max(n, 1) - 1).bit_length())
        self.buckets = 1 << max(0, (n // LOAD).bit_length())
        bit = self.terms.select(F.col("term").bitwiseAND(F.lit(self.bits - 1)).alias("bit"))
        words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("word"))
        place = Window.partitionBy("bucket").orderBy("term")
        slots = self.terms.select("term", F.shiftright("term", 40).bitwiseAND(F.lit(self.buckets - 1)).alias("bucket")).withColumn("slot", F.row_number().over(place) - 1)
        rows = slots.toArrow()
        self.depth = max([1, *(x + 1 for x in rows.column("slot").to_pylist())])
        table = [0] * (self.buckets * self.depth)
        for term, bucket, slot in zip(*(rows.column(c).to_pylist() for c in ("term", "bucket", "slot")), strict=True):
            table[bucket * self.depth + slot] = term
        filled = [0] * (self.bits // 64)
        for row in words.toLocalIterator():
            filled[row["at"]] = row["word"]
        self.bitmap, self.table = ",".join(map(str, filled)), ",".join(map(str, table))
        release(self.terms)

    def kept(self, docs: DataFrame, text: str, out: str) -> DataFrame:
        """``docs`` with the sorted hashes of a text's distinct lexicon terms as ``out``."""
        return self._looked_up(docs, text, out) if self.literal else self._joined(docs, text, out)

    def _looked_up(self, docs: DataFrame, text: str, out: str) -> DataFrame:
        # Constants that the optimizer folds into literals.
        words, table = (F.split(F.lit(x), ",").cast("array<bigint>") for x in (self.bitmap, self.table))

        def known(h: Column) -> Column:
            at = F.shiftright(h, 6).bitwiseAND(F.lit(self.bits // 64 - 1)).cast("int")
            return F.call_function("bit_get", F.get(words, at), h.bitwiseAND(F.lit(63)).cast("int")) == 1

        def surely(h: Column) -> Column:
            # the bucket's slots; the table stands here once, as every mention of it is a copy in the plan
            first = F.shiftright(h, 40).bitwiseAND(F.lit(self.buckets - 1)) * self.depth
            return F.array_contains(F.slice(table, first.cast("int") + 1, F.lit(self.depth)), h) & (h != 0)  # an empty slot holds 0

        return docs.withColumn(out, F.array_sort(F.filter(F.filter(term_hashes(text), known), surely)))

    def _joined(self, docs: DataFrame, text: str, out: str) -> DataFrame:
        keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
        keyed = docs.withColumn("q_k1", keys[0]).withColumn("q_k2", keys[1])
        each = keyed.select("q_k1", "q_k2", F.explode(term_hashes(text)).alias("term")).distinct()
        found = each.join(self.terms, "term").groupBy("q_k1", "q_k2").agg(F.array_sort(F.collect_list("term")).alias(out))
        nothing = F.array().cast("array<bigint>")
        return keyed.join(found, ["q_k1", "q_k2"], "left").withColumn(out, F.coalesce(out, nothing)).drop("q_k1", "q_k2")


def with_fingerprint(docs: DataFrame, text: str, out: str, lexicon_: Lexicon) -> DataFrame:
    """``docs`` with an array of the hashes of all subsets, rate by rate; null where a subset holds none of the text's terms.

    In steps: an expression that stands inside a lambda would be computed anew for every element.
    """
    found = lexicon_.kept(docs, text, "q_terms")
    for i, rate in enumerate(RATES):
        found = found.withColumn(f"q_own{i}", F.expr(f"filter(q_terms, h -> pmod(shiftright(h, 24), {rate}) = 0)"))
    nothing = F.xxhash64(F.array().cast("array<bigint>"))

    def parts(i: int) -> Column:
        dealt = lambda k: F.filter(f"q_own{i}", lambda h: F.pmod(F.shiftright(h, 34), F.lit(PARTS)) == k)
        return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.nullif(F.xxhash64(dealt(k)), nothing))

    return found.withColumn(out, F.concat(*[parts(i) for i in range(len(RATES))])).drop("q_terms", *[f"q_own{i}" for i in range(len(RATES))])


def likeness(a: str, b: str) -> Column:
    """0 to 1: the share of equal hashes among the subsets that hold terms of either text, at the rate where it is greatest
    (rates with fewer than ``ENOUGH`` such subsets count only if the densest rate has no more).  Two texts without lexicon
    terms are alike only as far as both fingerprints are empty: 1."""
    shares = []
    for i in range(len(RATES)):
        x, y = (F.slice(F.col(c), F.lit(i * PARTS + 1), F.lit(PARTS)) for c in (a, b))
        pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
        either = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
        same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
        share = F.when(either > 0, same / either)
        shares.append(F.when(either >= ENOUGH, share) if i else share)
    return F.coalesce(F.greatest(*shares), F.lit(1.0))


def as_text(array: str) -> Column:
    """A fingerprint as a string: up to 16 hexadecimal digits a subset, ``-`` where it is empty, joined by ``.``."""
    return F.array_join(F.transform(F.col(array), lambda h: F.coalesce(F.hex(h), F.lit("-"))), ".")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_<c>`` for each column: the values of the next row by (doc_id, text's hash);
    the last row's next is the first row.

    Rows are cut into ranges of about ``RANGE`` rows at quantiles of the ids (up to ``FAN * FAN`` ranges, longer ones beyond that),
    rows without an id, which come first, by their texts' hash; every range also gets the first row of the next one (a
    broadcast of one row a range), so the window runs inside a range and no global sort is needed.
    """
    n = docs.where("doc_id is not null").count()
    side = min(FAN, max(1, math.isqrt(n // RANGE)))
    shares = [k / side**2 for k in range(1, side**2)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 20 * side**2)).first()[0] if n and shares else []
    bounds = sorted(bounds or [])
    # two levels: of every ``side`` bounds the last, then those before it; a literal is made of a string at once
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")
    upto = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    hash_ = F.xxhash64("text")
    parts = F.floor((hash_ / F.lit(2.0**64) + 0.5) * 256).cast("long") - 257  # in the hashes' order, below all ranges of ids
    placed = docs.withColumn("q_hash", hash_).withColumn("q_block", upto(longs(bounds[side - 1 :: side])))
    inner = F.slice(longs(bounds), F.col("q_block") * side + 1, F.lit(side - 1))
    at = F.when(F.col("doc_id").isNull(), parts).otherwise(F.col("q_block") * side + upto(inner))
    placed = placed.withColumn("q_range", at.cast("long")).drop("q_block")
    firsts = placed.groupBy("q_range").agg(F.min(F.struct("doc_id", "q_hash")).alias("q_first"))
    chain = Window.orderBy("q_range")
    last = F.max("q_range").over(Window.partitionBy())
    firsts = firsts.select(F.col("q_first.doc_id").alias("q_id"), F.col("q_first.q_hash").alias("q_text"), F.col("q_range").alias("q_own"), F.coalesce(F.lag("q_range").over(chain), last).alias("q_before"))
    sent = placed.join(F.broadcast(firsts), (F.col("q_range") == F.col("q_own")) & F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("q_hash") == F.col("q_text")), "left")
    copies = F.array(F.struct(F.col("q_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("q_before").alias("r"), F.lit(1).alias("guest")))
    dealt = sent.withColumn("q_to", F.explode(F.filter(copies, lambda c: c["r"].isNotNull())))
    order = Window.partitionBy("q_to.r").orderBy("q_to.guest", "doc_id", "q_hash")
    out = dealt.select(*docs.columns, F.col("q_to.guest").alias("q_guest"), *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where("q_guest = 0").drop("q_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by the first as many (or all) of the next row's
    text, ascending doc_id (equal ids by the text's hash; nulls first); the last row's next is the first.  A null text is
    empty; equal texts have equal fingerprints; other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    terms = Lexicon(lexicon(slim))
    own = with_fingerprint(slim, "text", "fp", terms)
    paired = with_next(own, ["text", "fp"])
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    done = with_fingerprint(paired.withColumn("edited", edited), "edited", "edited_fp", terms)
    return done.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
