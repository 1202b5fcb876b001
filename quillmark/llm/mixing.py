"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source is expected ``f = target / source size`` times (``f <= 3``).  Along an order of the source's
documents the expected copies are summed, one offset in [0, 1) is added, and a document is emitted once for each whole
number that its share of the running sum crosses.  The order goes by size class, so that what is taken of a source misses
its target by about one document's size at most.

A source can hold a third of all rows, so no window runs over a source's rows: documents are ranked inside cells (source,
size class, salt), whose counts are summed in two steps, along the salts of a class and along the classes of a source.
The salt is a hash of the doc_id, and there are as many as keep a cell at about ``CELL`` rows even if all sizes are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights by the rank of the source, repeating; most copies of a document; least cells of one size class, and their rows.
WEIGHTS, MOST, SALT, CELL = (5, 2, 1), 3, 64, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    """Number of words of the whole text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Sizes below 32 one by one, above that 32 classes for each power of two (whole-number arithmetic)."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 6, F.lit(0))
    return shift.cast("long") * 64 + F.call_function("shiftright", size, shift.cast("int"))


def _salt(salts: int) -> Column:
    """Which of the cells a doc_id is in (null as 0), by 32 bits of its MD5."""
    name = F.md5(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).cast("string"))
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % salts


def offset_of(source: Column) -> Column:
    """The source's offset in [0, 1): 32 bits of a SHA-256 of its name (``n`` before a null, ``s`` before a name)."""
    name = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: weights share the total; a target stops at ``most`` times its source's size and the
    excess is shared again by weight among the others until none is above.

    Filling by weight in rounds ends where every source has ``min(most * size, level * weight)`` for one common level, so the
    level is found at once: in order of ``most * size / weight`` it is that of the first source that the level of all from it on
    does not fill up (levels fall from there on, so it is the greatest such).  The window runs over the sources (one row each).
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", pick).withColumn("full", F.col("source_size") * float(most)).withColumn("r", F.col("full") / F.col("w"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levels = ranked.withColumn("level", level).withColumn("common", F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(every))
    return levels.select("source", "source_size", F.when(F.col("common").isNull(), F.col("full")).otherwise(F.least("full", F.col("common") * F.col("w"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` appended (existing columns of these names are replaced).

    One row per input row; ``copies`` is how often the mix takes it, ``taken = copies * size``.  Reruns agree: the order
    inside a cell is by size, doc_id and the text's hash.  A null source is a source of its own (last); a null text has size
    0; sources without words have target 0; an empty table gives an empty result; repeated rows are documents of their own.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    sized = docs.select(*kept, size_of().alias("size"))
    salts = max(SALT, -(-docs.count() // CELL))
    # Only what the sums need is read for the targets and the cells.
    slim = docs.select("source", _salt(salts).alias("q_salt"), size_of().alias("size")).withColumn("q_class", _size_class(F.col("size")))
    cells = slim.groupBy("source", "q_class", "q_salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    targets = source_targets(cells, weights, most)
    inside = Window.partitionBy("source", "q_class").orderBy("q_salt").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("source").orderBy("q_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("source", "q_class").agg(F.sum("n").alias("n"))
    classes = classes.select(F.col("source").alias("q_from"), F.col("q_class").alias("q_of"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("q_before"))
    within = cells.select("source", "q_class", "q_salt", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("q_inside"))
    starts = within.join(classes, F.col("source").eqNullSafe(F.col("q_from")) & (F.col("q_class") == F.col("q_of"))).select("source", "q_class", "q_salt", (F.col("q_before") + F.col("q_inside")).alias("q_start"))
    t, s = targets.alias("t"), starts.alias("s")
    placed = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source").alias("q_source"), F.col("q_class").alias("q_c"), F.col("q_salt").alias("q_s"), "q_start", F.col("source_size").alias("q_size"), F.col("target").alias("q_target"))
    ranked = sized.withColumn("q_salt", _salt(salts)).withColumn("q_class", _size_class(F.col("size")))
    cell = Window.partitionBy("source", "q_class", "q_salt").orderBy("size", "doc_id", F.xxhash64("text"))
    ranked = ranked.withColumn("q_rank", F.row_number().over(cell))
    joined = ranked.join(placed, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("q_class") == F.col("q_c")) & (F.col("q_salt") == F.col("q_s")))
    factor = F.when(F.col("q_size") > 0, F.col("q_target") / F.col("q_size")).otherwise(F.lit(0.0))
    place = F.col("q_start") + F.col("q_rank")
    copies = (F.floor(factor * place + offset_of(F.col("source"))) - F.floor(factor * (place - 1) + offset_of(F.col("source")))).cast("long")
    return joined.select(*kept, "size", F.col("q_size").alias("source_size"), F.col("q_target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
cells AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id, 0)::VARCHAR), 1, 8))::BIGINT % (SELECT greatest({SALT}, ceil(count(*) / {CELL}.0::DOUBLE)::BIGINT) FROM documents) AS salt,
         greatest(length(bin(size)) - 6, 0)::BIGINT * 64 + (size >> greatest(length(bin(size)) - 6, 0)::INTEGER) AS class FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sizes),
levels AS (
  SELECT *, most / w AS r, ((SELECT sum(source_size) FROM weighed)::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN c IS NULL THEN most ELSE least(most, c * w) END AS target
  FROM levels CROSS JOIN (SELECT max(level) AS c FROM levels WHERE level <= r)),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST) AS place FROM cells),
drawn AS (
  SELECT doc_id, size, source_size, target, place, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS f,
         ('0x' || substr(sha256(CASE WHEN r.source IS NULL THEN 'n' ELSE 's' || r.source END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(f * place + u) - floor(f * (place - 1) + u))::BIGINT AS copies,
       (floor(f * place + u) - floor(f * (place - 1) + u))::BIGINT * size AS taken
FROM drawn"""
