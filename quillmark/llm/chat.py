"""Chat formatting with a collapse of cumulative snapshots (DataFrame functions only).

A logger that stores a conversation after every exchange leaves many copies, each a prefix of the next.  Every turn gets
a rolling hash of the conversation up to it; a conversation whose last hash is that of an earlier turn of a longer one is
a prefix and is dropped by an anti-join, equal conversations keep the smallest conv_id, and the rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.scratch import materialise

#: Turns of one step of the two-level prefix sums.
STEP = 256


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, n_turns, h1, h2``: turns in order with 128 bits of the hash of turns 1 to ``place``.

    A turn's hash covers its place, role and text, and prefixes are xor-ed, so the running hash is a running ``bit_xor``.
    Long conversations are summed in steps of turn numbers first, so no window needs a whole conversation's texts.
    Order: turn, then role and text (nulls first).
    """
    base = turns.select("conv_id", "turn", "role", "text", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / STEP).alias("step"))
    counts = base.groupBy("conv_id", "step").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c"), F.col("step").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("n_turns"))
    step = Window.partitionBy("conv_id", "step").orderBy("turn", "role", "text")
    placed = base.withColumn("k", F.row_number().over(step)).join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("s")))
    placed = placed.select("conv_id", "step", (F.col("start") + F.col("k")).alias("place"), "role", "text", "n_turns")
    # null and '' differ: the flags are hashed too
    parts = (F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    placed = placed.withColumn("t1", F.xxhash64(*parts)).withColumn("t2", F.xxhash64(F.lit(7), *parts))
    sums = placed.groupBy("conv_id", "step").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("step").alias("s"), *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")])
    run = Window.partitionBy("conv_id", "step").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("r1", F.bit_xor("t1").over(run)).withColumn("r2", F.bit_xor("t2").over(run))
    joined = running.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("s")))
    return joined.select("conv_id", "place", "role", "text", "n_turns", F.col("r1").bitwiseXOR(F.col("x1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("x2")).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n_turns`` of the conversations that are no prefix of a longer one; of equal ones the smallest
    conv_id stays (null before all).  A null conv_id is a conversation of its own."""
    # written without the texts: they are read three times
    hashed = materialise(prefix_hashes(turns).select("conv_id", "place", "n_turns", "h1", "h2"), "chat-prefixes")
    last = hashed.where("place = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("first"))
    inner = hashed.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    kept = last.join(inner, ["n_turns", "h1", "h2"], "left_anti").select(F.col("first.conv_id").alias("k"), "n_turns")
    return turns.select("conv_id", "turn", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("k"))).drop("k")


def render_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, chat``: one row per maximal conversation; each turn is ``<|role|>\\ntext\\n`` (null: empty).

    Rows that repeat a turn are turns of their own, in order of role and text; a null turn comes first; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    kept = maximal_conversations(turns).select("conv_id", "n_turns", F.struct("turn", "role", "text").alias("said"))
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list("said")), line)
    return kept.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.array_join(lines, "").alias("chat"))


CHAT_SQL = """
WITH convs AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
firsts AS (SELECT min(conv_id) AS conv_id, turns FROM convs GROUP BY turns),
prefixes AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM convs WHERE len(turns) > 1))
SELECT conv_id, len(turns)::BIGINT AS n_turns,
       list_aggregate(list_transform(turns, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || chr(10)), 'string_agg', '') AS chat
FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = f.turns)"""
