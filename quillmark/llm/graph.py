"""Connected components of links, by alternating large-star and small-star rounds (all distributed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.scratch import materialise, release


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links(a long, b long)``: the smallest node of its component.

    Each round hangs every node's larger, then smaller neighbours under the smallest one; a component becomes a star in
    a number of rounds that grows with the logarithm of its size.  Every round is written, so lineage stays short.  Null
    ends and self-links are ignored; repeated links count once.
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = materialise(links.where("a is not null and b is not null and a <> b").select(big, small).distinct(), label)
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, materialise(star, label)
        release(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
