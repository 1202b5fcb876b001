"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is sent to every executor.
SMALL = 200_000


def sent_if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (counted up to there); else as it is, so that the join
    shuffles (and adaptive execution splits skewed partitions)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hash_filter(values: DataFrame, column: str, most: int = SMALL, bits: int = 64):
    """``value_filter`` over the values' hashes (``xxhash64``)."""
    return value_filter(values.select(F.xxhash64(column).alias("h")), "h", most, bits)


def value_filter(values: DataFrame, column: str, most: int = SMALL, bits: int = 64):
    """A test of 64-bit hashes: whether one is among ``values``; about one in ``bits`` others passes too.

    At most ``most`` values go with the plan as a bitmap; for more of them None, and nothing is filtered ahead of a join.
    """
    hashes = values.select(F.col(column).alias("h")).distinct().limit(most + 1).toArrow().column(0).to_pylist()
    if len(hashes) > most:
        return None
    size = 1 << max(10, (bits * max(1, len(hashes)) - 1).bit_length())
    words = [0] * (size // 64)
    for h in hashes:
        words[(h >> 6) & (size // 64 - 1)] |= 1 << (h & 63)
    # a constant that the optimizer folds into one literal
    bitmap = F.split(F.lit(",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)), ",").cast("array<bigint>")

    def test(h):
        at = F.shiftright(h, 6).bitwiseAND(F.lit(size // 64 - 1)).cast("int")
        return F.call_function("bit_get", F.get(bitmap, at), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test
