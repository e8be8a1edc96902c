"""Left joins whose left side has many rows without a key, or with the same one.

An equality join sends all NULL keys, and all rows of a hot key, to one task.
Here the join key gets one more column. Rows with a NULL in their key can match
nothing: their extra value is a hash of the row's own id, so that they spread
over all tasks. Rows of hot keys are dealt to `salts` values, and the right rows
of these keys are repeated once per value; all others have the value 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = "_spread"


def hot_keys(left: DataFrame, keys: Sequence[str], above: int) -> DataFrame:
    """Keys with more than `above` rows; there are at most rows / `above` of them."""
    counted = left.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > above).select(*keys)


def _incomplete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))


def left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    hot: DataFrame | None = None,
    salts: int = 64,
) -> DataFrame:
    """`left.join(right, keys, "left")`, with NULL and hot keys spread by the columns `spread_by`.

    `hot` comes from `hot_keys` with a bound that keeps it small: it is broadcast.
    """
    keys = list(keys)
    own = F.xxhash64(*spread_by)
    # real keys have values from 0 to salts - 1
    nowhere = -1 - F.abs(own % 1_000_000)
    # a constant would be taken out of the join's keys by the optimizer, so that zero is computed
    here, there = F.lit(0).cast("long"), right.withColumn(SPREAD, F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")))
    if hot is not None:
        marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        left = left.join(marked, keys, "left")
        here = F.when(F.col("_hot"), F.pmod(own, F.lit(salts))).otherwise(0)
        copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
        there = right.join(marked, keys, "left").withColumn(SPREAD, F.explode(copies)).drop("_hot")
    placed = left.withColumn(SPREAD, F.when(_incomplete(keys), nowhere).otherwise(here).cast("long"))
    placed = placed.drop("_hot") if hot is not None else placed
    return placed.join(there, [*keys, SPREAD], "left").drop(SPREAD)
