"""Connected components of a table of links, as a sequence of joins.

Every component hooks to its smallest neighbour under a hashed order, which
keeps the trees shallow; the trees are flattened by pointer jumping; links are
then rewritten to the components' names and those inside one dropped. Each step
is a table of its own in the shared folder. A node with very many links is a
large key of a join, which adaptive execution splits, and never one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import Scratch

JUMPS = 40


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, comp) for every node of `links` (a, b); comp is one node of the component."""
    first = F.xxhash64("a") < F.xxhash64("b")
    edges = scratch.table(links.filter("a <> b").select("a", "b").distinct(), f"{name}-edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = scratch.table(ends.select("node", F.col("node").alias("comp")), f"{name}-labels")
    step = 0
    while edges.take(1):
        turned = edges.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi")
        )
        hook = turned.groupBy("hi").agg(F.min(F.struct(F.xxhash64("lo").alias("k"), F.col("lo"))).alias("m"))
        parents = scratch.table(hook.select(F.col("hi").alias("node"), F.col("m.lo").alias("up")), f"{name}-{step}-up0")
        for jump in range(1, JUMPS):
            upper = parents.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = parents.join(upper, "up", "left").select(
                "node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")
            )
            jumped = scratch.table(jumped, f"{name}-{step}-up{jump}")
            parents = jumped.select("node", "up")
            if not jumped.filter("moved").take(1):
                break
        to = parents.select(F.col("node").alias("comp"), "up")
        labels = scratch.table(
            labels.join(to, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), f"{name}-{step}-labels"
        )
        a = parents.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = parents.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(a, "a", "left").select(F.coalesce("ua", "a").alias("a"), "b")
        moved = moved.join(b, "b", "left").select("a", F.coalesce("ub", "b").alias("b"))
        edges = scratch.table(moved.filter("a <> b").distinct(), f"{name}-{step}-edges")
        step += 1
    return labels
