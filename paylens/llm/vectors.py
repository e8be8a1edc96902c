"""Distinct vectors, their smallest row ids, and results per row from results per vector.

Rows with equal vectors have equal neighbours, so that searches run over
distinct vectors only. Of each vector the `top` + 1 smallest ids, each with up
to `top` of its rows, are enough for lists of `top`; rows are first counted by
vector and id, and the smallest ids are found in three salted steps, because one
vector may have a third of all rows.

A row is never its own candidate, nor is any other row with its id. An id that
several distinct vectors have is therefore asked for apart from the rest of its
vector: such a query names the id, and the search leaves out vectors that only
this id has and orders the others by their smallest other id.

Rows whose id or vector is null, or whose vector holds a null or a component
that is not finite, take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch

SALTS = (64, 8, 1)


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector, key): rows that take part; the key stands for the vector's values."""
    x = F.col("vector")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    picked = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(fine)
    return picked.withColumn("key", F.md5(F.array_join(x.cast("array<string>"), ",")))


class Classes:
    """The distinct vectors among `rows` (vec_id, vector, key).

    distinct: key, vector, first_id and second_id (the two smallest ids, equal if
    there is one only). queries: unit, key, vector and `own`, the id as text whose
    rows the search leaves out, null where expand() does that.
    """

    def __init__(self, scratch: Scratch, rows: DataFrame, queries: Column, top: int) -> None:
        self.top = top
        rows = scratch.table(rows.withColumn("asks", queries), "vectors")
        ids = scratch.table(rows.groupBy("key", "vec_id").agg(F.count("*").alias("n"), F.max("asks").alias("asks")), "ids")
        found = ids.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.count("*").alias("n"))
        found = scratch.table(found, "classes")
        # one row of each class brings its vector; copies of a row are the same vector
        once = rows.join(found.select("key", F.col("first_id").alias("vec_id")), ["key", "vec_id"], "left_semi")
        vectors = once.select("key", "vector").dropDuplicates(["key"])
        several = ids.select("key", "vec_id", "n").join(found.filter("first_id < last_id").select("key"), "key")
        for salts in SALTS:
            inside = Window.partitionBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
            several = several.withColumn("r", F.row_number().over(inside)).filter(F.col("r") <= top + 1).drop("r")
        single = ids.join(found.filter("first_id = last_id").select("key"), "key").select("key", "vec_id", "n")
        self.members = scratch.table(single.union(several), "members")
        smallest = self.members.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        smallest = smallest.select("key", F.col("ids")[0].alias("first_id"), F.coalesce(F.get("ids", F.lit(1)), F.col("ids")[0]).alias("second_id"))
        self.distinct = scratch.table(vectors.join(smallest, "key"), "distinct")
        repeated = ids.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id", F.lit(True).alias("several"))
        asked = ids.filter("asks").select("key", "vec_id", F.col("n").alias("copies")).join(repeated, "vec_id", "left")
        asked = asked.withColumn("own", F.when(F.col("several"), F.col("vec_id").cast("string")))
        asked = asked.withColumn("unit", F.concat_ws(":", "key", "own"))
        self.asked = scratch.table(asked.select("unit", "key", "vec_id", "copies", "own"), "asked")
        units = self.asked.select("unit", "key", "own").distinct()
        self.queries = scratch.table(units.join(self.distinct.select("key", "vector"), "key"), "queries")

    def expand(self, best: DataFrame) -> DataFrame:
        """From (unit, c_key, score), at least the `top` + 1 best classes, to (query_id, rank, vec_id, score)."""
        top = self.top
        order = (F.desc("score"), "vec_id")
        ids = best.join(self.members.withColumnRenamed("key", "c_key"), "c_key")
        ids = ids.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(top)))))
        # no id fills a list twice over, so that twice its length is enough without the query's own
        each_id = Window.partitionBy("unit", "vec_id").orderBy(*order)
        ids = ids.withColumn("r", F.row_number().over(each_id)).filter(F.col("r") <= top)
        whole = Window.partitionBy("unit").orderBy(*order)
        ids = ids.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= 2 * top)
        lists = ids.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
        asked = self.asked.select("unit", F.col("vec_id").alias("query_id"), F.explode(F.expr("sequence(1L, copies)")))
        own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
        each = asked.join(lists, "unit").select("query_id", F.posexplode(F.slice(own, 1, top)).alias("at", "x"))
        return each.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def allowed(first: np.ndarray, second: np.ndarray, own: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Per class whether it has rows of another id than `own`, and the smallest id that counts."""
    if own is None:
        return np.ones(len(first), bool), first
    mine = first == int(own)
    return ~(mine & (first == second)), np.where(mine, second, first)
