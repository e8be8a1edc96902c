"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows of each source are put in a seeded random order; row r of a source with n
rows gets the fractional rank (r - u) / n, u in (0, 1) drawn once per source so
that small sources do not all meet in the middle. Rows sorted by fractional
rank hold every source in its overall proportion over any stretch; cutting that
order into equal stretches gives shards that differ by one row at most.

Both rankings are distributed: values are dealt into buckets by range, bucket
counts are summed up, and only inside a bucket are rows numbered. Bucket sizes
follow from the hash, not from the data: a hot source fills all its buckets.

The order is drawn from a row's id, its other columns and, of rows alike in all
of them, their number, so that the result does not depend on the order of the
input and no bucket holds more of a repeated row than of others. Copies are
numbered within their input partition, on top of those in partitions before it.

Defined results: a null source is a stratum of its own; null and repeated
doc_ids and repeated rows are rows of their own; an empty table gives no rows;
other columns are passed through where they are asked for (maps are no part of
the draw).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, seeded_unit

#: Rows per ranking bucket on average, and the most buckets: their counts are summed up in one task.
BUCKET_ROWS = 500
MOST_BUCKETS = 100_000


def interleave(scratch: Scratch, rows: DataFrame, shards: int, seed: int = 0, stratum: str = "source", identity: str = "doc_id") -> DataFrame:
    """`rows` with shard and slot; `stratum` and `identity` are column names."""
    kept = [f"c{i}" for i in range(len(rows.columns))]
    named = rows.toDF(*kept)
    by = named[kept[rows.columns.index(stratum)]]
    who = kept[rows.columns.index(identity)]
    told = [c for c, kind in named.dtypes if "map<" not in kind]
    drawn = named.withColumn("s", F.xxhash64(by.cast("string"))).withColumn("pid", F.spark_partition_id())
    drawn = drawn.withColumn("alike", F.xxhash64(*told, *(F.col(c).isNull() for c in told)))
    drawn = scratch.table(drawn, "drawn")
    here = drawn.groupBy("alike", "pid").agg(F.count("*").alias("m"))
    earlier = F.sum("m").over(Window.partitionBy("alike").orderBy("pid")) - F.col("m")
    copies = here.withColumn("earlier", earlier).filter("earlier > 0 or m > 1").select("alike", "pid", "earlier")
    drawn = drawn.join(copies, ["alike", "pid"], "left")
    copy = F.coalesce("earlier", F.lit(0).cast("long")) + F.row_number().over(Window.partitionBy("alike", "pid").orderBy("earlier"))
    drawn = drawn.withColumn("u", seeded_unit(seed, F.col(who), F.col("alike"), copy)).drop("alike", "pid", "earlier")
    total = rows.count()
    buckets = min(MOST_BUCKETS, max(1, total // BUCKET_ROWS))

    drawn = drawn.withColumn("b", F.floor(F.col("u") * buckets).cast("int"))
    counts = drawn.groupBy("s", "b").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("s").orderBy("b")
    whole = Window.partitionBy("s")
    counts = counts.select(
        "s", "b",
        (F.sum("n").over(upto) - F.col("n")).alias("before"),
        F.sum("n").over(whole).alias("of"),
    )
    inside = Window.partitionBy("s", "b").orderBy("u")
    ranked = drawn.join(counts, ["s", "b"]).withColumn("r", F.col("before") + F.row_number().over(inside))
    ranked = ranked.withColumn("f", (F.col("r") - seeded_unit(seed + 1, F.col("s"))) / F.col("of"))
    ranked = scratch.table(ranked.select(*kept, "s", "f"), "ranked")

    binned = ranked.withColumn("b", F.least(F.floor(F.greatest(F.col("f"), F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int"))
    sizes = binned.groupBy("b").agg(F.count("*").alias("n"))
    starts = sizes.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("f", "s")) - 1
    placed = binned.join(starts, "b").withColumn("p", place)
    shard = F.expr(f"cast((p * {shards}) div {max(total, 1)} as int)")
    slot = F.expr(f"p - (shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", slot).select(*kept, "shard", "slot").toDF(*rows.columns, "shard", "slot")
