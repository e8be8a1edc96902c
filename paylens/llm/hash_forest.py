"""Approximate nearest neighbours with a hash-prefix forest.

Every tree maps a vector to a long bit string, one bit per hyperplane, and
holds its strings as sorted arrays: vectors with a common prefix stand together
and a binary search descends to the longest match. A query goes up all trees at
once, one bit at a time, until the prefix ranges of all trees together hold the
wanted number of candidates; then the ranges are scored on the original vectors.

Hyperplanes are differences of vectors from a sample of at most SAMPLE rows, cut
at the sample's median; every distinct vector is indexed. Arrays are cut by
their first SHARD_BITS bits, and a shard with many vectors into slices by hash,
each a sorted array of its own that answers all of the shard's queries. How many
vectors lie under a prefix is known for prefixes up to COUNT_BITS bits, a table
of fixed size.

With nearly isotropic vectors a tree alone says little about a neighbour, so
that the number of candidates is a share of all rows: `share` times the number
of distinct vectors, over all trees, an index row counted once a tree.

Defined results: rows that take no part are listed in vectors.py, here also zero
vectors; fewer candidates than `top` are all returned; an empty table gives no
rows; repeated rows are candidates each, except those with the query's own id.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import Scratch
from paylens.llm.vectors import Classes, allowed, usable

TREES, BITS, SAMPLE = 16, 60, 2_048
SHARD_BITS, COUNT_BITS = 3, 12
SLICE = 4_096
SHARE = 1.4
#: Queries that one copy of a slice answers.
ASKED = 16_384
FOUND_SCHEMA = "unit string, c_key string, score double"


class Planes:
    """Hyperplanes of all trees; vectors of other lengths are cut or filled with zeros."""

    def __init__(self, sample: np.ndarray, trees: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.trees = trees
        pairs = rng.integers(0, len(sample), size=(2, trees * BITS))
        self.normals = sample[pairs[0]] - sample[pairs[1]]
        flat = ~self.normals.any(axis=1)
        self.normals[flat] = rng.normal(size=(int(flat.sum()), sample.shape[1]))
        self.cuts = np.median(sample @ self.normals.T, axis=0)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """vectors x trees"""
        bits = (vectors @ self.normals.T > self.cuts).reshape(len(vectors), self.trees, BITS)
        return (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=2)


def _matrix(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, x in enumerate(values):
        x = np.asarray(x, dtype=np.float64)[:width]
        out[i, : len(x)] = x
    return out


def _index(batches, planes: Planes, width: int):
    """Per distinct vector and tree: the code; queries keep their mark."""
    for batch in batches:
        n = batch.num_rows
        codes = planes.codes(_matrix(batch.column("vector").to_pylist(), width))
        row = np.repeat(np.arange(n), planes.trees)
        take = pa.array(row)
        yield pa.record_batch(
            {
                "tree": pa.array(np.tile(np.arange(planes.trees, dtype=np.int32), n)),
                "code": pa.array(codes.reshape(-1)),
                **{c: batch.column(c).take(take) for c in ("key", "first_id", "second_id", "vector")},
            }
        )


def _route(batches, planes: Planes, width: int, counts: np.ndarray, wanted: int):
    """Per query and tree: the common depth of all trees and the shards below that prefix.

    counts[tree, prefix] holds the vectors under each prefix of COUNT_BITS bits.
    """
    totals = [counts.reshape(planes.trees, 1 << d, -1).sum(axis=2) for d in range(COUNT_BITS + 1)]
    trees = np.arange(planes.trees)
    for batch in batches:
        vectors = batch.column("vector")
        codes = planes.codes(_matrix(vectors.to_pylist(), width))
        rows: list[tuple[int, int, int, int]] = []
        for i, own in enumerate(codes):
            depth = COUNT_BITS
            while depth and totals[depth][trees, own >> (BITS - depth)].sum() < wanted:
                depth -= 1
            for t in range(planes.trees):
                prefix = int(own[t]) >> (BITS - depth)
                up = max(0, SHARD_BITS - depth)
                first = prefix << up if up else prefix >> (depth - SHARD_BITS)
                rows += [(i, t, shard, depth) for shard in range(first, first + (1 << up))]
        which, tree, shard, depth = (np.array(c) for c in zip(*rows, strict=True)) if rows else [np.empty(0, int)] * 4
        yield pa.record_batch(
            {
                "tree": pa.array(tree.astype(np.int32)),
                "shard": pa.array(shard.astype(np.int32)),
                "depth": pa.array(depth.astype(np.int32)),
                "code": pa.array(codes[which, tree]),
                **{c: batch.column(c).take(pa.array(which)) for c in ("unit", "own", "vector")},
            }
        )


def _best(index: pd.DataFrame, queries: pd.DataFrame, keep: int, width: int) -> pd.DataFrame:
    """Score the prefix ranges of one slice; the `keep` best of each query."""
    out: list[tuple[str, str, float]] = []
    if len(index) and len(queries):
        index = index.sort_values("code", kind="stable")
        codes = index["code"].to_numpy()
        vectors, first = _matrix(index["vector"], width), index["first_id"].to_numpy()
        second = index["second_id"].to_numpy()
        keys = index["key"].to_numpy()
        shift = BITS - queries["depth"].to_numpy()
        low = (queries["code"].to_numpy() >> shift) << shift
        begin = np.searchsorted(codes, low, side="left")
        end = np.searchsorted(codes, low + (np.int64(1) << shift), side="left")
        asked = _matrix(queries["vector"], width)
        names = queries["unit"].to_numpy()
        owns = queries["own"].tolist()
        for a, b in sorted(set(zip(begin.tolist(), end.tolist(), strict=True))):
            if a == b:
                continue
            group = np.flatnonzero((begin == a) & (end == b))
            for at in range(0, len(group), 256):
                some = group[at : at + 256]
                scores = asked[some] @ vectors[a:b].T
                for q, row in zip(some, scores, strict=True):
                    fine, ids = allowed(first[a:b], second[a:b], owns[q])
                    if owns[q] is not None:
                        row = np.where(fine, row, -np.inf)
                    # rounding may differ in the last bits: everything at the cut is looked at exactly
                    cut = np.partition(row, len(row) - keep)[len(row) - keep] - 1e-9 if len(row) > keep else -np.inf
                    near = np.flatnonzero((row >= cut) & fine)
                    exact = [math.fsum(p) for p in (vectors[a + near] * asked[q]).tolist()]
                    order = np.lexsort((ids[near], -np.array(exact)))[:keep]
                    out += [(names[q], keys[a + near[o]], exact[o]) for o in order]
    return pd.DataFrame(out, columns=["unit", "c_key", "score"])


def search(scratch: Scratch, rows: DataFrame, every: int, top: int, share: float = SHARE, trees: int = TREES, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of rows whose vec_id is divisible by `every`."""
    spark = scratch.spark
    some = usable(rows).filter(F.exists("vector", lambda v: v != 0))
    classes = Classes(scratch, some, F.pmod(F.col("vec_id"), F.lit(every)) == 0, top)
    distinct = classes.distinct
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("key", F.lit(seed))).select("vector").limit(SAMPLE).collect()]
    width = distinct.agg(F.max(F.size("vector"))).first()[0]
    planes = Planes(_matrix(sample, width), trees, seed)

    kind = dict(distinct.dtypes)["vector"]
    index = distinct.select("key", "first_id", "second_id", "vector").mapInArrow(
        partial(_index, planes=planes, width=width), f"tree int, code long, key string, first_id long, second_id long, vector {kind}"
    )
    index = scratch.table(index.withColumn("shard", F.shiftright("code", BITS - SHARD_BITS).cast("int")), "index")
    counts = np.zeros((trees, 1 << COUNT_BITS), dtype=np.int64)
    # at most trees x 2^COUNT_BITS rows
    for r in index.groupBy("tree", F.shiftright("code", BITS - COUNT_BITS).alias("p")).agg(F.count("*").alias("n")).collect():
        counts[r["tree"], r["p"]] = r["n"]
    # at most trees x 2^SHARD_BITS rows
    sliced = counts.reshape(trees, 1 << SHARD_BITS, -1).sum(axis=2)
    slices = spark.createDataFrame(
        [(t, s, max(1, math.ceil(int(sliced[t, s]) / SLICE))) for t in range(trees) for s in range(1 << SHARD_BITS)], "tree int, shard int, slices int"
    )
    # at the least a few times `top` a tree, so that few rows are all searched
    wanted = min(trees * n, max(math.ceil(share * n), 4 * trees * top))
    index = index.join(F.broadcast(slices), ["tree", "shard"]).withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    asked = classes.queries.select("unit", "own", "vector").mapInArrow(
        partial(_route, planes=planes, width=width, counts=counts, wanted=wanted),
        f"tree int, shard int, depth int, code long, unit string, own string, vector {kind}",
    )
    asked = scratch.table(asked, "asked-shards")
    # queries of a shard are cut as well; each part meets a copy of the shard's slices
    asks = asked.groupBy("tree", "shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("asks"))
    spread = F.broadcast(slices.toDF("tree", "shard", "parts").join(asks, ["tree", "shard"]))
    asked = asked.join(spread, ["tree", "shard"]).withColumn("slice", F.explode(F.expr("sequence(0, parts - 1)")))
    asked = asked.withColumn("ask", F.pmod(F.xxhash64("unit"), F.col("asks")).cast("int")).drop("parts", "asks")
    index = index.join(F.broadcast(asks), ["tree", "shard"]).withColumn("ask", F.explode(F.expr("sequence(0, asks - 1)"))).drop("asks")
    keys = "tree", "shard", "slice", "ask"

    def best_of(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _best(index, queries, top + 1, width)

    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best_of, FOUND_SCHEMA)
    best = found.groupBy("unit", "c_key").agg(F.max("score").alias("score"))
    return classes.expand(best)
