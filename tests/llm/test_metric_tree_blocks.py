"""Blocks of queries through subtrees, against a comparison of every two; what the search moves."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from paylens.llm import metric_tree
from paylens.llm.common import Scratch
from tests.llm import plain

KEEP = 4


def subtrees(space, points, pivot, parts):
    """(pages, vectors, their numbers in the given order) of some cuts of the points."""
    out = []
    for rows in np.array_split(np.arange(len(points)), parts):
        pages, order = metric_tree.build(space.lifted(points[rows]), pivot)
        out.append((pages, points[rows][order], rows[order]))
    return out


@pytest.mark.parametrize("scale", [1, 90, 3_000, 10**6, 10**12])
@pytest.mark.parametrize("bounded", [False, True])
def test_a_block_finds_what_a_comparison_of_every_two_finds(scale, bounded):
    rng = np.random.default_rng(scale % 97)
    near = rng.integers(-5, 6, size=(40, 6))
    points = np.concatenate([near[rng.integers(0, 40, 900)] * 3 + rng.integers(-1, 2, size=(900, 6)), rng.integers(-9, 10, size=(300, 6))])
    points = np.unique(points, axis=0) * scale
    rng.shuffle(points)
    first = rng.permutation(len(points)) // 2  # ids that two classes have
    second = np.where(rng.random(len(points)) < 0.5, first, first + len(points))
    queries = points[:70]
    own, named = first[:70].copy(), rng.random(70) < 0.5
    want = []
    for q, mine, has in zip(queries.tolist(), own.tolist(), named.tolist(), strict=True):
        scores = [sum(a * b for a, b in zip(q, x, strict=True)) for x in points.tolist()]
        some = [(-s, b if has and a == mine else a) for s, a, b in zip(scores, first.tolist(), second.tolist(), strict=True) if not (has and a == b == mine)]
        want.append(sorted(some)[:KEEP])
    space = metric_tree.Space(6, float((points.astype(float) ** 2).sum(axis=1).max()))
    assert space.kind == (np.float32 if scale <= 90 else np.float64) and space.exact == (scale <= 10**6)
    stored = points.astype(space.stored)
    pivot = space.lifted(stored[:1])[0]
    kth = np.array([-x[-1][0] for x in want], float) if bounded else np.full(70, -np.inf)
    asked = metric_tree.Asked(space, stored[:70], own, named, kth, KEEP)
    to_top = space.distance_of(asked.squares, stored[:70].astype(float) @ pivot[:-1])
    start, pages_of_all, compared = 0, 0, 0
    inner = asked.compare

    def counted(*args):
        nonlocal compared
        compared += 1
        inner(*args)

    asked.compare = counted
    for pages, vectors, rows in subtrees(space, stored, pivot, 3):
        metric_tree.best_first(pages, vectors.astype(space.kind), first[rows], second[rows], start, asked, to_top)
        start += len(rows)
        pages_of_all += len(pages)
    got = [[(-s, i) for s, i in zip(asked.scores[k, :n].tolist(), asked.ids[k, :n].tolist(), strict=True)] for k, n in enumerate(asked.n_found.tolist())]
    assert got == want
    # a page is gone through once for all queries, not once for each
    assert compared <= pages_of_all


def test_few_classes_and_none():
    space = metric_tree.Space(2, 25.0)
    points = np.array([[3, 4], [0, 0]], np.int16)
    pivot = space.lifted(points[:1])[0]
    asked = metric_tree.Asked(space, points, np.zeros(2, int), np.zeros(2, bool), np.full(2, -np.inf), KEEP)
    (pages, vectors, rows) = subtrees(space, points, pivot, 1)[0]
    metric_tree.best_first(pages, vectors.astype(space.kind), rows, rows, 0, asked, space.distance_of(asked.squares, points @ pivot[:-1]))
    assert asked.n_found.tolist() == [2, 2] and asked.scores[:, :2].tolist() == [[25, 0], [0, 0]]
    assert asked.ids[0, :2].tolist() == [0, 1] and asked.ids[1, :2].tolist() == [0, 1]


def test_vectors_as_bytes():
    rows = [(1, [1.0, -0.5]), (None, [1.0]), (3, None), (4, [math.nan, 1.0]), (5, []), (6, [1e30, 2.0, -1e300]), (7, [None, 1.0]), (8, [math.inf]), (9, [200.0])]
    ids, vectors = zip(*rows, strict=True)
    batch = pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "vector": pa.array(vectors, pa.list_(pa.float64()))})
    whole = metric_tree.Space(3, math.inf)
    want = {1: [256, -128, 0], 5: [0, 0, 0], 6: [2**63, 512, -(2**63)], 9: [51200, 0, 0]}
    for part, ids in ((batch, [1, 5, 6, 9]), (batch.slice(4), [5, 6, 9]), (batch.slice(1, 3), [])):
        out = next(metric_tree._pack([part], 256.0))
        assert out.column("vec_id").to_pylist() == ids
        assert whole.matrix(out.column("vector").to_pylist()).tolist() == [want[i] for i in ids]
    exact = pa.record_batch({"vec_id": pa.array([1, 2]), "vector": pa.array([[1, -(2**63)], [None, 3]], pa.list_(pa.int64()))})
    assert next(metric_tree._pack([exact], None)).to_pylist() == [{"vec_id": 1, "vector": b"\x01" + (1).to_bytes(8, "little") + (-(2**63)).to_bytes(8, "little", signed=True)}]


def test_queries_move_in_packs_and_meet_every_subtree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(500), [float(rng.randrange(-6, 7)) / 4 for _ in range(5)]) for _ in range(900)]
    # subtrees of 8 vectors, tasks with 16 vectors and 16 queries
    monkeypatch.setattr(metric_tree, "SLICE", 8)
    monkeypatch.setattr(metric_tree, "HELD", 16 * 5 * 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    values = [(i, [int(math.floor(256 * a)) for a in v]) for i, v in rows]
    want = defaultdict(list)
    for q, found in plain.nearest_rows(values, 2, KEEP, lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))):
        want[q] += [(k + 1, s, c) for k, (s, c) in enumerate(found)]
    scratch = Scratch(spark, "t")
    got = defaultdict(list)
    for r in metric_tree.search(scratch, metric_tree.integers(df), 2, KEEP).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    # before, a row for each query, and a copy of it for each subtree
    asked = spark.read.parquet(f"{scratch.root}/home-asked")
    n_queries = spark.read.parquet(f"{scratch.root}/queries").count()
    assert asked.count() < n_queries / 2 and asked.agg({"n": "sum"}).first()[0] == n_queries


def test_integer_rows_as_arrays(spark):
    rows = [(k, [k % 7, -(k % 5), k]) for k in range(60)]
    want = {q: [(k + 1, s, c) for k, (s, c) in enumerate(found)] for q, found in plain.nearest_rows(rows, 20, 3, lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)))}
    got = defaultdict(list)
    for r in metric_tree.search(Scratch(spark, "t"), spark.createDataFrame(rows, "vec_id int, vector array<int>"), 20, 3).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert {q: sorted(x) for q, x in got.items()} == want
