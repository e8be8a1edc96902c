"""Exact top-k inner products of integer vectors with an M-tree.

Vectors get one more component that makes all norms equal to the largest; among
such vectors the largest inner product with a query is the smallest distance, a
metric an M-tree can index. The root's entries are regions: every distinct
vector belongs to the nearest of at most PIVOTS sampled ones, and the region
keeps the radius that covers its members. A region is cut into slices of about
SLICE vectors, each of which is one subtree, stored as a row of pages: entries
with covering radius and distance to the parent's object, fan-out FAN_OUT at
most, leaves of at most LEAF vectors.

A query first searches its own region best-first, then, with the k-th best
score so far, every region whose covering ball reaches that close. Queries go
through a subtree BLOCK at a time: each keeps its own bound and the pages it
still needs, the page nearest to any of them comes next, and its entries are
compared with all queries that need it in one matrix product. In a page, the
stored distances rule entries out by the triangle inequality before any
distance is computed. A task holds some subtrees of a region and some queries,
each up to HELD bytes, and a query's best go on from one subtree to the next.

Bounds carry a slack above rounding error and final scores are integers, so that
results are exact, ties to the smaller id. Partial sums of an inner product are
no larger than the largest squared norm: up to 2^24 they are exact in single
precision, up to 2^53 in double; beyond, those near the bound are taken again
on integers of any size.

Defined results: rows that take no part are listed in vectors.py; zero vectors
take part; a score that no long can hold is the nearest long; fewer candidates than `top` are all returned; an empty table gives no
rows; repeated rows are candidates each, except those with the query's own id.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch
from paylens.llm.vectors import Classes

PIVOTS, SLICE, FAN_OUT, LEAF = 32, 4_096, 16, 128
#: Queries that go through a subtree together.
BLOCK = 4_096
#: Bytes of vectors that a task holds of subtrees, and as much of queries.
HELD = 16 << 20
SINGLE, DOUBLE = 1 << 24, 1 << 53
FOUND_SCHEMA = "unit string, c_key string, score long, id long"
PACK_SCHEMA = "region int, mark string, n int, pack binary"
LONGS = (-(1 << 63), (1 << 63) - 1)
#: What components are packed as: a vector's first byte says which, the first that holds all of them.
KINDS = (np.dtype(np.int16), np.dtype(np.int64))


class Space:
    """Distances between padded vectors whose last component evens out the norms."""

    def __init__(self, width: int, square: float) -> None:
        self.width, self.square, self.norm = width, square, math.sqrt(square)
        self.slack = 1e-6 * (self.norm + 1)
        self.exact = square <= DOUBLE
        #: what inner products are taken in, and what vectors are stored as
        self.kind, self.stored = (np.float32, np.int16) if square <= SINGLE else (np.float64, np.float64)
        #: how far a rough score may be from the true one, twice over
        self.room = 0.0 if self.exact else 1e-9 * (square + 1)

    def held(self) -> int:
        """Vectors that fill HELD bytes."""
        return max(1, HELD // max(1, self.width * np.dtype(self.stored).itemsize))

    def matrix(self, packed: list[bytes]) -> np.ndarray:
        """Vectors by row, as they are stored."""
        out = np.zeros((len(packed), self.width), self.stored)
        sizes = np.array([len(x) for x in packed], np.int64)
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join([packed[i] for i in some.tolist()]), np.uint8).reshape(len(some), size)
            for mark, kind in enumerate(KINDS):
                rows = np.flatnonzero(raw[:, 0] == mark)
                if len(rows):
                    values = np.ascontiguousarray(raw[rows, 1:]).view(kind)
                    out[some[rows], : values.shape[1]] = values
        return out

    def lifted(self, plain: np.ndarray) -> np.ndarray:
        plain = plain.astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, self.square - (plain * plain).sum(axis=1)))
        return np.column_stack([plain, rest])

    @staticmethod
    def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - one) ** 2).sum(axis=1))

    def distance_of(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far vectors are whose inner products with queries of these squared norms are `scores`."""
        out = scores * -2.0
        out += squares + self.square
        return np.sqrt(np.maximum(0.0, out, out=out), out=out)


class Page:
    """Entries of one node: rows, distances to the parent's object, and for inner nodes radii and children."""

    __slots__ = ("children", "radii", "rows", "to_parent")

    def __init__(self, rows: np.ndarray | slice, to_parent: np.ndarray, radii: np.ndarray | None, children: list[int] | None) -> None:
        self.rows, self.to_parent, self.radii, self.children = rows, to_parent, radii, children


def build(points: np.ndarray, top_object: np.ndarray) -> tuple[list[Page], np.ndarray]:
    """Bulk-load one subtree, and the order in which its leaves hold the points.

    Page 0 is its top, whose parent object is given; rows of pages are places in
    that order, those of a leaf a slice.
    """
    pages: list[Page | None] = []
    leaves: list[np.ndarray] = []
    held = 0

    def load(rows: np.ndarray, parent: np.ndarray) -> tuple[int, float]:
        nonlocal held
        place = len(pages)
        pages.append(None)
        own = points[rows]
        far = Space.distances(own, parent)
        if len(rows) <= LEAF:
            order = np.argsort(far, kind="stable")
            pages[place] = Page(slice(held, held + len(rows)), far[order], None, None)
            leaves.append(rows[order])
            held += len(rows)
        else:
            seeds = np.linspace(0, len(rows) - 1, FAN_OUT).astype(int)
            gaps = (own * own).sum(axis=1)[:, None] - 2 * own @ own[seeds].T + (own[seeds] ** 2).sum(axis=1)
            nearest = gaps.argmin(axis=1)
            parts = [np.flatnonzero(nearest == s) for s in range(FAN_OUT)]
            if max(map(len, parts)) == len(rows):
                parts = np.array_split(np.arange(len(rows)), FAN_OUT)
            kept = [(s, p) for s, p in zip(seeds, parts, strict=True) if len(p)]
            loaded = [load(rows[p], own[s]) for s, p in kept]
            heads = np.array([s for s, _ in kept])
            pages[place] = Page(rows[heads], far[heads], np.array([r for _, r in loaded]), [c for c, _ in loaded])
        return place, float(far.max())

    load(np.arange(len(points)), top_object)
    order = np.concatenate(leaves)
    places = np.argsort(order)
    for page in pages:
        if page.children is not None:
            page.rows = places[page.rows]
    return pages, order


class Asked:
    """A block of queries, each with its best classes so far and the bounds that follow."""

    def __init__(self, space: Space, vectors: np.ndarray, own: np.ndarray, named: np.ndarray, kth: np.ndarray, keep: int) -> None:
        self.space, self.keep, self.own, self.named = space, keep, own, named
        self.points = vectors.astype(space.kind)
        self.squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.least = kth - space.room
        self.bound = space.distance_of(self.squares, kth) + space.slack
        self.n_found = np.zeros(len(vectors), np.int64)
        self.scores = np.zeros((len(vectors), keep), np.float64 if space.exact else object)
        self.ids, self.rows = np.zeros((2, len(vectors), keep), np.int64)
        self.open: list[tuple[np.ndarray, ...]] = []
        self.memory = np.zeros(0, space.kind), np.zeros(0, bool)

    def products(self, who: np.ndarray, objects: np.ndarray) -> np.ndarray:
        """Inner products, in memory that the next call takes again."""
        points = self.points if len(who) == len(self.points) else self.points[who]
        n = len(who) * len(objects)
        if n > len(self.memory[0]):
            self.memory = np.zeros(n, self.space.kind), np.zeros(n + 8, bool)
        return np.matmul(points, objects.T, out=self.memory[0][:n].reshape(len(who), len(objects)))

    def compare(self, who: np.ndarray, objects: np.ndarray, first: np.ndarray, second: np.ndarray, start: int) -> None:
        """Take in those of some classes, whose rows begin at `start`, that may be among the best of the queries `who`."""
        rough = self.products(who, objects)
        named = np.flatnonzero(self.named[who])
        if len(named):
            some = rough[named]
            some[(self.own[who[named]][:, None] == first) & (first == second)] = -np.inf
            rough[named] = some
        least = self.least[who]
        bare = np.flatnonzero(least == -np.inf)
        if len(bare) and len(objects) > self.keep:
            least[bare] = np.partition(rough[bare], -self.keep, axis=1)[:, -self.keep] - self.space.room
        # flags eight at a time, as few are set
        flags = self.memory[1][: -(-rough.size // 8) * 8]
        flags[rough.size :] = False
        np.greater_equal(rough, least.astype(rough.dtype)[:, None], out=flags[: rough.size].reshape(rough.shape))
        words = np.flatnonzero(flags.view(np.uint64))
        word, bit = np.nonzero(flags.reshape(-1, 8)[words])
        at = words[word] * 8 + bit
        if not len(at):
            return
        query, row = np.divmod(at, len(objects))
        scores = rough.ravel()[at].astype(np.float64)
        ids = first[row]
        if len(named):
            fine = scores > -np.inf
            query, row, scores, ids = query[fine], row[fine], scores[fine], ids[fine]
            mine = self.named[who[query]] & (ids == self.own[who[query]])
            ids = np.where(mine, second[row], ids)
        query = who[query]
        if not self.space.exact:
            pairs = zip(self.points[query].tolist(), objects[row].tolist(), strict=True)
            scores = np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in pairs], object)
        self.open.append((query, scores, ids, row + start))
        if sum(len(x[0]) for x in self.open) >= len(self.points) / 4:
            self.settle()

    def settle(self) -> None:
        """Sort what was taken in, ties by the smaller id, and draw the bounds in."""
        if not self.open:
            return
        query, scores, ids, rows = (np.concatenate(x) for x in zip(*self.open, strict=True))
        self.open = []
        touched = np.unique(query)
        old = np.arange(self.keep) < self.n_found[touched][:, None]
        query = np.concatenate([np.repeat(touched, self.n_found[touched]), query])
        scores, ids, rows = (np.concatenate([x[touched][old], y]) for x, y in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((ids, -scores, query)) if self.space.exact else np.array(sorted(range(len(query)), key=lambda k: (query[k], -scores[k], ids[k])))
        query = query[order]
        starts = np.searchsorted(query, touched)
        sizes = np.diff(np.append(starts, len(query)))
        rank = np.arange(len(query)) - np.repeat(starts, sizes)
        best = rank < self.keep
        query, rank, order = query[best], rank[best], order[best]
        self.scores[query, rank], self.ids[query, rank], self.rows[query, rank] = scores[order], ids[order], rows[order]
        self.n_found[touched] = np.minimum(sizes, self.keep)
        full = touched[sizes >= self.keep]
        kth = self.scores[full, -1].astype(np.float64)
        self.least[full] = np.maximum(self.least[full], kth - self.space.room)
        self.bound[full] = np.minimum(self.bound[full], self.space.distance_of(self.squares[full], kth) + self.space.slack)


def best_first(pages: list[Page], objects: np.ndarray, first: np.ndarray, second: np.ndarray, start: int, asked: Asked, to_top: np.ndarray) -> None:
    """Take a block of queries through one subtree, whose rows begin at `start`."""
    space, ties = asked.space, count()
    todo = [(0.0, next(ties), pages[0], np.arange(len(to_top)), np.zeros(len(to_top)), to_top)]
    while todo:
        nearest, _, page, who, least, to_parent = heapq.heappop(todo)
        if nearest > asked.bound.max():
            break
        fine = least <= asked.bound[who]
        if not fine.any():
            continue
        who = who if fine.all() else who[fine]
        if isinstance(page, slice):
            asked.compare(who, objects[page], first[page], second[page], start + page.start)
            continue
        to_parent = to_parent if len(to_parent) == len(who) else to_parent[fine]
        bound = asked.bound[who]
        if page.children is None:
            # entries are in the order of their distance to the parent's object
            low = int(np.searchsorted(page.to_parent, (to_parent - bound).min()))
            high = int(np.searchsorted(page.to_parent, (to_parent + bound).max(), "right"))
            if low < high:
                rows = slice(page.rows.start + low, page.rows.start + high)
                asked.compare(who, objects[rows], first[rows], second[rows], start + rows.start)
        else:
            # a row for each entry
            gap = to_parent - page.to_parent[:, None]
            np.abs(gap, out=gap)
            gap -= page.radii[:, None]
            near = gap <= bound
            entries = np.flatnonzero(near.any(axis=1))
            far = space.distance_of(asked.squares[who], np.ascontiguousarray(asked.products(who, objects[page.rows[entries]]).T, np.float64))
            low = far - (page.radii[entries, None] + space.slack)
            near = near[entries] & (low <= bound)
            children = [pages[page.children[i]] for i in entries.tolist()]
            if near.mean() > 0.5 and all(x.children is None for x in children):
                # leaves that most of the queries need, and that lie side by side, are one to compare with
                some = np.flatnonzero(near.any(axis=0))
                low = low.min(axis=0)[some]
                rows = slice(children[0].rows.start, children[-1].rows.stop)
                heapq.heappush(todo, (float(low.min()), next(ties), rows, who[some], low, None))
                continue
            for k, child in enumerate(children):
                if near[k].all():
                    heapq.heappush(todo, (float(low[k].min()), next(ties), child, who, low[k], far[k]))
                elif near[k].any():
                    some = np.flatnonzero(near[k])
                    heapq.heappush(todo, (float(low[k, some].min()), next(ties), child, who[some], low[k, some], far[k, some]))
    asked.settle()


def _assign(batches, pivots: np.ndarray, space: Space):
    """Region, its distance, and the vector itself."""
    for batch in batches:
        lifted = space.lifted(space.matrix(batch.column("vector").to_pylist()))
        gaps = (lifted * lifted).sum(axis=1)[:, None] - 2 * lifted @ pivots.T + (pivots**2).sum(axis=1)
        region = gaps.argmin(axis=1)
        far = np.sqrt(((lifted - pivots[region]) ** 2).sum(axis=1))
        yield pa.record_batch(
            {
                "region": pa.array(region.astype(np.int32)),
                "far": pa.array(far),
                **{c: batch.column(c) for c in batch.schema.names},
            }
        )


def _tree(group: pd.DataFrame, pivots: np.ndarray, space: Space) -> pd.DataFrame:
    """One subtree as a row; its bytes hold pages, vectors, keys and ids of at most a slice."""
    group = group.sort_values("first_id", kind="stable")
    region = int(group["region"].iloc[0])
    points = space.matrix(group["vector"].tolist())
    pages, order = build(space.lifted(points), pivots[region])
    flat = [(p.rows, p.to_parent, p.radii, p.children) for p in pages]
    keys = np.array(group["key"].tolist(), "S")[order]
    stored = pickle.dumps((flat, points[order], keys, group["first_id"].to_numpy()[order], group["second_id"].to_numpy()[order]))
    return pd.DataFrame({"region": [region], "slice": [int(group["slice"].iloc[0])], "tree": [zlib.compress(stored, 1)]})


def _search(trees: pd.DataFrame, packs: pd.DataFrame, pivots: np.ndarray, space: Space, keep: int) -> pd.DataFrame:
    names = ["unit", "c_key", "score", "id"]
    if not len(trees) or not len(packs):
        return pd.DataFrame([], columns=names)
    pivot = pivots[int(trees["region"].iloc[0])][:-1]
    held = [pickle.loads(zlib.decompress(x)) for x in trees["tree"]]
    held = [([Page(*p) for p in flat], *x) for flat, *x in held]
    starts = np.cumsum([0, *(len(x[1]) for x in held)])
    keys = np.concatenate([x[2] for x in held])
    units, vectors, own, named, kth, home = (np.concatenate(x) for x in zip(*(pickle.loads(zlib.decompress(x)) for x in packs["pack"]), strict=True))
    # queries of a region next to each other
    order = np.argsort(home, kind="stable")
    out = []
    for at in range(0, len(order), BLOCK):
        some = order[at : at + BLOCK]
        asked = Asked(space, vectors[some], own[some], named[some], kth[some], keep)
        to_top = space.distance_of(asked.squares, vectors[some].astype(np.float64) @ pivot)
        for (pages, points, _, first, second), start in zip(held, starts.tolist(), strict=False):
            best_first(pages, points.astype(space.kind), first, second, start, asked, to_top)
        found = np.arange(keep) < asked.n_found[:, None]
        scores = asked.scores[found]
        scores = scores.astype(np.int64) if space.exact else np.array([min(max(x, LONGS[0]), LONGS[1]) for x in scores], np.int64)
        out.append((units[some][np.nonzero(found)[0]], keys[asked.rows[found]].astype("U").astype(object), scores, asked.ids[found]))
    return pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))


def _packs(batches, pivots: np.ndarray, radii: np.ndarray, space: Space, home: bool):
    """Queries by the region they are to search, packed: their own one, or the others whose balls the bound reaches."""

    def packed(batch: pa.RecordBatch):
        stored = space.matrix(batch.column("vector").to_pylist())
        vectors = stored.astype(np.float64)
        region = batch.column("region").to_numpy()
        kth = np.array([-np.inf if x is None or x <= LONGS[0] else float(x) for x in batch.column("kth").to_pylist()])
        own = batch.column("own").to_pylist()
        units = np.array(batch.column("unit").to_pylist(), object)
        named = np.array([x is not None for x in own])
        own = np.array([int(x or 0) for x in own])
        if home:
            goes = region[:, None] == np.arange(len(pivots))
        else:
            squares = (vectors * vectors).sum(axis=1)
            bound = space.distance_of(squares, kth) + space.slack
            far = space.distance_of(squares[:, None], vectors @ pivots[:, :-1].T)
            goes = (far - radii - space.slack <= bound[:, None]) & (radii >= 0) & (region[:, None] != np.arange(len(pivots)))
        rows = []
        for r in np.flatnonzero(goes.any(axis=0)).tolist():
            some = np.flatnonzero(goes[:, r])
            pack = pickle.dumps((units[some], stored[some], own[some], named[some], kth[some], region[some]))
            rows.append((r, units[some[0]], len(some), zlib.compress(pack, 1)))
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["region", "mark", "n", "pack"])

    wait: list[pa.RecordBatch] = []
    for batch in batches:
        wait.append(batch)
        if sum(x.num_rows for x in wait) >= BLOCK:
            yield packed(pa.concat_batches(wait))
            wait = []
    if wait:
        yield packed(pa.concat_batches(wait))


def _pack(batches, scale: float | None):
    """Vectors without null or infinite components as bytes, their components floor(scale * x) if there is a scale."""
    for batch in batches:
        ids, column = batch.column("vec_id"), batch.column("vector")
        fine = np.asarray(ids.is_valid()) & np.asarray(column.is_valid())
        ids, column = ids.filter(pa.array(fine)), column.filter(pa.array(fine))
        flat, lengths = column.flatten(), np.diff(column.offsets.to_numpy())
        ends = np.cumsum(lengths)
        good = np.asarray(flat.is_valid())
        values = flat.fill_null(0).to_numpy(zero_copy_only=False)
        if scale is not None:
            values = values.astype(np.float64)
            good &= np.isfinite(values)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale)
                whole = values.astype(np.int64)
            values = np.where(values >= float(1 << 63), LONGS[1], np.where(values < float(LONGS[0]), LONGS[0], whole))
        bad = np.concatenate([[0], np.cumsum(~good)])
        fine = bad[ends] == bad[ends - lengths]
        out: list[bytes] = [b""] * len(ids)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(fine & (lengths == length))
            block = values[(ends - lengths)[rows][:, None] + np.arange(length)].astype(np.int64)
            least, most = np.iinfo(KINDS[0]).min, np.iinfo(KINDS[0]).max
            small = ((block >= least) & (block <= most)).all(axis=1)
            for mark, some in enumerate((small, ~small)):
                for i, x in zip(rows[some].tolist(), block[some].astype(KINDS[mark]), strict=True):
                    out[i] = bytes([mark]) + x.tobytes()
        yield pa.record_batch({"vec_id": ids, "vector": pa.array(out, pa.binary())}).filter(pa.array(fine))


def packed(rows: DataFrame, vec_id: str, vector: str, scale: float | None) -> DataFrame:
    """(vec_id, vector) of the rows that take part, vectors as bytes."""
    kinds, plain = ("float", "double"), "double"
    if scale is None:
        kinds, plain = ("tinyint", "smallint", "int", "bigint"), "bigint"
    x = F.col(vector)
    if dict(rows.dtypes)[vector] not in [f"array<{k}>" for k in kinds]:
        x = x.cast(f"array<{plain}>")
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("vector")).mapInArrow(partial(_pack, scale=scale), "vec_id long, vector binary")


def integers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, vector) with floor(scale * x) of every component, x as a double; vectors as bytes."""
    return packed(rows, vec_id, vector, scale)


def _sizes(batches):
    """Width and squared norm of the widest and the longest of some vectors."""
    for batch in batches:
        vectors = batch.column("vector").to_pylist()
        width = max((len(x) // KINDS[x[0]].itemsize for x in vectors), default=0)
        square = (Space(width, math.inf).matrix(vectors) ** 2).sum(axis=1).max(initial=0.0)
        yield pa.record_batch({"width": pa.array([width], pa.int32()), "square": pa.array([square], pa.float64())})


def search(scratch: Scratch, rows: DataFrame, every: int, top: int, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, integer vector, also as bytes) whose vec_id is divisible by `every`."""
    spark = scratch.spark
    keep = top + 1
    if dict(rows.dtypes)["vector"] != "binary":
        rows = packed(rows, "vec_id", "vector", None)
    # the key stands for the vector's values
    some = rows.select("vec_id", "vector", F.md5("vector").alias("key"))
    classes = Classes(scratch, some, F.pmod(F.col("vec_id"), F.lit(every)) == 0, top)
    distinct = classes.distinct
    size = distinct.select("vector").mapInArrow(_sizes, "width int, square double").agg(F.max("width").alias("width"), F.max("square").alias("square")).first()
    if size["width"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(size["width"], size["square"])
    drawn = distinct.orderBy(F.xxhash64("key", F.lit(seed))).select("vector").limit(PIVOTS).collect()
    pivots = space.lifted(space.matrix([r["vector"] for r in drawn]))

    placed = distinct.select("key", "vector", "first_id", "second_id").mapInArrow(
        partial(_assign, pivots=pivots, space=space), "region int, far double, key string, vector binary, first_id long, second_id long"
    )
    placed = scratch.table(placed, "placed")
    # at most PIVOTS rows
    sizes = {r["region"]: r for r in placed.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    radii = np.array([sizes[r]["far"] if r in sizes else -1.0 for r in range(len(pivots))])
    slices = spark.createDataFrame([(r, max(1, math.ceil(x["n"] / SLICE))) for r, x in sizes.items()], "region int, slices int")
    cut = placed.join(F.broadcast(slices), "region")
    members = cut.withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    trees = members.select("region", "slice", "key", "first_id", "second_id", "vector").groupBy("region", "slice")

    def tree_of(group: pd.DataFrame) -> pd.DataFrame:
        return _tree(group, pivots, space)

    def search_in(trees: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        return _search(trees, packs, pivots, space, keep)

    each = max(1, space.held() // SLICE)
    trees = scratch.table(trees.applyInPandas(tree_of, "region int, slice int, tree binary"), "trees")
    trees = trees.select("region", F.floor(F.col("slice") / each).cast("int").alias("chunk"), "tree")
    chunks = slices.select("region", F.ceil(F.col("slices") / each).cast("int").alias("chunks"))

    def visit(queries: DataFrame, name: str, home: bool) -> DataFrame:
        # queries of a region are cut as well; each part meets a copy of each chunk of the region's subtrees
        packs = queries.mapInArrow(partial(_packs, pivots=pivots, radii=radii, space=space, home=home), PACK_SCHEMA)
        packs = scratch.table(packs, f"{name}-asked")
        asks = packs.groupBy("region").agg(F.ceil(F.sum("n") / space.held()).cast("int").alias("asks"))
        spread = packs.join(F.broadcast(chunks.join(asks, "region")), "region")
        spread = spread.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        spread = spread.withColumn("ask", F.pmod(F.xxhash64("mark"), F.col("asks")).cast("int"))
        spread = spread.select("region", "chunk", "ask", "pack").groupBy("region", "chunk", "ask")
        copies = trees.join(F.broadcast(asks), "region").withColumn("ask", F.explode(F.expr("sequence(0, asks - 1)"))).drop("asks")
        found = copies.groupBy("region", "chunk", "ask").cogroup(spread)
        return scratch.table(found.applyInPandas(search_in, FOUND_SCHEMA), name)

    asked = placed.select("key", "region").join(classes.queries, "key").select("region", "unit", "own", "vector")
    home = visit(asked.withColumn("kth", F.lit(None).cast("long")), "home", True)
    kth = home.groupBy("unit").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = kth.select("unit", F.expr(f"try_element_at(s, {keep})").alias("kth"))
    away = visit(asked.join(kth, "unit", "left"), "away", False)
    # the best of a query over all tasks, as each of them has chosen
    order = Window.partitionBy("unit").orderBy(F.desc("score"), "id")
    best = home.unionByName(away).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep)
    return classes.expand(best.select("unit", "c_key", "score"))
