"""Near-duplicate documents by b-bit MinHash.

Each document's word shingles are hashed to 64 bits. Of BANDS x ROWS minima a
band's ROWS together give one bucket key; documents with one key are candidates.
Of every minimum only LOW_BITS bits are kept besides, packed as bit planes:
comparing two documents is an XOR and a bit count, corrected for minima that
agree in these bits by chance. Candidates whose estimate is far below the
threshold are dropped, the others confirmed on the full shingle sets. A pair at
similarity 0.8 shares no bucket with probability (1 - 0.8^5)^38 = 3e-7, and the
estimate's margin is five standard deviations.

Documents with equal sets form one class beforehand; only its first row goes
on. Inside a bucket not all pairs are made: small buckets are compared in full,
large ones with one pivot, which connects a group of near copies. A bucket whose
members lie in several components after that stays open. Open buckets that share
documents form a group, and a group is compared in blocks: every two of its
blocks of some BLOCK documents meet in one task, where signatures are estimated
by bit counts and likely pairs confirmed on the full sets, and which hands on
only links that connect something. So each pair of a bucket is tested or already
known to be connected: no cap, and no row for every pair.

Defined results: a null or word-less text has no shingles and links with
nothing; a text shorter than a shingle is one shingle; rows with equal sets are
one class; a null doc_id never names a component that has another id; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, small_batches, text_of
from paylens.llm.components import components
from paylens.llm.tokens import together

BANDS, ROWS, LOW_BITS = 38, 5, 4
MINIMA = BANDS * ROWS
WORDS64 = -(-MINIMA // 64)
SMALL_BUCKET = 16
ORDERS = 6
#: Documents of an open group's block on average, and shingles whose occurrences in two blocks are counted together.
BLOCK, COLUMNS = 512, 4096
#: Rows of a few numbers each that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
CHUNK = 1 << 15
SIGNATURE_SCHEMA = (
    "rid long, doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, packed array<long>"
)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a, b = rng.integers(0, 1 << 64, size=(2, MINIMA), dtype=np.uint64)
    return a | np.uint64(1), b


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, one text after the other, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
    empty = np.array([w == "" for w in coded.dictionary.to_pylist()] or [True])
    which = coded.indices.to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(which) and empty.any():
        gone = empty[which]
        text_of_word = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(text_of_word[gone], minlength=len(counts))
        which = which[~gone]
    hashes = own[which] if len(which) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = _mixed(rolled * ODD + hashes[k : k + len(rolled)])
    ends = np.cumsum(counts)
    sets, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if not n:
            continue
        if n < words:
            one = np.array([xxhash.xxh3_64_intdigest(hashes[end - n : end].tobytes(), seed=n)], dtype=np.uint64)
        else:
            one = np.sort(rolled[end - n : end - words + 1])
            if len(one) > 1:
                one = one[np.concatenate(([True], one[1:] != one[:-1]))]
        sets.append(one)
        sizes[i] = len(one)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def minima(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MINIMA x texts; every text has at least one shingle."""
    a, b = _multipliers()
    out = np.full((MINIMA, len(sizes)), np.iinfo(np.uint64).max, dtype=np.uint64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        begin = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
        for at in range(begin, int(ends[last - 1]), CHUNK):
            stop = min(at + CHUNK, int(ends[last - 1]))
            part = flat[at:stop]
            heads = np.maximum(ends[first:last] - sizes[first:last], at) - at
            room = np.empty_like(part)
            for k in range(MINIMA):
                np.multiply(part, a[k], out=room)
                np.add(room, b[k], out=room)
                np.minimum(out[k, first:last], np.minimum.reduceat(room, heads), out=out[k, first:last])
        first = last
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """texts x BANDS"""
    keys = np.empty((low.shape[1], BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(low.shape[1], (band + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1, dtype=np.uint64)
        for row in range(ROWS):
            key = _mixed((key ^ low[band * ROWS + row]) * ODD)
        keys[:, band] = key
    return keys.view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """texts x (LOW_BITS * WORDS64): bit planes of LOW_BITS bits of each minimum."""
    planes = np.zeros((low.shape[1], LOW_BITS * WORDS64), dtype=np.uint64)
    for k in range(MINIMA):
        for bit in range(LOW_BITS):
            planes[:, bit * WORDS64 + k // 64] |= ((low[k] >> np.uint64(32 + bit)) & np.uint64(1)) << np.uint64(k % 64)
    return planes.view(np.int64)


def _lists(values: np.ndarray, which: np.ndarray, n: int) -> pa.Array:
    """Rows of `values` for the texts `which` of n, empty lists for the others."""
    lengths = np.zeros(n, dtype=np.int32)
    lengths[which] = values.shape[1] if len(values) else 0
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values.reshape(-1)))


def _signatures(batches, words: int):
    rid = TaskContext.get().partitionId() << 33
    for batch in together(batches, "text", 8 << 20):
        n = batch.num_rows
        if not n:
            continue
        flat, sizes = shingle_sets(batch.column("text"), words)
        some = np.flatnonzero(sizes)
        low = minima(flat, sizes[some])
        ends = np.cumsum(sizes)
        keys: list[bytes | None] = [None] * n
        for i in some.tolist():
            keys[i] = xxhash.xxh3_128_digest(flat[ends[i] - sizes[i] : ends[i]].tobytes())
        yield pa.record_batch(
            {
                "rid": pa.array(np.arange(rid, rid + n)),
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "n_shingles": pa.array(sizes),
                "set_key": pa.array(keys, type=pa.binary()),
                "bands": _lists(band_keys(low), some, n),
                "packed": _lists(packed_bits(low), some, n),
            }
        )
        rid += n


def _sets(batches, words: int):
    for batch in together(batches, "text", 8 << 20):
        if batch.num_rows:
            flat, sizes = shingle_sets(batch.column("text"), words)
            bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.record_batch(
                {"rid": batch.column("rid"), "shingles": pa.ListArray.from_arrays(bounds, pa.array(flat.view(np.int64)))}
            )


def estimate(x: str, y: str):
    """Similarity of two packed signatures, corrected for agreement by chance."""
    differ = None
    for word in range(WORDS64):
        plane = None
        for bit in range(LOW_BITS):
            at = bit * WORDS64 + word
            one = F.col(x)[at].bitwiseXOR(F.col(y)[at])
            plane = one if plane is None else plane.bitwiseOR(one)
        count = F.bit_count(plane)
        differ = count if differ is None else differ + count
    chance = 2.0**-LOW_BITS
    return (1 - differ / F.lit(float(MINIMA)) - chance) / (1 - chance)


def least_estimate(threshold_pct: int) -> float:
    """The threshold less five standard deviations of the estimate there."""
    chance, threshold = 2.0**-LOW_BITS, threshold_pct / 100
    agree = threshold + (1 - threshold) * chance
    return threshold - 5 * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`estimate` of every row of packed signatures x with every row of y."""
    differ = np.zeros((len(x), len(y)), dtype=np.int32)
    for word in range(WORDS64):
        plane = np.zeros((len(x), len(y)), dtype=np.uint64)
        for bit in range(LOW_BITS):
            at = bit * WORDS64 + word
            plane |= x[:, at, None] ^ y[None, :, at]
        differ += np.bitwise_count(plane)
    chance = 2.0**-LOW_BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y; sets are sorted and distinct."""
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    if not x or not y:
        return out
    flat = [np.concatenate(sets) for sets in (x, y)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    rows = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (x, y)]
    for at in range(0, len(both), COLUMNS):
        own = both[at : at + COLUMNS]
        held = []
        for values, row, sets in zip(flat, rows, (x, y), strict=True):
            place = np.minimum(np.searchsorted(own, values), len(own) - 1)
            hit = own[place] == values
            matrix = np.zeros((len(sets), len(own)), dtype=np.float32)
            matrix[row[hit], place[hit]] = 1
            held.append(matrix)
        out += held[0] @ held[1].T
    return out


def block_links(x: dict, y: dict | None, threshold_pct: int) -> list[tuple[int, int]]:
    """Links between two blocks, or inside one (y None), that connect components; a block is a dict of columns."""
    other = x if y is None else y
    na, nb = x["n_shingles"][:, None], other["n_shingles"][None, :]
    wanted = (x["comp"][:, None] != other["comp"][None, :]) & (100 * np.minimum(na, nb) >= threshold_pct * np.maximum(na, nb))
    if y is None:
        wanted &= np.triu(np.ones(wanted.shape, dtype=bool), 1)
    wanted &= estimates(x["packed"], other["packed"]) >= least_estimate(threshold_pct)
    some, others = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    common = common_counts([x["shingles"][k] for k in some], [other["shingles"][k] for k in others]).astype(np.int64)
    total = x["n_shingles"][some][:, None] + other["n_shingles"][others][None, :]
    linked = wanted[np.ix_(some, others)] & (100 * common >= threshold_pct * (total - common))
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    out = []
    for i, j in np.argwhere(linked).tolist():
        a, b = root(int(x["comp"][some[i]])), root(int(other["comp"][others[j]]))
        if a != b:
            up[a] = b
            out.append((int(x["rid"][some[i]]), int(other["rid"][others[j]])))
    return out


def _columns(batch: pa.RecordBatch) -> dict:
    sets = batch.column("shingles")
    ends = sets.offsets.to_numpy()
    flat = sets.values.to_numpy().view(np.uint64)
    packed = batch.column("packed").flatten().to_numpy().view(np.uint64)
    out = {c: batch.column(c).to_numpy() for c in ("rid", "comp", "n_shingles")}
    out["packed"] = packed.reshape(batch.num_rows, LOW_BITS * WORDS64)
    out["shingles"] = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def _compared(batches, threshold_pct: int):
    """Rows sorted by (g, i, j): blocks i and j of group g, compared when both are whole."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        first = rows.column("block").to_numpy() == i
        x = _columns(rows.filter(pa.array(first)))
        y = None if i == j else _columns(rows.filter(pa.array(~first)))
        found = block_links(x, y, threshold_pct)
        return pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("g", "i", "j")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            key = tuple(keys[a].tolist())
            if held and key != now:
                yield whole(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield whole(held)


class NearDuplicates:
    """The stages of one run; `threshold_pct` of the union must be shared."""

    def __init__(self, scratch: Scratch, docs: DataFrame, words: int = 5, threshold_pct: int = 80) -> None:
        self.scratch, self.words, self.threshold_pct = scratch, words, threshold_pct
        small_batches(scratch.spark)
        self.texts = text_of(docs).withColumn("text_key", F.xxhash64("text"))
        self.signatures = scratch.table(self.texts.mapInArrow(partial(_signatures, words=words), SIGNATURE_SCHEMA), "signatures")
        self.sets: DataFrame | None = None

    def links(self) -> DataFrame:
        """Confirmed links (a, b) between first rows of classes, enough to connect every component."""
        scratch = self.scratch
        some = self.signatures.filter("n_shingles > 0")
        first = some.groupBy("set_key").agg(F.min("rid").alias("rid")).select("rid")
        nodes = scratch.table(some.join(first, "rid").select("rid", "doc_id", "text_key", "n_shingles", "bands", "packed"), "nodes")
        rows = nodes.select("rid", F.col("n_shingles").alias("size"), F.explode("bands").alias("h"))
        # a bucket's first pivot by one of ORDERS random orders: groups of copies get that many pivots in all
        rows = rows.withColumn("rank", F.xxhash64("rid", F.pmod("h", F.lit(ORDERS))))
        shared = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("rank").alias("least")).filter("n > 1")
        members = rows.join(shared, "h").select("h", "rid", "size", "n", (F.col("rank") == F.col("least")).alias("leads"))
        members = scratch.table(members, "members")

        marked = members.withColumn("pivot", F.col("leads") | (F.col("n") <= SMALL_BUCKET))
        pivots = marked.filter("pivot").select("h", F.col("rid").alias("p"), F.col("size").alias("p_size"))
        sized = F.least("size", "p_size") * 100 >= F.greatest("size", "p_size") * self.threshold_pct
        new = (F.col("rid") != F.col("p")) & (~F.col("pivot") | (F.col("rid") < F.col("p"))) & sized
        pairs = marked.join(pivots, "h").filter(new).select(F.least("rid", "p").alias("a"), F.greatest("rid", "p").alias("b"))
        confirmed = self._confirm(scratch.table(pairs.distinct(), "pairs"), nodes)
        comps = components(scratch, confirmed, "pivots").withColumnRenamed("node", "rid")
        labelled = members.filter(F.col("n") > SMALL_BUCKET).select("h", "rid").join(comps, "rid", "left")
        labelled = scratch.table(labelled.withColumn("comp", F.coalesce("comp", "rid")), "labelled")
        ends = labelled.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("rid").alias("lead")).filter("x <> y")
        rest = scratch.table(labelled.join(ends.select("h", "lead"), "h").select("rid", "comp", "lead"), "open")
        return confirmed.union(self._in_blocks(rest, nodes)) if rest.take(1) else confirmed

    def _in_blocks(self, rest: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links inside the groups of open buckets; `rest` has a row (rid, comp, lead) for a member of a bucket led by `lead`."""
        scratch = self.scratch
        groups = components(scratch, rest.select(F.col("rid").alias("a"), F.col("lead").alias("b")), "open")
        groups = groups.select(F.col("node").alias("rid"), F.col("comp").alias("g"))
        blocks = groups.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        docs = groups.join(rest.select("rid", "comp").distinct(), "rid").join(blocks, "g")
        docs = scratch.table(docs.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")), "grouped")
        held = self._small(docs.select("rid"), "grouped-ids")
        sets = self._held_sets(held, nodes, "grouped")
        known = nodes.join(held, "rid", "left_semi").select("rid", "n_shingles", "packed")
        rows = docs.join(known, "rid").join(sets, "rid").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        rows = rows.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "comp", "n_shingles", "packed", "shingles")
        rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
        return scratch.table(rows.mapInArrow(partial(_compared, threshold_pct=self.threshold_pct), "a long, b long"), "block-links")

    def _small(self, df: DataFrame, name: str) -> DataFrame:
        """`df` as a table, broadcast if it is small enough."""
        df = self.scratch.table(df, name)
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def _held_sets(self, held: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """(rid, shingles) of the rows `held` (rid), from the texts where they were not made before."""
        need = held if self.sets is None else held.join(self.sets.select("rid"), "rid", "left_anti")
        need = nodes.join(need, "rid", "left_semi").select("rid", F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
        need = self._small(need, f"{name}-need")
        found = self.texts.join(need, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
        found = found.select("rid", "text").dropDuplicates(["rid"]).mapInArrow(partial(_sets, words=self.words), "rid long, shingles array<long>")
        fresh = self.scratch.table(found, f"{name}-sets")
        self.sets = fresh if self.sets is None else self.sets.union(fresh)
        return self.sets.join(held, "rid", "left_semi")

    def _confirm(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) that share enough of their full sets."""
        scratch = self.scratch
        known = nodes.select("rid", "n_shingles", "packed")
        x, y = known.toDF("a", "na", "pa"), known.toDF("b", "nb", "pb")
        likely = pairs.join(x, "a").join(y, "b").filter(estimate("pa", "pb") >= least_estimate(self.threshold_pct)).select("a", "b", "na", "nb")
        likely = scratch.table(likely, "likely")
        held = self._small(likely.select(F.col("a").alias("rid")).union(likely.select("b")).distinct(), "likely-ids")
        sets = self._held_sets(held, nodes, "likely")
        x, y = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        common = F.size(F.array_intersect("sa", "sb"))
        exact = likely.join(x, "a").join(y, "b").withColumn("common", common)
        exact = exact.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * self.threshold_pct)
        return scratch.table(exact.select("a", "b"), "links")

    def result(self) -> DataFrame:
        """Per row: doc_id, text_key, n_shingles, component_id, rid, keeper (the one row of its component that stays)."""
        scratch = self.scratch
        links = self.links()
        comps = components(scratch, links, "last").withColumnRenamed("node", "rid")
        some = self.signatures.filter("n_shingles > 0")
        key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
        classes = some.groupBy("set_key").agg(F.min("rid").alias("rid"), F.min(key).alias("best"))
        classes = scratch.table(
            classes.join(comps, "rid", "left").select("set_key", F.coalesce("comp", "rid").alias("comp"), "best"), "classes"
        )
        best = classes.groupBy("comp").agg(F.min("best").alias("best"))
        named = classes.select("set_key", "comp").join(best, "comp").select(
            "set_key", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("keeper_rid")
        )
        kept = ["doc_id", "text_key", "n_shingles", "rid"]
        linked = some.join(named, "set_key").select(*kept, "component_id", (F.col("rid") == F.col("keeper_rid")).alias("keeper"))
        alone = self.signatures.filter("n_shingles = 0").select(*kept, F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
        return linked.unionByName(alone)


def keep_one(scratch: Scratch, docs: DataFrame, words: int = 5, threshold_pct: int = 80) -> DataFrame:
    """The documents that stay: all columns of one row per component.

    Rows that repeat both doc_id and text cannot be told apart and are reduced
    to one of them.
    """
    rows = NearDuplicates(scratch, docs, words, threshold_pct).result()
    keys = rows.groupBy("doc_id", "text_key").agg(F.max("keeper").alias("stays"), F.count("*").alias("n"))
    keys = scratch.table(keys.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "stays", "n"), "keys")
    names = [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("k"))
    stays = placed.join(keys.filter("not stays").select("d", "k"), same, "left_anti")
    repeated = keys.filter("stays and n > 1").select("d", "k")
    if repeated.take(1):
        once = stays.join(repeated, same, "left_semi").dropDuplicates([doc_id, text])
        stays = stays.join(repeated, same, "left_anti").unionByName(once)
    return stays.toDF(*docs.columns)
