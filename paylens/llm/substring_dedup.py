"""Removal of bytes covered by a long string that also starts elsewhere.

A sparse suffix array stands for the full one. Anchors are positions whose
8-byte hash is the least among some SPAN neighbours, so that equal windows of
`LENGTH` bytes hold anchors at the same places, one of them among their first
SPAN positions. Two equal windows therefore share an anchor and the CORE =
LENGTH - SPAN bytes after it; anchors whose core occurs once are dropped by a
count that combines before the shuffle.

The others are suffixes to be ordered. An anchor's context is its core with
SPAN bytes on either side, which decides every window that has this anchor.
Contexts that occur twice are repeated as a whole. Of the rest, those with one
core are sorted deep-shallow, forwards by what follows the core and backwards
by what precedes it; in the two arrays the windows with d bytes before the
anchor are equal where both common prefixes reach d and SPAN - d. A core with
very many contexts is first split by ranges of d and the bytes that all windows
of a range share, again and again; contexts that agree on all bytes a range
reaches have their spans and go on as one: no group above `GROUP` contexts is
ever sorted in one task, and a range that all share ends at once.

Texts with an exact copy are removed as a whole if they are long enough, and
only one of them takes part in the rest.

Defined results: a null text has no bytes, texts shorter than LENGTH lose
nothing, rows repeated in full are copies of each other, an empty table gives no
rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, small_batches, text_of
from paylens.llm.suffix_sort import common_prefix, deep_shallow_order
from paylens.llm.tokens import together

LENGTH, SPAN = 400, 128
CORE = LENGTH - SPAN
GROUP = 1_000
#: Members of a group up to which the common prefixes of every two are held; larger groups go through the depths.
TABLE = 64
CHUNK_BYTES = 1 << 19
ANCHOR_SCHEMA = "rid long, doc_id long, text_key long, n_bytes long, sha256 string, pos array<int>, core array<long>"
AFFECTED_SCHEMA = "rid long, text string, pos array<int>, core array<long>, full array<long>"
CONTEXT_SCHEMA = "rid long, pos int, core long, single boolean, left_part binary, right_part binary"


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of values[j : j + width] for every j that has so many."""
    n = len(values)
    blocks = -(-n // width)
    pick = np.minimum if least else np.maximum
    padded = np.full(blocks * width, np.iinfo(values.dtype).max if least else 0, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = pick.accumulate(rows, axis=1).reshape(-1)
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray) -> np.ndarray:
    """Positions that are the least of some window of SPAN positions, by the hash of the 8 bytes there."""
    if len(raw) < SPAN + 7:
        return np.empty(0, np.int64)
    grams = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    hashes = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    least = _sliding(hashes, SPAN, True)
    edge = np.zeros(SPAN - 1, dtype=np.uint32)
    reached = _sliding(np.concatenate((edge, least, edge)), SPAN, False)
    return np.flatnonzero(reached == hashes)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, bounds


def _int_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, type=kind))


def _find(batches):
    rid = TaskContext.get().partitionId() << 33
    for batch in together(batches, "text", 8 << 20):
        n = batch.num_rows
        if not n:
            continue
        raw, bounds = _text_bytes(batch.column("text"))
        view = memoryview(raw)
        doc, pos, core = [], [], []
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, side="right")) - 1)
            at = anchors(raw[bounds[first] : bounds[last]]) + bounds[first]
            of = np.searchsorted(bounds, at, side="right") - 1
            inside = (at + CORE <= bounds[of + 1]) & (bounds[of + 1] - bounds[of] >= LENGTH)
            at, of = at[inside], of[inside]
            digest = xxhash.xxh3_64_intdigest
            core.append(np.array([digest(view[p : p + CORE]) for p in at.tolist()], dtype=np.uint64))
            doc.append(of)
            pos.append(at - bounds[of])
            first = last
        doc, pos, core = np.concatenate(doc), np.concatenate(pos), np.concatenate(core)
        counts = np.bincount(doc, minlength=n)
        yield pa.record_batch(
            {
                "rid": pa.array(np.arange(rid, rid + n)),
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "n_bytes": pa.array(np.diff(bounds)),
                "sha256": batch.column("sha256"),
                "pos": _int_lists(pos.astype(np.int32), counts, pa.int32()),
                "core": _int_lists(core.view(np.int64), counts, pa.int64()),
            }
        )
        rid += n


def _contexts_hashed(batches):
    """Keep the texts that have repeated cores, with a hash of every context."""
    for batch in together(batches, "text", 8 << 20):
        full = []
        for text, positions in zip(batch.column("text"), batch.column("pos"), strict=True):
            raw = text.as_buffer().to_pybytes()
            own = []
            for p in positions.values.to_pylist():
                left, right = min(SPAN, p), min(SPAN, len(raw) - p - CORE)
                own.append(xxhash.xxh3_64_intdigest(raw[p - left : p + CORE + right], seed=left << 8 | right))
            full.append(np.array(own, dtype=np.uint64).view(np.int64))
        counts = np.array([len(f) for f in full])
        values = np.concatenate(full) if full else np.empty(0, np.int64)
        yield pa.record_batch(
            {**{c: batch.column(c) for c in ("rid", "text", "pos", "core")}, "full": _int_lists(values, counts, pa.int64())}
        )


def _contexts(batches):
    """The bytes around the anchors that need sorting."""
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in CONTEXT_SCHEMA.split(", ")}
        for rid, text, wanted in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for w in wanted:
                p = w["pos"]
                row = rid, p, w["core"], w["single"], raw[max(0, p - SPAN) : p], raw[p + CORE : p + CORE + SPAN]
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        types = pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()
        yield pa.record_batch({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})


def _ranked(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings' places in the sorted array, and the common prefix of each place with the one before it."""
    order = deep_shallow_order(strings)
    shared = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array(shared, dtype=np.int16)


def _prefix_table(rank: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common prefixes of every two strings: the least between their places."""
    n = len(rank)
    later = np.triu(np.ones((n, n), dtype=bool), 1)
    table = np.minimum.accumulate(np.where(later, shared, np.int16(SPAN)), axis=1)
    return np.minimum(table, table.T)[np.ix_(rank, rank)]


def repeated_depths(left: list[bytes], right: list[bytes], low: int, high: int) -> list[tuple[int, int] | None]:
    """Least and greatest d in [low, high] for which some other member has the same window.

    `left` holds the bytes before the core, `right` those after it; a window
    with d bytes before the anchor needs d of the one and SPAN - d of the other.
    """
    n = len(left)
    before = [x[::-1] for x in left]
    if n == 2:
        a, b = max(low, SPAN - common_prefix(*right)), min(high, common_prefix(*before))
        return [(a, b)] * 2 if a <= b else [None] * 2
    sides = _ranked(before), _ranked(right)
    if n <= TABLE:
        first = np.maximum(low, SPAN - _prefix_table(*sides[1]))
        last = np.minimum(high, _prefix_table(*sides[0]))
        some = first <= last
        np.fill_diagonal(some, False)
        least, most = np.where(some, first, SPAN + 1).min(axis=1), np.where(some, last, -1).max(axis=1)
    else:
        least, most = np.full(n, SPAN + 1), np.full(n, -1)
        # the first and last d of two members are ends of the range or follow from a common prefix
        ends = np.unique(np.concatenate(([low, high], sides[0][1], SPAN - sides[1][1])))
        for d in ends[(ends >= low) & (ends <= high)].tolist():
            own = np.cumsum(sides[0][1] < d)[sides[0][0]] * (n + 1) + np.cumsum(sides[1][1] < SPAN - d)[sides[1][0]]
            held = np.sort(own)
            twice = held[1:][held[1:] == held[:-1]]
            if len(twice):
                hit = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
                least[hit] = np.minimum(least[hit], d)
                most[hit] = d
    return [(a, b) if b >= 0 else None for a, b in zip(least.tolist(), most.tolist(), strict=True)]


def _sort_groups(batches):
    """Rows arrive sorted by group; each group is whole and at most GROUP rows."""
    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("g", "low", "high", "rid", "pos", "single", "left_part", "right_part")), strict=True))
        out = []
        for row in rows:
            if held and held[0][:3] != row[:3]:
                out += _solve(held)
                held = []
            held.append(row)
        if out:
            yield _spans(out)
    if held and (out := _solve(held)):
        yield _spans(out)


def _solve(group: list[tuple]) -> list[tuple[int, int, int]]:
    if len(group) < 2:
        return []
    low, high = group[0][1:3]
    found = repeated_depths([r[6] for r in group], [r[7] for r in group], low, high)
    return [
        (r[3], r[4] - d[1], r[4] - d[0] + LENGTH) for r, d in zip(group, found, strict=True) if d is not None and r[5]
    ]


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    rid, start, stop = zip(*rows, strict=True)
    return pa.record_batch({"rid": pa.array(rid, pa.int64()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})


def _cut(batches):
    """Merge each text's spans and hash what is left."""
    for batch in batches:
        rows = []
        for rid, text, spans in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            rows.append((rid, sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"start": a, "stop": b} for a, b in merged]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        types = pa.int64(), pa.int64(), pa.int64(), pa.string(), span
        names = "rid", "n_removed", "n_spans", "kept_sha256", "spans"
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _halved(scratch: Scratch, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Both halves of each range of d, and the spans known from them.

    All windows of a range of d share `low` bytes before the core and SPAN - `high`
    after it, which divide a group. Members that agree on every byte that a window
    of the range can reach share all its windows: their spans are known, and one of
    them goes on for the others.
    """
    middle = F.expr("(low + high) div 2")
    halves = F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))
    split = large.filter("low < high").withColumn("half", F.explode(halves))
    split = split.withColumn("low", F.col("half.a")).withColumn("high", F.col("half.b")).drop("half", "n")
    # the least and greatest d that the flanks have room for
    split = split.withColumn("least", F.greatest("low", SPAN - F.length("right_part"))).withColumn("most", F.least("high", F.length("left_part")))
    split = split.filter("least <= most")
    before, after = "substring(left_part, greatest(length(left_part) - {0}, 0) + 1, {0})", "substring(right_part, 1, {1} - {0})"
    split = split.withColumn("g", F.xxhash64("g", "low", "high", F.expr(before.format("low")), F.expr(after.format("high", SPAN))))
    split = split.withColumn("reach", F.xxhash64("g", F.expr(before.format("high")), F.expr(after.format("low", SPAN))))
    split = scratch.table(split, f"split-{level}")
    one = F.min(F.struct("rid", "pos", "single", "left_part", "right_part")).alias("one")
    classes = scratch.table(split.groupBy("g", "low", "high", "reach").agg(F.count("*").alias("n"), one), f"classes-{level}")
    alike = classes.filter("n > 1").select("g", "low", "high", "reach")
    known = split.filter("single").join(alike, ["g", "low", "high", "reach"], "left_semi")
    known = known.select("rid", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + LENGTH).alias("stop"))
    left = classes.select(
        "g", "low", "high", "one.rid", "one.pos", (F.col("one.single") & (F.col("n") == 1)).alias("single"), "one.left_part", "one.right_part"
    )
    return left, scratch.table(known, f"known-{level}")


def _group_spans(scratch: Scratch, contexts: DataFrame, group: int) -> DataFrame:
    """Spans of single contexts that equal another one's in part."""
    todo = contexts.select(F.xxhash64("core").alias("g"), F.lit(0).alias("low"), F.lit(SPAN).alias("high"), "rid", "pos", "single", "left_part", "right_part")
    ready, known, level = None, None, 0
    keys = ["g", "low", "high"]
    while True:
        sizes = scratch.table(todo.groupBy(*keys).agg(F.count("*").alias("n"), F.max("single").alias("open")).filter("n > 1 and open"), f"sizes-{level}")
        sized = todo.join(sizes.select(*keys, "n"), keys)
        small = sized.filter(F.col("n") <= group)
        ready = small if ready is None else ready.unionByName(small)
        if not sizes.filter(F.col("n") > group).take(1):
            break
        level += 1
        todo, found = _halved(scratch, sized.filter(F.col("n") > group), level)
        known = found if known is None else known.union(found)
    ordered = ready.repartition("g").sortWithinPartitions(*keys)
    spans = ordered.mapInArrow(_sort_groups, "rid long, start int, stop int")
    return spans if known is None else spans.union(known)


def remove_repeats(scratch: Scratch, docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (null: the whole text)."""
    small_batches(scratch.spark)
    texts = text_of(docs).withColumn("text_key", F.xxhash64("text"))
    hashed = texts.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    found = scratch.table(hashed.mapInArrow(_find, ANCHOR_SCHEMA), "anchors")
    copies = found.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"))
    copies = scratch.table(copies, "copies")

    rows = found.select("rid", "text_key", F.explode(F.arrays_zip("pos", "core")).alias("a")).select("rid", "text_key", "a.pos", "a.core")
    place = F.xxhash64("text_key", "pos")
    repeated = rows.groupBy("core").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("core")
    hits = scratch.table(rows.select("rid", "pos", "core").join(repeated, "core").join(copies.select("rid"), "rid", "left_semi"), "hits")
    per_text = hits.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "core"))).alias("at"))
    per_text = found.select("rid", F.col("doc_id").alias("d"), F.col("text_key").alias("k")).join(per_text, "rid")
    wanted = texts.join(per_text, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    wanted = wanted.select("rid", "text", F.col("at.pos").alias("pos"), F.col("at.core").alias("core")).dropDuplicates(["rid"])
    affected = scratch.table(wanted.mapInArrow(_contexts_hashed, AFFECTED_SCHEMA), "affected")

    rows = affected.select("rid", F.explode(F.arrays_zip("pos", "core", "full")).alias("a")).select("rid", "a.pos", "a.core", "a.full")
    alike = rows.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("first"))
    alike = scratch.table(alike, "alike")
    twice = alike.filter("n > 1").select("core", "full")
    size = affected.select("rid", F.octet_length("text").alias("size"))
    whole = rows.join(twice, ["core", "full"]).join(size, "rid").select(
        "rid",
        F.greatest(F.lit(0), F.col("pos") - SPAN).alias("start"),
        F.least(F.col("size"), F.col("pos") + LENGTH).alias("stop"),
    )
    several = alike.groupBy("core").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).filter("contexts > 1 and least = 1").select("core")
    edges = alike.join(several, "core").select(
        F.col("first.rid").alias("rid"), F.struct(F.col("first.pos").alias("pos"), "core", (F.col("n") == 1).alias("single")).alias("w")
    )
    edges = edges.groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    contexts = scratch.table(affected.select("rid", "text").join(edges, "rid").mapInArrow(_contexts, CONTEXT_SCHEMA), "contexts")
    spans = whole.union(_group_spans(scratch, contexts, group))
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = affected.select("rid", "text").join(spans, "rid").mapInArrow(
        _cut, "rid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
    )
    cut = scratch.table(cut, "cut")

    copied = copies.filter("copies > 1").select("sha256", F.lit(True).alias("copied"))
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return (
        found.select("rid", "doc_id", "n_bytes", "sha256")
        .join(copied, "sha256", "left")
        .join(cut, "rid", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
            F.when(~gone, F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))).alias("spans"),
        )
    )
