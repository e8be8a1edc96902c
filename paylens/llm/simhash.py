"""Near-duplicate documents by 64-bit SimHash, compared in bit slices.

A fingerprint bit is 1 where more than half of a document's shingle hashes have
it (XXH64, seed 42). Two fingerprints link when at most RADIUS bits differ.

Candidates come from the pigeonhole rule: of RADIUS + 1 parts of the bits, two
linked fingerprints agree in one. Fingerprints are dealt to one bucket per
part; a bucket of more than MOST distinct fingerprints is dealt out again by
the parts of the bits that are still free, until every bucket is small. The
bits run out, so this ends, and no pair is lost or capped.

Inside its bucket a fingerprint is compared with all others vertically: bit k
of 64 neighbours is one word of plane k. For every distance d between places, a
plane is XORed with itself moved by d, and carry-save counters add the outcome
to 64 distances at once; words whose 64 distances all exceed the radius are
abandoned after each slice of planes. A bucket reports only links that connect
two of its groups, so that a group of copies costs one link a member.

Defined results: a text of fewer words than a shingle is one shingle; a null or
word-less text has the fingerprint zero and is linked like any other; equal
fingerprints are one node; a null doc_id never names a component that has
another id; rows may repeat; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, small_batches, text_of
from paylens.llm.components import components
from paylens.llm.tokens import together

BITS, RADIUS, WORDS, SEED = 64, 2, 3, 42
#: Distinct fingerprints of a bucket that are compared in one block.
MOST = 1024
#: Planes between two looks at which words are still alive.
SLICE = 8
#: Shingle hashes whose bits are counted together; rows of buckets compared together.
TOGETHER, LANES = 1 << 15, 1 << 16


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of the words of `text`, A-Z lowered, joined by one space."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), TOGETHER):
        part = hashes[at : at + TOGETHER]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches, words: int):
    for batch in together(batches, "text"):
        texts = batch.column("text").cast(pa.binary())
        found = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words)) for t in texts), np.uint64, len(texts))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})


def _planes(prints: np.ndarray) -> np.ndarray:
    """BITS x words: bit k of lane i at bit i % 64 of word i // 64, with a spare word."""
    n = len(prints)
    lanes = -(-n // 64) * 64 + 64
    bits = np.zeros((lanes, BITS), np.uint8)
    bits[:n] = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes whose counter is above `radius`."""
    above, equal = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def near_lanes(planes: np.ndarray, after: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Lanes i that differ from lane i + d in at most `radius` bits; after: lanes of i's bucket behind i."""
    width = planes.shape[1]
    room = np.full((width - 1) * 64, -1, np.int64)
    room[: len(after)] = after
    inside = room.reshape(-1, 64) >= d
    words = np.flatnonzero(inside.any(axis=1))
    live = np.ascontiguousarray(np.packbits(inside[words], axis=1, bitorder="little")).view(np.uint64)[:, 0]
    q, r = divmod(d, 64)
    counters = [np.zeros(len(words), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(words), np.uint64)
    for first in range(0, BITS, SLICE):
        for k in range(first, first + SLICE):
            plane = planes[k]
            moved = plane.take(words + q, mode="clip")
            if r:
                moved = (moved >> np.uint64(r)) | (plane.take(words + q + 1, mode="clip") << np.uint64(64 - r))
            carry = plane[words] ^ moved
            for counter in counters:
                both = counter & carry
                counter ^= carry
                carry = both
            over |= carry
        live &= ~_exceeds(counters, over, radius)
        alive = live != 0
        if not alive.any():
            return np.empty(0, np.int64)
        if not alive.all():
            words, live, over = words[alive], live[alive], over[alive]
            counters = [c[alive] for c in counters]
    lanes = np.flatnonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return words[lanes // 64] * 64 + lanes % 64


def spanning_links(prints: np.ndarray, after: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs of lanes that connect what links inside the buckets connect."""
    planes = _planes(prints)
    group = np.arange(len(prints))
    out = []
    for d in range(1, int(after.max(initial=0)) + 1):
        lanes = near_lanes(planes, after, d, radius)
        lanes = lanes[group[lanes] != group[lanes + d]]
        if not len(lanes):
            continue
        up: dict[int, int] = {}

        def root(x: int, up=up) -> int:
            while x in up:
                x = up[x]
            return x

        for i in lanes.tolist():
            a, b = sorted((root(int(group[i])), root(int(group[i + d]))))
            if a != b:
                up[b] = a
                out.append((i, i + d))
        to = np.arange(len(prints))
        for x in up:
            to[x] = root(x)
        group = to[group]
    return out


def _block(buckets: np.ndarray, prints: np.ndarray, radius: int) -> pa.RecordBatch:
    last = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True))
    after = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(prints))
    found = np.array(spanning_links(prints, after, radius), np.int64).reshape(-1, 2)
    signed = prints.view(np.int64)
    return pa.record_batch({"a": pa.array(signed[found[:, 0]]), "b": pa.array(signed[found[:, 1]])})


def _compared(batches, radius: int):
    """Batches sorted by bucket; whole buckets are compared, the last one waits for the next batch."""
    buckets = prints = np.empty(0, np.int64)
    for batch in batches:
        buckets = np.concatenate((buckets, batch.column("bucket").to_numpy()))
        prints = np.concatenate((prints, batch.column("fp").to_numpy()))
        if len(buckets) >= LANES:
            cut = int(np.flatnonzero(buckets != buckets[-1]).max(initial=-1)) + 1
            if cut:
                yield _block(buckets[:cut], prints[:cut].view(np.uint64), radius)
                buckets, prints = buckets[cut:], prints[cut:]
    if len(buckets):
        yield _block(buckets, prints.view(np.uint64), radius)


def _parts(free: int, parts: int) -> list[int]:
    """The set bits of `free`, dealt into masks of neighbouring bits."""
    places = [k for k in range(BITS) if free >> k & 1]
    return [sum(1 << k for k in own.tolist()) for own in np.array_split(np.array(places, dtype=np.int64), parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(scratch: Scratch, prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `prints` (fp) as all links do."""
    spark = scratch.spark
    dealt, fixed = None, {0: 0}
    found = []
    level = 0
    while True:
        # (radius + 1)^level rows at most, and the bits run out after a few levels
        children = [
            (path, path * (radius + 1) + k + 1, mask | part)
            for path, mask in fixed.items()
            for k, part in enumerate(_parts(~mask & (1 << BITS) - 1, radius + 1))
        ]
        if level:
            masks = spark.createDataFrame([(p, c, _signed(m)) for p, c, m in children], "path long, child long, mask long")
            rows = dealt.join(F.broadcast(masks), "path")
        else:
            parts = [F.struct(F.lit(c).cast("long").alias("child"), F.lit(_signed(m)).cast("long").alias("mask")) for _, c, m in children]
            rows = prints.select("fp", F.inline(F.array(*parts)))
        key = F.xxhash64("child", F.col("fp").bitwiseAND(F.col("mask")))
        rows = scratch.table(rows.select("fp", F.col("child").alias("path"), key.alias("bucket")), f"dealt-{level}")
        sizes = scratch.table(rows.groupBy("bucket").count().filter("count > 1"), f"sizes-{level}")
        small = rows.join(sizes.filter(F.col("count") <= most), "bucket").select("bucket", "fp")
        compared = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_compared, radius=radius), "a long, b long")
        found.append(scratch.table(compared, f"links-{level}"))
        large = sizes.filter(F.col("count") > most).select("bucket")
        if not large.take(1):
            break
        dealt = scratch.table(rows.join(large, "bucket").select("fp", "path"), f"again-{level}")
        left = {r["path"] for r in dealt.select("path").distinct().toLocalIterator()}
        fixed = {child: mask for _, child, mask in children if child in left}
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(scratch: Scratch, docs: DataFrame, words: int = WORDS, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Per row of `docs`: doc_id, fp (its fingerprint as a signed long), component_id (smallest id reachable)."""
    small_batches(scratch.spark)
    rows = scratch.table(text_of(docs).mapInArrow(partial(_fingerprints, words=words), "doc_id long, fp long"), "fingerprints")
    classes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    comps = components(scratch, links(scratch, classes.select("fp"), radius, most), "simhash")
    linked = classes.join(comps.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = linked.join(named, "comp").select("fp", "component_id")
    alone = classes.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    names = scratch.table(named.union(alone), "names")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
