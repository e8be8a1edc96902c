"""Packing by concatenate and cut.

Documents are tokenized once, in the order of the input's partitions. The first
pass leaves, per document, its ids and the number of ids before it in its
partition, and per partition the total. Prefix sums over the totals turn these
into global offsets; the second pass cuts the one long run of ids into windows
of a fixed length. No row is shuffled: only one total per partition is.

Defined results: a null text counts as empty, an empty document is its end id
alone, rows with the same or a null doc_id are documents of their own, an empty
table gives no pieces, and further columns are not read. Only the last sequence
is shorter than the window; `padded_length` says to what it is padded.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, small_batches, text_of
from paylens.llm.tokens import encoded

TOKENS_SCHEMA = "part int, doc_id long, before long, n_ids long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
FRAGMENT_SCHEMA = "sequence_id long, offset int, ids binary, whole boolean"


def padded_length(n_ids: int, window: int) -> int:
    """The window, or for a sequence that a power of two holds, that power."""
    return min(window, 1 << max(0, n_ids - 1).bit_length())


def _narrow(largest_id: int) -> np.dtype:
    return np.dtype("<u2" if largest_id < 1 << 16 else "<u4")


def _tokenize(batches, path: str, end_id: int, width: str):
    """First pass over one partition."""
    part, before = TaskContext.get().partitionId(), 0
    for doc_ids, ids, lengths in encoded(batches, path, end_id):
        ends = np.cumsum(lengths)
        raw = ids.astype(width).tobytes()
        size = np.dtype(width).itemsize
        bounds = pa.array(np.concatenate(([0], ends * size)).astype(np.int64))
        blobs = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, bounds.buffers()[1], pa.py_buffer(raw)])
        yield pa.record_batch(
            {
                "part": pa.array(np.full(len(lengths), part, np.int32)),
                "doc_id": doc_ids,
                "before": pa.array(before + ends - lengths),
                "n_ids": pa.array(lengths),
                "ids": blobs.cast(pa.binary()),
            }
        )
        before += int(ends[-1])


def token_runs(scratch: Scratch, docs: DataFrame, path: str, end_id: int, vocabulary: int = 1 << 16) -> DataFrame:
    """Documents as token ids with their global offset `at`.

    The totals are one row per partition of the input, so that the sum over
    them and its broadcast are bounded by the number of tasks, not of rows.
    """
    small_batches(scratch.spark)
    width = _narrow(max(vocabulary - 1, end_id)).str
    runs = scratch.table(text_of(docs).mapInArrow(partial(_tokenize, path=path, end_id=end_id, width=width), TOKENS_SCHEMA), "tokens")
    totals = runs.groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return runs.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("at"), "n_ids", "ids"
    )


def _cut(at: np.ndarray, n: np.ndarray, window: int):
    """Of each document the pieces between window bounds: document, start, length."""
    first, last = at // window, (at + n - 1) // window
    count = last - first + 1
    doc = np.repeat(np.arange(len(at)), count)
    sequence = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    low = np.maximum(sequence * window, at[doc])
    high = np.minimum((sequence + 1) * window, at[doc] + n[doc])
    return doc, sequence, low, high - low


def _pieces(batches, window: int, width: str):
    for batch in batches:
        if not batch.num_rows:
            continue
        at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n_ids"))
        doc, sequence, low, length = _cut(at, n, window)
        start = low - at[doc]
        blobs = [np.frombuffer(b.as_buffer(), dtype=width).astype("<u4") for b in batch.column("ids")]
        crc = [zlib.crc32(blobs[d][s : s + k]) for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id").take(pa.array(doc)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, type=pa.int64()),
                "doc_tokens": pa.array(n[doc]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(low - sequence * window),
            }
        )


def pieces(runs: DataFrame, window: int, vocabulary: int = 1 << 16) -> DataFrame:
    """Second pass: one row per piece of a document in a sequence."""
    return runs.mapInArrow(partial(_pieces, window=window, width=_narrow(vocabulary - 1).str), PIECE_SCHEMA)


def _fragments(batches, window: int, width: str):
    """Neighbouring pieces of a batch joined; those short of a window are boundary records."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n_ids"))
        doc, sequence, low, length = _cut(at, n, window)
        blobs = [np.frombuffer(b.as_buffer(), dtype=width).astype("<u4") for b in batch.column("ids")]
        fresh = np.ones(len(doc), dtype=bool)
        fresh[1:] = (sequence[1:] != sequence[:-1]) | (low[1:] != low[:-1] + length[:-1])
        heads = np.append(np.flatnonzero(fresh), len(doc))
        start = low - at[doc]
        rows = [
            b"".join(blobs[doc[i]][start[i] : start[i] + length[i]].tobytes() for i in range(a, b))
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)
        ]
        head = heads[:-1]
        yield pa.record_batch(
            {
                "sequence_id": pa.array(sequence[head]),
                "offset": pa.array((low - sequence * window)[head].astype(np.int32)),
                "ids": pa.array(rows, type=pa.binary()),
                "whole": pa.array([len(r) == 4 * window for r in rows]),
            }
        )


def sequences(runs: DataFrame, window: int, vocabulary: int = 1 << 16) -> DataFrame:
    """The sequences themselves: sequence_id and ids, unsigned 32-bit little-endian.

    Windows inside one batch are whole at once; only boundary records are
    shuffled, at most a window's worth of ids to each sequence.
    """
    parts = runs.mapInArrow(partial(_fragments, window=window, width=_narrow(vocabulary - 1).str), FRAGMENT_SCHEMA)
    whole = parts.filter("whole").select("sequence_id", "ids")
    mended = (
        parts.filter(~F.col("whole"))
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
    )
    return whole.unionByName(mended)
