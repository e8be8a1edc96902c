"""Toxicity: a linear classifier on character n-grams with naive Bayes scaling.

A text's features are the distinct n-grams of its lower-cased UTF-8 bytes,
hashed into BUCKETS. On labelled rows each feature's log-count ratio between
toxic and other texts is measured; the features that tell most (likelihood
ratio) are kept; the counts are summed up and the features chosen on Spark, and
the driver holds the chosen features of the sampled rows, two bytes each. A
logistic regression with L2 penalty is fitted to binary features scaled by their
ratios. Scoring is one pass without a shuffle; the model is a few thousand
numbers.

At most `most_rows` labelled rows are used for fitting, a documented bound; they
are a seeded hash sample where there are more. Scores cover every whole text.

Defined results: a null text counts as empty, an empty text gets the model's
base rate, null labels and labels of unknown documents teach nothing, a doc_id
with several labels teaches each, an empty label table or a single class gives
the base rate everywhere, extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import small_batches, text_of
from paylens.llm.tokens import together

SIZES = (4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
FEATURES = 6_000
MOST_ROWS = 24_000
FIT_TASKS = 8
LEAST_TEXTS = 3
#: Bytes of text whose n-grams are counted together; a byte takes some 150 on the way.
COUNTED = 1 << 16
#: Rows a counting task hands on together; entries of the fit that are gone through together.
HANDED, PIECE = 1 << 16, 1 << 20
HELD_OUT_PART, PARTS = 2, 4
#: Scores from here on count as toxic.
REJECT = 0.3


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    base: float


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves the held-out remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % PARTS == HELD_OUT_PART, F.lit(False))


def _bytes_and_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lowered = pc.utf8_lower(texts).cast(pa.large_string())
    _, offsets, data = lowered.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def present(texts: pa.Array, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct n-gram; with `wanted` (a mask) only of those buckets."""
    raw, bounds = _bytes_and_bounds(texts)
    values = raw.astype(np.uint32)
    found: list[np.ndarray] = []
    rolled = np.zeros(len(raw), dtype=np.uint32)
    size = 0
    for n in SIZES:
        while size < n:
            usable = max(0, len(raw) - size)
            rolled = rolled[:usable] * np.uint32(0x01000193) + values[size : size + usable] + np.uint32(1)
            size += 1
        bucket = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
        at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
        text = np.searchsorted(bounds, at, side="right") - 1
        inside = at + n <= bounds[text + 1] if len(at) else np.empty(0, bool)
        found.append(text[inside].astype(np.int64) << BUCKET_BITS | bucket[at[inside]])
    both = np.unique(np.concatenate(found))
    return both >> BUCKET_BITS, both & (BUCKETS - 1)


def _count(batches):
    """(bucket, others, toxics): how many toxic and other texts of this task hold each bucket that any holds."""
    counts = np.zeros((2, BUCKETS), dtype=np.int32)
    for batch in together(batches, "text", COUNTED):
        text, bucket = present(batch.column("text"), None)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for label in (0, 1):
            np.add.at(counts[label], bucket[toxic[text] == label], 1)
    held = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(held), HANDED):
        own = held[at : at + HANDED]
        yield pa.record_batch({"bucket": pa.array(own.astype(np.int32)), "others": pa.array(counts[0, own]), "toxics": pa.array(counts[1, own])})


def _choose(batches, features: np.ndarray):
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[features] = np.arange(len(features))
    for batch in together(batches, "text", 4 << 20):
        text, bucket = present(batch.column("text"), place >= 0)
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[bucket].astype(np.int16)))
        yield pa.record_batch({"toxic": batch.column("toxic"), "features": lists})


def _likelihood_ratio(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Twice the log-likelihood gain of knowing the label, from how many toxic and other texts hold a bucket."""
    total = n_pos + n_neg
    both = pos + neg
    gain = F.lit(0.0)
    for seen, size in ((pos, n_pos), (neg, n_neg)):
        for part, overall in ((seen, both), (size - seen, total - both)):
            gain += F.when(part > 0, part * F.log(part * F.lit(float(total)) / (overall * F.lit(float(size))))).otherwise(0.0)
    return 2 * gain


def _logistic(lists: pa.ChunkedArray, scale: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the mean logistic loss; `lists` holds each row's features.

    The entries are gone through in pieces, so that no array but the features
    themselves has their number.
    """
    n, k = len(y), len(scale)
    pieces = []
    at = 0
    for chunk in lists.chunks:
        ends = chunk.offsets.to_numpy().astype(np.int64)
        features = chunk.values.to_numpy()
        first = 0
        while first < len(chunk):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, side="right")) - 1)
            pieces.append((at + first, np.diff(ends[first : last + 1]), features[ends[first] : ends[last]]))
            first = last
        at += len(chunk)
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        scaled, grad = scale * w, np.zeros(k)
        off = 0.0
        for start, sizes, features in pieces:
            rows = np.repeat(np.arange(len(sizes)), sizes)
            z = np.bincount(rows, weights=scaled[features], minlength=len(sizes)) + b
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[start : start + len(sizes)]
            grad += np.bincount(features, weights=error[rows], minlength=k)
            off += error.sum()
        grad = np.append(scale * grad / n + penalty * w, off / n)
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, seed: int = 0, penalty: float = 5e-4, steps: int = 300) -> Model:
    """Learn from labelled rows outside the held-out part.

    The sampled label rows are at most `most_rows` and a little, so that they
    are broadcast and no text is shuffled but theirs.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > most_rows:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) * F.lit(2.0**-53) < most_rows / n)
    labelled = text_of(docs).join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = labelled.repartition(FIT_TASKS)
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_neg, n_pos = sizes.get(0, 0), sizes.get(1, 0)
    base = float(np.log((n_pos + 0.5) / (n_neg + 0.5)))
    if not n_pos or not n_neg:
        return Model(np.empty(0, np.int64), np.empty(0), base)
    counts = rows.mapInArrow(_count, "bucket int, others int, toxics int").groupBy("bucket")
    counts = counts.agg(F.sum("others").alias("others"), F.sum("toxics").alias("toxics")).filter(F.col("others") + F.col("toxics") >= LEAST_TEXTS)
    gain = _likelihood_ratio(F.col("toxics"), F.col("others"), n_pos, n_neg)
    best = counts.withColumn("gain", gain).filter("gain > 0").orderBy(F.desc("gain"), "bucket").limit(FEATURES)
    best = sorted((r["bucket"], r["toxics"], r["others"]) for r in best.collect())
    features, pos, neg = np.array(best, dtype=np.int64).reshape(-1, 3).T
    ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    held = rows.mapInArrow(partial(_choose, features=features), "toxic int, features array<short>").toArrow()
    w, b = _logistic(held.column("features"), ratio, held.column("toxic").to_numpy().astype(float), penalty, steps)
    return Model(features, w * ratio, b)


def _score(batches, model: Model, text: str):
    wanted = np.zeros(BUCKETS, dtype=bool)
    wanted[model.features] = True
    weight = np.zeros(BUCKETS)
    weight[model.features] = model.weights
    for batch in together(batches, text, 4 << 20):
        texts = pc.fill_null(batch.column(text), "")
        which, bucket = present(texts, wanted)
        z = np.bincount(which, weights=weight[bucket], minlength=batch.num_rows) + model.base
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of `docs` and a score in (0, 1)."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    schema = ", ".join([*(f"{c} {t}" for c, t in inner.dtypes), "score double"])
    out = inner.mapInArrow(partial(_score, model=model, text=names[docs.columns.index(text)]), schema)
    return out.toDF(*docs.columns, column)
