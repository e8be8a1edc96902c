"""Token files: a concatenated id array with Elias-Fano document boundaries.

A file holds, in this order: the ids (little-endian, 16 or 32 bits wide), the
boundaries, the document ids, and a footer of fixed size. Boundaries and
document ids are non-decreasing, so that each is an Elias-Fano list: of every
value the low bits are stored plainly and the high bits in unary, about
2 + log2(range / count) bits a value. A sampled select structure finds the i-th
set bit of the unary part without decoding what lies before.

Documents are range-partitioned by doc_id; each task streams its ids to one
file, whose name carries the attempt, and reports it in the manifest only when
the file is closed. Retried or doubled attempts leave files that no manifest
names. Memory per task is a batch of texts plus two numbers per document.

Defined results: a null text is empty, an empty document is its end id alone,
rows with one doc_id stand together in the order of their texts, null doc_ids
come first, an empty table has an empty manifest, other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, small_batches, text_of
from paylens.llm.tokens import encoded

MAGIC = b"EFTOK1\0\0"
FOOTER = struct.Struct("<8sBQQQQQ")
SELECT_EVERY = 256
READ_IDS = 4 << 20
MANIFEST_SCHEMA = "shard int, file string, n_docs long, n_nulls long, n_ids long, n_bytes long"
DIGEST_SCHEMA = "shard int, position long, doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing list of non-negative integers."""

    HEAD = struct.Struct("<QBBQ")

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = b""
        if low_bits and n:
            shifts = np.arange(low_bits, dtype=np.uint64)
            bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[places] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little").tobytes(), places[::SELECT_EVERY])

    def select(self, i: int) -> int:
        """Place of the i-th set bit of the unary part."""
        place = int(self.samples[i // SELECT_EVERY])
        left = i % SELECT_EVERY
        byte = place // 8
        word = self.high[byte] >> (place % 8)
        base = place
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word, base = self.high[byte], byte * 8
        while left or not word & 1:
            left -= word & 1
            word >>= 1
            base += 1
        return base

    def __getitem__(self, i: int) -> int:
        high = self.select(i) - i
        if not self.low_bits:
            return high
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return high << self.low_bits | (chunk >> first % 8) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        unary = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        found = (np.flatnonzero(unary)[: self.n] - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            found |= bits.reshape(self.n, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return found.astype(np.int64)

    def to_bytes(self) -> bytes:
        """Select samples take as many bytes each as the last one needs."""
        last = int(self.samples[-1]) if len(self.samples) else 0
        width = max(1, (last.bit_length() + 7) // 8)
        samples = b"".join(int(s).to_bytes(width, "little") for s in self.samples)
        return self.HEAD.pack(self.n, self.low_bits, width, len(self.high)) + self.low + self.high + samples

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, width, n_high = cls.HEAD.unpack_from(raw)
        at = cls.HEAD.size
        n_low = (n * low_bits + 7) // 8
        low, high = raw[at : at + n_low], raw[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        samples = np.array([int.from_bytes(raw[i : i + width], "little") for i in range(at, len(raw), width)], dtype=np.int64)
        return cls(n, low_bits, low, high, samples)


def _write(batches, folder: str, path: str, end_id: int, width: str):
    """One file per task; its manifest row comes last."""
    shard = TaskContext.get().partitionId()
    system, base = pafs.FileSystem.from_uri(folder)
    name = f"{shard:07d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
    lengths_seen, docs_seen, nulls, out, written = [], [], 0, None, 0
    try:
        for doc_ids, ids, lengths in encoded(batches, path, end_id):
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(MAGIC)
            out.write(ids.astype(width).tobytes())
            lengths_seen.append(lengths)
            nulls += doc_ids.null_count
            docs_seen.append(doc_ids.drop_null().to_numpy())
            written += len(ids)
        if out is None:
            return
        lengths, docs = np.concatenate(lengths_seen), np.concatenate(docs_seen)
        lowest = int(docs[0]) if len(docs) else 0
        bounds = EliasFano.of(np.cumsum(lengths)).to_bytes()
        named = EliasFano.of(docs.astype(np.uint64) - np.uint64(lowest & 0xFFFFFFFFFFFFFFFF)).to_bytes()
        out.write(bounds + named)
        out.write(FOOTER.pack(MAGIC, np.dtype(width).itemsize, written, len(bounds), len(named), nulls, lowest & 0xFFFFFFFFFFFFFFFF))
        size = out.tell()
    finally:
        if out is not None:
            out.close()
    rows = [shard], [name], [len(lengths)], [nulls], [written], [size]
    types = pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
    names = [c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]
    yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)


def write_tokens(scratch: Scratch, docs: DataFrame, path: str, end_id: int, folder: str, shards: int, vocabulary: int = 1 << 16) -> DataFrame:
    """Write the files in ascending doc_id order; returns the manifest.

    The text hash and the row's place break ties of doc_id, so that rows with
    one doc_id, however many, spread over several shards.
    """
    small_batches(scratch.spark)
    width = "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"
    keyed = text_of(docs).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(shards, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    written = ordered.select("doc_id", "text").mapInArrow(
        partial(_write, folder=folder, path=path, end_id=end_id, width=width), MANIFEST_SCHEMA
    )
    return scratch.table(written, "manifest")


class TokenFile:
    """Random access to one file through its boundaries."""

    def __init__(self, folder: str, name: str) -> None:
        system, base = pafs.FileSystem.from_uri(folder)
        self.source = system.open_input_file(f"{base}/{name}")
        size = self.source.size()
        magic, self.width, self.n_ids, n_bounds, n_named, self.nulls, lowest = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        first = len(MAGIC) + self.n_ids * self.width
        self.bounds = EliasFano.from_bytes(self._at(first, n_bounds))
        self.named = EliasFano.from_bytes(self._at(first + n_bounds, n_named))
        self.lowest = lowest

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def doc_ids(self) -> np.ndarray:
        """Those that are not null; the nulls come before them."""
        return (self.named.values().astype(np.uint64) + np.uint64(self.lowest)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self._at(len(MAGIC) + start * self.width, (stop - start) * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i - 1] if i else 0, self.bounds[i])

    def close(self) -> None:
        self.source.close()


def _read(batches, folder: str):
    for batch in batches:
        for shard, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), strict=True):
            file = TokenFile(folder, name)
            bounds = np.concatenate(([0], file.bounds.values()))
            docs = pa.array([None] * file.nulls + file.doc_ids().tolist(), type=pa.int64())
            first = 0
            while first < len(docs):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + READ_IDS, side="right")) - 1)
                ids = file.ids(int(bounds[first]), int(bounds[last]))
                local = (bounds[first : last + 1] - bounds[first]).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(local[:-1], local[1:], strict=True)]
                yield pa.record_batch(
                    {
                        "shard": pa.array(np.full(last - first, shard, np.int32)),
                        "position": pa.array(np.arange(first, last)),
                        "doc_id": docs.slice(first, last - first),
                        "start": pa.array(bounds[first:last]),
                        "n_tokens": pa.array(np.diff(bounds[first : last + 1])),
                        "ids_crc32": pa.array(crc, type=pa.int64()),
                    }
                )
                first = last
            file.close()


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, global start, length and checksum.

    The sum over the manifest is one row per file; it is broadcast for that.
    """
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    files = manifest.select("shard", "file")
    found = files.repartition(max(1, files.count())).mapInArrow(partial(_read, folder=folder), DIGEST_SCHEMA)
    return found.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )
