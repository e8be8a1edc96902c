"""Token ids of whole texts, batch by batch, with a worker's words remembered.

The tokenizer lower-cases, drops white space and never joins characters across
it, so that a text's ids are the ids of its white-space-separated words one
after the other. Words repeat far more often than they are new: a batch is cut
into words with Arrow, its distinct words are looked up, and only unknown ones
go to the tokenizers library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered per Python worker, about 200 bytes each.
REMEMBERED = 1_000_000
#: Text bytes that are cut into words together.
TOGETHER_BYTES = 8 << 20
#: Unknown words made of letters alone share one call; the library's cost is mostly per call.
PER_CALL = 50
_ENCODERS: dict[str, TextEncoder] = {}


def ragged_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class TextEncoder:
    """Ids equal to the tokenizer's on the whole text.

    ASCII letters are lowered first, which the tokenizer's own lower-casing
    makes neutral. A full stop or comma after an ASCII letter at a word's end
    is a token run of its own. Texts that may hold a special token's string are
    encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.marks = sorted(marks)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.lengths = np.empty(1 << 14, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after the other, and how many each text has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lowered = pc.ascii_lower(texts)
        special = np.zeros(len(texts), dtype=bool)
        for mark in self.marks:
            special |= pc.match_substring(lowered, mark).to_numpy(zero_copy_only=False)
        if special.any():
            lowered = pc.if_else(pa.array(special), pa.scalar("", lowered.type), lowered)
        split = pc.ascii_split_whitespace(lowered)
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy(zero_copy_only=False)
        ids, counts = self._of_distinct(words.dictionary)
        starts = np.cumsum(counts) - counts
        per_word = counts[which]
        flat = ids[ragged_gather(starts[which], per_word)]
        before = np.concatenate(([0], np.cumsum(per_word)))
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
        lengths = np.diff(before[bounds])
        if special.any():
            flat, lengths = self._with_whole(texts, special, flat, lengths)
        return flat, lengths

    def _with_whole(self, texts, special, flat, lengths):
        parts, at = [], 0
        for i, n in enumerate(lengths.tolist()):
            own = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids if special[i] else flat[at : at + n]
            parts.append(np.asarray(own, dtype=np.uint32))
            at += n
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        stems = pc.replace_substring_regex(words, pattern="([a-z])[.,]$", replacement="\\1")
        cut = pc.less(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        comma = pc.ends_with(words, ",").to_numpy(zero_copy_only=False)
        coded = stems.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.forget()
        distinct = coded.dictionary.to_pylist()
        self._learn([",", ".", *distinct])
        look = self.known.__getitem__
        own = np.fromiter(map(look, distinct), np.int64, len(distinct))
        own = own[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.lengths[own] + cut
        flat = np.empty(int(counts.sum()), dtype=np.uint32)
        last = np.cumsum(counts) - 1
        body = np.ones(len(flat), dtype=bool)
        body[last[cut]] = False
        flat[body] = self.flat[ragged_gather(self.starts[own], self.lengths[own])]
        tails = self.flat[self.starts[[look(","), look(".")]]]
        flat[last[cut]] = np.where(comma[cut], tails[0], tails[1])
        return flat, counts

    def _learn(self, words: list[str]) -> None:
        known = self.known
        fresh = list(dict.fromkeys([w for w in words if w not in known]))
        plain = [w for w in fresh if w.isalpha()]
        calls = [plain[i : i + PER_CALL] for i in range(0, len(plain), PER_CALL)]
        encode = self.tokenizer.encode_batch_fast
        rest = [w for w in fresh if not w.isalpha()]
        for call, got in zip(calls, encode([" ".join(c) for c in calls], add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(call):
                self._remember(call, ids, np.diff(ends, prepend=0))
            else:
                rest += call
        if rest:
            found = [x.ids for x in encode(rest, add_special_tokens=False)]
            self._remember(rest, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found]))

    def _remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        self.flat = _room(self.flat, self.used + len(ids))
        self.starts, self.lengths = _room(self.starts, n + len(words)), _room(self.lengths, n + len(words))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(words)] = lengths
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.empty(max(size, 2 * len(array)), dtype=array.dtype)
    grown[: len(array)] = array
    return grown


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def together(batches: Iterator[pa.RecordBatch], column: str, most: int = TOGETHER_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches joined until their column holds about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int):
    """For each run of batches (doc_id, text): doc_id column, all ids with end ids, ids per text."""
    for batch in together(batches, "text"):
        if not batch.num_rows:
            continue
        flat, lengths = encoder(path).encode(batch.column("text"))
        ends = np.cumsum(lengths + 1)
        out = np.empty(int(ends[-1]), dtype=np.uint32)
        body = np.ones(len(out), dtype=bool)
        body[ends - 1] = False
        out[body] = flat
        out[ends - 1] = end_id
        yield batch.column("doc_id"), out, lengths + 1
