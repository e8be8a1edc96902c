"""Groups of spelling variants by pivotal grams.

Words are the maximal runs of LETTERS in whole texts, A-Z lowered, some of them
with one letter lost (see `damaged`), of LEAST_LETTERS code points and
LEAST_COUNT occurrences or more. Two words are near when one inserted, deleted
or replaced code point tells them apart.

Grams are pairs of neighbouring code points, rarest first by the number of
places they have in all words. A word's prefix is its three rarest grams, with
all that tie with the third. Two of them that do not overlap, the pair of the
least summed frequency by dynamic programming, are its pivots. One edit leaves
one of two disjoint grams whole, so that of two near words the one whose third
gram is not rarer finds a pivot of the other in its prefix. A pivot is looked up
only at lengths and places that one edit can give: same length and place, one
longer at the same or the next place, one shorter at the same or the previous.
Candidates are confirmed by their edit distance.

A word's form is its near word with the largest count, ties to the smaller in
code-point order, if that has at least twice the word's own count; the root is
what following forms ends at.

Defined results: a null or letter-less text has no words; a null doc_id counts
as an empty id; equal rows count each; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, small_batches, text_of

LETTERS = re.compile("[a-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT, LOSES_ONE_OF = 5, 3, 97
#: Grams of a prefix: with q = 2 and one edit, q * 1 + 1.
PREFIX = 3
#: What one edit can do to a gram it does not touch: (length, place).
MOVES = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))
#: Distinct words a task counts before it hands them on.
HELD = 200_000
JUMPS = 64


def damaged(run: str, id_crc: int) -> str:
    """`run`, less one code point if 97 divides the crc32 of '<doc_id>:<run>'; id_crc: that of '<doc_id>:'."""
    h = zlib.crc32(run.encode(), id_crc)
    if h % LOSES_ONE_OF:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches):
    total: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        out = pa.record_batch({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            id_crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(LETTERS.findall(text.as_py().lower().decode())).items():
                word = damaged(run, id_crc)
                if len(word) >= LEAST_LETTERS:
                    total[word] += n
            if len(total) >= HELD:
                yield handed()
    yield handed()


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over whole texts."""
    small_batches(docs.sparkSession)
    parts = text_of(docs).mapInArrow(_counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Each gram's rank, rarest first, and number of places.

    At most (26 + 64)^2 grams, whatever the number of words.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    counts = sorted((r["n"], r["gram"]) for r in grams.groupBy("gram").agg(F.count("*").alias("n")).toLocalIterator())
    return {gram: (rank, n) for rank, (n, gram) in enumerate(counts)}


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int], int]:
    """The prefix as (gram rank, place), the indices of its two pivots, and the rank of the third gram."""
    grams = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    third = sorted(grams)[PREFIX - 1][0]
    prefix = [(rank, place) for place, (rank, _) in enumerate(grams) if rank <= third]
    # of pairs ending at gram j, the cheapest takes the least frequent gram that ends before j begins; that one is carried along
    best, pair, cheapest, end = None, [0, 0], -1, 0
    for j, (_, place) in enumerate(prefix):
        while end < j and prefix[end][1] <= place - 2:
            if cheapest < 0 or grams[prefix[end][1]][1] < grams[prefix[cheapest][1]][1]:
                cheapest = end
            end += 1
        if cheapest >= 0:
            cost = grams[place][1] + grams[prefix[cheapest][1]][1]
            if best is None or cost < best:
                best, pair = cost, [cheapest, j]
    return prefix, pair, third


def _letters(word: str) -> int:
    """A bit for every letter in use, letters dealt to 63 bits: one edit changes two at most."""
    bits = 0
    for x in set(word):
        bits |= 1 << ord(x) % 63
    return bits


def _signed_grams(batches, order):
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("word", "size", "letters", "third", "gram", "place", "pivot")}
        for word in batch.column("word").to_pylist():
            prefix, pivots, third = signature(word, order)
            letters = _letters(word)
            for k, (gram, place) in enumerate(prefix):
                for name, value in zip(cols, (word, len(word), letters, third, gram, place, k in pivots), strict=True):
                    cols[name].append(value)
        types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.record_batch({name: pa.array(cols[name], kind) for name, kind in zip(cols, types, strict=True)})


SIGNATURE_SCHEMA = "word string, size int, letters long, third int, gram int, place int, pivot boolean"


def near_words(scratch: Scratch, words: DataFrame) -> DataFrame:
    """Pairs (a, b), each in both directions, of the distinct `words` (word) that one edit tells apart."""
    order = gram_order(words)
    grams = scratch.table(words.select("word").mapInArrow(partial(_signed_grams, order=order), SIGNATURE_SCHEMA), "grams")
    moves = F.array(*(F.struct(F.lit(size).alias("size"), F.lit(place).alias("place")) for size, place in MOVES))
    pivots = grams.filter("pivot").withColumn("to", F.explode(moves))
    pivots = pivots.select(
        F.col("word").alias("p_word"),
        F.col("letters").alias("p_letters"),
        F.col("third").alias("p_third"),
        "gram",
        (F.col("size") + F.col("to.size")).alias("size"),
        (F.col("place") + F.col("to.place")).alias("place"),
    )
    close = (F.col("p_third") <= F.col("third")) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("p_letters"))) <= 2)
    both = grams.drop("pivot").join(pivots, ["gram", "size", "place"]).filter(close & (F.levenshtein("word", "p_word", 1) == 1))
    pairs = scratch.table(both.select(F.least("word", "p_word").alias("a"), F.greatest("word", "p_word").alias("b")).distinct(), "pairs")
    return pairs.union(pairs.select("b", "a"))


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) for every word of `forms` (word, form), by pointer jumping; forms never run in a circle."""
    up = scratch.table(forms.select("word", F.col("form").alias("root")), "roots-0")
    for jump in range(1, JUMPS):
        upper = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = up.join(upper, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = scratch.table(moved, f"roots-{jump}")
        up = moved.select("word", "root")
        if not moved.filter("moved").take(1):
            break
    return up


def variants(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = scratch.table(word_counts(docs), "words")
    near = near_words(scratch, words)
    of = near.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = of.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b"))).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("b"), (-F.col("best.less")).alias("b_n"))
    out = words.join(best, "word", "left").withColumn("has", F.col("b_n") >= 2 * F.col("n"))
    out = scratch.table(
        out.select(
            "word",
            F.when(F.col("has"), F.col("b")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("has"), F.col("b_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(scratch, out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
