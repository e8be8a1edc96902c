"""Removal of repeated line runs, in DataFrame functions alone.

Documents are sequences of line ids. Prefix doubling ranks every run of 1, 2,
4, ... lines that occurs more than once: a run of 2^(k+1) lines is a pair of
ranks at level k, and its rank is the place of its first copy, so that equal
ranks are exactly the intervals of the suffix array whose common prefix is that
long. Runs that occur once leave at once, which keeps the tables small.

A run counts when its lines hold `min_words` words. Every line starts and ends
one shortest run that does; any maximal repeated run that counts is the union
of such runs inside it. The rank of a run of m lines is the pair of ranks of
its first and last 2^k <= m lines. A run whose first copy is elsewhere, earlier
by (doc_id, row, line), is a later copy: its lines are deleted. The first copy
of every line stays.

Blank lines have no id: they are skipped when runs are formed, and stay. Lines
are the pieces between newline characters, compared byte by byte.

Defined results: a null text stays null, an empty text stays empty, a document
may lose all lines and then has an empty text, rows of the same doc_id are
ordered by their place in the input and null doc_ids come first, an empty table
gives no rows, other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch

MIN_WORDS = 8


def _lines(base: DataFrame, text: str) -> DataFrame:
    """(rid, doc_id, seq, line_no, h, c, words) of lines that are not blank; seq counts only those."""
    numbered = F.transform(F.split(F.col(text), "\n", -1), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    solid = F.filter(numbered, lambda x: x["line"].rlike(r"\S"))
    return base.select("rid", "order_id", F.posexplode(solid).alias("seq", "at")).select(
        "rid",
        "order_id",
        "seq",
        "at.line_no",
        F.xxhash64("at.line").alias("h"),
        F.crc32(F.col("at.line").cast("binary")).alias("c"),
        F.regexp_count("at.line", F.lit(r"\S+")).alias("words"),
    )


def _shortest(words: str, least: int, ahead: bool) -> Column:
    """Lines of the shortest run that holds `least` words, starting or ending at this line."""
    line = Window.partitionBy("rid").orderBy("seq")
    frames = [line.rowsBetween(0, k) if ahead else line.rowsBetween(-k, 0) for k in range(least)]
    return F.coalesce(*(F.when(F.sum(words).over(f) >= least, F.lit(k + 1)) for k, f in enumerate(frames)))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once, with the place of the first copy as `rank`."""
    classes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("order_id", "rid", "seq")).alias("rank"))
    return rows.join(classes.filter("n > 1").drop("n"), keys)


def later_copies(scratch: Scratch, base: DataFrame, text: str, min_words: int) -> DataFrame:
    """(rid, line_no) of the lines to delete; `base` has rid and order_id."""
    lines = scratch.table(_lines(base, text), "lines")
    sized = lines.select(
        "rid", "order_id", "seq",
        _shortest("words", min_words, True).alias("ahead"), _shortest("words", min_words, False).alias("back"),
    )
    runs = sized.filter("ahead is not null").select("rid", "order_id", "seq", F.col("ahead").alias("m"))
    runs = runs.union(
        sized.filter("back is not null").select("rid", "order_id", (F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("m"))
    ).distinct()

    rank = scratch.table(_ranked(lines.select("rid", "order_id", "seq", "h", "c"), ["h", "c"]).select("rid", "order_id", "seq", "rank"), "rank-0")
    levels = [rank]
    while 2 ** len(levels) <= min_words:
        step = 2 ** (len(levels) - 1)
        ahead = rank.select("rid", (F.col("seq") - step).alias("seq"), F.col("rank").alias("second"))
        pairs = rank.withColumnRenamed("rank", "first").join(ahead, ["rid", "seq"])
        pairs = scratch.table(pairs, f"pairs-{len(levels)}")
        rank = scratch.table(_ranked(pairs, ["first", "second"]).select("rid", "order_id", "seq", "rank"), f"rank-{len(levels)}")
        levels.append(rank)
    ranks = reduce(DataFrame.unionByName, (r.select(F.lit(k).alias("k"), "rid", "seq", "rank") for k, r in enumerate(levels)))

    keyed = runs.withColumn("k", F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int"))
    keyed = keyed.withColumn("last", F.expr("cast(seq + m - shiftleft(1, k) as int)"))
    head = ranks.withColumnRenamed("rank", "first")
    tail = ranks.select("k", "rid", F.col("seq").alias("last"), F.col("rank").alias("second"))
    named = keyed.join(head, ["k", "rid", "seq"]).join(tail, ["k", "rid", "last"])
    copies = _ranked(scratch.table(named.select("rid", "order_id", "seq", "m", "first", "second"), "runs"), ["m", "first", "second"])
    later = copies.filter(F.col("rank") < F.struct("order_id", "rid", "seq"))
    covered = later.select("rid", F.explode(F.expr("sequence(seq, seq + m - 1)")).alias("seq")).distinct()
    return lines.join(covered, ["rid", "seq"]).select("rid", "line_no")


def remove_repeated_lines(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of line runs, and how many lines each had and lost."""
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    text = names[columns.index("text")]
    order = F.col(names[columns.index("doc_id")])
    base = docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()).withColumn("order_id", order)
    base = scratch.table(base, "docs")
    gone = later_copies(scratch, base, text, min_words)
    gone = scratch.table(gone.groupBy("rid").agg(F.collect_set("line_no").alias("gone")), "gone")
    split = F.split(F.col(text), "\n", -1)
    kept = F.filter(split, lambda _, i: ~F.array_contains(F.col("gone"), i))
    # one plan at every size: small inputs would broadcast `gone`, large ones shuffle the texts to it
    out = base.join(gone.hint("merge"), "rid", "left").select(
        *(F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if n == text else F.col(n) for n in names),
        F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
    return out.toDF(*columns, "n_lines", "n_lines_removed")
