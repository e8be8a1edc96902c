"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). The targets are shares of
the marginals tempered by a power: 1 keeps the corpus as it is, 0 makes all
values equal. A table of targets (dimension, value, weight) replaces them for
the dimensions it names; it must name all their values, those of weight 0 are
not drawn. The topic is a column or an expression that the caller gives, or else
a coarse guess from the form of the text.

The scale comes from a token budget, never from the rarest cell. A value that
has fewer tokens than the budget times its share gives all it has, and the other
values of its dimension share the rest in the proportions of their targets.
Without a given budget it is the largest at which, in every dimension, the
tokens missing from such values are at most SHORT of those drawn. Raking then
fits the cells' drawn tokens to these marginals in turn, none above the cell's
tokens, and a document's probability is its cell's drawn tokens over the cell's
tokens. Documents are kept where a seeded hash of their id and text lies below
it, for null ids also of their place in the input.

Raking stops when no dimension has more than TOLERANCE of the drawn tokens out
of place, when a plan of rounds brings it no closer by a hundredth, as with
targets that contradict each other (a source of one language only), or after
ROUNDS. What is then still out of place is the mixture's `residual`. Above the
tolerance it is an error under given targets and a warning under derived ones.

Only the cells, an aggregate, are iterated on. The driver sees each dimension's
values as a histogram of their supply over their target, in steps of 1/BINS of
the logarithm, whose size does not grow with the values.

Defined results: null source, language or topic is a value of its own; a null
text has no tokens; cells without tokens keep their documents; rows of the same id
and text share one fate, without an id each row has its own; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch, seeded_unit

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.9, "topic": 0.9}
SHORT = 0.01
BINS = 4096
TOLERANCE = 1e-3
ROUNDS = 96
ROUNDS_PER_PLAN = 4


def n_words(text: Column) -> Column:
    """Tokens of a text: its runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic read off the form of the text."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!! "), "shout")
        .when(text.rlike(r"\d"), "figures")
        .otherwise("prose")
    )


class Supply:
    """Supplies and target shares of one dimension's values, by rising ratio of the two."""

    def __init__(self, values: DataFrame) -> None:
        step = F.floor(F.log(F.col("supply") / F.col("target")) * BINS)
        bins = values.groupBy(step).agg(F.sum("supply").alias("supply"), F.sum("target").alias("target")).collect()
        self.bins = sorted(((r["supply"], r["target"]) for r in bins), key=lambda b: b[0] / b[1])

    def widest(self, short: float) -> float:
        """The largest budget from which values miss at most the share `short`."""
        supply = target = budget = 0.0
        for s, t in self.bins:
            if supply and target - supply * t / s > short:
                break
            supply, target = supply + s, target + t
            budget = supply / (target - short) if target > short else math.inf
        return min(budget, sum(s for s, _ in self.bins))

    def scale(self, budget: float) -> float:
        """c for which min(supply, c * target) sums to the budget."""
        supply, target, c = 0.0, 0.0, budget
        for s, t in self.bins:
            if supply + s / t * (1 - target) > budget:
                break
            supply, target = supply + s, target + t
            c = (budget - supply) / (1 - target) if 1 - target > 1e-12 else math.inf
        return max(c, 0.0)


@dataclass(frozen=True)
class Mixture:
    """Cells (dimensions, tokens, fitted), the share of the drawn tokens out of place, and marginals.

    `marginals` has dimension, value, target and drawn, both as shares; None of an empty corpus.
    """

    cells: DataFrame
    residual: float
    marginals: DataFrame | None


class TargetsContradict(ValueError):
    """The targets cannot hold together on this corpus."""


def given_weights(cells: DataFrame, targets: DataFrame, d: str) -> DataFrame:
    """(value, weight) of one dimension, checked against the cells' values."""
    weights = targets.filter(F.col("dimension") == d).groupBy("value").agg(F.sum("weight").cast("double").alias("weight"), F.count("*").alias("n"))
    wrong = weights.filter("n > 1 or weight is null or not (weight >= 0 and weight < double('infinity'))")
    if not wrong.isEmpty():
        raise ValueError(f"{d}: the weight of {wrong.first()['value']!r} is repeated, null, negative or not finite")
    values = cells.select(F.col(d).alias("is")).distinct()
    unnamed = values.join(weights, values["is"].eqNullSafe(weights["value"]), "left_anti")
    if not unnamed.isEmpty():
        raise ValueError(f"{d}: no target for {unnamed.first()['is']!r}")
    return weights.select("value", "weight")


def gap(cells: DataFrame, budget: float) -> float:
    """The largest share of the drawn tokens that is out of place in a dimension."""
    off = [
        cells.groupBy(d).agg(F.sum("fitted").alias("is"), F.first(f"goal_{d}").alias("goal"))
        .agg((F.sum(F.abs(F.col("is") - F.col("goal"))) / F.lit(2 * budget)).alias("off"))
        for d in DIMENSIONS
    ]
    return reduce(DataFrame.unionByName, off).agg(F.max("off")).first()[0] or 0.0


def rake(
    scratch: Scratch, cells: DataFrame, powers: dict[str, float], budget: float | None = None, targets: DataFrame | None = None
) -> Mixture:
    """`cells` (dimensions, tokens) with the tokens to draw, `fitted`, at most the cell's.

    `budget` is a share of the tokens of cells that targets let in.
    """
    whole = scratch.table(cells.filter("tokens > 0").withColumn("fitted", F.col("tokens").cast("double")), "cells-0")
    given = {}
    if targets is not None:
        targets = scratch.table(targets.select("dimension", F.col("value").cast("string").alias("value"), "weight"), "targets")
        named = {r[0] for r in targets.select("dimension").distinct().limit(len(DIMENSIONS) + 1).collect()}
        if not named <= set(DIMENSIONS):
            raise ValueError(f"targets of {sorted(map(str, named - set(DIMENSIONS)))}; the dimensions are {DIMENSIONS}")
        given = {d: given_weights(whole, targets, d) for d in DIMENSIONS if d in named}
    out = whole
    for d, weights in given.items():
        none = weights.filter("weight = 0")
        out = out.join(none, out[d].eqNullSafe(none["value"]), "left_anti")
    left_out = whole.join(out.select(*(F.col(d).alias(f"o_{d}") for d in DIMENSIONS)), _same(whole, "o_"), "left_anti") if given else None
    whole = scratch.table(out, "cells-in") if given else whole
    total = float(whole.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return Mixture(cells.filter("tokens > 0").withColumn("fitted", F.lit(0.0)), 0.0, None)
    shares, supplies = {}, {}
    for d in DIMENSIONS:
        values = whole.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("supply"))
        if d in given:
            weights = given[d].filter("weight > 0").withColumnRenamed("value", "named")
            absent = weights.join(values, weights["named"].eqNullSafe(values["value"]), "left_anti")
            if not absent.isEmpty():
                raise TargetsContradict(f"{d}: no tokens for the target of {absent.first()['named']!r}")
            values = values.join(weights, values["value"].eqNullSafe(weights["named"])).drop("named")
        else:
            values = values.withColumn("weight", F.pow(F.col("supply") / F.lit(total), F.lit(float(powers[d]))))
        weights = values.agg(F.sum("weight")).first()[0]
        shares[d] = scratch.table(values.select("value", "supply", (F.col("weight") / F.lit(weights)).alias("target")), f"values-{d}")
        supplies[d] = Supply(shares[d])
    drawn = min(s.widest(SHORT) for s in supplies.values()) if budget is None else total * budget
    for d in DIMENSIONS:
        goal = F.least("supply", F.col("target") * F.lit(supplies[d].scale(drawn)))
        goals = shares[d].select("value", goal.alias(f"goal_{d}"))
        whole = whole.join(goals, whole[d].eqNullSafe(goals["value"])).drop("value")
    whole = scratch.table(whole.withColumn("fitted", F.col("fitted") * F.lit(drawn / total)), "cells-1")
    before = math.inf
    for done in range(0, ROUNDS, ROUNDS_PER_PLAN):
        whole = reduce(
            lambda w, d: w.withColumn(
                "fitted", F.least(F.col("tokens").cast("double"), F.col("fitted") * F.col(f"goal_{d}") / F.sum("fitted").over(Window.partitionBy(d)))
            ),
            DIMENSIONS * ROUNDS_PER_PLAN,
            whole,
        )
        whole = scratch.table(whole, f"cells-{done + 2}")
        off = gap(whole, drawn)
        # targets that contradict each other stop getting closer
        if off <= TOLERANCE or off > 0.99 * before:
            break
        before = off
    if off > TOLERANCE:
        said = f"targets contradict each other: {off:.4f} of the drawn tokens are out of place after {done + ROUNDS_PER_PLAN} rounds"
        if given:
            raise TargetsContradict(said)
        warnings.warn(said, stacklevel=3)
    drawn = whole.agg(F.sum("fitted")).first()[0]
    marginals = [
        whole.groupBy(F.col(d).alias("v")).agg((F.sum("fitted") / F.lit(drawn)).alias("drawn"))
        .join(shares[d], F.col("v").eqNullSafe(F.col("value")))
        .select(F.lit(d).alias("dimension"), F.col("v").cast("string").alias("value"), "target", "drawn")
        for d in DIMENSIONS
    ]
    fitted = whole.select(*DIMENSIONS, "tokens", "fitted")
    if left_out is not None:
        fitted = fitted.unionByName(left_out.select(*DIMENSIONS, "tokens", F.lit(0.0).alias("fitted")))
    return Mixture(fitted, off, reduce(DataFrame.unionByName, marginals))


def _same(left: DataFrame, prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (left[d].eqNullSafe(F.col(f"{prefix}{d}")) for d in DIMENSIONS))


def mix(
    scratch: Scratch,
    docs: DataFrame,
    powers: dict[str, float] | None = None,
    seed: int = 0,
    budget: float | None = None,
    targets: DataFrame | None = None,
    topics: Column | str | None = None,
) -> DataFrame:
    """All columns of the documents drawn, with their `probability` and `fitted_share`.

    `budget`: the share of all tokens to draw, instead of the largest that meets the targets.
    `targets`: weights (dimension, value, weight) instead of the powers. `topics`: a column of
    `docs` or an expression over them instead of the guess.
    """
    if budget is not None and not 0 < budget <= 1:
        raise ValueError("the budget is a share of the tokens, above 0 and at most 1")
    powers = powers or POWERS
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    at = {c: F.col(names[columns.index(c)]) for c in ("doc_id", "text", "source", "lang")}
    guess = topic(F.coalesce(F.col("text"), F.lit("")))
    subject = guess if topics is None else F.col(topics) if isinstance(topics, str) else topics
    inner = docs.select("*", subject.alias("__topic")).toDF(*names, "topic").withColumns({"source": at["source"], "lang": at["lang"]})
    place = F.when(at["doc_id"].isNull(), F.monotonically_increasing_id())
    inner = inner.withColumn("u", seeded_unit(seed, at["doc_id"], F.xxhash64(at["text"]), place))
    cells = inner.withColumn("tokens", n_words(at["text"])).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    fitted = rake(scratch, cells, powers, budget, targets).cells
    drawn_tokens = fitted.agg(F.sum("fitted")).first()[0]
    fitted = fitted.select(
        *(F.col(d).alias(f"f_{d}") for d in DIMENSIONS),
        (F.col("fitted") / F.col("tokens")).alias("probability"),
        (F.col("fitted") / F.lit(drawn_tokens or 1.0)).alias("fitted_share"),
    )
    joined = inner.join(fitted, _same(inner, "f_"), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    drawn = joined.filter(F.col("u") < F.col("probability"))
    return drawn.select(*names, "topic", "probability", "fitted_share").toDF(*columns, "mix_topic", "probability", "fitted_share")
