"""From raw documents to packed token sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm import minhash, packing, toxicity
from paylens.llm.common import Scratch, leading
from paylens.llm.line_dedup import remove_repeated_lines
from paylens.llm.mixing import mix
from paylens.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejection score, all columns."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return leading(scored, docs.columns, F.col(f"c{len(docs.columns)}") < toxicity.REJECT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of line runs; n_chars follows the text.

    A document all of whose lines were later copies is itself a copy and goes.
    """
    columns = docs.columns
    out = remove_repeated_lines(Scratch(spark, "lines"), docs)
    removed, text = F.col(f"c{len(columns) + 1}"), F.col(f"c{columns.index('text')}")
    left = leading(out, columns, ~((removed > 0) & ~text.rlike(r"\S")))
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles to 0.8 or more."""
    return minhash.keep_one(Scratch(spark, "near"), docs, words=5, threshold_pct=80)


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target shares."""
    return leading(mix(Scratch(spark, "mix"), docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece of a document."""
    runs = packing.token_runs(Scratch(spark, "pack"), docs, tokenizer_path(), end_id=1)
    return packing.pieces(runs, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", draw_mixture),
    ("packing", pack),
]

#: Training a classifier is beyond SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
