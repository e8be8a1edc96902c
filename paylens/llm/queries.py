"""One thin query per operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm import conversation_repair, hash_forest, metric_tree, packing, sharding, simhash, spelling, substring_dedup, token_files, toxicity
from paylens.llm.common import Scratch, documents, text_of
from paylens.llm.line_dedup import remove_repeated_lines
from paylens.llm.minhash import NearDuplicates
from paylens.llm.mixing import mix
from paylens.llm.oracles import ORACLES as ORACLES

TOKENIZER = "word_bpe_49k.json"
SHARDS = 8
MB_PER_FILE = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = packing.token_runs(Scratch(spark, "op1"), documents(spark, sf_dir), tokenizer_path(), end_id=1)
    return packing.pieces(runs, window=2048)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(Scratch(spark, "op2"), documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix(Scratch(spark, "op3"), documents(spark, sf_dir))
    rounded = (F.round(c, 9).alias(c) for c in ("probability", "fitted_share"))
    return drawn.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), *rounded)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(Scratch(spark, "op5"), documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_lines_removed").cast("long").alias("n_removed"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.interleave(Scratch(spark, "op6"), rows, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(Scratch(spark, "op7"), spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, top=20)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "op8")
    folder = scratch.uri("files")
    total = text_of(docs).agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # a file of ids is about three quarters of its texts' size
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (MB_PER_FILE << 20))
    manifest = token_files.write_tokens(scratch, docs, tokenizer_path(), 2, folder, shards)
    return token_files.read_tokens(manifest, folder)


def op9_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_tree.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return metric_tree.search(Scratch(spark, "op9"), rows, every=50, top=5)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NearDuplicates(Scratch(spark, "op10"), documents(spark, sf_dir), words=2, threshold_pct=80).result()
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = conversation_repair.Repair(Scratch(spark, "op11"), conversation_repair.damage(given), given)
    return repair.report()


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(Scratch(spark, "op12"), documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(Scratch(spark, "op13"), documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_suffix_array_dedup,
        op3_mixing,
        op4_toxicity,
        op5_line_dedup,
        op6_sharding,
        op7_hash_forest,
        op8_token_files,
        op9_metric_tree,
        op10_minhash,
        op11_conversation_repair,
        op12_simhash,
        op13_spelling_variants,
    )
}
