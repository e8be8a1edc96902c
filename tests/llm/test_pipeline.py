"""Every stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_results import check_pieces, frame, odd_texts

SF = "/root/testdata/sf0.001"


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing",
    ]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=lambda r: r["doc_id"])
        out = stage(spark, docs, SF)
        if name == "packing":
            check_pieces(out.collect(), [(r["doc_id"], r["text"]) for r in before])
            break
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "line dedup":
            for r, gone in zip(before, plain.deleted_lines([r["text"] for r in before]), strict=True):
                left = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in gone)
                if r["doc_id"] in after:
                    assert (after[r["doc_id"]]["text"], after[r["doc_id"]]["n_chars"]) == (left, len(left))
                else:
                    assert gone and not left.strip()
        else:
            assert all(after[r["doc_id"]] == r for r in before if r["doc_id"] in after)
        if name == "MinHash near-dedup":
            groups = plain.near_groups([plain.shingles(r["text"], 5) for r in before])
            assert sorted(after) == sorted(before[g]["doc_id"] for g in set(groups))


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (frame(spark, odd_texts(), [None, 3, 3, *range(3, 14)]), frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                assert "sequence_id" in out.columns
                assert sum(Counter(r["doc_id"] for r in out.collect()).values()) >= docs.count()
                break
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
