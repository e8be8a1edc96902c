"""Counting n-grams for the fit takes memory by the unit of text, not by the task."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from paylens.llm import toxicity


def _batches():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(1000)]
    for at in range(0, len(texts), 25):
        part = texts[at : at + 25]
        yield pa.record_batch({"text": pa.array(part), "toxic": pa.array([i % 3 == 0 for i in range(len(part))], pa.bool_()).cast(pa.int32())})


def test_counting_stays_small_and_whole():
    batches = list(_batches())
    tracemalloc.start()
    found = pa.Table.from_batches(list(toxicity._count(iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    want = np.zeros((2, toxicity.BUCKETS), dtype=np.int64)
    for batch in batches:
        for i, toxic in enumerate(batch.column("toxic").to_pylist()):
            want[toxic, toxicity.present(batch.column("text").slice(i, 1), None)[1]] += 1
    held = np.flatnonzero(want.any(axis=0))
    assert found.column("bucket").to_pylist() == held.tolist()
    assert found.column("others").to_pylist() == want[0, held].tolist()
    assert found.column("toxics").to_pylist() == want[1, held].tolist()
