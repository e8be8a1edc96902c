"""SimHash against plain fingerprints and all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from paylens.llm import queries, simhash
from paylens.llm.common import Scratch
from tests.llm import plain
from tests.llm.test_results import frame, given, odd_texts


def test_of_given_documents(spark):
    rows = given(spark, "/root/testdata/sf0.01")
    prints = [plain.simhash(t) for _, t in rows]
    groups = plain.hamming_groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: (f"{x:016x}", rows[g][0]) for (d, _), x, g in zip(rows, prints, groups, strict=True)}


def test_of_odd_texts(spark):
    texts = [*odd_texts(), "A b C", "a B c", "a b c", "Éa b", "éa b"]
    ids = [None if k in (2, 14) else 50 - k for k in range(len(texts))]
    prints = [plain.simhash(t) for t in texts]
    groups = plain.hamming_groups(prints)
    least = {}
    for d, g in zip(ids, groups, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    rows = simhash.near_duplicates(Scratch(spark, "t"), frame(spark, texts, ids).repartition(3)).collect()
    want = sorted((str(d), x, str(least.get(g))) for d, x, g in zip(ids, prints, groups, strict=True))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in rows) == want
    assert simhash.near_duplicates(Scratch(spark, "t"), frame(spark, [])).count() == 0


def copies(seed, groups=30, each=40, most=5):
    """Fingerprints around some centres."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(each):
            x = centre
            for k in rng.sample(range(64), rng.randrange(most)):
                x ^= 1 << k
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_bit_slices_find_every_pair(radius):
    prints = np.array(copies(radius), dtype=np.uint64)
    np.random.default_rng(2).shuffle(prints)
    n = len(prints)
    buckets = np.sort(np.random.default_rng(3).integers(0, 4, size=n))
    last = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True))
    after = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(n)
    planes = simhash._planes(prints)
    got = {(i, i + d) for d in range(1, n) for i in simhash.near_lanes(planes, after, d, radius).tolist()}
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = {(i, j) for i, j in np.argwhere((far <= radius) & (buckets[:, None] == buckets[None, :])).tolist() if i < j}
    assert got == want


@pytest.mark.parametrize("most", [100, 1024])
def test_large_buckets_are_dealt_out_again(spark, most):
    # all fingerprints share 40 bits, so that the first buckets hold nearly everything
    prints = sorted({x & 0xFFFFFF00000000 | 0xAB for x in copies(9, 20, 30)} | set(copies(10, 5, 30)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    links = simhash.links(Scratch(spark, "t"), spark.createDataFrame(signed, "fp long"), most=most).collect()
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        a, b = (r[c] % (1 << 64) for c in "ab")
        assert (a ^ b).bit_count() <= 2
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    groups = plain.hamming_groups(prints)
    assert [root(x) for x in prints] == [prints[g] for g in groups]
