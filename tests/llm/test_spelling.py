"""Spelling variants against counted words and all single edits."""

from __future__ import annotations

import random

import pytest

from paylens.llm import queries, spelling
from paylens.llm.common import Scratch
from tests.llm import plain
from tests.llm.test_results import frame, given, odd_texts


def rows_of(df):
    found = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_of_given_documents(spark, sf):
    out = queries.op13_spelling_variants(spark, sf)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(out) == plain.spelling_rows(given(spark, sf))


def odd_documents():
    rng = random.Random(8)
    words = ["abcab", "ababab", "aaaaa", "aaaaaa", "aaaaaaaa", "aabaa", "baaaa", "Ünder", "ünder", "under", "kettle", "ketle", "kettles", "kattle", "x" * 3000, "x" * 3001, "Éclair", "éclair", "×÷×÷×"]
    words += ["".join(rng.choices("ab", k=rng.randrange(5, 9))) for _ in range(60)]
    texts = [" ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(words, [rng.randrange(1, 9) for _ in words], k=400)) for _ in range(40)]
    return [*texts, *odd_texts(), "1kettle2ketle_kettles", "broom " * 40 + "broon " * 12 + "croon " * 4]


def test_of_odd_texts(spark):
    texts = odd_documents()
    ids = [None if k % 9 == 0 else k % 17 for k in range(len(texts))]
    got = rows_of(spelling.variants(Scratch(spark, "t"), frame(spark, texts, ids).repartition(3)))
    assert got == plain.spelling_rows(list(zip(ids, texts, strict=True)))
    assert any(form is not None and root != form for form, root, *_ in got.values())
    assert spelling.variants(Scratch(spark, "t"), frame(spark, [])).count() == 0
    assert spelling.variants(Scratch(spark, "t"), frame(spark, [None, "", "a b c"])).count() == 0


def test_pivots_are_disjoint_and_least():
    rng = random.Random(1)
    words = {"".join(rng.choices("abcde", k=rng.randrange(5, 14))) for _ in range(3000)} | {"aaaaa", "ababab"}
    counts = {}
    for w in words:
        for i in range(len(w) - 1):
            counts[w[i : i + 2]] = counts.get(w[i : i + 2], 0) + 1
    order = {g: (k, n) for k, (n, g) in enumerate(sorted((n, g) for g, n in counts.items()))}
    for w in words:
        prefix, (i, j), third = spelling.signature(w, order)
        grams = [order[w[k : k + 2]] for k in range(len(w) - 1)]
        assert prefix == [(r, k) for k, (r, _) in enumerate(grams) if r <= third] and len(prefix) >= 3
        pairs = [(grams[a][1] + grams[b][1]) for a in range(len(grams)) for b in range(a + 2, len(grams)) if grams[a][0] <= third and grams[b][0] <= third]
        assert prefix[j][1] - prefix[i][1] >= 2
        assert grams[prefix[i][1]][1] + grams[prefix[j][1]][1] == min(pairs)
