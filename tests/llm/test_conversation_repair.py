"""Conversation repair against a plain backward search, on given and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paylens.llm import conversation_repair as cr
from paylens.llm import queries
from paylens.llm.common import Scratch
from tests.llm import plain

SCHEMA = "conv_id long, turn long, role string, text string, kind string, step int, right_conv_id long, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def sha(lines):
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def compared(report, rows, listed):
    got = {r["conv_id"]: tuple(r)[1:] for r in report}
    assert len(got) == len(report) and set(got) == set(listed)
    own = by_conversation(rows)
    for conv in listed:
        want, lines = plain.repaired(own[conv])
        assert got[conv] == (*want, sha(lines)), conv


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_conversations(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_conversation_repair(spark, sf)
    assert out.columns == ["conv_id", *cr.REPORT]
    compared(out.collect(), plain.damaged_rows(given), {r[0] for r in given})


def odd_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Hi.", "ok", "", " \n\t", "Why?", "Go!", None, "é.", "No end", "x" * 5000 + ".", "a. ", " "]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "sys", "U"]
    rows = []
    for conv in (*range(60), None):
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((conv, rng.choice([None, *range(-2, 9)]), rng.choices(roles, [9, 9, 4, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts)))
    rows += [(100, t, "user" if t % 3 else "assistant", f"turn {t // 2}.") for t in range(500)]
    rows += [(101, 5, "user", "again.")] * 300 + [(101, 6, "assistant", "well.")]
    rows += [(102, t, "user", "same.") for t in range(40)]
    rows += [(103, 1, "system", "rules."), (104, 2**40, "user", "far."), (104, 0, "assistant", "off")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [2, 7, 256])
def test_odd_rows_and_any_chunk(spark, chunk):
    rows = odd_rows()
    known = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    listed = {r[0] for r in rows} | {999}
    df = frame(spark, rows).repartition(3)
    repair = cr.Repair(Scratch(spark, "t"), df, spark.createDataFrame([(c,) for c in listed], "conv_id long"), chunk)
    compared(repair.report().collect(), known, listed)
    own = by_conversation(known)
    turns = by_conversation([(r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in repair.turns().collect()])
    for conv in listed:
        want, lines = plain.repaired(own[conv])
        got = sorted(turns[conv], key=lambda r: r[1])
        assert [(r[3], r[4]) for r in got] == list(lines) and [r[1] for r in got] == list(range(len(lines)))
        assert "".join(r[2] for r in got) == want[-1].replace("D", "")


def test_damage_of_odd_rows(spark):
    rows = odd_rows(4)
    got = sorted(map(repr, (tuple(r) for r in cr.damage(frame(spark, rows)).collect())))
    assert got == sorted(map(repr, plain.damaged_rows(rows)))


def test_empty_and_lost_conversations(spark):
    assert cr.Repair(Scratch(spark, "t"), frame(spark, [])).report().count() == 0
    lost = next(i for i in itertools.count() if not plain.damaged_rows([(i, 0, "user", "x.")]))
    given = frame(spark, [(lost, 0, "user", "x.")])
    row = cr.Repair(Scratch(spark, "t"), cr.damage(given), given).report().collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_other_id_types(spark):
    rows = frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Hi.")])
    named = rows.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id")))
    out = {r["conv_id"]: r["audit"] for r in cr.Repair(Scratch(spark, "t"), named).report().collect()}
    assert out == {"c1": "KK", "c2": "KI"}


def test_every_short_conversation_by_exhaustion():
    """The scalar weights against all edit sequences of up to three rows."""
    step, states = cr.NEXT, range(cr.STATES)
    for kinds in itertools.chain.from_iterable(itertools.product(range(9), repeat=n) for n in (1, 2, 3)):
        ways = cr.fold(tuple(cr.row_ways(k) for k in kinds), cr.ROW_BITS)
        least = {}

        def walk(i, state, cost, letters, start, run=0, kinds=kinds, least=least):
            if i == len(kinds):
                if run == 0:
                    key = (start, state)
                    least[key] = min(least.get(key, (cost, letters)), (cost, letters))
                return
            if run < 2:
                walk(i, step[cr.INSERTED[state]][state], cost + 2, letters + "I", start, run + 1)
            kind = kinds[i]
            walk(i + 1, state, cost + 3, letters + "D", start)
            if kind:
                role, late = "suao"[(kind - 1) // 2], (kind - 1) % 2
                if state in step.get(role, {}):
                    walk(i + 1, step[role][state], cost + late, letters + "K", start)
                for to in "ua":
                    if state in step[to]:
                        walk(i + 1, step[to][state], cost + 2 + late, letters + "R", start)

        for s in states:
            walk(0, s, 0, "", s)
        for p, q in itertools.product(states, states):
            way = ways[p * cr.STATES + q]
            got = None if way is None else (way[0], cr.letters_of(way[1], len(kinds)))
            assert got == least.get((p, q)), (kinds, p, q)
