"""Repair of conversations to the order (s?(ua)+)? of role initials, at least cost.

A conversation's rows are taken by turn, nulls first; rows of one turn by role,
then by the MD5 of the text. Edits and their costs: Keep 0, Rerole to user or
assistant 2, Delete 3, Insert a user or assistant row with empty text 2. Blank
rows and rows whose role and text came before must be deleted; a row that ends
in no full stop, exclamation or question mark costs 1 more unless deleted. Of
the cheapest edits the ones whose initials come first in ASCII order win.

One integer holds all of that. Its high digits are the cost; below them each row
has a place of three octal digits for the letters of its edits, inserts first,
padded with zeros at the end. Rows are edges between the four states of the
order (nothing yet, after s, after u, after a), an edge's weight is the cost and
letters of its edits at the row's place, weights add up, and the least integer
is the repair. No more than two inserts stand before a row: a third would come
back to a state already paid for. Every way through a row ends in its own
letter, so no row's letters are a prefix of another way's, and comparing padded
places is comparing the strings.

A conversation of any length is cut. Up to `chunk` rows give a 4 x 4 matrix of
least weights; for the letters behind an entry only their order matters, so
their rank among the matrix's entries, four bits, is the entry's letter one
level up, where up to `chunk` matrices are rows again, until one is left. The
states chosen there are handed down the levels. No group larger than a chunk is
held; the repaired rows of a conversation pass through one task as a stream,
because SHA-256 has no parallel form.

Defined results: null roles and texts count as one space; a null turn comes
first, and a null conv_id is a conversation of its own; an empty role has no
initial and is never kept; rows that are alike in every column are copies, all
but the first duplicates; a conversation of no rows has zeros, an empty audit
and the hash of nothing; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from functools import cached_property, lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import Scratch

BLANKS = " \t\n\x0b\f\r"
ENDS = ".!?"
CHUNK = 256
STATES = 4
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(STATES)
#: Letters as octal digits in ASCII order; zero ends a place.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
ROW_BITS, MATRIX_BITS = 9, 4
#: State after a row of the role, where the order allows one.
NEXT = {
    "s": {NOTHING: AFTER_S},
    "u": {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
    "a": {AFTER_U: AFTER_A},
}
INSERTED = {state: "a" if state == AFTER_U else "u" for state in range(STATES)}
FULL = {"u": "user", "a": "assistant"}
#: Inserts that end a conversation from each state.
TAILS = {NOTHING: "", AFTER_A: "", AFTER_U: "I", AFTER_S: "II"}
KEYS = ["conv_id", "turn", "role", "digest"]


def damage(rows: DataFrame, copies_too: bool = True) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of '<conv_id>:<turn>' modulo 20.

    0 drops the row, 1 empties its text, 2 removes the ends of sentences, 3
    repeats it, 4 makes it the user's.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    picked = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    picked = picked.filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )
    return picked.drop("copy")


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joined where all `names` agree, nulls included; once in the result, with the left's values."""
    right = right.select(*(F.col(c).alias(f"right_{c}") if c in names else F.col(c) for c in right.columns))
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"right_{name}"))
    return left.join(right, same, how).drop(*(f"right_{n}" for n in names))


# ways through one row, one integer each


@lru_cache(None)
def row_ways(kind: int) -> tuple[tuple[int, ...] | None, ...]:
    """For each (state before, state after): (cost, digits) of the least way through a row, or None.

    kind 0: must be deleted; else 1 + 2 * (index in 's', 'u', 'a', other) + truncated.
    """
    least: dict[tuple[int, int], tuple[int, int]] = {}
    role, truncated = ("sua"[(kind - 1) // 2 :][:1], (kind - 1) % 2) if kind else ("", 0)
    for start in range(STATES):
        state = start
        for inserts in range(3):
            ways = [("D", state)]
            if kind and state in NEXT.get(role, {}):
                ways.append(("K", NEXT[role][state]))
            if kind:
                ways += [("R", NEXT[to][state]) for to in FULL if state in NEXT[to]]
            for letter, end in ways:
                cost = inserts * COST["I"] + COST[letter] + (truncated if letter != "D" else 0)
                digits = sum(DIGIT[x] << 3 * (2 - i) for i, x in enumerate("I" * inserts + letter))
                least[start, end] = min(least.get((start, end), (cost, digits)), (cost, digits))
            state = NEXT[INSERTED[state]][state]
    return tuple(least.get((p, q)) for p in range(STATES) for q in range(STATES))


def fold(items: tuple, bits: int) -> list[tuple[int, int, str] | None]:
    """Least way through all `items` for each (state before, state after): cost, digits, states passed.

    An item has (cost, digits of `bits` bits) or None for each pair of states.
    """
    places = bits * len(items)
    out: list[tuple[int, int, str] | None] = []
    for start in range(STATES):
        reached: list[tuple[int, str] | None] = [None] * STATES
        reached[start] = (0, str(start))
        for i, item in enumerate(items):
            down = bits * (len(items) - 1 - i)
            weights = [None if way is None else (way[0] << places) + (way[1] << down) for way in item]
            after: list[tuple[int, str] | None] = [None] * STATES
            for p, so_far in enumerate(reached):
                if so_far is None:
                    continue
                for q in range(STATES):
                    weight = weights[p * STATES + q]
                    if weight is not None and (after[q] is None or so_far[0] + weight < after[q][0]):
                        after[q] = (so_far[0] + weight, so_far[1] + str(q))
            reached = after
        out += [None if x is None else (x[0] >> places, x[0] & (1 << places) - 1, x[1]) for x in reached]
    return out


def letters_of(digits: int, rows: int) -> str:
    """The letters that `rows` places of three digits hold."""
    found = (digits >> 3 * k & 7 for k in range(3 * rows - 1, -1, -1))
    return "".join(LETTER[x] for x in found if x)


def _ranked(ways: list) -> tuple[list, list]:
    """Costs and the ranks of the digits among all entries."""
    order = {digits: k for k, digits in enumerate(sorted({w[1] for w in ways if w is not None}))}
    return [None if w is None else w[0] for w in ways], [None if w is None else order[w[1]] for w in ways]


@lru_cache(100_000)
def _chunk(kinds: bytes) -> tuple[list, list, list]:
    ways = fold(tuple(row_ways(k) for k in kinds), ROW_BITS)
    return *_ranked(ways), [None if w is None else letters_of(w[1], len(kinds)) for w in ways]


CHUNK_FIELDS = "part int, seq long, cost array<long>, rank array<int>, letters array<string>"


def _types(schema, names) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {n: to_arrow_type(schema[n].dataType) for n in names}


def _batch(cols: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array(values, types[n]) for n, values in cols.items()})


CHUNK_TYPES = {
    "part": pa.int32(),
    "seq": pa.int64(),
    "cost": pa.list_(pa.int64()),
    "rank": pa.list_(pa.int32()),
    "letters": pa.list_(pa.string()),
}


def _chunks(batches, chunk: int, types):
    """Sorted rows (KEYS, kind) to chunks of one conversation, numbered by task and place in it."""
    part, nobody = TaskContext.get().partitionId(), object()
    now, seq, first, kinds = nobody, 0, None, bytearray()

    def closed(out):
        for name, value in zip((*KEYS, *CHUNK_TYPES), (*first, part, seq, *_chunk(bytes(kinds))), strict=True):
            out[name].append(value)

    for batch in batches:
        out: dict[str, list] = {n: [] for n in (*KEYS, *CHUNK_TYPES)}
        for *key, kind in zip(*(batch.column(n).to_pylist() for n in (*KEYS, "kind")), strict=True):
            if kinds and (key[0] != now or len(kinds) == chunk):
                closed(out)
                seq = seq + 1 if key[0] == now else 0
                kinds.clear()
            elif key[0] != now:
                seq = 0
            if not kinds:
                now, first = key[0], key
            kinds.append(kind)
        yield _batch(out, types)
    if kinds:
        out = {n: [] for n in (*KEYS, *CHUNK_TYPES)}
        closed(out)
        yield _batch(out, types)


def _parents(batches, types):
    """Sorted matrices (conv_id, p_part, p_seq, part, seq, cost, rank) to one matrix per parent, with the states passed."""
    names = ("conv_id", "part", "seq", "cost", "rank", "states", "child_part", "child_seq")
    key, items, below = None, [], []

    def closed(out):
        ways = fold(tuple(items), MATRIX_BITS)
        values = (*key, *_ranked(ways), [None if w is None else w[2] for w in ways], [b[0] for b in below], [b[1] for b in below])
        for name, value in zip(names, values, strict=True):
            out[name].append(value)

    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        cols = ("conv_id", "p_part", "p_seq", "part", "seq", "cost", "rank")
        for conv, p_part, p_seq, part, seq, cost, rank in zip(*(batch.column(n).to_pylist() for n in cols), strict=True):
            if items and key != (conv, p_part, p_seq):
                closed(out)
                items, below = [], []
            key = (conv, p_part, p_seq)
            items.append(tuple(None if c is None else (c, r) for c, r in zip(cost, rank, strict=True)))
            below.append((part, seq))
        yield _batch(out, types)
    if items:
        out = {n: [] for n in names}
        closed(out)
        yield _batch(out, types)


def _exit() -> Column:
    """From a whole conversation's matrix: the state it ends in, with the inserts that end it."""
    ways = []
    for q in range(STATES):
        cost = F.col("cost")[q] + len(TAILS[q]) * COST["I"]
        way = F.struct(cost.alias("cost"), F.col("rank")[q].alias("rank"), F.lit(TAILS[q]).alias("tail"), F.lit(q).alias("q"))
        ways.append(F.when(F.col("cost")[q].isNotNull(), way))
    return F.array_min(F.filter(F.array(*ways), lambda w: w.isNotNull()))


class _Reading:
    """One conversation as its records come by."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.state, self.letters = NOTHING, iter("")
        self.audit: list[str] = []
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.turns = 0
        self.before = None
        self.keeps = None

    def edited(self, letter: str, role: str = "") -> tuple[str, str] | None:
        """Takes one edit; the role of the row it leaves, if any."""
        self.audit.append(letter)
        self.cost += COST[letter]
        if letter == "D":
            return None
        initial = role[:1] if letter == "K" else INSERTED[self.state]
        self.state = NEXT[initial][self.state]
        return role if letter == "K" else FULL[initial]

    def inserts(self):
        """Roles of the inserts up to the next other letter, which comes last as itself."""
        for letter in self.letters:
            if letter != "I":
                yield letter, None
                return
            yield letter, self.edited("I")

    def row(self, turn, role: str, n: int, blank: bool, first: bool, truncated: bool):
        """Roles inserted before the row; afterwards `keeps` is its role if it stays."""
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += first and truncated
        self.illegal += n - 1 + (self.before is not None and self.before + role[:1] not in ("su", "ua", "au"))
        self.before = role[:1]
        for letter, inserted in self.inserts():
            if inserted is not None:
                yield inserted
            else:
                self.keeps = self.edited(letter, role)
        if self.keeps is not None and first and not blank and truncated:
            self.cost += 1
        self.audit.append("D" * (n - 1))
        self.cost += COST["D"] * (n - 1)


RECORD = [*KEYS, "step", "letters", "n", "blank", "first", "truncated", "text"]


def _read(batches):
    """Sorted records to (conversation, None) when one ends and (conversation, (place, letter, role, text)) for each row it has after repair."""
    now = None
    place = 0

    def ended(now, place):
        for _, role in now.inserts():
            yield now, (place, "I", role, "")
            place += 1
        yield now, None

    for batch in batches:
        for conv, turn, role, _, step, letters, n, blank, first, truncated, text in zip(*(batch.column(c).to_pylist() for c in RECORD), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    yield from ended(now, place)
                now, place = _Reading(conv), 0
            if step == 1:
                now.letters = iter(letters)
            elif step == 2:
                now.keeps = None
                for inserted in now.row(turn, role, n, blank, first, truncated):
                    yield now, (place, "I", inserted, "")
                    place += 1
            elif step == 3 and now.keeps is not None:
                yield now, (place, "K" if now.keeps == role else "R", now.keeps, text)
                now.keeps = None
                place += 1
    if now is not None:
        yield from ended(now, place)


REPORT = {
    "gaps": pa.int64(),
    "blank": pa.int64(),
    "duplicate": pa.int64(),
    "truncated": pa.int64(),
    "illegal": pa.int64(),
    "cost": pa.int64(),
    "audit": pa.string(),
    "repaired_sha256": pa.string(),
}
REPORT_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = {"place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
TURNS_SCHEMA = "place long, edit string, role string, text string"
ROWS_OUT = 256


def _reports(batches, types):
    out: dict[str, list] = {n: [] for n in types}
    digest = hashlib.sha256()
    for now, line in _read(batches):
        if line is not None:
            place, _, role, text = line
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            continue
        gaps = 0 if now.low is None else now.high - now.low + 1 - now.turns
        counts = (gaps, now.blank, now.duplicate, now.truncated, now.illegal, now.cost)
        for name, value in zip(types, (now.conv_id, *counts, "".join(now.audit), digest.hexdigest()), strict=True):
            out[name].append(value)
        digest = hashlib.sha256()
        if len(out["conv_id"]) == ROWS_OUT:
            yield _batch(out, types)
            out = {n: [] for n in types}
    yield _batch(out, types)


def _turns(batches, types):
    out: dict[str, list] = {n: [] for n in types}
    for now, line in _read(batches):
        if line is not None:
            for name, value in zip(types, (now.conv_id, *line), strict=True):
                out[name].append(value)
        if len(out["conv_id"]) >= ROWS_OUT:
            yield _batch(out, types)
            out = {n: [] for n in types}
    yield _batch(out, types)


class Repair:
    """One repair of `rows` (conv_id, turn, role, text); `listed` (conv_id) names conversations that may have no rows."""

    def __init__(self, scratch: Scratch, rows: DataFrame, listed: DataFrame | None = None, chunk: int = CHUNK) -> None:
        self.scratch, self.chunk = scratch, chunk
        spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
        rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
        self.texts = rows.withColumn("digest", F.md5("text"))
        self.listed = (rows if listed is None else listed).select("conv_id").distinct()
        self.lines = scratch.table(self._lines(), "lines")
        self.conv_type = rows.select("conv_id").schema

    def _lines(self) -> DataFrame:
        """One narrow row for rows that are alike: KEYS, n, blank, truncated, first (nothing with its role and text came before), kind."""
        ended = F.rtrim(F.col("text"), F.lit(BLANKS))
        marked = self.texts.withColumn("blank", ended == "").withColumn("truncated", ~F.right(ended, F.lit(1)).isin(*ENDS))
        alike = self.scratch.table(marked.groupBy(*KEYS, "blank", "truncated").agg(F.count("*").alias("n")), "alike")
        came = alike.groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("turn"))
        came = came.select("conv_id", "role", "digest", F.when(~F.col("none"), F.col("turn")).alias("turn"))
        # the key has the turn as well, so that no text that is everywhere in a conversation makes a large group
        found = _joined(alike, came.withColumn("came", F.lit(True)), KEYS, "left")
        lines = found.select(*alike.columns, F.col("came").isNotNull().alias("first"))
        initial = F.substring("role", 1, 1)
        place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        kind = F.when(F.col("blank") | ~F.col("first"), 0).otherwise(1 + 2 * place + F.col("truncated").cast("int"))
        return lines.withColumn("kind", kind)

    @cached_property
    def decided(self) -> DataFrame:
        """The first row's KEYS of every chunk and the letters of its edits."""
        scratch = self.scratch
        types = _types(self.lines.schema, KEYS) | CHUNK_TYPES
        schema = f"{', '.join(f'{n} {t}' for n, t in self.lines.select(*KEYS).dtypes)}, {CHUNK_FIELDS}"
        ordered = self.lines.select(*KEYS, "kind").repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
        chunks = scratch.table(ordered.mapInArrow(partial(_chunks, chunk=self.chunk, types=types), schema), "chunks")
        several = chunks.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
        several = scratch.table(several.filter("n > 1"), "several")
        alone = _joined(chunks, several.select("conv_id"), ["conv_id"], "left_anti").withColumn("exit", _exit())
        letters = F.concat(F.element_at("letters", F.col("exit.q") + 1), F.col("exit.tail"))
        decided = alone.select(*KEYS, letters.alias("letters"))
        if not several.take(1):
            return decided
        mine = _joined(chunks, several.select("conv_id"), ["conv_id"], "left_semi")
        ways = self._handed_down(mine.select("conv_id", "part", "seq", "cost", "rank"))
        found = _joined(mine, ways, ["conv_id", "part", "seq"])
        letters = F.concat(F.element_at("letters", F.col("p") * STATES + F.col("q") + 1), F.col("tail"))
        return decided.union(found.select(*KEYS, letters.alias("letters")))

    def _handed_down(self, level: DataFrame) -> DataFrame:
        """For matrices (conv_id, part, seq, cost, rank) of conversations that have several: the states p and q around each, and the tail behind it."""
        scratch = self.scratch
        conv = level.select("conv_id").schema
        conv_sql = level.select("conv_id").dtypes[0][1]
        fields = {k: CHUNK_TYPES[k] for k in ("part", "seq", "cost", "rank")}
        types = _types(conv, ["conv_id"]) | fields
        types |= {"states": pa.list_(pa.string()), "child_part": pa.list_(pa.int32()), "child_seq": pa.list_(pa.int64())}
        schema = f"conv_id {conv_sql}, part int, seq long, cost array<long>, rank array<int>, states array<string>, child_part array<int>, child_seq array<long>"
        tops, levels = [], []
        while True:
            inside = level.filter("seq > 0").take(1)
            p_part, p_seq = (F.col("part"), F.floor(F.col("seq") / self.chunk)) if inside else (F.floor(F.col("part") / self.chunk).cast("int"), F.lit(0).cast("long"))
            keyed = level.select("*", p_part.alias("p_part"), p_seq.cast("long").alias("p_seq"))
            keyed = keyed.repartition("conv_id", "p_part", "p_seq").sortWithinPartitions("conv_id", "p_part", "p_seq", "part", "seq")
            levels.append(scratch.table(keyed.mapInArrow(partial(_parents, types=types), schema), f"level-{len(levels)}"))
            level = levels[-1].select("conv_id", "part", "seq", "cost", "rank")
            if not level.filter("part > 0 or seq > 0").take(1):
                break
        ways = level.withColumn("exit", _exit())
        ways = ways.select("conv_id", "part", "seq", F.lit(NOTHING).alias("p"), F.col("exit.q").alias("q"), F.col("exit.tail").alias("tail"))
        for k in range(len(levels) - 1, -1, -1):
            up = levels[k].drop("cost", "rank")
            found = _joined(up, ways, ["conv_id", "part", "seq"])
            path = F.element_at("states", F.col("p") * STATES + F.col("q") + 1)
            each = found.select("conv_id", path.alias("path"), "tail", F.posexplode(F.arrays_zip("child_part", "child_seq")).alias("i", "child"))
            state = lambda i: F.substring("path", i, F.lit(1)).cast("int")
            last = F.col("i") + 2 == F.length("path")
            ways = each.select(
                "conv_id",
                F.col("child.child_part").alias("part"),
                F.col("child.child_seq").alias("seq"),
                state(F.col("i") + 1).alias("p"),
                state(F.col("i") + 2).alias("q"),
                F.when(last, F.col("tail")).otherwise("").alias("tail"),
            )
            ways = scratch.table(ways, f"ways-{k}")
        return ways

    def _records(self) -> DataFrame:
        """All records of a conversation together and in order: itself, each chunk's letters, each row's marks, each row's text."""
        nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
        kinds = dict(self.lines.dtypes)

        def shaped(df: DataFrame, step: int) -> DataFrame:
            have = {**kinds, "letters": "string", "text": "string"}
            return df.select(*(F.lit(step).alias(c) if c == "step" else F.col(c) if c in df.columns else nothing(c, have[c]) for c in RECORD))

        records = shaped(self.listed, 0).union(shaped(self.decided, 1)).union(shaped(self.lines, 2)).union(shaped(self.texts, 3))
        return records.repartition("conv_id").sortWithinPartitions(*KEYS, "step")

    def _out(self, function, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
        types = _types(self.conv_type, ["conv_id"]) | columns
        conv = self.lines.select("conv_id").dtypes[0][1]
        return self._records().mapInArrow(partial(function, types=types), f"conv_id {conv}, {schema}")

    def report(self) -> DataFrame:
        """Per conversation: conv_id, gaps, faults, illegal neighbours, cost, audit, SHA-256 of the repaired rows."""
        return self._out(_reports, REPORT, REPORT_SCHEMA)

    def turns(self) -> DataFrame:
        """The repaired rows: conv_id, place (from 0), edit (K, R or I), role, text."""
        return self._out(_turns, TURNS, TURNS_SCHEMA)
