"""Brute-force versions, in plain Python, of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def removed_bytes(texts: list[bytes], length: int = 400) -> list[tuple[int, int, str]]:
    """Per text: bytes covered by a string of `length` that starts elsewhere too, runs, hash of the rest."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None, words: int) -> frozenset:
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_groups(sets: list[frozenset], pct: int = 80) -> list[int]:
    """Smallest index reachable by links, per set."""
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter()
    for members in holders.values():
        for a in range(len(members)):
            for b in range(a):
                common[members[b], members[a]] += 1
    for (i, j), both in common.items():
        if 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(sets))]


def deleted_lines(texts: list[str | None], min_words: int = 8) -> list[set[int]]:
    """Line numbers of later copies of runs, texts in order."""
    solid = []
    for d, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        solid.append([(n, x, len(re.findall(r"[^ \t\n\x0B\f\r]+", x))) for n, x in enumerate(lines) if re.search(r"[^ \t\n\x0B\f\r]", x)])
    places = defaultdict(list)
    for d, rows in enumerate(solid):
        for s, (_, x, _) in enumerate(rows):
            places[x].append((d, s))
    gone = [set() for _ in texts]
    for at in places.values():
        for i, (da, sa) in enumerate(at):
            for db, sb in at[i + 1 :]:
                if sa and sb and solid[da][sa - 1][1] == solid[db][sb - 1][1]:
                    continue
                k = 0
                while sa + k < len(solid[da]) and sb + k < len(solid[db]) and solid[da][sa + k][1] == solid[db][sb + k][1]:
                    k += 1
                if sum(w for _, _, w in solid[db][sb : sb + k]) >= min_words:
                    gone[db].update(n for n, _, _ in solid[db][sb : sb + k])
    return gone


def nearest(ids: list[int], vectors: np.ndarray, every: int, top: int) -> dict[int, list[tuple[float, int]]]:
    scores = vectors @ vectors.T
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            found = sorted((-scores[i, j], c) for j, c in enumerate(ids) if c != q)[:top]
            out[q] = [(-s, c) for s, c in found]
    return out


def damaged_rows(rows):
    """(conv, turn, role, text) after faults by crc32 modulo 20."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def repaired(rows):
    """One conversation's rows in any order: gaps, faults, illegal, cost, audit, repaired rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    # least (cost, letters, rows after repair) from each state on; a letter put before strings keeps their order
    after = {s: (0, "", ()) if s in ("", "a") else None for s in ("", "s", "u", "a")}
    for i in range(len(rows), -1, -1):
        now = dict.fromkeys(after)
        if i == len(rows):
            now = dict(after)
        else:
            _, _, role, text = rows[i]
            late = faults[i] == "truncated"
            for s in now:
                ways = [(3, "D", s, ())]
                if faults[i] not in ("blank", "duplicate"):
                    if role and (s, role[0]) in step:
                        ways.append((late, "K", step[s, role[0]], ((role, text),)))
                    ways += [(2 + late, "R", step[s, to[0]], ((to, text),)) for to in ("user", "assistant") if (s, to[0]) in step]
                found = [(c + after[t][0], x + after[t][1], line + after[t][2]) for c, x, t, line in ways if after[t] is not None]
                now[s] = min(found, default=None)
        for _ in range(4):
            for s in now:
                for to in ("user", "assistant"):
                    t = step.get((s, to[0]))
                    if t and now[t] is not None:
                        way = (2 + now[t][0], "I" + now[t][1], ((to, ""), *now[t][2]))
                        now[s] = way if now[s] is None else min(now[s], way)
        after = now
    cost, audit, lines = after[""]
    counts = Counter(faults)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), lines


def simhash(text: str | None, words: int = 3) -> int:
    import xxhash

    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def hamming_groups(prints: list[int], radius: int = 2) -> list[int]:
    """Smallest index reachable by links, per fingerprint."""
    distinct = sorted(set(prints))
    values = np.array(distinct, dtype=np.uint64)
    group = {x: x for x in distinct}

    def root(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius).tolist():
            a, b = root(x), root(distinct[j])
            group[max(a, b)] = min(a, b)
    first: dict[int, int] = {}
    return [first.setdefault(root(x), i) for i, x in enumerate(prints)]


def spelling_words(docs, least: int = 3):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= least and len(w) >= 5}


def spelling_near(words):
    """Words one edit away, per word."""
    near = defaultdict(set)
    masked = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    return near


def spelling_rows(docs):
    """{word: (form, root, n, n_near, form_n)}"""
    words = spelling_words(docs)
    near = spelling_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


def nearest_rows(rows, every: int, top: int, score):
    """Per asked row, in order: its (score, vec_id) list over all rows of other ids."""
    out = []
    for q, x in rows:
        if q % every == 0:
            found = sorted((-score(x, y), c) for c, y in rows if c != q)[:top]
            out.append((q, [(-s, c) for s, c in found]))
    return sorted(out)


def logistic_scores(train, texts, sizes=(4, 5, 6), features=6000, least=3, penalty=5e-4, steps=300):
    """Scores of `texts` from n-grams of bytes, log-count ratios and logistic regression; train: (text, label)."""

    def grams(text):
        raw = (text or "").lower().encode()
        return {raw[i : i + n] for n in sizes for i in range(len(raw) - n + 1)}

    held = [(grams(t), y) for t, y in train]
    n_pos = sum(y for _, y in held)
    n_neg = len(held) - n_pos
    pos, neg = Counter(), Counter()
    for g, y in held:
        (pos if y else neg).update(g)

    def gain(x):
        out = 0.0
        for seen, size in ((pos[x], n_pos), (neg[x], n_neg)):
            for part, overall in ((seen, pos[x] + neg[x]), (size - seen, len(held) - pos[x] - neg[x])):
                if part:
                    out += part * np.log(part * len(held) / (size * overall))
        return out

    chosen = sorted((x for x in pos | neg if pos[x] + neg[x] >= least), key=lambda x: -gain(x))[:features]
    place = {x: i for i, x in enumerate(chosen)}
    ratio = np.array([np.log((pos[x] + 1) / (n_pos + 2)) - np.log((neg[x] + 1) / (n_neg + 2)) for x in chosen])

    def matrix(sets):
        out = np.zeros((len(sets), len(chosen)))
        for i, g in enumerate(sets):
            out[i, [place[x] for x in g if x in place]] = 1
        return out * ratio

    m, y = matrix([g for g, _ in held]), np.array([y for _, y in held], dtype=float)
    w, b = np.zeros(len(chosen)), np.log((n_pos + 1) / (n_neg + 1))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(m @ w + b))) - y
        grad = np.append(m.T @ error / len(y) + penalty * w, error.mean())
        first += 0.1 * (grad - first)
        second += 0.001 * (grad**2 - second)
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return 1 / (1 + np.exp(-(matrix([grams(t) for t in texts]) @ w + b)))
