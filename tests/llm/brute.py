"""Plain versions of operators, a row at a time, for the tests."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from tideline.llm._common import row_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIGNS = set("!#$%&*|<>{}[]=_~^@\\/")


def shares(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Target by source: the budget by weight, caps at three times the size, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if 3.0 * sizes[s] < share * weight[s]]
        if not over:
            return out | {s: min(3.0 * sizes[s], share * weight[s]) for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def mixed(rows: list) -> list:
    """rows: (doc_id, source, text, tie). For each: (row, size, source_size, target, epochs)."""
    by, out = {}, []
    for r in rows:
        i, source, text, tie = r
        digest = hashlib.md5(f"11|{'null' if i is None else i}|{tie}".encode()).hexdigest()
        signs = sum(c in SIGNS for c in text or "")
        quality = 1.0 - 0.9 * min(1.0, signs * 4 / len(text) if text else 0.0)
        key = -math.log((int(digest[:13], 16) + 0.5) / 2**52) / max(quality, 1e-6)
        by.setdefault(source, []).append((key, i is not None, i or 0, len(WORD.findall(text or "")), tie, r))
    sizes = {s: sum(x[3] for x in xs) for s, xs in by.items()}
    goals = shares(sizes)
    for s, xs in by.items():
        xs.sort(key=lambda x: x[:5])
        full = min(3, int(goals[s] // sizes[s])) if sizes[s] else 0
        rest, ahead, chosen = goals[s] - full * sizes[s] if full < 3 else 0.0, 0, []
        for x in xs:
            chosen.append(ahead + x[3] <= rest)
            ahead += x[3]
        gap = rest - sum(x[3] for x, c in zip(xs, chosen, strict=True) if c)
        spare = [x for x, c in zip(xs, chosen, strict=True) if not c and 0 < x[3] < 2 * gap and gap > 0]
        last = max(spare, key=lambda x: (x[3] if x[3] <= gap else -x[3], x[0], x[1], x[2], x[4]), default=None)
        for x, c in zip(xs, chosen, strict=True):
            closes = last is not None and not c and x[3] > 0 and x[:3] == last[:3] and x[4] == last[4]
            out.append((x[5], x[3], sizes[s], goals[s], full + (c or closes)))
    return out


def taken_by_row(docs) -> list:
    """The rows of docs, each as often as the mix takes it."""
    rows = docs.select("*", F.concat_ws(" ", row_hash(docs, 1), row_hash(docs, 2)).alias("tie_")).collect()
    out, queue = [], {}
    for r in rows:
        queue.setdefault(r["tie_"], []).append(tuple(r)[:-1])
    for (_, _, _, tie), _, _, _, epochs in mixed([(r["doc_id"], r["source"], r["text"], r["tie_"]) for r in rows]):
        out += [queue[tie][0]] * epochs
    return out


def near_groups(texts: list, n: int = 5, percent: int = 80) -> list:
    """Of each text the place of the first text within reach of links; its own for texts without words."""
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up, seen = list(range(len(sets))), {}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for j, b in enumerate(sets):
        for i in sorted({k for g in b for k in seen.get(g, ())}):
            both = len(sets[i] & b)
            if 100 * both >= percent * (len(sets[i]) + len(b) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
        for g in b:
            seen.setdefault(g, []).append(j)
    return [find(i) for i in range(len(sets))]
