import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rastrum.llm import conversation_repair as cr

SHAPE = "conv_id long, turn long, role string, text string"
DUE = {"": "user", "s": "user", "u": "assistant", "a": "user"}
MAY = {"": "su", "s": "u", "u": "a", "a": "u"}


def least(rows):
    """(cost, audit, repaired) by comparing whole strings from the front."""
    best = {"": (0, "", ())}

    def put(into, last, new):
        if last not in into or new < into[last]:
            into[last] = new

    def grown(states):
        out = dict(states)
        for _ in range(2):
            for last, (c, a, r) in list(out.items()):
                role = DUE[last]
                put(out, role[0], (c + 5, a + "I", r + ((role, ""),)))
        return out

    for role, text, fault in rows:
        new = {}
        for last, (c, a, r) in grown(best).items():
            put(new, last, (c + 2, a + "D", r))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if role and role[0] in MAY[last]:
                    put(new, role[0], (c + more, a + "K", r + ((role, text),)))
                due = DUE[last]
                put(new, due[0], (c + 1 + more, a + "R", r + ((due, text),)))
        best = new
    return min(v for k, v in grown(best).items() if k in ("", "a"))


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for c, t, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort()
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, text in after:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = {t for known, t, _, _ in after if known}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, done = least(marked)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    for c in ("key", "block", "at", "audit", "n", "fault", "copies", "kind"):
        df = df.withColumn(c, F.lit("x"))
    out = cr.repair_report(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(map(tuple, out.collect()), key=repr)


def drawn(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sys", None])
            text = rng.choice(["Yes.", "No!", "cut", " ", "", "A long. \t", f"word {t}.", f"word {t}", None, "é!\n"])
            rows += [(c, rng.choice([t, t, t, None, t * 3]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


ODD = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "Hi."), (7, None, "user", "Hi."), (7, 2, "assistant", "w " * 50_000 + "."), (8, -5, "assistant", "Only."),
       (9, 0, "system", "Be kind."), (9, 1, "user", "Ok?"), (9, 9, "assistant", "Yes."), (9, 9, "assistant", "Ja."), (9, 9, "user", "Ja."), (9, 12, "user", "éa.")]


def test_brute_force(spark):
    rows = ODD + drawn(1, 120, 7)
    assert got(spark, rows) == brute(rows)


def test_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", 4)
    rows = ODD + drawn(2, 6, 60) + [(50, 1, "user", "Again.")] * 30
    assert got(spark, rows) == brute(rows)


def test_nothing(spark):
    assert got(spark, []) == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(spark, [(dropped, 0, "user", "Gone.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("seed", range(3))
def test_matrices_agree_with_one_block(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    initial, fault = rng.integers(0, 4, 40), rng.integers(0, 4, 40)
    whole = cr.costs_to_go(initial, fault, np.array([0]), np.array([40]), cr.ENDED[None])[1][0]
    unit = np.where(np.eye(4, dtype=bool), 0, cr.FAR)[None].astype(np.int64)
    now = cr.ENDED
    for at in range(30, -1, -10):
        matrix = cr.costs_to_go(initial[at:at + 10], fault[at:at + 10], np.array([0]), np.array([10]), unit)[1][0]
        now = np.minimum((matrix + now[None, :]).min(axis=1), cr.FAR)
    assert now.tolist() == whole.tolist()
