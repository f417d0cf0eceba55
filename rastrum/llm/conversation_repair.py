"""Cheapest repair of conversations, the least audit by prefix-doubling path ranking.

A repaired conversation is empty, or an optional system turn followed by pairs of a user's and an
assistant's turn. Every row is kept (K, free), given the role that is due (R, 1) or deleted (D, 2, the
only edit of blank and duplicate rows); empty turns are inserted anywhere (I, 5); a truncated row that
is not deleted adds 5. Four states say what may follow: nothing yet, after the system, after a user,
after an assistant. A node is (place, state); costs to go come from a backward dynamic programme. Of
every node's optimal arcs the one is taken whose letter, and then whose target's rank, is least; ranks
come by doubling: ranks of audits of length 2^k, paired through pointers 2^k edits ahead, give those of
length 2^(k+1). The path is read through the same doubled pointers.

Rows are sorted once by (conversation, turn, role, text, copy) over all executors and numbered in blocks
of ``BLOCK``, so one conversation may lie in many blocks. Each block answers with a 4 x 4 matrix of
least costs a conversation; only conversations that lie in several blocks are folded, from matrices
alone. Texts are streamed once more, by conversation, to apply the edits. A conversation's audit is one
value, so a conversation has 2^31 edits, and half a million matrices, at most.

Defined cases: null ids, roles and texts are one space in the damage's key, null roles and texts become
one space; rows whose id is null form one conversation; null turns come first; rows of one turn are ordered by role
and text; a role counts by its first character, and a row whose role is empty or begins with none of
s, u, a cannot be kept; repeated rows are duplicates after the first; very long texts are one row and are only
hashed and copied; empty tables give no row; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record, written

BLOCK = 4096
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: the state after the role that is due, and that role
DUE = np.array([USER, USER, ASSISTANT, USER])
#: state after keeping a role with initial (other, s, u, a); -1 where it may not follow
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
FAR = 1 << 60
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LETTERS = "\0DIKR"


def conversation_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): each row damaged by the checksum of its id and turn."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))) % 20
    said = F.coalesce(F.col(text), blank)
    return df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), kind.alias("kind"), F.coalesce(F.col(role), blank).alias("role"), said.alias("text")).where("kind <> 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, initial, fault, at, block) of (conv, turn, role, text, copies), written in order.

    Equal rows are counted before they are sorted and then told apart by their number, so that a much
    repeated one is dealt over ranges like any other."""
    counted = rows.groupBy(conversation_key(F.col("conv")).alias("key"), "turn", "role", "text").agg(F.sum("copies").alias("n"))
    counted = written(counted.withColumn("words", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "counted")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = (counted.groupBy("key", "words").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1").select("key", "words", "first"))
    seen = counted.join(first, ["key", "words"], "left").withColumn("later", F.coalesce(F.col("first") < place, F.lit(False)))
    told = seen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("later") | (F.col("copy") > 1), DUPLICATE).when(last.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    facts = told.select("key", "turn", "role", "text", "copy", fault.cast("int").alias("fault"),
                        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"))
    order = ["key", F.col("turn").asc_nulls_first(), "role"]
    dealt = facts.repartitionByRange(*order, F.substring("text", 1, 200), "copy").sortWithinPartitions(*order, "text", "copy")
    numbered = dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", BLOCK.bit_length() - 1))
    return written(numbered.drop("copy"), "ordered")


def _segments(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The block in order, where its conversations begin, and how many rows they have."""
    table = table.sort_by("at")
    keys = np.array(table.column("key").to_pylist(), dtype=object)
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return table, begins, np.diff(np.append(begins, len(keys)))


def _arcs(initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row and state: the state that keeping leads to (-1: none), costs of keeping and of a new role."""
    stays = np.where((fault == BLANK) | (fault == DUPLICATE), FAR, np.where(fault == TRUNCATED, UNFINISHED, 0))[:, None]
    to = KEPT[:, initial].T
    return to, np.where(to >= 0, stays, FAR), np.broadcast_to(stays + REROLE, to.shape)


def _with_inserts(base: np.ndarray) -> np.ndarray:
    """Least costs of each state of a place when empty turns may be put in there."""
    out = base.copy()
    out[..., USER] = np.minimum(base[..., USER], base[..., ASSISTANT] + INSERT)
    out[..., ASSISTANT] = np.minimum(base[..., ASSISTANT], base[..., USER] + INSERT)
    for s in (NOTHING, SYSTEM):
        out[..., s] = np.minimum(base[..., s], out[..., USER] + INSERT)
    return out


#: costs to go at the end of a conversation
ENDED = _with_inserts(np.array([0, FAR, FAR, 0]))


def costs_to_go(initial: np.ndarray, fault: np.ndarray, begins: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Costs to go by (row, state, ...), and those behind the last row, for each segment's ``after`` (segment, state, ...).

    All segments of a block go back together, a row at a time."""
    to, keep, rerole = _arcs(initial, fault)
    extra = (1,) * (after.ndim - 2)
    out = np.full((len(initial), 4, *after.shape[2:]), FAR, np.int64)
    behind = after.copy()
    for back in range(int(lengths.max(initial=0))):
        open_ = np.flatnonzero(lengths > back)
        row = begins[open_] + lengths[open_] - 1 - back
        nxt = behind[open_]
        along = np.take_along_axis(nxt, np.maximum(to[row], 0).reshape(len(row), 4, *extra).repeat(1, axis=1) + np.zeros((1, 4, *after.shape[2:]), int), axis=1)
        k = keep[row].reshape(len(row), 4, *extra) + along
        r = rerole[row].reshape(len(row), 4, *extra) + nxt[:, DUE]
        base = np.minimum(np.minimum(k, r), nxt + DELETE)
        moved = np.moveaxis(_with_inserts(np.moveaxis(base, 1, -1)), -1, 1)
        out[row] = np.minimum(moved, FAR)
        behind[open_] = out[row]
    return [out, behind]


def least_paths(initial: np.ndarray, fault: np.ndarray, begins: np.ndarray, lengths: np.ndarray, after: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[list[str | None]], list[list[int]]]:
    """Costs at each segment's begin by state, and from each state the least audit and the state it ends in.

    ``after`` has the costs to go behind each segment, ``ends`` says whether its conversation ends there."""
    go, start = costs_to_go(initial, fault, begins, lengths, after)
    n, m = len(initial), len(begins)
    cost = np.concatenate([go, after])  # nodes: 4 a row, then 4 a segment's end
    following = np.arange(1, n + 1)
    following[begins + lengths - 1] = n + np.arange(m)
    to, keep, rerole = _arcs(initial, fault)
    state = np.arange(4)
    node = (np.arange(n + m)[:, None] * 4 + state).ravel()
    letter = np.zeros((5, 4 * (n + m)), bool)
    target = np.tile(node, (5, 1))
    here, rows = cost.reshape(-1), slice(0, 4 * n)
    target[1, rows] = (following[:, None] * 4 + state).ravel()
    target[2] = (np.arange(n + m)[:, None] * 4 + DUE).ravel()
    target[3, rows] = (following[:, None] * 4 + np.maximum(to, 0)).ravel()
    target[4, rows] = (following[:, None] * 4 + DUE).ravel()
    price = np.full(target.shape, FAR, np.int64)
    price[1, rows], price[3, rows], price[4, rows] = DELETE, keep.ravel(), rerole.ravel()
    price[2, rows] = INSERT
    price[2, 4 * n:] = np.where(np.repeat(ends, 4), INSERT, FAR)
    letter = (price + here[target] == here) & (here < FAR)
    # ranks of audits of one letter, then of twice as many
    first = np.where(letter.any(axis=0), letter.argmax(axis=0), 0)
    rank, ahead, span = first, target[first, node], 1
    longest = 3 * (int(lengths.max(initial=0)) + 1)
    while span < longest:
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)[1]
        ahead, span = ahead[ahead], span * 2
    by_rank = np.where(letter, np.arange(5)[:, None] * (int(rank.max()) + 1) + rank[target], FAR)
    best = np.where(letter.any(axis=0), by_rank.argmin(axis=0), 0)
    doubled = [target[best, node]]
    while 1 << len(doubled) < longest:
        doubled.append(doubled[-1][doubled[-1]])
    code = np.frombuffer(LETTERS.encode(), np.uint8)
    audits, exits = [], []
    for i in range(m):
        audits.append([])
        exits.append([])
        depth = max(1, (3 * (int(lengths[i]) + 1)).bit_length())
        for s in range(4):
            at = 4 * begins[i] + s
            if here[at] >= FAR:
                audits[i].append(None)
                exits[i].append(-1)
                continue
            path = np.array([at])
            for jump in doubled[:depth]:
                path = np.concatenate([path, jump[path]])
            taken = best[path]
            taken = taken[: np.flatnonzero(taken == 0)[0]]
            audits[i].append(code[taken].tobytes().decode())
            exits[i].append(int(path[len(taken)]) % 4)
    return start, audits, exits


SUMMARY = pa.schema([("key", pa.string()), ("block", pa.int64()), ("matrix", pa.list_(pa.int64())), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                     ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.int32()), ("last_initial", pa.int32())])
SUMMARY_SQL = "key string, block long, matrix array<long>, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial int, last_initial int"
LEGAL = np.zeros((4, 4), bool)
LEGAL[1, 2] = LEGAL[2, 3] = LEGAL[3, 2] = True


def summarised(table: pa.Table) -> pa.Table:
    """One row a conversation of a block: its cost matrix and what its rows count."""
    table, begins, lengths = _segments(table)
    initial, fault = table.column("initial").to_numpy(), table.column("fault").to_numpy()
    unit = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(begins), 4, 4)).astype(np.int64)
    matrix = costs_to_go(initial, fault, begins, lengths, unit)[1]
    keys, turns = table.column("key").to_pylist(), table.column("turn").to_pylist()
    ends = begins + lengths
    new_turn = np.array([t is not None and (i == 0 or t != turns[i - 1]) for i, t in enumerate(turns)])
    new_turn[begins] = [turns[b] is not None for b in begins]
    illegal = np.concatenate([[False], ~LEGAL[initial[:-1], initial[1:]]])
    illegal[begins] = False

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), begins)

    first = begins + np.array([next((j for j in range(e - b) if turns[b + j] is not None), 0) for b, e in zip(begins, ends)])
    return pa.Table.from_batches([record(
        SUMMARY, key=[keys[b] for b in begins], block=[table.column("block")[0].as_py()] * len(begins), matrix=matrix.reshape(len(begins), 16).tolist(), n=lengths, blank=total(fault == BLANK), duplicate=total(fault == DUPLICATE),
        truncated=total(fault == TRUNCATED), illegal=total(illegal), turns=total(new_turn), first_turn=[turns[f] for f in first], last_turn=[turns[e - 1] for e in ends], first_initial=initial[begins].astype(np.int32), last_initial=initial[ends - 1].astype(np.int32))])


def _folded_back(table: pa.Table) -> pa.Table:
    """Costs to go behind each block of one conversation, from its matrices alone."""
    table = table.sort_by("block")
    matrices = np.array(table.column("matrix").to_pylist(), np.int64).reshape(-1, 4, 4)
    after, now = [], ENDED
    for matrix in matrices[::-1]:
        after.append(now.tolist())
        now = np.minimum((matrix + now[None, :]).min(axis=1), FAR)
    return pa.table({"key": table.column("key"), "block": table.column("block"), "after": after[::-1], "ends": [False] * (len(after) - 1) + [True]}, schema=pa.schema([("key", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int64())), ("ends", pa.bool_())]))


PLANNED = pa.schema([("key", pa.string()), ("block", pa.int64()), ("cost", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))])


def _planned(rows: pa.Table, behind: pa.Table) -> pa.Table:
    """Least audits of a block from every state."""
    table, begins, lengths = _segments(rows)
    known = {k: (a, e) for k, a, e in zip(*(behind.column(c).to_pylist() for c in ("key", "after", "ends")))}
    keys = [k for k in table.column("key").take(pa.array(begins)).to_pylist()]
    after = np.array([known[k][0] if k in known else ENDED for k in keys], np.int64)
    ends = np.array([known[k][1] if k in known else True for k in keys])
    start, audits, exits = least_paths(table.column("initial").to_numpy(), table.column("fault").to_numpy(), begins, lengths, after, ends)
    return pa.Table.from_batches([record(PLANNED, key=keys, block=[table.column("block")[0].as_py()] * len(keys), cost=start[:, NOTHING], audits=audits, exits=exits)])


def _entered(table: pa.Table) -> pa.Table:
    """The state in which each block of one conversation is entered."""
    table = table.sort_by("block")
    states, state = [], NOTHING
    for exits in table.column("exits").to_pylist():
        states.append(state)
        state = exits[state]
    return pa.table({"key": table.column("key"), "block": table.column("block"), "entry": pa.array(states, pa.int32())})


def _several(df: DataFrame) -> DataFrame:
    """Rows of conversations that lie in several blocks."""
    return df.join(df.groupBy("key").agg(F.count("*").alias("blocks")).where("blocks > 1").select("key"), "key")


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, block, entry, audit) of ordered rows, and one row of counts and costs a conversation."""
    codes = rows.select("key", "block", "at", "turn", "initial", "fault")
    summary = written(codes.groupBy("block").applyInArrow(summarised, SUMMARY_SQL), "summary")
    behind = _several(summary.select("key", "block", "matrix")).groupBy("key").applyInArrow(_folded_back, "key string, block long, after array<long>, ends boolean")
    planned = written(codes.groupBy("block").cogroup(behind.groupBy("block")).applyInArrow(_planned, "key string, block long, cost long, audits array<string>, exits array<int>"), "planned")
    entry = _several(planned.select("key", "block", "exits")).groupBy("key").applyInArrow(_entered, "key string, block long, entry int")
    chosen = planned.join(entry, ["key", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(NOTHING)))
    audits = chosen.select("key", "block", "entry", F.get("audits", F.col("entry")).alias("audit"))
    order = Window.partitionBy("key").orderBy("block")
    before = [F.lag(c).over(order).alias(f"before_{c}") for c in ("last_initial", "last_turn")]
    legal = F.col("before_last_initial").isNull() | ((F.col("before_last_initial") == 1) & (F.col("first_initial") == 2)) | ((F.col("before_last_initial") == 2) & (F.col("first_initial") == 3)) | ((F.col("before_last_initial") == 3) & (F.col("first_initial") == 2))
    linked = summary.drop("matrix").select("*", *before).join(planned.select("key", "block", "cost"), ["key", "block"])
    counts = linked.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.when(legal, 0).otherwise(1)).alias("illegal"),
        F.min_by("cost", "block").alias("cost"), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"),
        F.sum(F.col("turns") - F.when(F.col("before_last_turn") == F.col("first_turn"), 1).otherwise(0)).alias("turns"))
    return audits, counts


REPAIRED = pa.schema([("key", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(key, edit, role, text) of every edit in order, by conversation: deleted rows are marked D.

    Rows of a conversation are streamed, never held together."""
    steps = audits.select("key", "block", F.lit(-1).cast("long").alias("at"), F.col("entry").cast("string").alias("role"), F.col("audit").alias("text"))
    both = steps.unionByName(rows.select("key", "block", "at", "role", "text")).repartition("key").sortWithinPartitions("key", "block", "at")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, state = None, iter(""), NOTHING
        for batch in batches:
            out: list[tuple] = []

            def inserted() -> str | None:
                nonlocal state
                for letter in left:
                    if letter != "I":
                        return letter
                    state = int(DUE[state])
                    out.append((key, "I", "user" if state == USER else "assistant", ""))
                return None

            for new, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "role", "text"))):
                if at < 0:
                    inserted()
                    key, left, state = new, iter(text), int(role)
                    continue
                letter = inserted()
                if letter == "R":
                    state = int(DUE[state])
                    role = "user" if state == USER else "assistant"
                elif letter == "K":
                    state = int(KEPT[state, "sua".index(role[0]) + 1])
                out.append((key, letter, role, text))
            if out:
                yield record(REPAIRED, **{c: [r[i] for r in out] for i, c in enumerate(("key", "edit", "role", "text"))})
        out = []
        for letter in left:
            state = int(DUE[state])
            out.append((key, letter, "user" if state == USER else "assistant", ""))
        if out:
            yield record(REPAIRED, **{c: [r[i] for r in out] for i, c in enumerate(("key", "edit", "role", "text"))})

    return both.mapInArrow(edited, "key string, edit string, role string, text string")


DIGEST = pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digests(edits: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256) of repaired rows as they lie in their partitions."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, letters, some = None, None, [], False
        for batch in batches:
            out = []
            for new, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or new != key:
                    if digest is not None:
                        out.append((key, "".join(letters), digest.hexdigest()))
                    key, digest, letters, some = new, hashlib.sha256(), [], False
                letters.append(edit)
                if edit != "D":
                    digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                    some = True
            if out:
                yield record(DIGEST, **{c: [r[i] for r in out] for i, c in enumerate(DIGEST.names)})
        if digest is not None:
            yield record(DIGEST, key=[key], audit=["".join(letters)], repaired_sha256=[digest.hexdigest()])

    return edits.mapInArrow(summed, "key string, audit string, repaired_sha256 string")


def repair_report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation of ``df``: what was wrong after the damage, the cheapest edits and a digest of the result."""
    rows = ordered_rows(damaged(df, conv, turn, role, text))
    audits, counts = plan(rows)
    done = digests(repaired(rows, audits))
    gaps = F.coalesce(F.try_subtract(F.try_add(F.try_subtract("last_turn", "first_turn"), F.lit(1)), "turns"), F.lit(0))
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = counts.select("key", gaps.alias("gaps"), *names).join(done, "key")
    all_of = df.select(F.col(conv).alias("conv_id")).distinct().withColumn("key", conversation_key(F.col("conv_id")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *names)]
    return all_of.join(whole, "key", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
