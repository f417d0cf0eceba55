"""Quality scores from a sparse rule ensemble.

Statistics of a text are Spark columns. Shallow trees are grown on the statistics of a bounded
sample of labelled documents; every path from a root to a node is a rule, a conjunction of
comparisons. A logistic model over the rules, with an L1 penalty, keeps few of them, and those are
compiled into one Spark column expression that scores all documents where they are read.

Defined cases: null texts count as empty; an empty text has all statistics 0 and is scored; a null
label is not used; a null id counts as the empty text when rows are held out; repeated rows are
each scored (and each learned from); without labels, or with labels of one kind, the score is the
share of ones with one more row of either kind; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: most labelled rows that a model is fitted on, the first in the order of a hash of their ids
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name, all double, 0 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size(words)
    lines = F.split(text, "\n")

    def per(count: Column, of: Column) -> Column:
        return F.when(of > 0, count.cast("double") / of).otherwise(F.lit(0.0))

    def share(pattern: str) -> Column:
        return per(F.regexp_count(text, F.lit(pattern)), chars)

    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": per(F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")), n_words),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": F.when(chars > 0, per(F.size(F.array_distinct(lines)), F.size(lines))).otherwise(F.lit(0.0)),
        "line_length": per(chars, F.when(chars > 0, F.size(lines)).otherwise(F.lit(0))),
        "upper_share": share("[A-Z]"),
        "digit_share": share("[0-9]"),
        "stop_share": share("[.,;:?]"),
        "symbol_share": share(r"[!|#%&$*@^~=<>{}\[\]\\_]"),
    }


def kept_out(doc_id: str, remainder: int) -> Column:
    """crc32 of the id as text, modulo 5, equals the remainder."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == remainder


Condition = tuple[str, bool, float]  # statistic, at most (else above), threshold


@dataclass(frozen=True)
class RuleModel:
    """Bias and weighted rules; a rule holds where all of its conditions do."""
    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = None
            for name, at_most, cut in conditions:
                c = stats[name] <= F.lit(cut) if at_most else stats[name] > F.lit(cut)
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, least: int, usable: np.ndarray, path: tuple, out: list) -> list[tuple[tuple, float]]:
    """Paths of one regression tree on residuals; returns (leaf path, mean)."""
    mean = float(residual[rows].mean())
    if depth == 0 or len(rows) < 2 * least:
        return [(path, mean)]
    best = (1e-9, None, None)
    r = residual[rows]
    for f in usable:
        if not len(cuts[f]):
            continue
        b = bins[rows, f]
        n = np.bincount(b, minlength=len(cuts[f]) + 1)[:-1].cumsum()
        s = np.bincount(b, weights=r, minlength=len(cuts[f]) + 1)[:-1].cumsum()
        ok = (n >= least) & (len(r) - n >= least)
        if not ok.any():
            continue
        gain = np.where(ok, s ** 2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(r) - n, 1) - r.sum() ** 2 / len(r), -np.inf)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] is None:
        return [(path, mean)]
    _, f, k = best
    left = bins[rows, f] <= k
    leaves = []
    for side, at_most in ((left, True), (~left, False)):
        longer = (*path, (int(f), at_most, float(cuts[f][k])))
        out.append(longer)
        leaves += _grow(x, bins, cuts, residual, rows[side], depth - 1, least, usable, longer, out)
    return leaves


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, at_most, cut in path:
        ok &= x[:, f] <= cut if at_most else x[:, f] > cut
    return ok


def _tidy(path: tuple) -> tuple:
    """One condition per statistic and side: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for f, at_most, cut in path:
        old = tight.get((f, at_most))
        tight[f, at_most] = cut if old is None else min(old, cut) if at_most else max(old, cut)
    return tuple((f, a, c) for (f, a), c in sorted(tight.items()))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, penalty: float = 3e-4, rounds: int = 600, seed: int = 7) -> RuleModel:
    """Grow boosted trees on halves of the rows, then fit lasso logistic weights over their rules."""
    n = len(y)
    prior = (float(y.sum()) + 1) / (n + 2)
    base = RuleModel(math.log(prior / (1 - prior)), ())
    if n == 0 or y.min() == y.max():
        return base
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64), method="lower")) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    value, paths = np.full(n, math.log(prior / (1 - prior))), []
    least = max(2, n // 1000)
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(n) < 0.5)
        usable = np.sort(rng.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False))
        if not len(rows):
            continue
        for path, mean in _grow(x, bins, cuts, y - 1 / (1 + np.exp(-value)), rows, depth, least, usable, (), paths):
            value += 0.5 * mean * 4 * _holds(x, path)
    rules = list(dict.fromkeys(_tidy(p) for p in paths))
    columns: dict[bytes, tuple] = {}
    for rule in rules:
        h = _holds(x, rule)
        if 0 < h.sum() < n:
            columns.setdefault(np.packbits(h).tobytes(), (rule, h))  # of equal columns the first
    if not columns:
        return base
    rules, z = [r for r, _ in columns.values()], np.empty((n, len(columns)))
    for k, (_, h) in enumerate(columns.values()):
        z[:, k] = h
    columns.clear()
    # in place and in blocks of columns: one matrix of rules is all that the driver holds
    shift = z.mean(axis=0)
    scale = np.concatenate([z[:, a:a + 32].std(axis=0) for a in range(0, z.shape[1], 32)])
    z -= shift
    z /= scale
    centred = z
    step = 4.0 / max(np.linalg.eigvalsh(centred.T @ centred / n)[-1], 1e-9)
    w, bias, ahead, ahead_bias, t = np.zeros(z.shape[1]), base.bias, np.zeros(z.shape[1]), base.bias, 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        miss = 1 / (1 + np.exp(-(centred @ ahead + ahead_bias))) - y
        nw = ahead - step * (centred.T @ miss) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = ahead_bias - 4.0 * miss.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    kept = np.flatnonzero(w)
    weight = w[kept] / scale[kept]
    bias -= float((weight * shift[kept]).sum())
    return RuleModel(float(bias), tuple((tuple((names[f], a, c) for f, a, c in rules[k]), float(v)) for k, v in zip(kept, weight, strict=True)))


def learn(docs: DataFrame, labels: DataFrame, label: str, held_out: int = 0, most: int = SAMPLE_ROWS, **how) -> RuleModel:
    """Fit on at most ``most`` labelled rows that are not held out; only their statistics reach the driver."""
    known = labels.where(F.col(label).isNotNull() & ~kept_out("doc_id", held_out)).select(F.col("doc_id").alias("l_id"), F.col(label).alias("l_label"))
    sample = known.orderBy(F.xxhash64("l_id"), "l_id", "l_label").limit(most)  # at most ``most`` pairs of numbers
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("l_id", "l_label", *[c.alias(n) for n, c in stats.items()])
    # repeated documents may multiply the sample: the bound holds for what is collected as well
    found = rows.orderBy(F.xxhash64("l_id"), "l_id", "l_label", *stats).limit(most).toPandas()
    return fit(found[list(stats)].to_numpy(float).reshape(len(found), len(stats)), found["l_label"].to_numpy(float), list(stats), **how)


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with ``score``; statistics that no kept rule asks for are not computed."""
    used = {name for conditions, _ in model.rules for name, _, _ in conditions}
    stats = {n: c for n, c in statistics(F.col("text")).items() if n in used}
    held = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in stats.items()])
    return held.withColumn("score", model.score({n: F.col(n) for n in stats})).select("row", "score")
