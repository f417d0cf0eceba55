"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are words, lower-cased over A-Z, and one end token a text. The model's symbols are the most
frequent tokens and, for all others, classes by script and ending. The vector of the symbol before,
times a position matrix, predicts the vector of the next; one matrix product gives the scores of
all pairs of symbols, and a row-wise softmax makes them log-probabilities. A word outside the frequent
ones has the probability of its class times its share of the class's smoothed counts, so the
probabilities over all words, with one unseen word a class, sum to one.

What is learned from the corpus is counted over all training texts, in Spark: every word, and every
pair of symbols. Pairs are at most the square of the symbols, so they are trained on whole, in numpy:
noise-contrastive estimation in its expectation over all pairs, without sampling.

Words whose count must be known to score a text are looked up in two ways: the more frequent ones,
at most ``HEAD_WORDS``, are sent to the tasks; the others are joined with the counts as rows.

Defined cases: null texts count as empty and have the end token alone; a null id counts as the empty
text when rows are held out; repeated rows are each counted and scored; other columns are ignored;
without training texts every word is unseen (N = V = 0) and all symbols are alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record, texts, written
from .quality import kept_out

FREQUENT = 1000
HEAD_WORDS = 200_000
END = b""  # no word is empty
SCRIPTS = ("ñóíáú¡¿", "äöüß", "éèêçàùâîôûœ")
N_CLASSES = 20
LN10 = np.log(10.0)


def word_class(word: str) -> int:
    """Class of a word outside the frequent ones: script of its letters, and its last character."""
    script = 0
    if not word.isascii():
        script = next((i + 1 for i, s in enumerate(SCRIPTS) if any(c in s for c in word)), 4)
    last = word[-1]
    ending = 0 if last.isalpha() else 1 if last == "." else 2 if last == "," else 3
    return script * 4 + ending


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


class Symbols:
    """Symbol of every word: a frequent token's number, else its class's (after them)."""

    def __init__(self, frequent: list[bytes], head: list[bytes], counts: np.ndarray):
        """``head`` are known words with ``counts``, the frequent ones first."""
        self.n_frequent, self.size = len(frequent), len(frequent) + N_CLASSES
        self.number = {w: i for i, w in enumerate(head)}
        self.symbol = np.array([i if i < len(frequent) else len(frequent) + word_class(w.decode()) for i, w in enumerate(head)], np.int64)
        self.log_count = np.log10(counts + 0.5)
        self.other: dict[bytes, int] = {}

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head numbers (-1 for others) and symbols of words, with the end token after them."""
        at = np.fromiter(itertools.chain(map(self.number.get, words, itertools.repeat(-1)), (self.number.get(END, -1),)), np.int64, len(words) + 1)
        symbols = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int64)
        unknown = np.flatnonzero(at[:-1] < 0)
        if len(unknown):
            if len(self.other) > 300_000:
                self.other.clear()
            for i in unknown.tolist():
                w = words[i]
                c = self.other.get(w)
                if c is None:
                    self.other[w] = c = self.n_frequent + word_class(w.decode())
                symbols[i] = c
        if at[-1] < 0:  # nothing was learned from: the end token is its own class of no words
            symbols[-1] = self.n_frequent
        return at, symbols


def training(docs: DataFrame, held_out: int) -> DataFrame:
    return docs.where(~kept_out("doc_id", held_out)).select("text")


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all tokens; the end token is the empty word. Each task adds up what it reads
    before anything is exchanged."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column("text")):
                found.update(words_of(text))
                found[END] += 1
                if len(found) > 400_000:
                    yield record(schema, word=list(found), c=list(found.values()))
                    found.clear()
        if found:
            yield record(schema, word=list(found), c=list(found.values()))

    return train.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_threshold(counts: DataFrame, most: int) -> int:
    """Least count of the words sent to the tasks, so that they are at most ``most``.

    How many words have each count is summed in Spark; counts of 1,000 and more share one row
    for every tenth of their logarithm, so the rows stay few."""
    step = F.when(F.col("c") < 1000, F.col("c")).otherwise(1000 + F.floor(10 * F.log("c")))
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    total, threshold = 0, 1 << 62
    for r in rows:
        total += r["n"]
        if total > most:
            break
        threshold = r["least"]
    return threshold


def class_mass(counts: DataFrame, frequent: set[bytes]) -> np.ndarray:
    """Smoothed counts of the words in each class, with half a count for its unseen word."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(N_CLASSES)
        for batch in batches:
            for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if w and w not in frequent:
                    mass[word_class(w.decode())] += c + 0.5
        yield pa.RecordBatch.from_arrays([pa.array(range(N_CLASSES), pa.int32()), pa.array(mass)], ["class", "mass"])

    rows = counts.mapInArrow(add, "class int, mass double").groupBy("class").agg(F.sum("mass").alias("mass")).collect()
    out = np.full(N_CLASSES, 0.5)
    for r in rows:
        out[r["class"]] += r["mass"]
    return out


def pair_counts(train: DataFrame, symbols) -> DataFrame:
    """(before, after, n) of neighbouring symbols; a text begins after an end token."""
    schema = pa.schema([("before", pa.int32()), ("after", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Symbols = symbols.value
        total = np.zeros(s.size * s.size, np.int64)
        for batch in batches:
            coded, size = [], 0
            for text in texts(batch.column("text")):
                at, symbol = s.read(words_of(text))
                coded.append(np.concatenate([symbol[-1:], symbol[:-1]]) * s.size + symbol)
                size += len(symbol)
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(coded), minlength=len(total))
                    coded, size = [], 0
            if coded:
                total += np.bincount(np.concatenate(coded), minlength=len(total))
        some = np.flatnonzero(total)
        yield record(schema, before=some // s.size, after=some % s.size, n=total[some])

    return train.mapInArrow(count, "before int, after int, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    """score(h, w) = (r_h C) . q_w + b_w"""
    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probability of each symbol (column) after each symbol (row)."""
        score = self.r @ self.c @ self.q.T + self.b
        top = score.max(axis=1, keepdims=True)
        return (score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))) / LN10


def train_nce(pairs: np.ndarray, dim: int = 32, noise: int = 25, rounds: int = 250, rate: float = 0.05, seed: int = 11) -> LogBilinear:
    """Fit to a matrix of pair counts. Noise is the symbols' own distribution; for each pair the
    expected loss over data and ``noise`` noise words is summed, so each round sees the whole corpus."""
    size = len(pairs)
    rng = np.random.default_rng(seed)
    model = LogBilinear(rng.normal(0, 0.1, (size, dim)), np.eye(dim), rng.normal(0, 0.1, (size, dim)), np.zeros(size))
    total = pairs.sum()
    if total == 0:
        return model
    share = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * size)
    model.b = np.log(share)
    data = pairs / total
    false = noise * data.sum(axis=1, keepdims=True) * share
    shift = np.log(noise * share)
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.r, model.c, model.q, model.b)]
    for t in range(1, rounds + 1):
        h = model.r @ model.c
        p = 1 / (1 + np.exp(-(h @ model.q.T + model.b - shift)))
        g = false * p - data * (1 - p)  # slope of the loss in each score
        gh = g @ model.q
        slopes = (gh @ model.c.T, model.r.T @ gh, g.T @ h, g.sum(axis=0))
        for value, slope, m in zip((model.r, model.c, model.q, model.b), slopes, moment, strict=True):
            m[0] += 0.1 * (slope - m[0])
            m[1] += 0.001 * (slope * slope - m[1])
            value -= rate * (1 - t / (rounds + 1)) * (m[0] / (1 - 0.9 ** t)) / (np.sqrt(m[1] / (1 - 0.999 ** t)) + 1e-10)
    return model


SCORED = ("doc_id long, n_tokens long, n_head long, head_log double, model_log double, words array<binary>, times array<int>")


def score_texts(docs: DataFrame, symbols, table, mass: np.ndarray) -> DataFrame:
    """What can be told of each text from the words sent to the tasks, and its other words with counts.

    ``head_log`` sums log10(c + 0.5) over head words, ``model_log`` what does not ask for a count that
    is not at hand."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_log", pa.float64()), ("model_log", pa.float64()),
                        ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
    log_mass = np.log10(mass)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, log_p = symbols.value, table.value
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema if f.name != "doc_id"}
            for text in texts(batch.column("text")):
                words = words_of(text)
                at, symbol = s.read(words)
                head = at >= 0
                known = at[head]
                logs = s.log_count[known]
                in_class = symbol >= s.n_frequent
                total = log_p[np.concatenate([symbol[-1:], symbol[:-1]]), symbol].sum(dtype=np.float64) - log_mass[symbol[in_class] - s.n_frequent].sum()
                rest = Counter(words[i] for i in np.flatnonzero(~head).tolist() if i < len(words))
                out["n_tokens"].append(len(at))
                out["n_head"].append(len(known))
                out["head_log"].append(float(logs.sum()))
                out["model_log"].append(float(total + logs[known >= s.n_frequent].sum()))
                out["words"].append(list(rest))
                out["times"].append(list(rest.values()))
            yield record(schema, doc_id=batch.column("doc_id"), **out)

    return docs.select("doc_id", "text").mapInArrow(score, SCORED)


def language_scores(docs: DataFrame, held_out: int, frequent: int = FREQUENT, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (the model)."""
    spark = docs.sparkSession
    train = training(docs, held_out)
    counts = written(word_counts(train), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    log_all = float(np.log10(totals["n"] + 0.5 * (totals["v"] + 1)))
    top = [(bytes(r["word"]), r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(frequent).collect()]
    if totals["n"] and END not in {w for w, _ in top}:
        top[-1] = (END, counts.where(F.octet_length("word") == 0).head()["c"])
    often = {w for w, _ in top}
    threshold = head_threshold(counts, max(head_words, frequent))
    found = counts.where(F.col("c") >= threshold).toPandas()  # at most ``head_words`` rows
    rest = [(bytes(w), c) for w, c in zip(found["word"], found["c"], strict=True) if bytes(w) not in often]
    head = [*top, *rest]
    symbols = spark.sparkContext.broadcast(Symbols([w for w, _ in top], [w for w, _ in head], np.array([c for _, c in head], np.float64)))
    mass = class_mass(counts, often)
    pairs = pair_counts(train, symbols).toPandas()  # at most the square of the symbols
    size = len(top) + N_CLASSES
    matrix = np.zeros((size, size))
    matrix[pairs["before"].to_numpy(int), pairs["after"].to_numpy(int)] = pairs["n"].to_numpy(float)
    table = spark.sparkContext.broadcast(train_nce(matrix).log10_table().astype(np.float32))
    scored = written(score_texts(docs, symbols, table, mass).withColumn("row", F.monotonically_increasing_id()), "scored")
    others = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("o")).select("row", F.col("o.words").alias("w"), F.col("o.times").alias("times"))
    less = counts.where(F.col("c") < threshold)
    unseen = float(np.log10(0.5))
    met = others.join(less, F.col("w") == F.col("word"), "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"),
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("c") + 0.5), F.lit(unseen))).alias("log")).withColumnRenamed("row", "m_row")
    # the end token of a text has no count where nothing was learned
    missing = F.lit(0.0 if totals["n"] else unseen)
    both = scored.drop("words", "times").join(met, F.col("row") == F.col("m_row"), "left")
    log = F.coalesce(F.col("log"), F.lit(0.0)) + missing
    return both.select("doc_id", "n_tokens", (F.col("n_head") + F.coalesce(F.col("seen"), F.lit(0))).cast("bigint").alias("n_known"), F.lit(int(totals["n"])).cast("bigint").alias("train_tokens"),
                       (F.col("head_log") + log - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("model_log") + log).alias("score"))
