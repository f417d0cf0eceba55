import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.llm import phrases

from .cases import collected, no_docs, odd_docs

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, most, least):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in f.items():
        often = {g: a for g, a in c.items() if a >= least and len(g) > 1}
        longer = Counter()
        for g, a in often.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i:i + m]] = max(longer[g[i:i + m]], a)
        kept = []
        for g, a in often.items():
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            if 100 * longer[g] < 80 * a:
                kept.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most])]
    return sorted(out, key=repr)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "of", "ab", "b", "é", "漢字", "x\x1cy", "rare%d", "in", "a b"]
    return "".join((w % rng.randint(0, 10 ** 6) if "%" in w else w) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for w in rng.choices(words, [9, 5, 7, 4, 3, 2, 2, 1, 3, 5, 2], k=n))


@pytest.mark.parametrize("hot, buffer, most", [(10 ** 6, 400_000, 2000), (1, 50, 2000), (40, 7, 9)])
def test_brute_force(spark, monkeypatch, hot, buffer, most):
    monkeypatch.setattr(phrases, "HOT_PAIR", hot)
    monkeypatch.setattr(phrases, "BUFFER_ROWS", buffer)
    rows = [("en", prose(i, 400)) for i in range(12)] + [(None, prose(20 + i, 300)) for i in range(6)] + [("fr", None), ("fr", ""), ("de", "one two. " * 40), ("de", "one two three four five " * 40), ("", "Ab ab. " * 50)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for c in ("h", "n", "w1", "word", "score", "hot", "k"):
        df = df.withColumn(c, F.lit("x"))
    assert collected(phrases.collocations(df, most, 30), *COLUMNS) == brute(rows, most, 30)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert collected(phrases.collocations(docs, 50, 3), *COLUMNS) == brute(rows, 50, 3)
    assert phrases.collocations(no_docs(spark), 50, 3).collect() == []


def test_chunks_end_with_pieces(monkeypatch):
    import pyarrow as pa

    text = prose(3, 5000)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"], "text": [text, "word " * 500]})
    whole = {"a": b"", "b": b""}
    for lang, plain in phrases._chunks(iter([batch])):
        whole[lang] += plain
    assert whole["a"] == text.encode().translate(phrases.PLAIN) and whole["b"] == b"word " * 500


@pytest.mark.parametrize("seed", range(4))
def test_quicksort_counts(seed):
    rng = np.random.default_rng(seed)
    depth = rng.integers(2, 5, 3000)
    columns = [np.where(d < depth, rng.integers(1, 4 + 5 * seed, 3000), 0) for d in range(4)]
    weight = rng.integers(1, 4, 3000)
    want = Counter()
    for i in range(3000):
        for m in range(2, depth[i] + 1):
            want[tuple(int(columns[d][i]) if d < m else 0 for d in range(4))] += int(weight[i])
    found, counts = phrases.sorted_counts(columns, weight, 30, np.zeros(3000, bool))
    assert dict(zip(map(tuple, found.tolist()), counts.tolist())) == {g: n for g, n in want.items() if n >= 30}
