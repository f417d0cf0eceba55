import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.llm import decontam as d
from tests.conftest import SMALL
from tests.llm.cases import no_docs, odd_docs, prose


def edited(text, n, seed):
    rng, chars = random.Random(seed), list(text)
    for _ in range(n):
        k, i = rng.choice("sid"), rng.randrange(len(chars))
        if k == "s":
            chars[i] = "z"
        elif k == "i":
            chars.insert(i, "q")
        else:
            del chars[i]
    return "".join(chars)


def brute(text, segment, e):
    """Least edits between the segment and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) <= e


@pytest.mark.parametrize("edits", [0, 3, 6, 7, 10, 25])
def test_segments_against_brute_force(edits):
    for seed in range(12):
        item = prose(seed, 12)[:80].ljust(80, "k")
        text = prose(seed + 50, 20) + " " + edited(item, edits, seed) + " " + prose(seed + 90, 20)
        known = d.Segments.of([(1, item)], d.EDITS)
        data = np.frombuffer(text.encode(), np.uint8)
        assert bool(d.passages(data, np.array([len(data)]), known)) == brute(text, item, 6), (seed, edits)


def test_real_passages(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {(a["doc_id"], b["item_id"]) for a in docs.collect() for b in bench.collect() if b["text"] in a["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(docs, bench).collect()}
    assert want and got == want


def test_changed_case_space_and_words_are_found_clean_texts_are_not(spark):
    item = prose(7, 45)
    words = item.split()
    words[10] = "other"
    rows = [(1, prose(8, 80) + "\n\n" + item.upper().replace(" ", "  ")), (2, " ".join(words)), (3, prose(9, 400)), (4, item[:60]), (5, prose(3, 30) + item[70:200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(docs, bench).collect()}
    assert got == {(i, j) for i in (1, 2, 5) for j in (1, 2)}
    assert [r["doc_id"] for r in d.without_passages(docs, bench).orderBy("doc_id").collect()] == [3, 4]


def test_many_blocks_agree(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = sorted(map(tuple, d.matches(docs, bench).collect()))
    left = sorted(r["doc_id"] for r in d.without_passages(docs, bench).collect())
    monkeypatch.setattr(d, "BLOCK_CHARS", 2_000)
    assert sorted(map(tuple, d.matches(docs, bench).collect())) == one
    assert sorted(r["doc_id"] for r in d.without_passages(docs, bench).collect()) == left


def test_odd_rows(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, prose(3, 90)), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    assert {r["doc_id"] for r in d.matches(docs, bench).collect()} == {None, 7, 13}
    kept = d.without_passages(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    for a, b in ((no_docs(spark), bench), (docs, bench.limit(0))):
        assert d.matches(a, b).count() == 0 and d.without_passages(a, b).count() == a.count()
