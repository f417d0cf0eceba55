import collections
import math
import zlib

import numpy as np
import pytest

from rastrum.llm import language_model as L
from tests.llm.cases import no_docs, odd_docs, real_docs


def brute(rows):
    c = collections.Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        out.append((i, len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make,head", [(odd_docs, 200_000), (real_docs, 200_000), (real_docs, 60), (no_docs, 10)])
def test_base_score(spark, make, head):
    docs = make(spark)
    rows = L.language_scores(docs, 1, frequent=50, head_words=head).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_head_size_does_not_change_scores(spark):
    a = {r["doc_id"]: r["score"] for r in L.language_scores(real_docs(spark), 1, frequent=100).collect()}
    b = {r["doc_id"]: r["score"] for r in L.language_scores(real_docs(spark), 1, frequent=100, head_words=150).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    rng = np.random.default_rng(1)
    truth = rng.dirichlet(np.full(30, 0.2), 30)
    pairs = np.round(truth * 5000)
    table = L.train_nce(pairs, dim=16).log10_table()
    assert np.allclose((10 ** table).sum(axis=1), 1)
    share = pairs.sum(axis=0) / pairs.sum()
    assert (pairs * table).sum() > (pairs * np.log10(share)).sum() + 0.2 * pairs.sum()
    docs = real_docs(spark, "/root/testdata/sf0.01")
    held = L.language_scores(docs, 1).where("crc32(cast(doc_id as string)) % 5 = 1").agg({"score": "sum", "base_score": "sum"}).head()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_model_distribution_over_words_sums_to_one():
    counts = {b"": 10, b"a": 8, b"b.": 5, b"c": 3, b"\xc3\xbc": 2, b"d,": 1}
    words = [b"", b"a"]
    s = L.Symbols(words, list(counts), np.array(list(counts.values()), float))
    mass = np.full(L.N_CLASSES, 0.5)
    for w, c in counts.items():
        if w not in words:
            mass[L.word_class(w.decode())] += c + 0.5
    table = L.train_nce(np.ones((s.size, s.size))).log10_table()
    total = 10 ** table[0, :2].sum() if False else sum(10 ** table[0, i] for i in range(2))
    for w, c in counts.items():
        if w not in words:
            k = L.word_class(w.decode())
            total += 10 ** table[0, 2 + k] * (c + 0.5) / mass[k]
    total += sum(10 ** table[0, 2 + k] * 0.5 / mass[k] for k in range(L.N_CLASSES))  # one unseen word a class
    assert math.isclose(total, 1)
