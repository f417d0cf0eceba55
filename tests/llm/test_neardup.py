import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.llm import neardup as n
from tests.llm.cases import BASE, no_docs, odd_docs, prose, real_docs


def sets(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    sh, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        same = (rows[a][1] or "") == (rows[b][1] or "")
        if same or (sh[a] and sh[b] and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])):
            root[find(a)] = find(b)
    out = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        out[find(i)].append(doc_id)
    return sorted((sorted(v, key=repr) for v in out.values()), key=repr)


@pytest.mark.parametrize("make", [odd_docs, real_docs, no_docs])
def test_classes_against_brute_force(spark, make):
    docs = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    got = collections.Counter((r["class_id"], r["class_size"]) for r in n.near_classes(docs).collect())
    expect = collections.Counter()
    for members in want:
        known = [m for m in members if m is not None]
        expect[min(known) if known else None, len(members)] += len(members)
    assert got == expect


def test_one_of_each(spark):
    docs = odd_docs(spark)
    kept = n.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept.count() == len(want)
    assert kept.where("doc_id in (2, 6)").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert n.one_of_each(no_docs(spark)).count() == 0


def test_signatures_agree_like_weighted_similarity():
    rng = np.random.default_rng(0)
    for top in (1, 9):
        agree, alike = [], []
        for _ in range(40):
            items = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
            items.sort()
            a, b = rng.integers(1, top + 1, 300).astype(float), rng.integers(1, top + 1, 300).astype(float)
            b[:250], a[260:280], b[280:] = a[:250], 0, 0
            x, y = a > 0, b > 0
            agree.append((n.signature(items[x], a[x], 128) == n.signature(items[y], b[y], 128)).mean())
            alike.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert abs(np.mean(agree) - np.mean(alike)) < 0.02


def test_hashes_do_not_depend_on_the_buffer():
    alone = np.frombuffer(BASE.encode(), np.uint8)
    two = np.frombuffer(("x y z" + BASE + "tail").encode(), np.uint8)
    a = n.shingle_hashes(alone, np.array([len(alone)]))[0]
    b = n.shingle_hashes(two, np.array([5, 5 + len(alone), len(two)]))
    assert (a == b[1]).all() and len(a) == len(BASE.split()) - 4 and len(b[0]) == len(b[2]) == 1


def test_two_groups_in_one_bucket(spark):
    """Texts of one bucket that are not like its hub still find each other."""
    x, y = prose(1, 200).split(), prose(1, 200).split()
    y[40:60] = prose(2, 20).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join([*x[:-1], f"x{i}"])))
    for i in range(12, 15):
        rows.append((i, " ".join([*y[:-1], f"y{i}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {frozenset(r[0] for r in g) for g in [[(r["doc_id"],) for r in n.near_classes(docs, bands=40, rows=1).collect() if r["class_id"] == c] for c in (0, 12)]}
    want = {frozenset(m) for m in brute(rows)}
    assert got == want


def classes(docs, **how):
    out = collections.defaultdict(list)
    for r in n.near_classes(docs, **how).collect():
        out[r["class_id"]].append(r["doc_id"])
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize("most,by_count", [(n.MOST_TEXTS, False), (3, False), (n.MOST_TEXTS, True)])
def test_many_groups_in_one_bucket(spark, monkeypatch, most, by_count):
    """Later groups of a bucket, after the passes over hubs, are found too."""
    monkeypatch.setattr(n, "banded", lambda texts, *_: texts.select("id", F.lit(0).alias("band"), F.lit(0).cast("long").alias("bucket")))
    monkeypatch.setattr(n, "MOST_TEXTS", most)
    base, rows = prose(1, 200).split(), []
    for g in range(14):
        own = base.copy()
        own[10 * g + 20:10 * g + 40] = prose(50 + g, 20).split()
        rows += [(3 * g + i, " ".join([*own[:-1], f"x{g}{i}"])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(sorted(m) for m in brute(rows))
    assert len(want) == 14
    assert classes(docs, by_count=by_count) == want


def test_chain_to_a_settled_text(spark, monkeypatch):
    """C is like B alone, and B is settled by the hub of the big group around A in all buckets they share."""
    a = prose(1, 200).split()
    b = [*a[:50], *prose(2, 10).split(), *a[60:]]
    c = [*b[:100], *prose(3, 10).split(), *b[110:]]
    rows = [(i, " ".join([*a[:-1], f"x{i}"])) for i in range(12)] + [(20, " ".join(b)), (21, " ".join(c))]
    near_a = F.col("text").contains(" ".join(a[48:62]))
    one = F.lit(0).cast("long").alias("bucket")

    def banded(texts, *_):
        """All texts are in one bucket and those around A in another, so that one of them is the hub."""
        return texts.select("id", F.lit(0).alias("band"), one).unionByName(texts.where(near_a).select("id", F.lit(1).alias("band"), one))

    monkeypatch.setattr(n, "banded", banded)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(brute(rows)) == 1 and len(brute([rows[0], rows[13]])) == 2
    assert classes(docs) == [sorted(r[0] for r in rows)]


def test_by_count(spark):
    a = "one two three four five " * 10
    b = "one two three four five " * 12
    docs = spark.createDataFrame([(1, a), (2, b), (3, "one two three four five " * 2)], "doc_id long, text string")
    assert len({r["class_id"] for r in n.near_classes(docs).collect()}) == 1
    assert len({r["class_id"] for r in n.near_classes(docs, by_count=True, bands=40, rows=2).collect()}) == 2
