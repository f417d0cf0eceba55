import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from rastrum.llm import repeats as R
from tests.llm.cases import no_docs, odd_docs, prose, real_docs


def brute(rows, length):
    at = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        at.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for doc_id, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if at[b[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        runs = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(docs, length, **how):
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
                   for r in R.without_repeats(docs, length, **how).collect()), key=repr)


@pytest.mark.parametrize("make", [odd_docs, real_docs, no_docs])
@pytest.mark.parametrize("most", [R.MOST_CONTEXTS, 1])
def test_against_brute_force(spark, make, most):
    """``most`` 1 sends every gram to the counting way."""
    docs = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 50_000]
    docs = docs.where("text is null or length(text) < 50000")
    assert got(docs, 400, most_contexts=most) == brute(rows, 400)


def test_planted_edges(spark):
    rng = random.Random(5)
    common = prose(11, 300)
    rows = []
    for i in range(40):
        a = rng.randrange(0, 900)
        n = rng.randrange(380, 700)
        rows.append((i, prose(100 + i, 40) + common[a:a + n] + prose(200 + i, 40)))
    rows += [(50, "xy" * 450), (51, "z" * 1200), (52, "abc" * 133)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(docs, 400) == brute(rows, 400)


def test_suffix_order_is_byte_order():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.choice([97, 98], rng.integers(1, 60)).astype(np.uint8)) for _ in range(200)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    group = np.repeat(np.arange(20), 10)
    order = R.suffix_order(R.PrefixHash(data), starts, ends, data, group)
    assert [parts[i] for i in order] == [p for g in range(20) for p in sorted(parts[10 * g:10 * g + 10])]


def test_windows_have_anchors_that_depend_on_content_alone():
    text = prose(21, 400).encode()
    a = np.frombuffer(text, np.uint8)
    b = np.frombuffer(prose(22, 50).encode() + text[300:1500] + prose(23, 50).encode(), np.uint8)
    number, at, gram, near, far = R.anchors(a, np.array([len(a)]), 400)
    assert sum(f - n + 1 for f, n in zip(far, near)) == len(a) - 399
    inner = {int(g) for g, p in zip(gram, at) if 300 + 400 <= p < 1500 - 400}
    assert inner and inner <= {int(g) for g in R.anchors(b, np.array([len(b)]), 400)[2]}


@pytest.mark.parametrize("most", [R.MOST_CONTEXTS, 1])
def test_colliding_prefix_hashes_remove_nothing(spark, monkeypatch, most):
    """Different contexts and windows of one gram stay different where their prefix hashes are equal."""
    base = R.PrefixHash

    class Weak(base):
        def of(self, start, end):
            return base.of(self, start, end) & np.uint64(3)

    passage = prose(11, 100)[:300]
    rows = [(i, prose(100 + i, 90) + passage + prose(200 + i, 90)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(R, "PrefixHash", Weak)
    assert got(docs, 400, most_contexts=most) == brute(rows, 400)


def test_lists_become_objects_a_few_thousand_at_a_time():
    """Batches hold up to 10,000 texts: their places as Python objects would take many times a worker's share."""
    rng = random.Random(9)
    texts = ["x" * rng.choice((0, 10, 3_000_000)) for _ in range(40)] + ["y" * 50] * 3000
    places = [None if i % 7 == 0 else [{"at": j} for j in range(rng.choice((0, 3, 9000)) if i < 40 else 14)] for i in range(3040)]
    batch = pa.record_batch({"text": texts, "places": places}).slice(1)
    parts = list(R._small(batch, "text", "places"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    for p in parts:
        rows = p.to_pylist()
        assert len(rows) == 1 or sum(len(r["text"]) for r in rows) <= R.OBJECT_BYTES and sum(len(r["places"] or ()) for r in rows) <= R.OBJECTS
    assert len(parts) < 300
