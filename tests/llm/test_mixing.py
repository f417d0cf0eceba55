import math
from collections import defaultdict

import pytest

from rastrum.llm import mixing
from tests.llm.cases import no_docs, odd_docs, real_docs


@pytest.mark.parametrize("make", [odd_docs, real_docs])
def test_targets_and_takes(spark, make):
    rows = mixing.mix(make(spark)).collect()
    assert len(rows) == make(spark).count()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    due, full, want = 1.5 * sum(size.values()), set(), {}
    while True:  # deal by weight, fill, deal the excess again
        rest = due - sum(2 * size[s] for s in full)
        open_ = [s for s in names if s not in full]
        want = {s: 2.0 * size[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if want[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6) and abs(taken[s] - want[s]) <= 1


def test_small_slices_give_the_same_mix(spark, monkeypatch):
    plain = sorted(map(str, mixing.mix(real_docs(spark)).drop("text_key").collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)
    spark.conf.set("spark.rastrum.hotGroupRows", "2")
    try:
        assert sorted(map(str, mixing.mix(real_docs(spark)).drop("text_key").collect())) == plain
    finally:
        spark.conf.unset("spark.rastrum.hotGroupRows")


@pytest.mark.parametrize("schedule", mixing.SCHEDULES)
def test_time_inverts_the_integral(spark, schedule):
    from pyspark.sql import functions as F

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u")).select("u", mixing.time_of(F.col("u"), schedule).alias("t")).collect()

    def mass(t):
        out = 0.0
        for (a, x), (b, y) in zip(schedule, schedule[1:]):
            end = min(t, b)
            if end > a:
                out += (end - a) * (x + x + (y - x) * (end - a) / (b - a)) / 2
        return out
    for r in rows:
        assert math.isclose(mass(r["t"]), r["u"] * mass(1), abs_tol=1e-9)


def test_training_order_rises(spark):
    parts = mixing.training_order(mixing.mix(real_docs(spark))).rdd.glom().collect()
    positions = [r["position"] for p in parts for r in p]
    assert positions == sorted(positions) and len(positions) > 200


def test_mixed_documents_keep_columns_and_rows(spark):
    docs = odd_docs(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {r["text"] for r in docs.collect()}
    assert out.count() > 0 and all(r["text"] in texts for r in out.collect())
    repeated = out.where("doc_id = 6").count()
    assert repeated <= 4


def test_texts_are_dealt_out_twice_at_most(spark):
    """Once to meet their copies, once for the order of training."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges, nodes = 0, [mixing.mixed_documents(real_docs(spark))._jdf.queryExecution().executedPlan().initialPlan()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    while nodes:
        node = nodes.pop()
        wide = any(a.name() == "row" for a in (node.output().apply(i) for i in range(node.output().size())))
        exchanges += wide and "Exchange" in node.nodeName()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert exchanges == 2


def test_repeated_rows_take_a_set_of_copies_each(spark):
    docs = real_docs(spark).limit(20).crossJoin(spark.range(3).select()).unionByName(real_docs(spark).limit(5))
    chosen = mixing.mix(docs).collect()
    want, got = defaultdict(int), defaultdict(int)
    for r in chosen:
        want[r["doc_id"]] += sum(2 * c["words"] >= r["size"] for c in r["copies"])
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] += 1
    assert got == {k: n for k, n in want.items() if n} and max(got.values()) > 2


def test_empty(spark):
    assert mixing.mix(no_docs(spark)).count() == 0
    assert mixing.mixed_documents(no_docs(spark)).count() == 0
