import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rastrum.llm import queries as q
from rastrum.llm import token_counts as tc
from rastrum.llm import token_files as tf
from tests.llm.cases import ROWS, no_docs, odd_docs, real_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("make", [odd_docs, real_docs, no_docs])
def test_token_files(spark, make):
    docs = make(spark)
    got = sorted(tf.token_files(docs, PATH, 2, 50_257).collect(), key=lambda r: r["start"])
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(ids(r["text"]) + [2])
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)  # null ids first
    order = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert order == sorted(order) and len(got) == docs.count()
    at = 0
    for r in got:
        match = [x for x in want[r["doc_id"]] if len(x) == r["n_tokens"] and zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"]]
        assert r["start"] == at and match
        want[r["doc_id"]].remove(match[0])
        at += r["n_tokens"]


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 31])
def test_pack_round_trip(bits):
    v = np.random.default_rng(bits).integers(0, 2 ** bits, 5000).astype(np.uint32)
    assert (tf.unpack(tf.pack(v, bits), 5000, bits) == v).all()
    shard = tf.Shard(tf.shard_bytes(np.array([5, 6, 9]), np.array([1000, 0, 4000]), v, bits))
    assert (shard.ids_between(1020, 3100) == v[1020:3100]).all() and len(shard.document(1)) == 0 and (shard.document(2) == v[1000:]).all()


def test_other_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [t or "" for _, t, _ in ROWS]
    assert [x.tolist() for x in tf.PieceEncoder(path)(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_width():
    assert [tf.width(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("make", [odd_docs, real_docs, no_docs])
def test_token_counts(spark, make):
    docs = make(spark)
    got = sorted(map(tuple, tc.token_counts(docs, PATH, 1024).drop("fit_chars").collect()), key=repr)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(ids(r["text"])), n > 1024) for r in docs.collect()), key=repr)
    assert got == want


def test_budget_prefix_fits(spark):
    docs = {r["doc_id"]: r["text"] for r in real_docs(spark).collect()}
    for r in tc.token_counts(real_docs(spark), PATH, 300).collect():
        assert len(ids(docs[r["doc_id"]][:r["fit_chars"]])) <= 300
        assert r["fit_chars"] == len(docs[r["doc_id"]]) or len(ids(docs[r["doc_id"]][:r["fit_chars"]])) > 280


def test_every_prefix_is_exact(spark):
    for text in [(t or "")[:250] for _, t, _ in ROWS] + ["I'll we're 'l'v'd \n\n x  y\t z", ".'ll '' 'll", "  a   b  "]:
        counts = tc.counter(PATH).text_prefixes(text)
        assert counts.tolist() == [len(ids(text[:k])) for k in range(len(text) + 1)], text[:40]
    rows = tc.prefix_table(odd_docs(spark).where("doc_id = 1"), PATH).collect()
    cut = tc.budget_cut(rows[0]["counts"], 50)
    text = ROWS[0][1]
    assert len(ids(text[:cut])) <= 50 < len(ids(text[:cut + 1]))


def test_forgetting_changes_nothing():
    texts = [t or "" for _, t, _ in ROWS] * 2
    small, large = tf.PieceEncoder(PATH), tf.PieceEncoder(PATH)
    small.pieces.most = 1
    assert all((a == b).all() for t in texts for a, b in zip(small([t]), large([t]), strict=True))


def test_long_words_and_merge_order():
    with open(PATH, encoding="utf-8") as f:
        assert tc.Words.independent(json.load(f))
    for word in ["aaaaaaa" * 300, "ab" * 700 + "-" * 90, "=" * 400]:
        assert tc.counter(PATH).count(word) == len(ids(word))


def test_query_limits():
    assert (q.END_ID, q.TOKEN_LIMIT) == (2, 1024)
