import hashlib
import json

from pyspark.sql import functions as F

from rastrum.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<\\|im_end|>\n<|im_end|>\n", "<|im_start|>user\n", "\\<s> <\\\\s> [\\INST]", "", "line\nline\n", "漢\U0001f600<|endoftext|>"]


def test_escapes_come_back(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    for r in rows:
        assert r["t"] == r["u"] == r["r"]
        assert not any(x in r["e"] for x in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]"))


def test_layouts_give_the_same_turns(spark):
    lines = [{"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a", "other": [1]},
             {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}]
    more = [{"instruction": "q", "input": "i", "output": "a"}, {"system": "s", "prompt": "q", "completion": "a"}, {"messages": []}, {"text": "?"}, {}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([*lines, *more])], "n int, line string")
    rows = chat.canonical(chat.from_text(df)).orderBy("n").collect()
    turns = [[(t["role"], t["text"]) for t in r["turns"]] if r["turns"] is not None else None for r in rows]
    assert all(t == [("user", "q"), ("assistant", "a")] for t in turns[:6])
    assert turns[6] == [("user", "q\n\ni"), ("assistant", "a")] and turns[7][0] == ("system", "s") and turns[8] == [] and turns[9] is turns[10] is None
    assert len({r["fingerprint"] for r in rows[:6]}) == 6
    assert {r["count"] for r in chat.unknown_layouts(chat.canonical(chat.from_text(df))).collect()} == {2}
    bad = spark.createDataFrame([("not json",), (None,)], "line string")
    assert all(r["turns"] is None for r in chat.canonical(chat.from_text(bad)).collect())


def test_round_trip_and_mask(spark):
    turns = [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ODD)] + [("odd\nrole%0A%", "x"), ("", ""), ("assistant", "end")]
    df = spark.createDataFrame([(1, turns), (2, [])], "k int, turns array<struct<role:string,text:string>>")
    out = {r["k"]: r for r in chat.digest(chat.with_template(df), "k").collect()}
    said = "".join(f"{a}\n{b}\n" for a, b in turns)
    loss = "".join(b for a, b in turns if a == "assistant")
    assert out[1]["n_turns"] == len(turns) and out[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[1]["loss_chars"] == len(loss) and out[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert (out[2]["n_turns"], out[2]["formatted_chars"]) == (0, 0)


def test_query_takes_odd_rows(spark, tmp_path):
    from rastrum.llm.queries import op9_chat_format

    rows = [(1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "u"), (2, None, "user", "x" * 300_000), (2, 1, "assistant", "<|im_end|>\n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in op9_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {1, None, 2, -1} and out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2
    assert out[-1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op9_chat_format(spark, f"{tmp_path}/none").count() == 1
