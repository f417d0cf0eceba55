"""Rows that an operator must take without crashing: nulls, empty and very long texts, ties, repeated
rows, and extra columns whose names the operators use themselves."""
import random

from pyspark.sql import functions as F

CLASHING = ["row", "key", "id", "size", "target", "copies", "position", "score", "n", "gram", "at", "hub", "word", "c", "pass", "slice", "part", "seq"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


BASE, LONG = prose(1, 300), prose(2, 40_000)
NEAR = BASE.replace(BASE.split()[150], "changed", 1)
PASSAGE = prose(3, 90)
ROWS = [
    (1, BASE, "s1"), (2, NEAR, "s1"), (3, None, None), (4, "", "s2"), (5, LONG, "s1"), (6, BASE, "s2"), (6, BASE, "s2"),
    (None, "no id here " + PASSAGE, "s1"), (None, None, "s3"), (7, prose(4, 60) + " " + PASSAGE + " " + prose(5, 60), "s1"), (8, "<|endoftext|> one two  three\n\n'll éü漢\U0001f600", "s3"),
    (9, "aaaa" * 500, "s1"), (10, " \t\n ", "s2"), (11, "word", "s2"), (12, "ab " * 400, "s4"), (13, (PASSAGE + " ") * 3, "s4"),
]


def odd_docs(spark):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def no_docs(spark):
    return odd_docs(spark).limit(0)


def real_docs(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
