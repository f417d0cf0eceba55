"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, decontam, embedding_dedup, language_model, mixing, neardup, phrases, quality, repeats, topk
from . import token_counts as tc
from . import token_files as tf
from .common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_IDS = 50_257
END_ID = 2
TOKEN_LIMIT = 1024


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, (rank - 1) % 3 AS kind, 2.0::DOUBLE * source_size AS most FROM r),
u AS (SELECT *, most / w AS ratio, sum(most) OVER o AS filled, sum(w) OVER o AS w_sum, 1.5::DOUBLE * sum(source_size) OVER () AS due, sum(w) OVER () AS all_w
      FROM w WINDOW o AS (ORDER BY most / w, rank)),
l AS (SELECT *, (due - (filled - most)) / (all_w - (w_sum - w)) AS level FROM u),
f AS (SELECT arg_min(level, rank_in_order) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, rank) AS rank_in_order FROM l) WHERE ratio > level),
t AS (SELECT source, source_size, kind, CASE WHEN f.level IS NULL THEN most ELSE least(most, w * f.level) END AS target FROM w, f),
c AS (SELECT d.*, t.source_size, t.target, t.kind, CAST(round(t.target) AS BIGINT) AS goal,
      CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, goal - start)) AS first_words, greatest(0, least(size, goal - source_size - start)) AS second_words,
      (start + greatest(0, least(size, goal - start)) / 2) / goal AS spent FROM c)
SELECT doc_id, size, source_size, target, CAST(first_words + second_words AS BIGINT) AS taken,
  CASE WHEN first_words = 0 THEN NULL
       WHEN kind = 0 THEN round(least(1, 2 * (spent * 1.25) / (2 + sqrt(greatest(4 - 3 * (spent * 1.25), 0)))), 6)
       WHEN kind = 1 THEN round(least(1, 2 * spent / 2), 6)
       WHEN spent * 1.125 <= 0.375 THEN round(2 * (spent * 1.125) / (0.5 + sqrt(greatest(0.25 + 2 * (spent * 1.125), 0))), 6)
       ELSE round(least(1, 0.5 + 2 * (spent * 1.125 - 0.375) / (1 + sqrt(greatest(1 + 4 * (spent * 1.125 - 0.375), 0)))), 6) END AS position
FROM p
"""


@register("op1_curriculum_mix", OP1_SQL)
def op1_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``position`` is where the document is first taken; rows come in that order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("copies", F.lit(0))["position"], 6).alias("position"))
    return mixing.by_position(rows, "doc_id")


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, BYTE_BPE_IDS)


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), TOKEN_LIMIT)


QUALITY_CUT = 0.3


@register("op4_rule_quality")
def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), "quality", held_out=0)
    return quality.scored(docs, model).select("row.doc_id", "score").select(
        "doc_id", quality.kept_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


@register("op5_qgram_passages")
def op5_qgram_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the item: clean documents have no row."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_dart_minhash")
def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


REPEAT_BYTES = 400


@register("op7_suffix_repeats")
def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.without_repeats(table(spark, sf_dir, "documents"), REPEAT_BYTES)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_log_bilinear")
def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model.language_scores(table(spark, sf_dir, "documents"), held_out=1)
    return scores.withColumn("held_out", quality.kept_out("doc_id", 1))


def _escaped_sql(column: str) -> str:
    angle = f"regexp_replace({column}, '<(\\\\*)(/?s>|\\|im_(?:start|end)\\|>|\\|endoftext\\|>)', '<\\\\\\1\\2', 'g')"
    return f"regexp_replace({angle}, '\\[(\\\\*)(/?INST\\])', '[\\\\\\1\\2', 'g')"


OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(replace(replace({_escaped_sql("role")}, '%', '%25'), chr(10), '%0A')) + 1 + length({_escaped_sql("text")}) + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@register("op9_chat_format", OP9_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of a user's and then an assistant's turn come as prompt and completion, the others
    as messages; both layouts go by their fingerprints into the same turns."""
    odd = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    pair = (F.size("said") == 2) & (F.get("said", F.lit(0))["role"] == "user") & (F.get("said", F.lit(1))["role"] == "assistant")
    records = talks.select("conv_id", F.struct(
        F.when(pair, F.get("said", F.lit(0))["content"]).alias("prompt"), F.when(pair, F.get("said", F.lit(1))["content"]).alias("completion"),
        F.when(~pair, F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("messages")).alias("record"))
    files = written(chat.with_template(chat.canonical(records)).select("conv_id", "layout", "segments"), "chat")
    return chat.digest(files, "conv_id")


TOP_K = 5
OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@register("op10_exact_topk", OP10_SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 50 == 0, TOP_K)


def _step_sql(state: str, cost: str, letter: str, said: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {said}}}"


_FAR_SQL = "{'c': 1000000000000::BIGINT, 'a': '', 'r': ''}"
_KEPT_SQL, _USER_SQL, _ASSISTANT_SQL = (f"chr(10) || {role} || ':' || r.text" for role in ("r.role", "'user'", "'assistant'"))


def _keep_sql(state: str, initial: str) -> str:
    return f"CASE WHEN r.stays AND r.initial = '{initial}' THEN {_step_sql(state, 'r.more', 'K', _KEPT_SQL)} ELSE {_FAR_SQL} END"


def _rerole_sql(state: str, said: str) -> str:
    return f"CASE WHEN r.stays THEN {_step_sql(state, '1 + r.more', 'R', said)} ELSE {_FAR_SQL} END"


_INSERTED_SQL = "SELECT conv_id, i, z, s, u, least(a, {to_a}) AS a FROM (SELECT conv_id, i, z, s, least(u, {to_u}) AS u, a FROM {walk})"


def _inserted_sql(walk: str) -> str:
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    return _INSERTED_SQL.format(walk=walk, to_a=_step_sql("u", "5", "I", assistant), to_u=", ".join(_step_sql(x, "5", "I", user) for x in "zsa"))


OP11_SQL = f"""
WITH RECURSIVE k AS (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
crc AS (SELECT key, 0 AS i, 4294967295::BIGINT AS x FROM (SELECT DISTINCT key FROM k)
  UNION ALL SELECT key, i + 1, list_reduce(list_prepend(xor(x, ascii(key[i + 1])::BIGINT), range(8)), lambda y, bit: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END) FROM crc WHERE i < length(key)),
kinds AS (SELECT key, xor(x, 4294967295::BIGINT) % 20 AS kind FROM crc WHERE i = length(key)),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k JOIN kinds USING (key) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM d),
f AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
r AS (SELECT *, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, left(role, 1) AS initial FROM f),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS z, {_FAR_SQL} AS s, {_FAR_SQL} AS u, {_FAR_SQL} AS a FROM counts
  UNION ALL SELECT w.conv_id, r.i, {_step_sql("w.z", "2", "D")}, least({_step_sql("w.s", "2", "D")}, {_keep_sql("w.z", "s")}),
    least({_step_sql("w.u", "2", "D")}, {", ".join(_rerole_sql(x, _USER_SQL) + ", " + _keep_sql(x, "u") for x in ("w.z", "w.s", "w.a"))}),
    least({_step_sql("w.a", "2", "D")}, {_rerole_sql("w.u", _ASSISTANT_SQL)}, {_keep_sql("w.u", "a")})
  FROM ({_inserted_sql("walk")}) w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
best AS (SELECT e.conv_id, least(e.z, e.a) AS b FROM ({_inserted_sql("walk")}) e JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.n = e.i)
SELECT a.conv_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@register("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


NEAR_COSINE = 0.93
NEAR_RECALL = 0.999
OP12_SQL = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.i, b.i AS j, b.vec_id FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.i <> b.i WHERE list_cosine_similarity(a.v, b.v) >= {NEAR_COSINE}),
reach AS (SELECT i, i AS j FROM ok UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j),
parts AS (SELECT r.i, min(e.vec_id) AS component_id FROM reach r JOIN e ON e.i = r.j GROUP BY r.i),
n AS (SELECT i, count(*) AS n_links FROM links GROUP BY i)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, CASE WHEN parts.i IS NULL THEN e.vec_id ELSE parts.component_id END AS component_id,
  coalesce(e.vec_id = CASE WHEN parts.i IS NULL THEN e.vec_id ELSE parts.component_id END, false) AS kept
FROM e LEFT JOIN n USING (i) LEFT JOIN parts USING (i)
"""


@register("op12_embedding_near_dedup", OP12_SQL)
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=NEAR_COSINE, recall=NEAR_RECALL)


PHRASES_A_LANGUAGE = 2000
OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row_number() OVER () AS piece, lang, piece_text FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece_text FROM d)),
t AS (SELECT piece, lang, unnest(list_filter(string_split(translate(piece_text, chr(9), ' '), ' '), lambda w: w <> '')) AS w, generate_subscripts(list_filter(string_split(translate(piece_text, chr(9), ' '), ' '), lambda w: w <> ''), 1) AS i FROM p),
s4 AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, g, m, count(*) AS a FROM (SELECT lang, w AS g, 1 AS m FROM s4 UNION ALL SELECT lang, w || ' ' || w2, 2 FROM s4 WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3 FROM s4 WHERE w3 IS NOT NULL UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM s4 WHERE w4 IS NOT NULL) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
e AS (SELECT lang, g, m, a, unnest(range(1, m + 1)) AS first, string_split(g, ' ') AS q FROM f WHERE m > 1),
part AS (SELECT lang, g, m, a, first, size, array_to_string(list_slice(q, first, first + size - 1), ' ') AS part FROM (SELECT *, unnest(range(1, m - first + 2)) AS size FROM e) WHERE size < m),
s AS (SELECT x.lang, x.g, x.a, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * x.a // (l.a + r.a) AS BIGINT) AS score FROM part x JOIN part y ON y.lang = x.lang AND y.g = x.g AND y.first = x.size + 1 AND y.size = x.m - x.size
  JOIN f l ON l.lang = x.lang AND l.g = x.part JOIN f r ON r.lang = x.lang AND r.g = y.part WHERE x.first = 1 QUALIFY row_number() OVER (PARTITION BY x.lang, x.g ORDER BY score, x.size) = 1),
longer AS (SELECT lang, part AS g, max(a) AS longer FROM part WHERE size > 1 GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN longer USING (lang, g) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT o.lang, rank, g AS phrase, a, l, r, n.n, score FROM o JOIN n USING (lang) WHERE rank <= {PHRASES_A_LANGUAGE}
"""


@register("op13_phrase_collocations", OP13_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), PHRASES_A_LANGUAGE)
