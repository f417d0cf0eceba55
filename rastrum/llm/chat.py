"""Chat formatting by schema fingerprints, in DataFrame functions alone.

Records come in many layouts (a prompt and its completion, an instruction with input and output,
lists of messages). The sorted paths of the nested fields that a record fills are hashed; that
fingerprint selects a declared mapping from the layout to canonical turns (role, text). Turns are
then written in one template with a loss mask over the assistants' texts.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings of this and of
common other templates inside a text get a backslash after their first character (one more where
there are some already), so no text can open or close a turn and the text comes back exactly.
In roles, percent signs and line breaks are written as %25 and %0A.

Defined cases: null roles and texts count as empty; a record whose fingerprint no mapping has keeps
``layout`` null and no turns (``unknown_layouts`` lists them); a record without turns formats to
the empty string; turns with equal numbers go by role, then text; repeated rows are turns of their
own; columns other than those named are ignored. One conversation is one text, as the output asks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ANGLE = r"(/?s>|\|im_(?:start|end)\|>|\|endoftext\|>)"
SQUARE = r"(/?INST\])"

#: every field that a declared layout may fill
RECORD = ("prompt string, completion string, response string, instruction string, input string, output string, question string, "
          "answer string, system string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>")


def turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


@dataclass(frozen=True)
class Layout:
    """Paths a record of this layout must fill, paths it may fill, and its turns."""
    name: str
    paths: Sequence[str]
    turns: Callable[[Callable[[str], Column]], Column]
    optional: Sequence[str] = field(default=())


def _pair(ask: str, answer: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.array(turn("user", get(ask)), turn("assistant", get(answer)))


def _instruction(get: Callable[[str], Column]) -> Column:
    ask = F.when(F.coalesce(get("input"), F.lit("")) == "", get("instruction")).otherwise(F.concat(get("instruction"), F.lit("\n\n"), get("input")))
    return F.array(turn("user", ask), turn("assistant", get("output")))


def _shared(get: Callable[[str], Column]) -> Column:
    role = lambda r: F.when(r == "human", "user").when(r == "gpt", "assistant").otherwise(r)
    return F.transform(get("conversations"), lambda m: turn(role(m["from"]), m["value"]))


LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", ("messages[].role", "messages[].content"), lambda get: F.transform(get("messages"), lambda m: turn(m["role"], m["content"])), ("system",)),
    Layout("no messages", ("messages[]",), lambda get: F.filter(F.array(turn("", F.lit(""))), lambda _: F.lit(False)), ("system",)),
    Layout("shared", ("conversations[].from", "conversations[].value"), _shared, ("system",)),
    Layout("prompt", ("prompt", "completion"), _pair("prompt", "completion"), ("system",)),
    Layout("response", ("prompt", "response"), _pair("prompt", "response"), ("system",)),
    Layout("instruction", ("instruction", "output"), _instruction, ("input", "system")),
    Layout("question", ("question", "answer"), _pair("question", "answer"), ("system",)),
)


def _any_filled(items: Column, name: str) -> Column:
    return F.exists(items, lambda m: m[name].isNotNull())


def filled_paths(record: str, schema: T.StructType) -> Column:
    """Sorted paths of the leaves that a record fills; elements of a list share the path ``name[]``,
    which an empty list fills itself."""
    out: list[tuple[str, Column]] = []
    for f in schema.fields:
        here = F.col(f"{record}.`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType.fields:
                out.append((f"{f.name}[].{g.name}", _any_filled(here, g.name)))
            out.append((f"{f.name}[]", F.size(here) == 0))
        else:
            out.append((f.name, here.isNotNull()))
    names = [F.when(F.coalesce(has, F.lit(False)), F.lit(path)) for path, has in sorted(out, key=lambda x: x[0])]
    return F.array_compact(F.array(*names))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` (role, text) for a struct column of known layouts."""
    schema = records.schema[record].dataType
    have = {f.name for f in schema.fields}
    get = lambda name: F.col(f"{record}.`{name}`") if name in have else F.lit(None).cast("string")
    layout = turns = None
    for one in layouts:
        if not {p.split("[]")[0] for p in one.paths} <= have:
            continue
        ways = [sorted([*one.paths, *extra]) for n in range(len(one.optional) + 1) for extra in itertools.combinations(one.optional, n)]
        match = F.col("fingerprint").isin(*[fingerprint(F.array(*map(F.lit, w))) for w in ways])
        said = one.turns(get)
        if "system" in one.optional and "system" in have:
            said = F.when(get("system").isNotNull(), F.concat(F.array(turn("system", get("system"))), said)).otherwise(said)
        layout = F.when(match, one.name) if layout is None else layout.when(match, one.name)
        turns = F.when(match, said) if turns is None else turns.when(match, said)
    return records.withColumn("fingerprint", fingerprint(filled_paths(record, schema))).withColumn("layout", layout).withColumn("turns", turns)


def from_text(lines: DataFrame, column: str = "line") -> DataFrame:
    """Records from lines of JSON: fields outside the known ones are passed over."""
    return lines.withColumn("record", F.from_json(column, RECORD))


def unknown_layouts(formatted: DataFrame) -> DataFrame:
    return formatted.where(F.col("layout").isNull()).groupBy("fingerprint").count()


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)" + ANGLE, r"<\\$1$2"), r"\[(\\*)" + SQUARE, r"[\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)" + ANGLE, "<$1$2"), r"\[\\(\\*)" + SQUARE, "[$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def with_template(turned: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``segments``: runs of text in order, each with its place under the loss mask; the formatted
    text is the runs end to end (``formatted``)."""
    def runs(t: Column) -> Column:
        trained = t["role"] == "assistant"
        return F.array(F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"]).alias("text"), trained.alias("loss")),
                       F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    return turned.withColumn("segments", F.flatten(F.transform(F.coalesce(F.col(turns), F.filter(F.array(turn("", F.lit(""))), lambda _: F.lit(False))), runs)))


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parsed(text: Column) -> Column:
    """Turns of a formatted text: cut at closings, then at the first line break."""
    bodies = F.filter(F.split(text, r"\Q" + CLOSE.rstrip("\n") + r"\E\n"), lambda b: b != "")
    def one(b: Column) -> Column:
        body = F.substr(b, F.lit(len(OPEN) + 1))
        line = F.instr(body, F.lit("\n"))
        return F.struct(unescape_role(F.substr(body, F.lit(1), line - 1)).alias("role"), unescape(F.substr(body, line + 1)).alias("text"))
    return F.transform(bodies, one)


def under_mask(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(files: DataFrame, key: str) -> DataFrame:
    """Turns, mask and lengths as read back from formatted output."""
    out = files.withColumn("__text", formatted()).withColumn("__turns", parsed(F.col("__text"))).withColumn("__loss", under_mask())
    said = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(key, F.size("__turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.char_length("__loss").cast("bigint").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
                      F.char_length("__text").cast("bigint").alias("formatted_chars"))
