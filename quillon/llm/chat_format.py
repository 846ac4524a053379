"""Chat formatting, in DataFrame functions only.

`fingerprint` hashes the sorted nested field paths of a layout; LAYOUTS has, for each known layout, a
declarative mapping that turns a row into canonical turns, an array of (role, text). A table's schema is
fingerprinted once; a column of JSON texts is fingerprinted row by row through its variant's schema, so
prompt, instruction and message layouts can be mixed in one table.

The template marks each turn as `<|im_start|>role<|im_sep|>text<|im_end|>`. Control strings inside roles
and texts get a backslash after their first character, backslashes are doubled before that, and
`unescape` takes both back. A formatted conversation is a list of segments, each with its loss flag: the
texts of assistant turns are under the loss mask and nothing else is.

Defined results: a null role or text is empty; rows of one conversation that have the same turn are
ordered by role and text; repeated rows stay; rows without a conv_id are one conversation; a layout with no mapping raises an error for a table and gives null turns for
a JSON row; an empty table gives no conversations. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that models or templates read as control strings. Fixed values.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = "([<\\[])(" + "|".join(f"\\Q{c[1:]}\\E" for c in CONTROL) + ")"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Dotted paths of all leaves; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _named(role: Column) -> Column:
    """Names of roles in other layouts; what isn't listed stays."""
    names = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[role], role)


#: Layout name -> field paths of one conversation's row and the mapping from its fields to turns.
LAYOUTS: dict[str, tuple[tuple[str, ...], object]] = {
    "messages": (("messages[].content", "messages[].role"), lambda c: F.transform(c("messages"), lambda m: _turn(_named(m["role"]), m["content"]))),
    "from_value": (("conversations[].from", "conversations[].value"), lambda c: F.transform(c("conversations"), lambda m: _turn(_named(m["from"]), m["value"]))),
    "prompt_completion": (("completion", "prompt"), lambda c: F.array(_turn("user", c("prompt")), _turn("assistant", c("completion")))),
    "prompt_response": (("prompt", "response"), lambda c: F.array(_turn("user", c("prompt")), _turn("assistant", c("response")))),
    "instruction": (("input", "instruction", "output"), lambda c: F.array(_turn("user", F.concat(F.coalesce(c("instruction"), F.lit("")), F.when(F.coalesce(c("input"), F.lit("")) != "", F.concat(F.lit("\n\n"), c("input"))).otherwise(F.lit("")))), _turn("assistant", c("output")))),
    "instruction_only": (("instruction", "output"), lambda c: F.array(_turn("user", c("instruction")), _turn("assistant", c("output")))),
    "question_answer": (("answer", "question"), lambda c: F.array(_turn("user", c("question")), _turn("assistant", c("answer")))),
}
#: A table with one row for each turn.
ROWS = ("role", "text", "turn")
BY_PRINT = {fingerprint(list(paths)): name for name, (paths, _) in LAYOUTS.items()} | {fingerprint(list(ROWS)): "rows"}
#: How the fields of a JSON layout are read.
JSON_FIELDS = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, completion string, response string, instruction string, input string, output string, question string, answer string"


def canonical(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turns): canonical turns of any known layout."""
    own = [f for f in df.schema.fields if f.name != id_col]
    layout = BY_PRINT.get(fingerprint(field_paths(T.StructType(own))))
    if layout is None:  # columns beside a known layout don't count
        held = set(field_paths(T.StructType(own)))
        fitting = [n for n, paths in [("rows", ROWS), *((n, p) for n, (p, _) in LAYOUTS.items())] if set(paths) <= held]
        layout = max(fitting, key=lambda n: len(ROWS if n == "rows" else LAYOUTS[n][0]), default=None)
    if layout is None:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(T.StructType(own)))}")
    if layout == "rows":
        turns = df.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("_turns"))
        return turns.select(id_col, F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS).alias("turns"))
    return df.select(id_col, LAYOUTS[layout][1](lambda name: F.col(name)).cast(TURNS).alias("turns"))


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """As canonical, of a column of JSON objects whose layouts may differ from row to row."""
    shape = F.schema_of_variant(F.try_parse_json(json_col))
    # OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING>>> becomes the same sorted field paths' text.
    bare = F.regexp_replace(shape, r": (STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]+\)|VARIANT)", "")
    known = {
        "OBJECT<messages: ARRAY<OBJECT<content, role>>>": "messages",
        "OBJECT<conversations: ARRAY<OBJECT<from, value>>>": "from_value",
    } | {f"OBJECT<{', '.join(sorted(paths))}>": name for name, (paths, _) in LAYOUTS.items() if not any("[]" in p for p in paths)}
    prints = F.create_map(*[F.lit(x) for shape_text, name in known.items() for x in (shape_text, fingerprint(list(LAYOUTS[name][0])))])
    read = df.select(id_col, prints[bare].alias("_print"), F.from_json(json_col, JSON_FIELDS).alias("_j"))
    turns = None
    for name, (paths, mapping) in LAYOUTS.items():
        when = F.col("_print") == F.lit(fingerprint(list(paths)))
        made = mapping(lambda field: F.col("_j")[field]).cast(TURNS)
        turns = F.when(when, made) if turns is None else turns.when(when, made)
    return read.select(id_col, turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _ESCAPE, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\((?s:.))", "$1")


def formatted(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, formatted, segments): the text and the same text in pieces (text, loss)."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                piece(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)), F.lit(False)),
                piece(escape(t["text"]), t["role"] == "assistant"),
                piece(F.lit(END), F.lit(False)),
            ),
        )
    )
    made = turns.select(id_col, parts.alias("segments"))
    return made.select(id_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parsed(formatted: Column) -> Column:
    """The canonical turns read back from a formatted text."""
    return F.transform(
        F.filter(F.split(formatted, f"\\Q{START}\\E", -1), lambda p, k: k > 0),
        lambda p: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit(SEP)) + len(SEP), F.length(p) - F.instr(p, F.lit(SEP)) - len(SEP) + 1 - len(END))).alias("text"),
        ),
    )


def digest(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the contract asks for, read back from formatted texts and their loss masks."""
    back = made.select(
        id_col,
        parsed(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("lost"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return back.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """The contract's conversation -1 beside the table's."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) AS plain,
         length(text) - length(replace(text, '\', ''))
         + length(role) - length(replace(role, '\', ''))
         + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|startoftext\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
         + len(regexp_extract_all(role, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|startoftext\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS extra
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(plain + extra + 32)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
