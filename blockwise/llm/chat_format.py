"""Chat formatting (DataFrame operations only).

A layout is recognised by its schema fingerprint: the hash of its sorted nested
field paths. Of a schema or record, the paths that a layout has count for it, so
other fields do not hide it; of several layouts the one with most paths is taken,
then the first of ``LAYOUTS``. The fingerprint selects a declarative mapping that turns rows,
prompt, instruction or message layouts into canonical turns
(``conv_id, turn, role, text``). ``format_chat`` renders the turns of each
conversation as one training string with a loss mask, ``read_turns`` reads them
back.

Template of a turn: ``### <role>: <text> </turn>`` and a line end. Inside role
and text the control characters are escaped: a backslash is doubled, ``#``,
``<`` and (in roles) ``:`` become a backslash with the letter h, l or c. So
neither a marker nor an end can occur in them, and the escape is reversible.
The loss mask lists start and length (code points) of each assistant text in
the formatted string.

Defined results: a null text or role is empty; turns are ordered by (turn, role,
text), nulls first; repeated rows stay repeated; a null conversation id is a
conversation of its own; an empty table gives no rows. A conversation is one
training record and so must fit a row; conversations are spread by id.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_END = " </turn>\n"
MARK = "### "
AFTER_ROLE = ": "


# ------------------------------------------------------------ layouts


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, arrays as ``[]``, sorted."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def _turn(n: int, role: str, text: str) -> Column:
    return F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(text).cast("string").alias("text"))


def _messages(array: str, role: str, text: str, roles: dict[str, str] | None = None) -> Column:
    def one(x: Column, i: Column) -> Column:
        r = x[role]
        for given, canonical in (roles or {}).items():
            r = F.when(x[role] == given, F.lit(canonical)).otherwise(r)
        return F.struct(i.cast("long").alias("turn"), r.alias("role"), x[text].alias("text"))

    return F.transform(F.col(array), one)


def _joined(a: str, b: str) -> Column:
    return F.when(F.coalesce(F.col(b), F.lit("")) == "", F.col(a)).otherwise(F.concat_ws("\n\n", a, b))


def _user_assistant(user: Column, assistant: str) -> Column:
    return F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), user.alias("text")), _turn(1, "assistant", assistant))


#: Layout name -> (its field paths without the id, how its turns are made; None: it has a row per turn already).
LAYOUTS: dict[str, tuple[list[str], object]] = {
    "rows": (["role", "text", "turn"], None),
    "messages": (["messages[].content", "messages[].role"], lambda: _messages("messages", "role", "content")),
    "from_value": (
        ["conversations[].from", "conversations[].value"],
        lambda: _messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
    "instruction": (["input", "instruction", "output"], lambda: _user_assistant(_joined("instruction", "input"), "output")),
    "instruction_only": (["instruction", "output"], lambda: _user_assistant(F.col("instruction"), "output")),
    "prompt": (["completion", "prompt"], lambda: _user_assistant(F.col("prompt"), "completion")),
    "prompt_response": (["prompt", "response"], lambda: _user_assistant(F.col("prompt"), "response")),
    "system_prompt": (
        ["prompt", "response", "system"],
        lambda: F.array(_turn(0, "system", "system"), _turn(1, "user", "prompt"), _turn(2, "assistant", "response")),
    ),
}

#: JSON schemas of the nested layouts, for records that arrive as text.
JSON_SCHEMAS = {
    "messages": "messages array<struct<role:string,content:string>>",
    "from_value": "conversations array<struct<from:string,value:string>>",
    "instruction": "instruction string, input string, output string",
    "instruction_only": "instruction string, output string",
    "prompt": "prompt string, completion string",
    "prompt_response": "prompt string, response string",
    "system_prompt": "system string, prompt string, response string",
}


def fingerprint(paths: Column) -> Column:
    """Hash of a sorted array of field paths."""
    return F.md5(F.concat_ws("\x1f", F.array_sort(paths)))


def _hash(paths) -> str:
    """The same hash of paths on the driver."""
    return hashlib.md5("\x1f".join(sorted(paths)).encode()).hexdigest()


#: Layout name -> fingerprint.
FINGERPRINTS = {k: _hash(paths) for k, (paths, _) in LAYOUTS.items()}


def layout_of(schema: T.StructType, id_col: str = "conv_id") -> str:
    """The most specific layout whose fingerprint the schema's paths, projected to the layout's, have."""
    have = {p for p in field_paths(schema) if p != id_col}
    fits = [k for k, (paths, _) in LAYOUTS.items() if _hash(have & set(paths)) == FINGERPRINTS[k]]
    if not fits:
        raise ValueError(f"no layout has fields {sorted(have)}")
    return max(fits, key=lambda k: len(LAYOUTS[k][0]))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, turn, role, text`` from a table in any known layout; other columns are left out."""
    layout = layout_of(df.schema, id_col)
    make = LAYOUTS[layout][1]
    if make is None:
        return df.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = df.select(F.col(id_col).alias("conv_id"), F.explode(make()).alias("t"))
    return turns.select("conv_id", "t.turn", "t.role", "t.text")


def _json_paths(record: str) -> Column:
    """Field paths of a JSON record: its keys, and for an array of objects the keys of its first object."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def nested(k: Column) -> Column:
        first = F.get_json_object(F.col(record), "$.messages[0]"), F.get_json_object(F.col(record), "$.conversations[0]")
        inner = F.when(k == "messages", F.json_object_keys(first[0])).when(k == "conversations", F.json_object_keys(first[1]))
        return F.when(inner.isNotNull(), F.transform(inner, lambda x: F.concat(k, F.lit("[]."), x))).otherwise(F.array(k))

    return F.flatten(F.transform(keys, nested))


def turns_from_json(df: DataFrame, id_col: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of mixed JSON records; a record's fingerprint selects its mapping.

    Records of an unknown layout come back as one turn with role ``unknown`` and the record as text, none is lost.
    """
    marked = df.select(F.col(id_col).alias("conv_id"), F.col(record).alias("record"))
    marked = marked.withColumn("paths", F.array_distinct(_json_paths("record")))
    turns = F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("unknown").alias("role"), F.col("record").alias("text")))
    out = marked
    for name, schema in JSON_SCHEMAS.items():
        own = F.array_intersect("paths", F.array(*[F.lit(p) for p in LAYOUTS[name][0]]))
        out = out.withColumn(f"_{name}", F.when(fingerprint(own) == FINGERPRINTS[name], F.from_json("record", schema)))
    # The last that fits is taken: the one with most paths, then the first of LAYOUTS.
    for name in sorted(reversed(JSON_SCHEMAS), key=lambda k: len(LAYOUTS[k][0])):
        fields = out.select(f"_{name}.*").columns
        scope = {f: f"_{name}.{f}" for f in fields}
        turns = F.when(F.col(f"_{name}").isNotNull(), _scoped(name, scope)).otherwise(turns)
    return out.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def _scoped(name: str, at: dict[str, str]) -> Column:
    if name == "messages":
        return _messages(at["messages"], "role", "content")
    if name == "from_value":
        return _messages(at["conversations"], "from", "value", {"human": "user", "gpt": "assistant"})
    if name == "instruction":
        return _user_assistant(_joined(at["instruction"], at["input"]), at["output"])
    if name == "instruction_only":
        return _user_assistant(F.col(at["instruction"]), at["output"])
    if name == "prompt":
        return _user_assistant(F.col(at["prompt"]), at["completion"])
    if name == "prompt_response":
        return _user_assistant(F.col(at["prompt"]), at["response"])
    return F.array(_turn(0, "system", at["system"]), _turn(1, "user", at["prompt"]), _turn(2, "assistant", at["response"]))


# ------------------------------------------------------------ template


def escape(x: Column) -> Column:
    for char, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        x = F.replace(x, F.lit(char), F.lit(code))
    return x


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit(":"), F.lit("\\c"))


def unescape(x: Column) -> Column:
    """Inverse of the escapes: doubled backslashes are split off from the left first."""

    def plain(p: Column) -> Column:
        for char, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c")):
            p = F.replace(p, F.lit(code), F.lit(char))
        return p

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), plain), "\\")


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` (array of start, length in code points) from canonical turns."""
    empty = F.lit("")
    written = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    ).withColumns(
        {
            "before": F.concat(F.lit(MARK), escape_role(F.col("role")), F.lit(AFTER_ROLE)),
            "body": escape(F.col("text")),
            "loss": F.col("role") == "assistant",
        }
    )
    length = F.char_length("before") + F.char_length("body") + F.lit(len(TURN_END))
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.withColumn("at", F.coalesce(F.sum(length.cast("long")).over(earlier), F.lit(0)))
    piece = F.struct(
        "at",
        F.concat("before", "body", F.lit(TURN_END)).alias("piece"),
        "loss",
        (F.col("at") + F.char_length("before")).alias("start"),
        F.char_length("body").cast("long").alias("length"),
    )
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(piece)).alias("p"))
        .select(
            "conv_id",
            F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"),
            F.transform(F.filter("p", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_mask"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted string."""
    parts = F.split(formatted, TURN_END.replace("\n", r"\n"), -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(MARK) + 1))
        role = F.substring_index(body, AFTER_ROLE, 1)
        text = F.substr(body, F.char_length(role) + F.lit(len(AFTER_ROLE) + 1))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, one)


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss_mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
