r"""Chat formatting by schema fingerprints and declarative mappings (DataFrame functions only).

``fingerprint`` hashes the sorted nested field paths of a layout. ``MAPPINGS`` holds,
for each fingerprint, SQL expressions that turn that layout into canonical turns
(role, text). Tables with one conversation or (``ROW_LAYOUTS``) one turn a row are matched on their schema
(``canonical_turns``, ``canonical_rows``), JSON strings of mixed layouts row by row (``canonical_json``);
a layout with further fields takes the mapping with the most fields that it holds.

``format_turns`` writes one string a conversation:
``<|start|>role<|sep|>text<|end|>\n`` for each turn. A control string inside a role or
text gets one more backslash after its first character (``<|end|>`` -> ``<\|end|>``,
``<\|end|>`` -> ``<\\|end|>``), which ``unescape`` takes away again, so any text comes
back exactly. The loss mask is a list of [start, end) code-point spans of the formatted
string, one for each assistant text. A conversation is one output row by definition, so
its turns meet in one group.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls
first), then role, then text; repeated rows are turns of their own; conversations with
a null id form one conversation; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semlake.llm.common import sha256_hex, table, unused

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Control strings after their first character: this template's own and those of other templates.
ANGLE, SQUARE = r"(\|(?:start|sep|end|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>)", r"(/?INST\])"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<(\\*)" + ANGLE, r"<\\$1$2")
    return F.regexp_replace(c, r"\[(\\*)" + SQUARE, r"[\\$1$2")


def unescape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<\\(\\*)" + ANGLE, r"<$1$2")
    return F.regexp_replace(c, r"\[\\(\\*)" + SQUARE, r"[$1$2")


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths: struct fields by name, array elements as []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(names) -> str:
    return hashlib.sha256("\n".join(sorted(set(names))).encode()).hexdigest()[:16]


_PAIR = "array(named_struct('role', 'user', 'text', {0}), named_struct('role', 'assistant', 'text', {1}))"
_LIST = "transform({0}, m -> named_struct('role', {1}, 'text', m.{2}))"
_NAME = "case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end"
#: Layout (its schema) -> SQL expression of its canonical turns; @ stands before a top-level field.
LAYOUTS = {
    "prompt string, response string": _PAIR.format("@prompt", "@response"),
    "prompt string, completion string": _PAIR.format("@prompt", "@completion"),
    "question string, answer string": _PAIR.format("@question", "@answer"),
    "instruction string, output string": _PAIR.format("@instruction", "@output"),
    "instruction string, input string, output string": _PAIR.format("concat_ws('\n\n', @instruction, nullif(@input, ''))", "@output"),
    "messages array<struct<role string, content string>>": _LIST.format("@messages", "m.role", "content"),
    "conversations array<struct<from string, value string>>": _LIST.format("@conversations", _NAME, "value"),
    "turns array<struct<role string, text string>>": _LIST.format("@turns", "m.role", "text"),
}
#: Likewise with one turn a row, placed by its turn: the row's own turn. For tables only, as a JSON row is a conversation.
ROW_LAYOUTS = {
    "conv_id bigint, turn bigint, role string, text string": "array(named_struct('role', @role, 'text', @text))",
}


def _mappings(layouts: dict[str, str] = LAYOUTS | ROW_LAYOUTS) -> dict[str, tuple[frozenset, str, str]]:
    out = {}
    for ddl, sql in layouts.items():
        names = paths(T._parse_datatype_string(ddl))
        out[fingerprint(names)] = (frozenset(names), ddl, sql)
    return out


def mapping_for(names, mappings: dict) -> tuple[frozenset, str, str]:
    """By fingerprint; else, with further fields, the mapping with the most fields among them (then the first by name)."""
    if (known := mappings.get(fingerprint(names))) is not None:
        return known
    fits = sorted((m for m in mappings.values() if m[0] <= set(names)), key=lambda m: (-len(m[0]), m[1]))
    if not fits:
        raise ValueError(f"no mapping for the fields {sorted(names)}")
    return fits[0]


def canonical_turns(df: DataFrame) -> DataFrame:
    """The table with a column turns, array<struct<role, text>>, by the mapping of its schema."""
    return df.withColumn("turns", F.expr(mapping_for(paths(df.schema), _mappings())[2].replace("@", "")))


def held_paths(column: Column, known: list[str]) -> Column:
    """Those of the known nested paths that a JSON object holds. A path through an array is held if each element
    has the field; none is held where the value is an object or array itself. An empty array holds all of its paths."""
    tops: dict[str, list[str]] = {}
    for p in sorted(known):
        top, _, field = p.partition("[].")
        tops.setdefault(top, []).extend([field] if field else [])
    ddl = lambda one: ", ".join(f"{t} array<struct<{', '.join(f'{f} {one}' for f in fields)}>>" if fields else f"{t} {one}" for t, fields in tops.items())
    keys = F.json_object_keys(column)
    maps = F.from_json(column, ", ".join(f"{t} array<map<string,string>>" for t in tops))
    nested = [F.from_json(column, ddl(kind)) for kind in ("array<string>", "map<string,string>")]
    held = []
    for t, fields in tops.items():
        if not fields:
            held.append(F.when(F.array_contains(keys, t) & nested[0][t].isNull() & nested[1][t].isNull(), F.lit(t)))
        for f in fields:
            every = F.forall(maps[t], lambda m: F.coalesce(F.map_contains_key(m, f), F.lit(False)))  # noqa: B023
            deep = [F.coalesce(F.exists(n[t], lambda m: m[f].isNotNull()), F.lit(False)) for n in nested]  # noqa: B023
            held.append(F.when(every & ~deep[0] & ~deep[1], F.lit(f"{t}[].{f}")))
    return F.array_compact(F.array(*held))


def canonical_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Rows of JSON objects of mixed layouts: each row takes the mapping with the fingerprint of its nested field paths
    (of those that any layout knows), else the one with the most fields among those whose paths it holds. turns is null
    where none fits or the JSON is malformed."""
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    known = sorted(_mappings(LAYOUTS).values(), key=lambda m: (len(m[0]), m[1]))
    held, *names = unused(df, "_paths", *(f"_layout_{i}" for i in range(len(known))))
    out = df.withColumn(held, held_paths(F.col(column), sorted(set().union(*(m[0] for m in known)))))
    out = out.withColumns({n: F.from_json(F.col(column), m[1]) for n, m in zip(names, known, strict=True)})
    own = F.substring(sha256_hex(F.array_join(F.array_sort(held), "\n")), 1, 16)
    for exact in (False, True):
        for n, (fields, _, sql) in zip(names, known, strict=True):
            fits = own == fingerprint(fields) if exact else F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(fields))))) == len(fields)
            turns = F.when(fits, F.expr(sql.replace("@", f"{n}."))).otherwise(turns)
    return out.withColumn("turns", turns).drop(held, *names)


def turn_rows(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a turn of a table with a column turns: (conv_id, turn, role, text). turn is the place in turns, or
    where a row holds one turn the column order."""
    if order:
        return df.select(F.col(key).alias("conv_id"), F.col(order).alias("turn"), F.inline("turns")).select("conv_id", "turn", "role", "text")
    return df.select(F.col(key).alias("conv_id"), F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text")


def canonical_rows(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table by the mapping of its schema."""
    ddl = mapping_for(paths(df.schema), _mappings())[1]
    return turn_rows(canonical_turns(df), key, "turn" if ddl in ROW_LAYOUTS else None)


def format_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of a table with one turn a row; one shuffle, by conv_id."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"r": escape(F.col("role")), "t": escape(F.col("text"))})
    rows = rows.withColumn("s", F.concat(F.lit(START), "r", F.lit(SEP), "t", F.lit(END + "\n")))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order), "at": F.coalesce(F.sum(F.length("s")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    start = F.col("at") + len(START + SEP) + F.length("r")
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("int").alias("start"), (start + F.length("t")).cast("int").alias("end")))
    rows = rows.select("conv_id", F.struct("pos", "s", span.alias("span")).alias("x"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    spans = F.filter(F.transform("x", lambda x: x.span), lambda x: x.isNotNull())
    return got.select("conv_id", F.array_join(F.transform("x", lambda x: x.s), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted string."""
    parts = F.filter(F.split(formatted, r"<\|start\|>", -1), lambda x, i: i > 0)
    body = lambda x: F.substring_index(x, END, 1)
    return F.transform(parts, lambda x: F.struct(unescape(F.substring_index(x, SEP, 1)).alias("role"), unescape(F.substring_index(body(x), SEP, -1)).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask. Cut from an array of code points, so that long
    conversations take linear time."""
    points = F.split(formatted, "")
    return F.transform(spans, lambda x: unescape(F.array_join(F.slice(points, x.start + 1, x.end - x.start), "")))


#: The conversation that the query adds: control strings of another template inside its texts.
PLANTED = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_rows(table(spark, sf_dir, "conversations"))
    more = [(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)]
    out = format_rows(rows.unionByName(spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string")))
    out = out.withColumn("points", F.split("formatted", ""))
    cut = F.transform("loss_spans", lambda x: unescape(F.array_join(F.slice("points", x.start + 1, x.end - x.start), "")))
    out = out.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(cut, "").alias("loss"), F.size("points").cast("long").alias("formatted_chars"))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(turns).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '<(\\*)(\|(?:start|sep|end|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"


OP7_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START + SEP + END) + 1} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
