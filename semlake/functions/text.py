"""Texts of records: pretty printing, document text, prompt templates, names, endpoints, errors."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.schemas import EXPERIENCE, KINDS, RULE_KINDS

EXPR_LIMIT = 500
DEFAULT_PHRASE = "constants, theorems and types"
# The frame of an experience's document text.
EXPERIENCE_HEAD = "This is an experience that aims to help prove goals of the following forms:"
EXPERIENCE_TAIL = "The experience should be used in the following situation:"


def truncate(c: Column, limit: int = EXPR_LIMIT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def pretty(label: Column, name: Column, expr: Column) -> Column:
    """``label name``, and ``: expr`` unless expr is null or empty."""
    return F.concat(label, F.lit(" "), name, F.when(F.coalesce(expr, F.lit("")) != "", F.concat(F.lit(": "), expr)).otherwise(F.lit("")))


def document_text(kind: Column, label: Column, name: Column, expr: Column, interpretation: Column, patterns: Column) -> Column:
    """What is embedded; null if there is no interpretation, or an experience has no patterns."""
    framed = F.concat(F.lit(EXPERIENCE_HEAD + "\n"), F.array_join(F.transform(patterns, lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("\n" + EXPERIENCE_TAIL + "\n"), interpretation)
    experience = F.when(F.coalesce(F.size(patterns), F.lit(0)) > 0, framed)
    return F.when(interpretation.isNull(), None).when(kind == EXPERIENCE, experience).otherwise(F.concat(pretty(label, name, expr), F.lit("\n"), interpretation))


def to_unicode(c: Column, table: dict[str, str]) -> Column:
    """Escapes to characters by a table, longest escape first; literal."""
    for k in sorted(table, key=lambda k: (-len(k), k)):
        c = F.replace(c, F.lit(k), F.lit(table[k]))
    return c


def to_ascii(c: Column, table: dict[str, str]) -> Column:
    return to_unicode(c, {v: k for k, v in table.items()})


def render_kinds(kinds: Sequence[int]) -> str:
    """The noun phrase of a kind filter; the four rule kinds are one phrase."""
    phrase = {k: p for k, _, p in KINDS}
    found = list(dict.fromkeys(phrase.get(k) or ("inference rules" if k in RULE_KINDS else DEFAULT_PHRASE) for k in kinds))
    if not found:
        return DEFAULT_PHRASE
    return found[0] if len(found) == 1 else ", ".join(found[:-1]) + " and " + found[-1]


def render_kinds_column(phrases: Column) -> Column:
    """The same on an array column of phrases."""
    p = F.array_distinct(phrases)
    n = F.size(p)
    return F.when(n == 0, DEFAULT_PHRASE).when(n == 1, F.element_at(p, 1)).otherwise(F.concat(F.array_join(F.slice(p, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(p, -1)))


def template_task(description: str, kinds_phrase: str | None = None, override: str | None = None) -> str:
    task = override if override is not None else description.replace("{kinds}", kinds_phrase or DEFAULT_PHRASE)
    if "{text}" in task or "{task}" in task:
        raise ValueError(f"a task sentence must not contain '{{text}}' or '{{task}}': {task!r}")
    return task


def apply_template(text: Column, template: str, role: str, task: str | None = None) -> Column:
    """Literal replacement, {task} first; braces inside the text stay as they are."""
    if role not in ("query", "document"):
        raise ValueError(f"unknown role {role!r}")
    if role == "query":
        template = template.replace("{task}", template_task("", override=task or ""))
    return F.replace(F.lit(template), F.lit("{text}"), text)


def endpoint_domain(url: Column) -> Column:
    """Lower-case host, and the port unless it is the scheme's own."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(own, host).otherwise(F.concat(host, F.lit(":"), port))


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def has_version_segment(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.exists(F.split(path, "/"), lambda s: s.rlike("^v[0-9]"))


def sanitize_model(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("__"))


def restore_model(name: Column) -> Column:
    return F.replace(name, F.lit("__"), F.lit("/"))


def strip_trailing_begin(source: Column) -> Column:
    return F.regexp_replace(source, r"\nbegin\s*$", "")


def strip_lone_surrogates(c: Column) -> Column:
    return F.regexp_replace(c, "(?<![\\ud800-\\udbff])[\\udc00-\\udfff]|[\\ud800-\\udbff](?![\\udc00-\\udfff])", "")


def fact_name(name: Column) -> Column:
    """``name(3)`` -> struct(name, index); index null without one."""
    pattern = r"^(.*)\(([0-9]+)\)$"
    hit = name.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("name"), F.when(hit, F.regexp_extract(name, pattern, 2).cast("int")).alias("index"))


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _rule_name(name: Column, letter: str, suffixes: Sequence[str]) -> Column:
    out = base_name(name).rlike(f"[^A-Z]{letter}$")
    for s in suffixes:
        out = out | name.endswith(s)
    return out


# Name endings of rules.
def is_introduction_name(name: Column) -> Column:
    return _rule_name(name, "I", ("_intro", ".intro", "_intros", ".intros"))


def is_elimination_name(name: Column) -> Column:
    return _rule_name(name, "E", ("_elim", ".elim", "_elims", ".elims", "_dest", ".dest"))


def is_induction_name(name: Column) -> Column:
    return base_name(name).rlike("(_induct|_ind)$")


def is_case_split_name(name: Column) -> Column:
    return base_name(name).rlike("(_cases|_case)$")


def rule_kind(name: Column) -> Column:
    return F.when(is_introduction_name(name), "introduction").when(is_elimination_name(name), "elimination").when(is_induction_name(name), "induction").when(is_case_split_name(name), "case_split").otherwise("none")


def agent_label(label: Column, name: Column) -> Column:
    return F.concat(F.coalesce(label, F.lit("unknown")), F.lit(" "), name)


def human_size(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.format_string("%.2f GiB", n / float(1 << 30))).otherwise(F.format_string("%.1f MiB", n / float(1 << 20)))


def error_class(error: Column, status: Column, result: Column) -> Column:
    """Ordered classification of an agent's failure: the enum first, then the status, then the text."""
    text = F.coalesce(result, F.lit(""))
    return (
        F.when(error == "rate_limit", "rate_limit")
        .when(error == "server_error", "transient")
        .when(error == "authentication_failed", "auth")
        .when(error == "billing_error", "billing")
        .when(error == "invalid_request", "invalid_request")
        .when(text.startswith("You've hit your limit"), "limit")
        .when(text.contains("Rate limit"), "rate_limit")
        .when(status == 400, "poisoned")
        .when(F.lower(text).contains("not logged in") | (status == 401), "auth")
        .when(error.isNotNull() | (status >= 400), "fatal")
        .otherwise("ok")
    )


def http_hint(status: Column, is_auth: Column, has_key: Column, url: Column) -> Column:
    """Class of advice for an HTTP failure; authentication is tested before the status."""
    return (
        F.when(is_auth & ~has_key, "no_key")
        .when(is_auth, "rejected_key")
        .when((status == 404) & ~has_version_segment(url), "check_model_and_version")
        .when(status.isin(400, 404, 422), "check_model")
        .when(status == 429, "rate_or_quota")
        .otherwise("")
    )


def tri_state(value: Column) -> Column:
    """Strict boolean settings: null when unset, false when blank; anything unknown raises an error."""
    v = F.lower(F.trim(value))
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), value)).cast("boolean")
    return F.when(v.isNull(), None).when(v.isin("1", "true", "yes", "on"), True).when(v.isin("", "0", "false", "no", "off"), False).otherwise(wrong)


def _section(title: str, parts: Column) -> Column:
    return F.concat(F.lit(f"###{title}\n"), F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("\n\n"))), ""))


def encode_goal(variables: Column, premises: Column, conclusion: Column) -> Column:
    return F.concat(_section("Variables", variables), _section("Premises", premises), F.lit("###Conclusion\n"), conclusion)


def encode_fact(variables: Column, statement: Column) -> Column:
    return F.concat(_section("Variables", variables), F.lit("###Statement\n"), statement)


def within_limit(text: Column, tokens: Column, limit: int, heading: str) -> Column:
    """The text under its heading; an error if it is more than three tokens over the limit."""
    return F.when(tokens > limit + 3, F.raise_error(F.lit(f"more than {limit} tokens"))).otherwise(F.concat(F.lit(f"#{heading}\n"), text))


def entity_digest(kind: Column, *parts: Column) -> Column:
    """A digest of an entity's definition; a null part differs from an empty one."""
    marked = [F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.to_json(F.array(kind.cast("string"), *marked)), 256)


def dependencies(*parts: Column) -> Column:
    """The union of dependency lists, each once, sorted; null lists are empty."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))))


def token_counts(pieces):
    """A pandas UDF: the number of tokens of each string of an array. pieces: str -> list of str that concatenate to it."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda xs: None if xs is None else [len(pieces(x)) for x in xs])

    return run


def first_tokens(pieces, limit: int):
    """A pandas UDF: a text cut after the limit."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else "".join(pieces(x)[:limit]))

    return run


def shrink(df: DataFrame, column: str, pieces, limit: int, for_goal: bool = True, out: str = "shrunk") -> DataFrame:
    """The table with the text within a token limit, under ``out``.

    Of a goal, lines go from the front until the rest fits, blank lines and headings (###) stay; a fact, or a goal
    that still does not fit, is cut after the limit. The tokenizer counts once for each row; which lines go follows in
    columns, from the running sum of what was dropped."""
    held = F.col("_counted")
    df = df.withColumn("_lines", F.split(column, "\n", -1))
    # The whole text is counted along with its lines, in one call.
    df = df.withColumn("_counted", token_counts(pieces)(F.concat(F.array(column), F.col("_lines"))))
    total = F.element_at(held, 1)
    stays = lambda line: (line == "") | line.startswith("###")
    # Lines are dropped up to some place: what is left, whether that is enough, the line at hand and the last one dropped.
    state = lambda left, done, at, cut: F.struct(left.alias("left"), done.alias("done"), at.alias("at"), cut.alias("cut"))
    start = state(total, F.lit(False), F.lit(0), F.lit(-1))

    def step(s: Column, x: Column) -> Column:
        goes = ~s["done"] & ~stays(x["line"])
        left = F.when(goes, s["left"] - x["n"]).otherwise(s["left"])
        return state(left, s["done"] | (goes & (left <= limit)), s["at"] + 1, F.when(goes, s["at"]).otherwise(s["cut"]))

    lines = F.arrays_zip(F.col("_lines").alias("line"), F.slice(held, F.lit(2), F.size("_lines")).alias("n"))
    df = df.withColumn("_end", F.aggregate(lines, start, step))
    kept = F.filter("_lines", lambda line, i: (i > F.col("_end.cut")) | stays(line))
    shorter = F.when(F.col("_end.done"), F.array_join(kept, "\n")) if for_goal else F.lit(None).cast("string")
    df = df.withColumn(out, F.when(F.col(column).isNull() | (total <= limit), F.col(column)).otherwise(shorter))
    cut = first_tokens(pieces, limit)(F.when(F.col(out).isNull(), F.col(column)))
    return df.withColumn(out, F.coalesce(out, cut)).drop("_lines", "_counted", "_end")
