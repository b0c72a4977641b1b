"""Catalogue: ordered logic, reports and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from semlake.operators import index, joins, rank, records, report
from semlake.plans.vectors import table
from semlake.sources import entities


def batch_plan(spark, sf_dir):
    out = rank.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), 20, "source", "doc_id")
    return out.select("doc_id", "source", F.col("batch").cast("bigint").alias("batch"))


def running_budget(spark, sf_dir):
    out = rank.within_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "n_chars", 20_000, "source", "doc_id")
    return out.select("doc_id", "source", F.col("spent").cast("bigint").alias("spent"))


def trim_context(spark, sf_dir):
    """The turns of a conversation as segments before its statement, within 400 characters."""
    conv = table(spark, sf_dir, "conversations")
    seg = F.concat(F.when(F.col("turn") % 3 == 0, "theory ").when(F.col("turn") % 3 == 1, "fact ").otherwise("notation "), F.replace("text", F.lit("\n"), F.lit(" ")))
    one = conv.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))), lambda x: x.s), "\n\n\n").alias("ctx"))
    one = one.withColumn("stmt", F.lit("goal"))
    return rank.trim_context(one, "conv_id", "ctx", "stmt", F.length, 400)


def keep_first_dedup(spark, sf_dir):
    out = rank.keep_first(table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text_md5")), "text_md5", "source", "doc_id")
    return out.select("doc_id", "source", "text_md5")


def priority_dedup(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", F.col("event_id") % 1000).otherwise(-1).alias("goal_off"),
        (F.col("event_id") * 7 % 5000 - 1).alias("word_off"), F.col("event_id").alias("input_pos"))
    return rank.keep_best_entry(df, "key")


def prev_row_collapse(spark, sf_dir):
    """Within a conversation: a role and length class that equal those of the turn before are collapsed."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 < 3, "Generated by a locale").alias("head"), F.when(F.col("turn") % 5 < 4, F.concat(F.lit("Locale "), (F.col("turn") / 2).cast("int"))).alias("locale"))
    return rank.collapse_repeats(df, "conv_id", ["turn"], "head", "locale", "(same locale as above)")


def last_answer_wins(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id")).where("conv_id % 3 <> 0")
    out = rank.best_answers(df, known, "conv_id", "turn", "text")
    return out.select("conv_id", F.md5("text").alias("answer_md5"))


def unknown_labels(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id")).where("conv_id % 3 <> 0")
    return rank.unknown_labels(df, known, "conv_id")


def not_unique(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("source", "lang", F.md5("text").alias("name"))
    return rank.duplicates(df, ["source", "lang", "name"])


def usage_by_type(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("cents", (F.col("value") * 100).cast("bigint")).withColumn("n", F.lit(1))
    return report.usage(ev, ["event_type"], ["cents", "n"]).select("event_type", F.col("cents").cast("bigint").alias("cents"), F.col("n").cast("bigint").alias("n"))


def blocked_modules(spark, sf_dir):
    """Documents without a label are missing; sources with over 30 % low quality count as finished."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    missing = docs.join(labels, "doc_id", "left_anti").select("source", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("name"))
    done = spark.createDataFrame([("src1",), ("src2",)], "source string")
    out = report.blocked(missing, done, "source", "name")
    return out.select("source", "total", F.array_join("first", ",").alias("first"), F.col("more").cast("bigint").alias("more"))


def bucketed_names(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("name"))
    out = entities.by_module(df)
    return out.select("module", "kind", F.md5(F.array_join("names", ",")).alias("names_md5"), "n")


def fact_indices(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    out = entities.facts(df, "l_orderkey", "lines")
    return out.select("l_orderkey", F.col("index").cast("int").alias("index"), F.col("theorem").cast("int").alias("line"))


def new_members(spark, sf_dir):
    """Suppliers of return-flagged lines that no other flag has, per ship year."""
    li = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("collection"), F.col("l_suppkey").alias("key"), "l_returnflag")
    return entities.new_members(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'")).select("collection", "key")


def span_lookup(spark, sf_dir):
    """Offsets of events within the span of an order's price, per status."""
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("node"), F.col("o_orderkey").alias("command"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 8).alias("end"))
    at = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("event_id") % 3 + 1).cast("int")).alias("node"), (F.col("event_id") * 5).alias("off"))
    return joins.span_at(at, spans, "node").where("command is not null").select("event_id", "command")


def staged_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.col("p_partkey").alias("target"))
    parts = parts.groupBy("name").agg(F.min("target").alias("target"))
    by_base = parts.select(F.element_at(F.split("name", r"\."), -1).alias("base"), "target")
    wanted = parts.select("name").unionByName(by_base.select(F.col("base").alias("name")).distinct())
    return joins.staged_lookup(wanted.distinct(), parts, by_base)


def explained_constants(spark, sf_dir):
    """Suppliers of the orders as constants with their names, without those seen before."""
    terms = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.array_sort(F.collect_list("l_suppkey")).alias("consts"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("interpretation"))
    seen = known.where("name % 5 = 0").select(F.col("name").alias("const"))
    return joins.explain_constants(terms, known, seen).select("const", "interpretation")


def replay_match(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.split("p_name", " "), -1)).alias("name"), F.floor(F.col("p_partkey") / 4).alias("digest"))
    replay = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("template"), F.element_at(F.split("p_name", " "), -1).alias("suffix"), F.floor(F.col("p_partkey") / 4).alias("digest"))
    return joins.replayed(entries, replay).select("name", "digest", "template", "confirmed")


def availability_division(spark, sf_dir):
    """Orders all of whose suppliers are loaded (suppkey % 4 <> 0)."""
    exp = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.collect_set("l_suppkey"), lambda h: F.struct(h.alias("hash"))).alias("constituents"))
    loaded = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("hash"))
    return index.available(exp, loaded).select("key", F.size("constituents").cast("bigint").alias("n"))


def index_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"))
    return index.difference(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")))


def point_gets(spark, sf_dir):
    """Three wanted keys in order, one of them missing, and whether they are there."""
    wanted = spark.createDataFrame([(0, 7), (1, -5), (2, 3)], "pos int, key bigint")
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source")
    out = records.contains(df, records.get_many(df, wanted))
    return out.select("pos", "key", "source", "present")


ORACLES = {
    "batch_plan": "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents",
    "running_budget": "SELECT doc_id, source, CAST(spent AS BIGINT) AS spent FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) WHERE spent <= 20000",
    "trim_context": """WITH s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'theory ' WHEN 1 THEN 'fact ' ELSE 'notation ' END || replace(text, chr(10), ' ') || chr(10) || chr(10) AS p FROM conversations),
r AS (SELECT *, 4 + sum(length(p)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent, CASE turn % 3 WHEN 0 THEN -1 WHEN 1 THEN 3 ELSE 0 END AS k FROM s)
SELECT conv_id, coalesce(string_agg(p, '' ORDER BY k, turn) FILTER (WHERE spent <= 400), '') || 'goal' AS text FROM r GROUP BY conv_id""",
    "keep_first_dedup": "SELECT doc_id, source, text_md5 FROM (SELECT doc_id, source, md5(text) AS text_md5 FROM documents) QUALIFY row_number() OVER (PARTITION BY text_md5 ORDER BY source, doc_id) = 1",
    "priority_dedup": """SELECT key, goal_off, word_off, input_pos FROM (SELECT user_id AS key, CASE WHEN event_type = 'purchase' THEN event_id % 1000 ELSE -1 END AS goal_off, event_id * 7 % 5000 - 1 AS word_off, event_id AS input_pos FROM events)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY goal_off >= 0 DESC, CASE WHEN goal_off >= 0 THEN goal_off END, CASE WHEN goal_off < 0 THEN word_off END, input_pos) = 1""",
    "prev_row_collapse": """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 < 3 THEN 'Generated by a locale' END AS head, CASE WHEN turn % 5 < 4 THEN 'Locale ' || (turn // 2) END AS locale FROM conversations),
a AS (SELECT *, coalesce(lag(head) OVER w = head AND lag(locale) OVER w = locale, false) AS again FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN again THEN '(same locale as above)' ELSE head END AS head, CASE WHEN NOT again THEN locale END AS locale FROM a""",
    "last_answer_wins": "SELECT conv_id, md5(arg_max(text, turn)) AS answer_md5 FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) GROUP BY conv_id",
    "unknown_labels": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)",
    "not_unique": "SELECT source, lang, md5(text) AS name, count(*) AS n FROM documents GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "usage_by_type": "SELECT event_type, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM events GROUP BY event_type",
    "blocked_modules": """WITH m AS (SELECT source, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src1', 'src2'))
SELECT source, count(*) AS total, array_to_string(list_sort(list(name))[:10], ',') AS first, greatest(count(*) - 10, 0) AS more FROM m GROUP BY source""",
    "bucketed_names": "SELECT source AS module, lang AS kind, md5(array_to_string(list_sort(list(CAST(doc_id AS VARCHAR))), ',')) AS names_md5, count(*) AS n FROM documents GROUP BY 1, 2",
    "fact_indices": "SELECT l_orderkey, CAST(CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 0 ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) END AS INTEGER) AS index, CAST(l_linenumber AS INTEGER) AS line FROM lineitem",
    "new_members": "SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS collection, l_suppkey AS key FROM lineitem WHERE l_returnflag = 'R' AND (year(l_shipdate), l_suppkey) NOT IN (SELECT (year(l_shipdate), l_suppkey) FROM lineitem WHERE l_returnflag = 'A')",
    "span_lookup": """SELECT event_id, o_orderkey AS command FROM events JOIN orders ON ['F', 'O', 'P'][CAST(event_id % 3 + 1 AS INTEGER)] = o_orderstatus
  AND o_orderkey * 10 <= event_id * 5 AND event_id * 5 < o_orderkey * 10 + 8""",
    "staged_names": """WITH p AS (SELECT replace(p_name, ' ', '.') AS name, min(p_partkey) AS target FROM part GROUP BY 1), b AS (SELECT string_split(name, '.')[-1] AS base, target FROM p),
u AS (SELECT base, min(target) AS t FROM b GROUP BY base HAVING count(*) = 1), w AS (SELECT name FROM p UNION SELECT base FROM b)
SELECT w.name, coalesce(p.target, u.t) AS target, CASE WHEN p.target IS NOT NULL THEN 'exact' WHEN u.t IS NOT NULL THEN 'base' ELSE 'none' END AS stage FROM w LEFT JOIN p ON p.name = w.name LEFT JOIN u ON u.base = w.name""",
    "explained_constants": "SELECT DISTINCT s_suppkey AS const, s_name AS interpretation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0",
    "replay_match": """WITH e AS (SELECT p_partkey || '.' || string_split(p_name, ' ')[-1] AS name, p_partkey // 4 AS digest FROM part), r AS (SELECT p_partkey AS template, string_split(p_name, ' ')[-1] AS suffix, p_partkey // 4 AS digest FROM part),
b AS (SELECT name, e.digest, template, suffix, CAST(ends_with(name, suffix) AS INTEGER) AS confirmed FROM e JOIN r ON e.digest = r.digest), a AS (SELECT *, max(confirmed) OVER (PARTITION BY digest) AS x FROM b)
SELECT name, digest, template, confirmed FROM a WHERE x = 1 QUALIFY row_number() OVER (PARTITION BY name ORDER BY confirmed DESC, length(suffix) DESC, template) = 1""",
    "availability_division": "SELECT l_orderkey AS key, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0))",
    "index_diff": """SELECT doc_id AS key, 'missing' AS side FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'stale' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)""",
    "point_gets": "SELECT pos, k AS key, source, doc_id IS NOT NULL AS present FROM (VALUES (0, 7), (1, -5), (2, 3)) w(pos, k) LEFT JOIN documents ON doc_id = k",
}

QUERIES = {name: globals()[name] for name in ORACLES}
