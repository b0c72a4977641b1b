"""Catalogue: point and batch reads, mutations, reports and the index over a store of records.

Documents stand for plain records under their source, orders for experiences whose suppliers are the constituents;
a 16-byte hash is the md5 of a name."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.functions import keys
from semlake.operators import index, records, report, topk
from semlake.plans.vectors import table
from semlake.schemas import EXPERIENCE, INTRODUCTION, RULE_KINDS, THEOREM

_NO_PARTS = "array<struct<name:string,hash:binary>>"
COUNTERS = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens")


def _md5(c):
    return F.unhex(F.md5(c.cast("string")))


def _hash(name: str) -> bytes:
    return hashlib.md5(name.encode(), usedforsecurity=False).digest()


def _hex(c):
    return F.lower(F.hex(c))


def plain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, kind, name, interpretation, constituents) of the documents; kinds 1, 3, 4 and 7 in turn; every fifth is not interpreted."""
    kind = F.element_at(F.array(*map(F.lit, (1, 3, 4, 7))), (F.col("doc_id") % 4 + 1).cast("int"))
    tag = F.unhex(F.lpad(F.hex(kind), 2, "0"))
    return table(spark, sf_dir, "documents").select(
        F.concat(_md5(F.col("source")), tag, F.substring(_md5(F.col("doc_id")), 1, 15)).alias("key"), kind.alias("kind"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("interpretation"), F.lit(None).cast(_NO_PARTS).alias("constituents"),
    )


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns of the orders."""
    parts = F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda s: F.struct(s.cast("string").alias("name"), _md5(s).alias("hash")))
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(parts.alias("constituents"))
    key = F.concat(keys.xor_prefix(F.transform("constituents", lambda c: c["hash"])), F.lit(bytes([EXPERIENCE])), F.substring(_md5(F.col("l_orderkey")), 1, 15))
    return each.select(key.alias("key"), F.lit(EXPERIENCE).alias("kind"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("name"), F.lit("use").alias("interpretation"), "constituents")


def module_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose number is not divisible by 3, with the characters of their documents as tokens; even ones are finished."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    zero = [F.lit(0).cast("bigint").alias(c) for c in COUNTERS[1:]]
    out = table(spark, sf_dir, "documents").where(n % 3 != 0).groupBy("source").agg(F.sum("n_chars").cast("bigint").alias("input_tokens"))
    return out.select(_md5(F.col("source")).alias("key"), "input_tokens", *zero, F.lit(0.0).alias("cost_usd"), (n % 2 == 0).alias("finished"), F.lit("m").alias("model"))


def entity_get(spark, sf_dir):
    """One record by its key."""
    df = plain_records(spark, sf_dir)
    key = df.where("name = 'n7'").select("key").first()
    return records.get(df, bytes(key[0]) if key else b"").select("name", _hex(F.col("key")).alias("key"))


def entity_scan(spark, sf_dir):
    """All records, but not the rows of modules that share the table."""
    df = plain_records(spark, sf_dir).select("key", "name")
    modules = table(spark, sf_dir, "documents").select(_md5(F.col("source")).alias("key"), F.col("source").alias("name")).distinct()
    return records.entities(df.unionByName(modules)).select("name", _hex(F.col("key")).alias("key"))


def entities_of_kind(spark, sf_dir):
    """By the tag in the key: experiences, from a table of all records."""
    return records.of_key_kind(plain_records(spark, sf_dir).unionByName(experiences(spark, sf_dir)), EXPERIENCE).select("name")


def entities_with_prefix(spark, sf_dir):
    return records.with_prefix(plain_records(spark, sf_dir), _hash("src1")).select("name", F.col("kind").cast("int").alias("kind"))


def embed_candidates(spark, sf_dir):
    return records.embed_candidates(plain_records(spark, sf_dir), [1, 3]).select("name", F.col("kind").cast("int").alias("kind"))


def batch_gets(spark, sf_dir):
    """Every tenth document is asked for, and as many keys that are not there; in order of asking."""
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source")
    asked = df.where("key % 10 = 0").select("key")
    wanted = asked.unionByName(asked.select((-F.col("key") - 1).alias("key"))).select((F.col("key") * 2).alias("pos"), "key")
    return records.get_many(df, wanted).select("pos", "key", "source")


def interpreted_modules(spark, sf_dir):
    """All sources are done: finished, with zero counters where there was no row; odd hashes are in progress and skipped."""
    done = table(spark, sf_dir, "documents").select(_md5(F.col("source")).alias("key")).distinct()
    return records.mark_interpreted(module_status(spark, sf_dir), done).select(_hex(F.col("key")).alias("key"), "input_tokens", "finished")


def ledger_totals(spark, sf_dir):
    """Even events are in the ledger already, odd ones are added: counters add up, the model of the last one wins."""
    ev = table(spark, sf_dir, "events").withColumns({"key": F.col("user_id"), "model": F.col("event_type"), "cost_usd": (F.col("value") * 100).cast("bigint").cast("double")})
    ev = ev.withColumns({c: F.col("event_id") % (i + 2) for i, c in enumerate(COUNTERS)})
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTERS]
    old = ev.where("event_id % 2 = 0").groupBy("key").agg(*sums, F.sum("cost_usd").alias("cost_usd"), F.bool_or(F.col("event_type") == "purchase").alias("finished"), F.lit("old").alias("model"))
    out = records.add_costs(old, ev.where("event_id % 2 = 1").select("key", *COUNTERS, "cost_usd", "model", F.expr("ts + make_dt_interval(0, 0, 0, event_id / 1e6)").alias("ts")))
    return out.select("key", *COUNTERS, F.col("cost_usd").cast("bigint").alias("cents"), "finished", "model")


def put_and_delete_experiences(spark, sf_dir):
    """Experiences of odd orders join those of even ones, then those divisible by 3 go, from records and vectors."""
    exp = experiences(spark, sf_dir).withColumn("n", F.substring("name", 2, 20).cast("bigint"))
    vectors = exp.select(F.lit("m").alias("model"), "key", "n", F.array(F.lit(1).cast("smallint")).alias("q"))
    half = lambda df, k: df.where(F.col("n") % 2 == k)
    held, vecs = records.put_experiences(half(exp, 0), half(vectors, 0), half(exp, 1), half(vectors, 1))
    held, vecs = records.delete_experiences(held, vecs, exp.where("n % 3 = 0").select("key"))
    return held.join(vecs.select("key", F.size("q").alias("size")), "key").select("name", F.col("size").cast("bigint").alias("size"))


def purged_kind(spark, sf_dir):
    """Vectors of all records without those of experiences."""
    every = plain_records(spark, sf_dir).unionByName(experiences(spark, sf_dir)).select("key", "name")
    return records.purge_kind(every).select("name")


def copied_prefix(spark, sf_dir):
    """Records of src1 once more under a new prefix. Keys of XOR length are skipped, so they are cut by a byte here."""
    df = plain_records(spark, sf_dir).select(F.substring("key", 1, 31).alias("key"), "name")
    return records.copy_prefix(df, _hash("src1"), _hash("new")).select("name", _hex(F.col("key")).alias("key"))


def experience_index(spark, sf_dir):
    """Experiences that mention supplier 3, 5 or 7, from the posting lists; their keys prove the XOR prefix."""
    posting = index.posting(experiences(spark, sf_dir))
    loaded = spark.range(3, 8, 2).select(_md5(F.col("id")).alias("hash"))
    return index.candidates(posting, loaded).select(_hex(F.col("key")).alias("key"))


def xor_consistency(spark, sf_dir):
    """Counts over all records; every seventh experience has a prefix that does not fit, every eleventh no constituents."""
    exp = experiences(spark, sf_dir).withColumn("n", F.substring("name", 2, 20).cast("bigint"))
    exp = exp.withColumns({"key": F.when(F.col("n") % 7 == 0, keys.with_prefix(F.col("key"), F.lit(b"\xff" * 16))).otherwise(F.col("key")), "constituents": F.when(F.col("n") % 11 != 0, F.col("constituents"))})
    return index.consistency(plain_records(spark, sf_dir).unionByName(exp.drop("n")))


def repair_of_prefixes(spark, sf_dir):
    """Every seventh experience has a prefix that does not fit: where it moves to."""
    exp = experiences(spark, sf_dir).withColumn("n", F.substring("name", 2, 20).cast("bigint"))
    exp = exp.withColumn("key", F.when(F.col("n") % 7 == 0, keys.with_prefix(F.col("key"), F.lit(b"\xff" * 16))).otherwise(F.col("key"))).drop("n")
    return index.repair_plan(exp).select(_hex(F.col("new_key")).alias("new_key"), "action")


def _report(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(_md5(F.col("source")).alias("hash"), F.col("source").alias("name")).distinct()
    every = plain_records(spark, sf_dir).unionByName(experiences(spark, sf_dir))
    return report.module_report(every, module_status(spark, sf_dir), names)


def store_report(spark, sf_dir):
    """Sources and suppliers as modules: entities, status, and whether they are in progress."""
    return _report(spark, sf_dir).select("name", "entities", "finished", "wip", F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"))


def store_totals(spark, sf_dir):
    return report.totals(_report(spark, sf_dir))


def removal_counts(spark, sf_dir):
    """Records that would go with suppliers 1 and 2 and with src1."""
    targets = spark.range(1, 3).select(F.col("id").cast("string").alias("s")).union(spark.sql("SELECT 'src1' AS s")).select(_md5(F.col("s")).alias("hash"))
    every = plain_records(spark, sf_dir).unionByName(experiences(spark, sf_dir))
    return report.removal_counts(every, targets).select(_hex(F.col("hash")).alias("hash"), "n")


def store_sizes(spark, sf_dir):
    """Labels as models."""
    return report.store_sizes(table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("model"), F.col("embedding").alias("q")))


def collection_hits(spark, sf_dir):
    """Suppliers as collections of lines; a line of quantity 50 matches."""
    return report.collection_hits(table(spark, sf_dir, "lineitem"), F.col("l_quantity") >= 50, "l_suppkey")


def resolved_names(spark, sf_dir):
    """Every third key is ranked; every fourth of those has another live name, and records without interpretation have no stored one."""
    df = plain_records(spark, sf_dir).withColumn("n", F.substring("name", 2, 20).cast("bigint"))
    stored = df.select("key", F.when(F.col("interpretation").isNotNull(), F.col("name")).alias("name"), "interpretation")
    live = df.where("n % 4 = 0").select("key", F.concat(F.lit("live"), F.col("n")).alias("name"))
    return topk.resolved(df.where("n % 3 = 0").select("key"), stored, live).select("name", "interpretation")


def without_shown_faces(spark, sf_dir):
    """Documents as theorem faces; every third fact is shown as a rule already, every fifth as the theorem itself."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(_md5(F.col("source")), F.lit(bytes([THEOREM])), F.substring(_md5(F.col("doc_id")), 1, 15)).alias("key"))
    df = df.withColumn("kind", F.lit(THEOREM))
    rules = df.where("doc_id % 3 = 0").select(keys.retag(F.col("key"), INTRODUCTION).alias("key"), F.lit(INTRODUCTION).alias("kind"))
    present = rules.unionByName(df.where("doc_id % 5 = 0").select("key", "kind"))
    return topk.without_shown_faces(df, present, THEOREM, RULE_KINDS).select("doc_id")


def padded_ranking(spark, sf_dir):
    """Reranked documents first, then others whose name is not among them, to 30 rows."""
    top = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string")).alias("name"), (F.col("n_chars") / 1000.0).alias("score"))
    ranked = top.where("key < 10").withColumn("score", F.col("key") / 10.0)
    return topk.pad_reranked(ranked, top, 30).select("key", "name", F.round("score", 6).alias("score"))


_R = """d AS (SELECT *, [1, 3, 4, 7][CAST(doc_id % 4 + 1 AS INTEGER)] AS kind FROM documents),
r AS (SELECT md5(source) || printf('%02x', kind) || substr(md5(CAST(doc_id AS VARCHAR)), 1, 30) AS key, kind, 'n' || doc_id AS name, CASE WHEN doc_id % 5 <> 0 THEN source END AS interpretation, source, doc_id FROM d)"""
_E = """s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, md5(CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem),
x AS (SELECT o, bit_xor(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS a, bit_xor(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS b, bool_or(s IN (3, 5, 7)) AS wanted FROM s GROUP BY o),
e AS (SELECT o, wanted, lpad(lower(to_hex(a)), 16, '0') || lpad(lower(to_hex(b)), 16, '0') || '08' || substr(md5(CAST(o AS VARCHAR)), 1, 30) AS key FROM x)"""
_WIP = "CAST('0x' || substr({0}, 1, 2) AS INTEGER) % 2 = 1"
_ST = """t AS (SELECT md5(source) AS key, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n, CAST(sum(n_chars) AS BIGINT) AS input_tokens FROM documents GROUP BY source),
st AS (SELECT key, input_tokens, n % 2 = 0 AS finished FROM t WHERE n % 3 <> 0)"""
_REPORT = f"""WITH {_ST}, m AS (SELECT md5(source) AS h, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT md5(CAST(l_suppkey AS VARCHAR)), count(DISTINCT l_orderkey) FROM lineitem GROUP BY 1),
q AS (SELECT coalesce(source, h) AS name, n AS entities, coalesce(finished, false) AS finished, {_WIP.format("h")} AS wip, coalesce(input_tokens, 0) AS input_tokens
  FROM m LEFT JOIN st ON st.key = h LEFT JOIN (SELECT DISTINCT source FROM documents) ON md5(source) = h)
"""

ORACLES = {
    "entity_get": f"WITH {_R} SELECT name, key FROM r WHERE doc_id = 7",
    "entity_scan": f"WITH {_R} SELECT name, key FROM r",
    "entities_of_kind": "SELECT DISTINCT 'o' || l_orderkey AS name FROM lineitem",
    "entities_with_prefix": f"WITH {_R} SELECT name, CAST(kind AS INTEGER) AS kind FROM r WHERE source = 'src1'",
    "embed_candidates": f"WITH {_R} SELECT name, CAST(kind AS INTEGER) AS kind FROM r WHERE interpretation IS NOT NULL AND kind IN (1, 3)",
    "batch_gets": "SELECT doc_id * 2 AS pos, doc_id AS key, source FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT (-doc_id - 1) * 2, -doc_id - 1, NULL FROM documents WHERE doc_id % 10 = 0",
    "interpreted_modules": f"""WITH {_ST} SELECT key, input_tokens, finished OR NOT ({_WIP.format("key")}) AS finished FROM st
UNION ALL SELECT key, 0, true FROM t WHERE n % 3 = 0 AND NOT ({_WIP.format("key")})""",
    "ledger_totals": """SELECT user_id AS key, CAST(sum(event_id % 2) AS BIGINT) AS input_tokens, CAST(sum(event_id % 3) AS BIGINT) AS cache_creation_tokens, CAST(sum(event_id % 4) AS BIGINT) AS cache_read_tokens,
CAST(sum(event_id % 5) AS BIGINT) AS output_tokens, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS cents, coalesce(bool_or(event_type = 'purchase') FILTER (WHERE event_id % 2 = 0), false) AS finished,
coalesce(arg_max(event_type, (ts, event_id)) FILTER (WHERE event_id % 2 = 1), 'old') AS model FROM events GROUP BY user_id""",
    "put_and_delete_experiences": "SELECT DISTINCT 'o' || l_orderkey AS name, 1::BIGINT AS size FROM lineitem WHERE l_orderkey % 3 <> 0",
    "purged_kind": "SELECT 'n' || doc_id AS name FROM documents",
    "copied_prefix": f"WITH {_R} SELECT name, substr(key, 1, 62) AS key FROM r UNION ALL SELECT name, md5('new') || substr(key, 33, 30) FROM r WHERE source = 'src1'",
    "experience_index": f"WITH {_E} SELECT key FROM e WHERE wanted",
    "xor_consistency": """WITH o AS (SELECT DISTINCT l_orderkey AS o FROM lineitem) SELECT (SELECT count(*) FROM documents) + count(*) AS n_records, count(*) AS n_experiences,
count(*) FILTER (WHERE o % 11 = 0) AS legacy, count(*) FILTER (WHERE o % 7 = 0 AND o % 11 <> 0) AS mismatches FROM o""",
    "repair_of_prefixes": f"WITH {_E} SELECT key AS new_key, 'move' AS action FROM e WHERE o % 7 = 0",
    "store_report": _REPORT + "SELECT * FROM q",
    "store_totals": _REPORT + "SELECT count(*) AS modules, count(*) FILTER (WHERE finished) AS done, count(*) FILTER (WHERE wip) AS wip, CAST(sum(entities) AS BIGINT) AS entities FROM q",
    "removal_counts": """SELECT md5(CAST(l_suppkey AS VARCHAR)) AS hash, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1
UNION ALL SELECT md5(source), count(*) FROM documents WHERE source = 'src1' GROUP BY 1""",
    "store_sizes": "SELECT CAST(label AS VARCHAR) AS model, count(*) AS entries, CAST(sum(len(embedding) * 2) AS BIGINT) AS bytes FROM embeddings GROUP BY 1",
    "collection_hits": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity >= 50 GROUP BY 1",
    "resolved_names": f"WITH {_R} SELECT CASE WHEN doc_id % 4 = 0 THEN 'live' || doc_id ELSE name END AS name, interpretation FROM r WHERE doc_id % 3 = 0 AND (doc_id % 4 = 0 OR interpretation IS NOT NULL)",
    "without_shown_faces": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0",
    "padded_ranking": """WITH t AS (SELECT doc_id AS key, 'n' || (doc_id % 50) AS name, n_chars / 1000.0::DOUBLE AS score, 1 AS stage FROM documents),
a AS (SELECT key, name, key / 10.0::DOUBLE AS score, 0 AS stage FROM t WHERE key < 10)
SELECT key, name, round(score, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM t WHERE name NOT IN (SELECT name FROM a)) ORDER BY stage, score DESC, key LIMIT 30""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
