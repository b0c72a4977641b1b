"""Catalogue: mutations, repair, snapshots, graphs and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from semlake.functions import keys
from semlake.operators import filters, graph, rank, records, snapshot
from semlake.plans.vectors import table


def _hash(c):
    """A 16-byte hash as a stand-in: md5 of the number."""
    return F.unhex(F.md5(c.cast("string")))


def purge_wip(spark, sf_dir):
    """Keys are md5 of doc_id; those with an odd first byte are in progress."""
    df = table(spark, sf_dir, "documents").select("doc_id", _hash(F.col("doc_id")).alias("key"))
    return records.clean_wip(df).select("doc_id")


def remove_modules(spark, sf_dir):
    """Experiences (orders) and plain records (parts): all that belong to the modules of suppliers 1 and 2 go."""
    suppliers = F.array_sort(F.collect_set("l_suppkey"))
    exp = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(suppliers, lambda s: F.struct(s.cast("string").alias("name"), _hash(s).alias("hash"))).alias("constituents"))
    exp = exp.select(F.concat(keys.xor_prefix(F.transform("constituents", lambda c: c["hash"])), F.lit(bytes([8])), F.substring(_hash(F.col("l_orderkey")), 1, 15)).alias("key"), F.lit(8).alias("kind"), "constituents", F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("name"))
    part = table(spark, sf_dir, "part").select(F.concat(_hash(F.col("p_partkey") % 10), F.lit(bytes([1])), _hash(F.col("p_partkey"))).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("array<struct<name:string,hash:binary>>").alias("constituents"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    gone = [bytes(r[0]) for r in spark.range(1, 3).select(_hash(F.col("id"))).collect()]
    left, _ = records.remove_modules(exp.unionByName(part), exp.select("key"), gone)
    return left.select("name", F.col("kind").cast("int").alias("kind"))


def rekey_constituents(spark, sf_dir):
    """Orders that mention supplier 1: its hash becomes that of supplier 1000, keys follow."""
    exp = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda s: F.struct(s.cast("string").alias("name"), _hash(s).alias("hash"))).alias("constituents"))
    exp = exp.withColumn("key", F.concat(keys.xor_prefix(F.transform("constituents", lambda c: c["hash"])), F.lit(bytes([8])), F.substring(_hash(F.col("l_orderkey")), 1, 15)))
    old, new = (bytes(spark.range(1).select(_hash(F.lit(n))).first()[0]) for n in (1, 1000))
    out = records.rekey_constituent(exp, old, new)
    return out.select("l_orderkey", F.size("constituents").cast("bigint").alias("n"), F.array_contains(F.transform("constituents", lambda c: c["hash"]), F.lit(new)).alias("swapped"), (F.substring("key", 17, 16) == F.substring("old_key", 17, 16)).alias("same_rest"), (keys.prefix(F.col("key")) == keys.prefix(F.col("old_key"))).alias("same_prefix"))


def snapshot_merge(spark, sf_dir):
    """Local: orders with key % 3 <> 0; remote: key % 5 <> 0 with other prices for key % 4 = 0; status F is finished, remote ones less so."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 100).cast("bigint").alias("cents"), (F.col("o_orderstatus") == "F").alias("finished"))
    local = df.where("o_orderkey % 3 <> 0")
    remote = df.where("o_orderkey % 5 <> 0").withColumns({"cents": F.when(F.col("o_orderkey") % 4 == 0, F.col("cents") + 1).otherwise(F.col("cents")), "finished": F.col("finished") & (F.col("o_orderkey") % 2 == 0)})
    return snapshot.merge(local, remote, ["o_orderkey"], "finished")


def merge_statistics(spark, sf_dir):
    return snapshot.statistics(snapshot_merge(spark, sf_dir))


def migrate_latest_finished(spark, sf_dir):
    """Users as names, events as versions: the newest purchase of each, but for the newest event itself."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return rank.newest(ev, "user_id", "event_id", "ts", F.col("event_type") == "purchase").select("user_id", "event_id")


def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 10).alias("key"), F.col("r_name").alias("name"))
    return records.upsert(old, new)


def update_names(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 10).alias("key"), F.col("r_name").alias("name"))
    return records.update_field(old, new, "name")


def mark_embedded(spark, sf_dir):
    """Tokens of documents by source and language, added where positive."""
    old = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("model"), F.col("source").alias("key")).agg(F.lit(False).alias("finished"), F.count("*").alias("total_tokens"))
    done = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("lang").alias("model"), F.col("source").alias("key"), (F.col("n_chars") - 500).alias("tokens"))
    return records.mark_embedded(old, done).select("model", "key", "finished", F.col("total_tokens").cast("bigint").alias("total_tokens"))


def _edges(spark, sf_dir):
    """Nations hang below the nation with a third of their number: a tree with chains."""
    n = table(spark, sf_dir, "nation").where("n_nationkey > 0")
    return n.select(F.floor(F.col("n_nationkey") / 3).cast("bigint").alias("parent"), F.col("n_nationkey").cast("bigint").alias("child"))


def plan_cone(spark, sf_dir):
    """Ancestors of 24 and 17, walked through the excluded node 2, without the finished node 0."""
    roots = spark.createDataFrame([(24,), (17,)], "node bigint")
    out = graph.cone(_edges(spark, sf_dir), roots, spark.createDataFrame([(2,)], "node bigint"))
    return graph.plan(out, spark.createDataFrame([(0,)], "node bigint")).select("node", F.col("depth").cast("bigint").alias("depth"))


def contracted_edges(spark, sf_dir):
    keep = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return graph.contract(_edges(spark, sf_dir), keep)


def schedule_levels(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return graph.levels(_edges(spark, sf_dir), nodes).select("node", F.col("level").cast("bigint").alias("level"))


def bounded_expansion(spark, sf_dir):
    """Breadth first from 24 to at most three nodes; all edges have the same rank."""
    e = _edges(spark, sf_dir).withColumn("rank", F.lit(1))
    return graph.expand(e, spark.createDataFrame([(24,)], "node bigint"), 3).select("node", F.col("depth").cast("bigint").alias("depth"))


def infra_cascade(spark, sf_dir):
    """Orders that mention an internal supplier (key % 10 = 0)."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("consts"))
    infra = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("name"))
    return filters.mentions_any(facts, "consts", infra, "l_orderkey")


def infra_collections(spark, sf_dir):
    """Parts as collections of facts, named after six theories and five endings; every 11th is concealed, every 13th out of reach."""
    key = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (key % n + 1).cast("int"))
    df = table(spark, sf_dir, "part").withColumn("name", F.concat_ws(".", pick(("HOL", "List", "Transfer", "Lifting", "SMT", "Quotient"), 6), pick(("no_atp", "cong_refl", "coinduct_upto", "id_simps", "simps"), 5)))
    return df.where(filters.is_infra_collection(F.col("name"), key % 11 == 0, F.lit(False), key % 13 == 0)).select("p_partkey", "name")


def infra_methods(spark, sf_dir):
    """Parts as methods of their brand; brands that begin with Brand#1 are the base, every 10th part has no brand, every 7th is hidden."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    flags = [(key % 7 == 0).alias("hidden"), F.lit(False).alias("concealed"), F.lit(None).cast("boolean").alias("inaccessible")]
    methods = part.select(key.alias("name"), F.when(key % 10 != 0, F.col("p_brand")).alias("module"), *flags)
    return filters.infra_methods(methods, part.where("p_brand LIKE 'Brand#1%'").select(F.col("p_brand").alias("module")))


def auto_embed_fill(spark, sf_dir):
    """Vectors of documents without one, by the offline hashing provider; even documents have theirs already."""
    from semlake import providers
    from semlake.schemas import ModelConfig

    docs = table(spark, sf_dir, "documents").select(_hash(F.col("doc_id")).alias("key"), "text", "doc_id")
    held = docs.where("doc_id % 2 = 0").select(F.lit("hash-64").alias("model"), "key", F.array().cast("array<smallint>").alias("q"))
    out = providers.fill_vectors(docs.select("key", "text"), held, providers.HashingProvider(ModelConfig("hash-64", 64)))
    return out.select(F.lower(F.hex("key")).alias("key"), F.size("q").alias("n"), F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


_TREE = "e AS (SELECT n_nationkey // 3 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0)"
_MERGE = """WITH d AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus = 'F' AS finished FROM orders),
l AS (SELECT * FROM d WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN cents + 1 ELSE cents END AS cents, finished AND o_orderkey % 2 = 0 AS finished FROM d WHERE o_orderkey % 5 <> 0),
m AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.cents AS lc, r.cents AS rc, l.finished AS lf, r.finished AS rf,
  CASE WHEN r.o_orderkey IS NULL THEN 'local_only' WHEN l.o_orderkey IS NULL THEN 'added' WHEN l.finished AND NOT r.finished THEN 'kept_local' WHEN l.cents <> r.cents OR l.finished <> r.finished THEN 'overwritten' ELSE 'same' END AS action
  FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey)
"""
ORACLES = {
    "purge_wip": "SELECT doc_id FROM documents WHERE ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INTEGER % 2 = 0",
    "remove_modules": """SELECT 'o' || l_orderkey AS name, 8 AS kind FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_suppkey IN (1, 2))
UNION ALL SELECT 'p' || p_partkey, 1 FROM part WHERE p_partkey % 10 NOT IN (1, 2)""",
    "rekey_constituents": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, true AS swapped, true AS same_rest, false AS same_prefix FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_suppkey = 1)",
    "snapshot_merge": _MERGE + "SELECT o_orderkey, CASE WHEN action IN ('added', 'overwritten') THEN rc ELSE lc END AS cents, CASE WHEN action IN ('added', 'overwritten') THEN rf ELSE lf END AS finished, action FROM m",
    "merge_statistics": _MERGE + "SELECT count(*) FILTER (WHERE action = 'added') AS added, count(*) FILTER (WHERE action = 'overwritten') AS overwritten, count(*) FILTER (WHERE action = 'kept_local') AS kept_local FROM m",
    "migrate_latest_finished": "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "upsert_rows": "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 10 FROM region) UNION ALL SELECT r_regionkey * 10, r_name FROM region",
    "update_names": "SELECT n_nationkey AS key, coalesce(r_name, n_name) AS name FROM nation LEFT JOIN region ON r_regionkey * 10 = n_nationkey",
    "mark_embedded": """SELECT model, key, bool_or(f) AS finished, CAST(sum(t) AS BIGINT) AS total_tokens FROM (SELECT lang AS model, source AS key, false AS f, count(*) AS t FROM documents GROUP BY 1, 2
UNION ALL SELECT lang, source, true, greatest(n_chars - 500, 0) FROM documents WHERE doc_id % 2 = 0) GROUP BY model, key""",
    "plan_cone": f"WITH RECURSIVE {_TREE}, c AS (SELECT * FROM (VALUES (24, 0), (17, 0)) r(node, depth) UNION SELECT parent, depth + 1 FROM c JOIN e ON child = node) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM c WHERE node NOT IN (2, 0) GROUP BY node",
    "contracted_edges": f"WITH RECURSIVE {_TREE}, w AS (SELECT parent, child FROM e WHERE child % 2 = 0 UNION SELECT e.parent, w.child FROM w JOIN e ON e.child = w.parent WHERE w.parent % 2 <> 0) SELECT parent, child FROM w WHERE parent % 2 = 0",
    "schedule_levels": f"WITH RECURSIVE {_TREE}, l AS (SELECT 0 AS node, 0 AS level UNION ALL SELECT child, level + 1 FROM l JOIN e ON parent = node) SELECT node, CAST(level AS BIGINT) AS level FROM l",
    "bounded_expansion": f"WITH RECURSIVE {_TREE}, c AS (SELECT 24 AS node, 0 AS depth UNION ALL SELECT parent, depth + 1 FROM c JOIN e ON child = node) SELECT node, CAST(depth AS BIGINT) AS depth FROM c ORDER BY depth LIMIT 3",
    "infra_cascade": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)",
    "infra_collections": """WITH n AS (SELECT p_partkey, ['HOL', 'List', 'Transfer', 'Lifting', 'SMT', 'Quotient'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS theory,
  ['no_atp', 'cong_refl', 'coinduct_upto', 'id_simps', 'simps'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS base FROM part)
SELECT p_partkey, theory || '.' || base AS name FROM n WHERE theory IN ('Transfer', 'Lifting', 'SMT') OR base IN ('cong_refl', 'coinduct_upto')
  OR (theory, base) IN (('HOL', 'no_atp'), ('Quotient', 'id_simps')) OR p_partkey % 11 = 0 OR p_partkey % 13 = 0""",
    "infra_methods": """SELECT p_partkey AS name FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 7 = 0
  OR p_brand LIKE 'Brand#1%'""",
}

QUERIES = {name: globals()[name] for name in (*ORACLES, "auto_embed_fill")}
