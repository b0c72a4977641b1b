"""Catalogue: digests over dependencies, terms and patterns, stored values, and tables of base and deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import codec, terms
from semlake.operators import description, digests, enumeration, graph, patterns
from semlake.operators.common import checkpoint_path
from semlake.plans.vectors import table
from semlake.sources.store import Store


def _named(letter, c):
    return F.concat(F.lit(letter), c.cast("string"))


def _dependencies(spark, sf_dir):
    """Orders depend on the parts of their lines, a part on that with a tenth of its number, and some neighbours on each other."""
    p = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    near = F.when(p % 50 == 10, p + 1).when(p % 50 == 11, p - 1)
    edges = [
        part.where("p_partkey >= 10").select(_named("p", p).alias("node"), _named("p", F.floor(p / 10)).alias("dep")),
        part.where(near.isNotNull()).select(_named("p", p).alias("node"), _named("p", near).alias("dep")),
        table(spark, sf_dir, "lineitem").select(_named("o", F.col("l_orderkey")).alias("node"), _named("p", F.col("l_partkey")).alias("dep")),
    ]
    orders = table(spark, sf_dir, "orders").select(_named("o", F.col("o_orderkey")).alias("node"), F.col("o_orderpriority").alias("own"))
    return part.select(_named("p", p).alias("node"), F.col("p_name").alias("own"), "p_partkey"), orders, reduce(DataFrame.union, edges)


def stale_entities(spark, sf_dir):
    """Every 200th part gets another definition: what is recomputed, and what is stale by its digest."""
    part, orders, edges = _dependencies(spark, sf_dir)
    before = digests.digests(part.drop("p_partkey").union(orders), edges)
    after = part.withColumn("own", F.when(F.col("p_partkey") % 200 == 7, F.concat("own", F.lit(" changed"))).otherwise(F.col("own")))
    out = digests.refresh(after.drop("p_partkey").union(orders), edges, before)
    return out.where("stale or recomputed").select("node", "stale", "recomputed")


def _line_terms(spark, sf_dir):
    """``a + b = k * a`` for each line, its variables named after supplier and part; the binder's name does not count."""
    line = table(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    a, b = F.concat(F.lit("%x"), F.col("l_suppkey") % 40), F.concat(F.lit("%x"), F.col("l_partkey") % 40)
    k = F.concat(F.lit("k"), (F.col("l_quantity") % 5).cast("int"))
    term = F.concat(F.lit("all/1 \\v"), F.col("l_orderkey"), F.lit("/1 eq/2 plus/2 "), a, F.lit("/0 "), b, F.lit("/0 times/2 "), k, F.lit("/0 "), a, F.lit("/0"))
    return line.select("line", term.alias("term"))


def alpha_equal_terms(spark, sf_dir):
    """How many lines share each digest."""
    return _line_terms(spark, sf_dir).groupBy(terms.alpha_digest(F.col("term")).alias("digest")).agg(F.count("*").alias("n"))


def pattern_matches(spark, sf_dir):
    """Sub-terms of the lines: twice the same, a product with k3, an equation whose sides share their first part, and one that is nowhere."""
    rows = [(1, "plus/2 ?p/0 ?p/0"), (2, "times/2 k3/0 ?q/0"), (3, "eq/2 plus/2 ?a/0 ?b/0 times/2 ?k/0 ?a/0"), (4, "minus/2 ?p/0 ?q/0")]
    wanted = spark.createDataFrame(rows, "pattern bigint, text string")
    found = patterns.matches(_line_terms(spark, sf_dir), wanted, "line", "term")
    first = F.element_at(F.map_values("bindings"), 1)
    return found.select("pattern", "line", F.col("at").cast("bigint").alias("at"), first.alias("first"))


def rule_shapes(spark, sf_dir):
    """``(a ==> P i x) ==> P j y`` for each order: a rule if i and j are the same; every fourth has no premise."""
    i, j = (F.concat(F.lit("judgment/1 ?P"), c % 3, F.lit("/1 %x/0")) for c in (F.col("o_orderkey"), F.col("o_custkey")))
    prop = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("all/1 "), j)).otherwise(F.concat(F.lit("all/1 imp/2 imp/2 %a/0 "), i, F.lit(" "), j))
    return table(spark, sf_dir, "orders").groupBy(terms.rule_shape(prop).alias("is_rule")).agg(F.count("*").alias("n"))


def _stored_records(spark, sf_dir):
    """Documents as stored values: every 13th in an older, shorter form, every 17th cut short, every 19th with a byte too many."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(8)), (n % 3 + 1).cast("int"))
    legacy = (kind == 8) & (n % 11 == 0)
    none = F.lit(None)
    record = F.struct(
        kind.alias("kind"), F.concat(F.lit("n"), n).alias("name"),
        F.when(legacy, F.lit('["p","q"]')).when(kind != 8, F.concat(F.lit("e"), n)).alias("expr"), F.col("text").alias("interpretation"),
        F.when(n % 5 == 0, F.struct(none.cast("binary").alias("template_uk"), F.unhex(F.md5("source")).alias("locale_uk"), F.col("lang").alias("qualifier"))).alias("provenance"),
        F.array(F.struct(F.col("source").alias("name"), F.unhex(F.md5("source")).alias("hash"))).alias("constituents"), none.cast("string").alias("experience"),
        F.when((kind == 8) & ~legacy, F.array(F.lit("p"))).alias("goal_patterns"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", record.alias("record"), F.when(n % 13 == 0, 4).otherwise(8).alias("fields"))
    value = F.when(n % 17 == 0, F.expr("substring(value, 1, length(value) - 3)")).when(n % 19 == 0, F.concat("value", F.unhex(F.lit("C0")))).otherwise(F.col("value"))
    return codec.encode(docs, "record", "fields").select("doc_id", value.alias("value"))


def decoded_records(spark, sf_dir):
    r = codec.decode(_stored_records(spark, sf_dir)).select("doc_id", "record.*", "reason")
    parts = F.lower(F.hex(F.element_at("constituents.hash", 1)))
    return r.select("doc_id", F.col("kind").cast("int").alias("kind"), "name", "expr", F.md5("interpretation").alias("meaning"), F.col("provenance.qualifier").alias("qualifier"), parts.alias("part"), F.array_join("goal_patterns", ",").alias("patterns"), "reason")


def unreadable_values(spark, sf_dir):
    return codec.unreadable(codec.decode(_stored_records(spark, sf_dir)))


def stored_orders(spark, sf_dir):
    """Orders in a store: a base, a delta that replaces every 7th, one that deletes every 10th and adds new ones; read as base plus deltas."""
    store = Store(spark, checkpoint_path(spark))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    store.replace("orders", o)
    store.change().upsert("orders", o.where("key % 7 = 0").withColumn("cents", F.col("cents") + 1)).commit()
    store.change().delete("orders", o.where("key % 10 = 0")).upsert("orders", o.where("key % 100 = 1").select((-F.col("key")).alias("key"), "cents")).commit()
    return store.read("orders")


def stored_ledger(spark, sf_dir):
    """Events in a store's ledger, in three deltas of which one comes twice, folded after the second."""
    store = Store(spark, checkpoint_path(spark))
    zero = {c: F.lit(0).cast("bigint") for c in ("cache_creation_tokens", "cache_read_tokens", "output_tokens")}
    ev = table(spark, sf_dir, "events").withColumns({"key": F.col("user_id"), "input_tokens": F.col("event_id") % 100, "cost_usd": F.lit(0.25), "finished": F.col("event_type") == "purchase", "model": F.col("event_type")} | zero)
    ev = ev.withColumn("ts", F.expr("ts + make_dt_interval(0, 0, 0, event_id / 1e6)"))
    names = ["key", "input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "cost_usd", "finished", "model", "ts"]
    for i in (0, 1, 1, 2):
        change = store.change().add("ledger", ev.where(F.col("event_id") % 3 == i).select(*names), "events", i)
        change.commit()
        if i == 1:
            store.compact("ledger")
    return store.read("ledger").select("key", "input_tokens", (F.col("cost_usd") * 4).cast("bigint").alias("events"), "finished", "model")


def members_of_modules(spark, sf_dir):
    """Parts as members of 12 modules (by supplier), each built on those with half and a third of its number: the members that are new in theirs."""
    members = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("module"), F.col("l_partkey").alias("key")).distinct()
    m = spark.range(1, 12).select(F.col("id").alias("module"), F.explode(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("parent"))
    return enumeration.new_members(members, m)


def described_entries(spark, sf_dir):
    """Documents are described in rounds, a quarter of them in each; answers are also blank, repeated or under labels that nobody has."""

    def answerer(left, round_):
        some = left.where((F.col("doc_id") + round_) % 4 == 0)
        right = F.concat(F.col("label"), F.lit(":"), F.col("n_chars"))
        wrong = [(some, F.lit("first try"), 0), (some, F.lit("  "), 9), (left.withColumn("label", F.concat(F.lit("x"), "label")), right, 1)]
        rows = [df.select("label", a.alias("answer"), F.lit(seq).alias("seq")) for df, a, seq in [*wrong, (some, right, 5)]]
        return reduce(DataFrame.union, rows)

    docs = table(spark, sf_dir, "documents")
    entries = docs.select(F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("key"), _named("n", F.col("doc_id")).alias("label"), "doc_id", "n_chars")
    out = description.describe(Store(spark, checkpoint_path(spark)), entries, answerer)
    return out.select(F.lower(F.hex("key")).alias("key"), "answer")


def _part_graph(spark, sf_dir):
    """Parts below those with half and a third of their number; every fifth also below part 1, which most cones reach."""
    p = F.col("p_partkey")
    up = F.array(F.floor(p / 2), F.floor(p / 3), F.when(p % 5 == 0, F.lit(1).cast("bigint")))
    e = table(spark, sf_dir, "part").select(F.explode(F.array_distinct(up)).alias("parent"), p.alias("child"))
    return e.where("parent >= 1 and parent <> child")


def _parts(spark, sf_dir, where):
    return table(spark, sf_dir, "part").where(where).select(F.col("p_partkey").alias("node"))


def part_cone(spark, sf_dir):
    """Ancestors of every 40th part, walked through every 7th, which are left out."""
    out = graph.cone(_part_graph(spark, sf_dir), _parts(spark, sf_dir, "p_partkey % 40 = 0"), _parts(spark, sf_dir, "p_partkey % 7 = 0"))
    return out.select("node", F.col("depth").cast("bigint").alias("depth"))


def part_contraction(spark, sf_dir):
    """Edges between parts whose number is divisible by 3, through the others."""
    return graph.contract(_part_graph(spark, sf_dir), _parts(spark, sf_dir, "p_partkey % 3 = 0"))


def part_levels(spark, sf_dir):
    return graph.levels(_part_graph(spark, sf_dir), _parts(spark, sf_dir, "true")).select("node", F.col("level").cast("bigint").alias("level"))


def part_expansion(spark, sf_dir):
    """Breadth first from every 50th part to the bound of 300."""
    e = _part_graph(spark, sf_dir).withColumn("rank", F.lit(1))
    return graph.expand(e, _parts(spark, sf_dir, "p_partkey % 50 = 0")).select("node", F.col("depth").cast("bigint").alias("depth"))


_KIND = "[1, 2, 8][CAST(doc_id % 3 + 1 AS INTEGER)]"
_STORED = f"""WITH d AS (SELECT *, {_KIND} AS kind, {_KIND} = 8 AND doc_id % 11 = 0 AS legacy, doc_id % 13 = 0 AS old,
  CASE WHEN doc_id % 17 = 0 THEN 'cut short' WHEN doc_id % 19 = 0 THEN 'bytes after the tuple' END AS reason FROM documents)
"""
_PARTS = """WITH RECURSIVE e AS (SELECT DISTINCT a AS parent, p_partkey AS child FROM (SELECT p_partkey, unnest([p_partkey // 2, p_partkey // 3, CASE WHEN p_partkey % 5 = 0 THEN 1 END]) AS a FROM part) WHERE a >= 1 AND a <> p_partkey)"""
_UP = "c AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % {0} = 0 UNION SELECT parent, depth + 1 FROM c JOIN e ON child = node)"
_LINE = "FROM (SELECT l_orderkey || '-' || l_linenumber AS line, '%x' || (l_suppkey % 40) AS a, '%x' || (l_partkey % 40) AS b, 'k' || CAST(l_quantity % 5 AS INTEGER) AS k FROM lineitem)"

ORACLES = {
    "stale_entities": """WITH RECURSIVE e AS (SELECT 'p' || p_partkey AS node, 'p' || (p_partkey // 10) AS dep FROM part WHERE p_partkey >= 10
UNION ALL SELECT 'p' || p_partkey, 'p' || CASE WHEN p_partkey % 50 = 10 THEN p_partkey + 1 ELSE p_partkey - 1 END FROM part WHERE p_partkey % 50 IN (10, 11)
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
r AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 200 = 7 UNION SELECT e.node FROM r JOIN e ON e.dep = r.node)
SELECT node, true AS stale, true AS recomputed FROM r""",
    "alpha_equal_terms": rf"""SELECT md5('all/1 \/1 eq/2 plus/2 %0/0 %' || CASE WHEN a = b THEN '0' ELSE '1' END || '/0 times/2 ' || k || '/0 %0/0') AS digest, count(*) AS n {_LINE} GROUP BY 1""",
    "pattern_matches": f"""SELECT 1 AS pattern, line, 3 AS at, a || '/0' AS first {_LINE} WHERE a = b UNION ALL SELECT 2, line, 6, a || '/0' {_LINE} WHERE k = 'k3'
UNION ALL SELECT 3, line, 2, a || '/0' {_LINE}""",
    "rule_shapes": "SELECT o_orderkey % 4 <> 0 AND o_orderkey % 3 = o_custkey % 3 AS is_rule, count(*) AS n FROM orders GROUP BY 1",
    "decoded_records": _STORED + """SELECT doc_id, kind, 'n' || doc_id AS name, CASE WHEN kind <> 8 THEN 'e' || doc_id END AS expr, md5(text) AS meaning,
CASE WHEN doc_id % 5 = 0 AND NOT old THEN lang END AS qualifier, CASE WHEN NOT old THEN md5(source) END AS part, CASE WHEN legacy THEN 'p,q' WHEN kind = 8 AND NOT old THEN 'p' END AS patterns, reason FROM d WHERE reason IS NULL
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM d WHERE reason IS NOT NULL""",
    "unreadable_values": _STORED + "SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY 1",
    "stored_orders": """SELECT o_orderkey AS key, CAST(trunc(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS cents FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT -o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) FROM orders WHERE o_orderkey % 100 = 1""",
    "members_of_modules": """WITH RECURSIVE up AS (SELECT m, m // 2 AS a FROM range(1, 12) t(m) UNION SELECT m, m // 3 FROM range(1, 12) t(m)),
anc AS (SELECT m, a FROM up UNION SELECT anc.m, up.a FROM anc JOIN up ON up.m = anc.a),
mem AS (SELECT DISTINCT l_suppkey % 12 AS module, l_partkey AS key FROM lineitem),
old AS (SELECT DISTINCT anc.m AS module, o.key FROM anc JOIN mem o ON o.module = anc.a)
SELECT module, key FROM mem EXCEPT SELECT module, key FROM old""",
    "described_entries": "SELECT md5(CAST(doc_id AS VARCHAR)) AS key, 'n' || doc_id || ':' || n_chars AS answer FROM documents",
    "part_cone": f"{_PARTS}, {_UP.format(40)} SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM c WHERE node % 7 <> 0 GROUP BY node",
    "part_contraction": f"""{_PARTS}, w AS (SELECT parent, child FROM e WHERE child % 3 = 0 UNION SELECT e.parent, w.child FROM w JOIN e ON e.child = w.parent WHERE w.parent % 3 <> 0)
SELECT parent, child FROM w WHERE parent % 3 = 0""",
    "part_levels": f"""{_PARTS}, l AS (SELECT p_partkey AS node, 0 AS level FROM part UNION SELECT child, level + 1 FROM l JOIN e ON parent = node)
SELECT node, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY node""",
    "part_expansion": f"{_PARTS}, {_UP.format(50)} SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY node ORDER BY depth, node LIMIT 300",
    "stored_ledger": """SELECT user_id AS key, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, count(*) AS events, bool_or(event_type = 'purchase') AS finished, arg_max(event_type, (ts, event_id)) AS model
FROM events GROUP BY user_id""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
