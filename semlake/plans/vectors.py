"""Catalogue: retrieval over quantized vectors (table embeddings; label stands for the kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.functions import q15
from semlake.operators import rank, report, topk
from semlake.sources.store import stored_once

K, DIMENSION = 10, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The table's vectors in 16 bits, written once and then searched."""
    raw = table(spark, sf_dir, "embeddings")
    held = stored_once(raw, lambda df: df.select("vec_id", "label", q15.quantize(F.col("embedding")).cast("array<smallint>").alias("q")), "q15-2", ["vec_id"])
    return held.select("vec_id", *more, "q")


def query_vector(held: DataFrame, vec_id: int = 0) -> list[int]:
    rows = held.where(F.col("vec_id") == vec_id).select("q").limit(1).collect()
    return list(rows[0]["q"]) if rows else [0] * DIMENSION


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "raw", F.round("score", 6).alias("score"))


def knn_topk(spark, sf_dir):
    held = store(spark, sf_dir)
    return _rounded(topk.top_k(held, query_vector(held), K, "vec_id"), "vec_id")


def knn_topk_by_kind(spark, sf_dir):
    held = store(spark, sf_dir, "label")
    df = topk.of_kinds(held, [1, 2, 3], "label")
    return _rounded(topk.top_k(df, query_vector(held), K, "vec_id"), "vec_id", "label")


def knn_topk_per_kind(spark, sf_dir):
    held = store(spark, sf_dir, "label")
    df = topk.scored(held, query_vector(held))
    out = topk.top_k_per(df, "label", 3, "vec_id")
    return out.select("label", "vec_id", "raw", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def knn_restricted(spark, sf_dir):
    """A restricted domain with repeated keys (labels), each scanned once."""
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    wanted = wanted.union(wanted)
    held = store(spark, sf_dir)
    got = topk.gather(wanted, held, "vec_id", "q", DIMENSION).where("state = 'keep'")
    return _rounded(topk.top_k(got, query_vector(held), K, "vec_id"), "vec_id")


def gather_split(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    got = topk.gather(wanted, store(spark, sf_dir), "vec_id", "q", DIMENSION)
    return got.groupBy("state").agg(F.count("*").alias("n"))


def knn_default_tier(spark, sf_dir):
    """Candidates are the labelled documents; those without a vector get the score of their locality."""
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") == 1).alias("is_local"), F.col("doc_id").alias("ord")).dropDuplicates(["vec_id"])
    held = store(spark, sf_dir)
    got = topk.gather(wanted, held, "vec_id", "q", DIMENSION)
    top = topk.top_k(got.where("state = 'keep'"), query_vector(held), K, "vec_id").select("vec_id", "is_local", "ord", "score")
    rest = topk.default_tier(got.select("vec_id", "is_local", "ord"), top, K, "vec_id", 0.3, 0.5)
    out = topk.final_cut(top, rest, K, "vec_id")
    return out.select("vec_id", F.round("score", 6).alias("score"), F.col("tier").cast("int").alias("tier"))


def knn_boosted(spark, sf_dir):
    """Hits are known for even keys, as a share that depends on the label."""
    held = store(spark, sf_dir, "label")
    df = topk.scored(held, query_vector(held))
    hits = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select("vec_id", (F.col("label") / 10).alias("hit"))
    out = df.join(hits, "vec_id", "left").withColumn("boosted", topk.boosted(F.col("score"), F.col("hit"), 2))
    return out.orderBy(F.desc(F.round("boosted", 6)), "vec_id").limit(K).select("vec_id", "raw", F.round("boosted", 6).alias("score"))


def knn_batch(spark, sf_dir):
    """Every vector whose key is divisible by 20 asks for its three nearest."""
    df = store(spark, sf_dir)
    queries = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("q").alias("qv"))
    out = topk.top_k_batch(df, queries, 3, "vec_id", "query_id")
    return out.select("query_id", "vec_id", "raw", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def q15_encode(spark, sf_dir):
    """From the raw table, so that the encoding itself is what is measured."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", q15.quantize(F.col("embedding")).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.select("vec_id", F.element_at("q", 1).cast("int").alias("first"), total.alias("total"), F.array_min("q").cast("int").alias("least"), F.array_max("q").cast("int").alias("most"))


def dequant_norm(spark, sf_dir):
    back = q15.dequantize(F.col("q"), DIMENSION)
    return store(spark, sf_dir).select("vec_id", F.round(q15.norm(back), 3).alias("norm"))


def plain_topk(spark, sf_dir):
    """The contiguous form: raw / 32768, as the fusion uses it."""
    held = store(spark, sf_dir)
    out = topk.top_k(held, query_vector(held), K, "vec_id")
    return out.select("vec_id", F.round(q15.plain_score(F.col("raw")), 6).alias("score"))


def unit_rows(spark, sf_dir):
    """Row normalisation; the norm of each row afterwards."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", q15.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(q15.norm(F.col("v")), 6).alias("norm"))


def length_histogram(spark, sf_dir):
    return report.length_histogram(table(spark, sf_dir, "embeddings"), F.size("embedding")).select(F.col("length").cast("bigint").alias("length"), "n")


def rank_fusion(spark, sf_dir):
    """A rank-weighted list (parts by retail size) and a similarity list, half and half."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"))
    from pyspark.sql import Window as W

    # The first list: 50 keys by their last digits, weighted by rank.
    first = parts.orderBy(F.col("vec_id") % 97, "vec_id").limit(50)
    first = first.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("vec_id") % 97, "vec_id")) - 1)
    first = first.select("vec_id", rank.rank_weight(F.col("rank")).alias("score"))
    held = store(spark, sf_dir)
    second = topk.top_k(held, query_vector(held), 50, "vec_id").select("vec_id", q15.plain_score(F.col("raw")).alias("score"))
    forced = spark.createDataFrame([(7,), (8,)], "vec_id bigint")
    out = rank.mesh([(0.5, first), (0.5, second)], "vec_id", 20, forced)
    return out.select("vec_id", F.round("score", 6).alias("score"), F.col("forced").cast("int").alias("forced"))


_Q = """
n AS (SELECT vec_id, label, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-12 AS n FROM embeddings),
v AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(round_even(0.95::DOUBLE * (x::DOUBLE / n) * 32768::DOUBLE, 0) AS INTEGER)) AS q FROM n),
qv AS (SELECT q AS qq FROM v WHERE vec_id = 0),
s AS (SELECT vec_id, label, CAST(list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] * qq[i] + 16384) >> 15)) AS BIGINT) AS raw FROM v, qv),
c AS (SELECT *, greatest(-1.0, least(1.0, raw / (32768 * 0.95::DOUBLE * 0.95::DOUBLE))) AS score FROM s)"""

ORACLES = {
    "knn_topk": f"WITH {_Q} SELECT vec_id, raw, round(score, 6) AS score FROM c ORDER BY raw DESC, vec_id LIMIT 10",
    "knn_topk_by_kind": f"WITH {_Q} SELECT vec_id, label, raw, round(score, 6) AS score FROM c WHERE label IN (1, 2, 3) ORDER BY raw DESC, vec_id LIMIT 10",
    "knn_topk_per_kind": f"WITH {_Q} SELECT label, vec_id, raw, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY raw DESC, vec_id) AS rank FROM c QUALIFY rank <= 3",
    "knn_restricted": f"WITH {_Q} SELECT vec_id, raw, round(score, 6) AS score FROM c WHERE vec_id IN (SELECT doc_id FROM labels) ORDER BY raw DESC, vec_id LIMIT 10",
    "gather_split": "SELECT CASE WHEN vec_id IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'skipped' ELSE 'keep' END AS state, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels) LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1",
    "knn_default_tier": f"""WITH {_Q},
w AS (SELECT doc_id, max(quality) = 1 AS loc FROM labels GROUP BY doc_id),
t AS (SELECT vec_id, score FROM c WHERE vec_id IN (SELECT doc_id FROM w) ORDER BY raw DESC, vec_id LIMIT 10),
r AS (SELECT doc_id, loc, row_number() OVER (PARTITION BY loc ORDER BY doc_id) AS i FROM w WHERE doc_id NOT IN (SELECT vec_id FROM t))
SELECT vec_id, round(score, 6) AS score, tier FROM (
  SELECT vec_id, score, 0 AS tier FROM t UNION ALL SELECT doc_id, CASE WHEN loc THEN 0.5 ELSE 0.3 END, 1 FROM r WHERE i <= 10)
ORDER BY score DESC, tier, vec_id LIMIT 10""",
    "knn_boosted": f"""WITH {_Q}, b AS (SELECT vec_id, raw, score + (1 - score) * 0.25 * CASE WHEN vec_id % 2 = 0 THEN label / 10 ELSE 1.0 END AS x FROM c)
SELECT vec_id, raw, round(x, 6) AS score FROM b ORDER BY round(x, 6) DESC, vec_id LIMIT 10""",
    "knn_batch": f"""WITH {_Q},
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(b.q) + 1), lambda i: (b.q[i] * a.q[i] + 16384) >> 15)) AS BIGINT) AS raw FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query_id, vec_id, raw, round(greatest(-1.0, least(1.0, raw / (32768 * 0.95::DOUBLE * 0.95::DOUBLE))), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM p QUALIFY rank <= 3""",
    "q15_encode": f"WITH {_Q} SELECT vec_id, q[1] AS first, CAST(list_sum(q) AS BIGINT) AS total, list_min(q) AS least, list_max(q) AS most FROM v",
    "dequant_norm": f"WITH {_Q} SELECT vec_id, round(sqrt(list_sum(list_transform(q, lambda x: (x / 32768.0)::DOUBLE * (x / 32768.0)::DOUBLE))), 3) AS norm FROM v",
    "plain_topk": f"WITH {_Q} SELECT vec_id, round(raw / 32768.0::DOUBLE, 6) AS score FROM c ORDER BY raw DESC, vec_id LIMIT 10",
    "unit_rows": "SELECT vec_id, round(CASE WHEN n = 0 THEN 0.0 ELSE sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n)))) END, 6) AS norm FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)",
    "length_histogram": "SELECT CAST(len(embedding) AS BIGINT) AS length, count(*) AS n FROM embeddings GROUP BY 1",
    "rank_fusion": f"""WITH {_Q},
a AS (SELECT p_partkey AS vec_id, pow(0.62, log2(row_number() OVER (ORDER BY p_partkey % 97, p_partkey))) AS score FROM part ORDER BY p_partkey % 97, p_partkey LIMIT 50),
b AS (SELECT vec_id, raw / 32768.0::DOUBLE AS score FROM c ORDER BY raw DESC, vec_id LIMIT 50),
m AS (SELECT vec_id, 0.5 * score / (SELECT avg(score) FROM a) AS p FROM a UNION ALL SELECT vec_id, 0.5 * score / (SELECT avg(score) FROM b) FROM b),
t AS (SELECT vec_id, sum(p) AS score, 0 AS forced FROM m WHERE vec_id NOT IN (7, 8) GROUP BY vec_id UNION ALL SELECT 7, NULL, 1 UNION ALL SELECT 8, NULL, 1)
SELECT vec_id, round(score, 6) AS score, forced FROM t ORDER BY forced DESC, score DESC, vec_id LIMIT 20""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
