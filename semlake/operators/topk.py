"""Retrieval: gather, cosine top-k, boosts, default scores and the composed lookup."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semlake.functions import q15
from semlake.operators.common import is_small, ship, small

BOOST = 0.25
#: Queries that are sent to the tasks at once, and vectors that meet a query at once.
QUERY_ROWS, VECTOR_ROWS = 4096, 8192


def _none(df: DataFrame) -> DataFrame:
    return df.limit(0)


def of_kinds(df: DataFrame, kinds: Sequence[int], column: str = "kind") -> DataFrame:
    """Rows of the kinds; no kinds, no rows."""
    return df.where(F.col(column).isin(list(kinds))) if kinds else _none(df)


def gather(candidates: DataFrame, vectors: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """Distinct candidates with their vector and state: keep, missing, or skipped for a wrong length. vectors: one row a key. Neither
    broadcasts vectors nor shuffles stored ones: few candidates go to the vectors, many into the buckets."""
    wanted, held = candidates.dropDuplicates([key]), vectors.select(key, vector)
    if is_small(wanted):
        hit = held.join(F.broadcast(wanted), key)
        lost = wanted.join(F.broadcast(hit.select(key)), key, "left_anti")
        found = hit.select(*wanted.columns, vector).unionByName(lost.withColumn(vector, F.lit(None).cast(held.schema[vector].dataType)))
    else:
        found = wanted.join(held, key, "left")
    state = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != dimension, "skipped").otherwise("keep")
    return found.withColumn("state", state)


def scored(vectors: DataFrame, query: Sequence[int], vector: str = "q") -> DataFrame:
    """raw (bigint) and score (cosine) against a literal query vector; compiled, without a shuffle."""
    return vectors.withColumn("raw", q15.dot(vector, list(query))).withColumn("score", q15.recover_cos(F.col("raw")))


def top_k(vectors: DataFrame, query: Sequence[int], k: int, key: str, vector: str = "q") -> DataFrame:
    """The k best by (raw desc, key); each task keeps k rows, and only these meet."""
    if k <= 0:
        return _none(scored(vectors, query, vector))
    return scored(vectors, query, vector).orderBy(F.desc("raw"), key).limit(k)


def top_k_per(df: DataFrame, by: str | list[str], k: int, key: str) -> DataFrame:
    """The k best of each group of rows with raw; tasks cut groups to k before the shuffle."""
    order = W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc("raw"), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(df: DataFrame, ids: str, vector: str, dimension: int, rows: int, count: int, name: str) -> DataFrame:
    """(name, name_ids, name_rows): rows of vectors as one binary each, about ``rows`` of them, dealt by a hash of their key. Vectors of
    another length are left out; lengths are read off the list offsets."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    blocks = max(1, -(-count // rows))
    dealt = df.select(ids, vector, F.pmod(F.xxhash64(ids), F.lit(blocks)).cast("int").alias(name)).where(F.size(vector) == dimension)
    dealt = dealt.repartition(name).sortWithinPartitions(name)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(name).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                v = batch.column(vector).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype("<i2")
                row = [pa.array([int(block[a])], pa.int32()), pa.array([batch.column(ids).slice(a, b - a).to_pylist()], pa.list_(batch.column(ids).type)), pa.array([v.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=[name, f"{name}_ids", f"{name}_rows"])

    return dealt.mapInArrow(pack, f"`{name}` int, `{name}_ids` array<{kinds[ids]}>, `{name}_rows` binary")


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "q", query_vector: str = "qv", dimension: int | None = None) -> DataFrame:
    """Exact top-k for a stated set of queries in one job: blocks of queries meet blocks of vectors, and k rows of each query leave a
    meeting. Vectors and queries of another length than the dimension (that of the first query, if not given) are left out, as a search
    leaves out what it skips; no k, no rows."""
    ship(vectors.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema.fields, *queries.schema.fields)}
    schema = f"`{query_key}` {kinds[query_key]}, raw bigint, `{key}` {kinds[key]}"
    if dimension is None:
        first = queries.where(F.col(query_vector).isNotNull()).select(F.size(query_vector)).first()
        dimension = first[0] if first else 0
    if k <= 0 or not dimension:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.withColumns({"rank": F.lit(1), "score": F.lit(0.0)})
    size = max(1, min(VECTOR_ROWS, (8 << 20) // dimension))
    some = _blocks(queries, query_key, query_vector, dimension, min(QUERY_ROWS, size), queries.count(), "asked")
    # Each block of vectors is sent once to each block of queries: the smaller the share of queries, the fewer copies.
    n_asked = max(1, -(-queries.count() // min(QUERY_ROWS, size)))
    held = _blocks(vectors, key, vector, dimension, size, vectors.count(), "held").withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    types = [pa.from_numpy_dtype("int64")]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, q, ids, v in zip(*(batch.column(c) for c in ("asked_ids", "asked_rows", "held_ids", "held_rows")), strict=True):
                queries_ = np.frombuffer(q.as_buffer(), "<i2").astype(np.int32).reshape(-1, dimension)
                block = np.frombuffer(v.as_buffer(), "<i2").astype(np.int32).reshape(-1, dimension)
                at, raws, who = [], [], []
                for i, x in enumerate(queries_):
                    raw = ((block * x + 16384) >> 15).sum(1, dtype=np.int64)
                    near = np.flatnonzero(raw >= np.partition(raw, -k)[-k]) if len(raw) > k else np.arange(len(raw))  # ties stay until keys are compared
                    at.append(near)
                    raws.append(raw[near])
                    who.append(np.full(len(near), i))
                columns = [asked.values.take(pa.array(np.concatenate(who))), pa.array(np.concatenate(raws), types[0]), ids.values.take(pa.array(np.concatenate(at)))]
                yield pa.RecordBatch.from_arrays(columns, names=[query_key, "raw", key])

    found = held.join(some, "asked").select("asked_ids", "asked_rows", "held_ids", "held_rows").mapInArrow(best, schema)
    return top_k_per(found, query_key, k, key).withColumn("score", q15.recover_cos(F.col("raw")))


def boosted(score: Column, hit: Column, patterns: int) -> Column:
    """With more than one pattern: s + (1 - s) * 0.25 * hit, hit being 1 where unknown."""
    return score + (1 - score) * BOOST * F.coalesce(hit, F.lit(1.0)) if patterns > 1 else score


def default_tier(candidates: DataFrame, top: DataFrame, k: int, key: str, default: float, local: float) -> DataFrame:
    """Candidates outside ``top`` with the score of their locality, at most k of each tier in candidate order (ord)."""
    left = candidates.join(small(top.select(key)), key, "left_anti")
    local_ = F.coalesce("is_local", F.lit(False))
    tier = lambda cond, s: left.where(cond).orderBy("ord", key).limit(k).withColumn("score", F.lit(s))
    return tier(local_, local).unionByName(tier(~local_, default))


def final_cut(embedded: DataFrame, defaults: DataFrame, k: int, key: str) -> DataFrame:
    """By score; ties keep embedded rows before defaults, then candidate order."""
    both = embedded.withColumn("tier", F.lit(0)).unionByName(defaults.withColumn("tier", F.lit(1)), allowMissingColumns=True)
    return both.orderBy(F.desc("score"), "tier", "ord", key).limit(k)


def without_shown_faces(extras: DataFrame, present: DataFrame, theorem_kind: int, rule_kinds: Sequence[int]) -> DataFrame:
    """Extras whose key is new and which are not the theorem face of a rule that is there already."""
    from semlake.functions import keys

    new = extras.join(present.select("key"), "key", "left_anti")
    rules = present.where(F.col("kind").isin(list(rule_kinds))).select(keys.face(F.col("key")).alias("face"), F.lit(True).alias("shown")).distinct()
    out = new.withColumn("face", keys.face(F.col("key"))).join(rules, "face", "left")
    return out.where(~((F.col("kind") == theorem_kind) & F.coalesce("shown", F.lit(False)))).drop("face", "shown")


def resolved(top: DataFrame, records: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Names of the ranked keys, joined after the ranking: the live name wins, keys without any name are dropped."""
    # A left join can't broadcast its left side: the few rows that were ranked are fetched first.
    ranked = small(top.select("key").distinct())
    stored = records.join(ranked, "key", "left_semi").select("key", F.col("name").alias("stored_name"), "interpretation")
    out = top.join(small(stored), "key", "left")
    if live is not None:
        named = live.join(ranked, "key", "left_semi").select("key", F.col("name").alias("live_name"))
        out = out.join(small(named), "key", "left")
    else:
        out = out.withColumn("live_name", F.lit(None).cast("string"))
    return out.withColumn("name", F.coalesce("live_name", "stored_name")).where(F.col("name").isNotNull()).drop("live_name", "stored_name")


def pad_reranked(reranked: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """Reranked rows first, then rows of ``top`` whose *name* is not among them, to k rows."""
    rest = top.join(reranked.select("name"), "name", "left_anti").withColumn("stage", F.lit(1))
    both = reranked.withColumn("stage", F.lit(0)).unionByName(rest, allowMissingColumns=True)
    return both.orderBy("stage", F.desc("score"), "key").limit(k).drop("stage")
