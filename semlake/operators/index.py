"""The inverted index of constituents, availability, consistency and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import keys
from semlake.operators.common import small
from semlake.schemas import EXPERIENCE


def posting(experiences: DataFrame) -> DataFrame:
    """(hash, key), derived; [] is the global bucket of 16 zero bytes, null constituents are not indexed."""
    hashes = F.array_distinct(F.transform("constituents", lambda c: c["hash"]))
    known = experiences.where(F.col("constituents").isNotNull())
    return known.select(F.explode(F.when(F.size("constituents") > 0, hashes).otherwise(F.array(F.lit(keys.ZERO)))).alias("hash"), "key")


def candidates(index: DataFrame, loaded: DataFrame) -> DataFrame:
    """Keys that mention a loaded hash, or are global."""
    wanted = loaded.select("hash").union(loaded.sparkSession.createDataFrame([(bytearray(keys.ZERO),)], "hash binary"))
    return index.join(small(wanted.distinct()), "hash", "left_semi").select("key").distinct()


def available(experiences: DataFrame, loaded: DataFrame) -> DataFrame:
    """Experiences all of whose constituents are loaded (division): those without an unloaded one. Null constituents never."""
    each = experiences.where(F.col("constituents").isNotNull()).select("key", F.explode("constituents.hash").alias("hash"))
    blocked = each.join(small(loaded.select("hash").distinct()), "hash", "left_anti").select("key").distinct()
    return experiences.where(F.col("constituents").isNotNull()).join(blocked, "key", "left_anti")


def difference(expected: DataFrame, indexed: DataFrame, key: str = "key") -> DataFrame:
    """(key, side): missing from the index, or stale in it."""
    missing = expected.select(key).distinct().join(indexed.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    stale = indexed.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("side", F.lit("stale"))
    return missing.unionByName(stale)


def expected_key(key, constituents):
    return keys.with_prefix(key, keys.xor_prefix(F.transform(constituents, lambda c: c["hash"])))


def consistency(records: DataFrame) -> DataFrame:
    """One row: records, experiences, legacy (no constituents) and XOR keys that do not fit their constituents."""
    xor = keys.is_xor_keyed(F.col("kind"))
    wrong = xor & F.col("constituents").isNotNull() & (F.col("key") != expected_key(F.col("key"), F.col("constituents")))
    return records.agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("kind") == EXPERIENCE).alias("n_experiences"),
        F.count_if(xor & F.col("constituents").isNull()).alias("legacy"),
        F.count_if(wrong).alias("mismatches"),
    )


def repair_plan(records: DataFrame) -> DataFrame:
    """(key, new_key, action) of mismatched records: move if the target is free or identical, else conflict."""
    good = records.where(keys.is_xor_keyed(F.col("kind")) & F.col("constituents").isNotNull()).withColumn("new_key", expected_key(F.col("key"), F.col("constituents")))
    body = F.to_json(F.struct(*[c for c in records.columns if c != "key"]))
    moved = good.where("key <> new_key").select("key", "new_key", body.alias("body"))
    target = records.select(F.col("key").alias("new_key"), body.alias("there"))
    out = moved.join(target, "new_key", "left")
    # Two different records for one free target: the first by key moves, the others conflict unless identical.
    return out.groupBy("new_key").agg(F.sort_array(F.collect_list(F.struct("key", "body"))).alias("m"), F.first("there").alias("there")).select(
        "new_key", F.explode(F.transform("m", lambda x: F.struct(x.key.alias("key"), F.when(x.body == F.coalesce("there", F.element_at("m", 1).body), "move").otherwise("conflict").alias("action")))).alias("x")
    ).select("x.key", "new_key", "x.action")


def repaired(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply the moves to records or vectors; conflicts stay as they are, duplicates collapse."""
    moves = plan.where("action = 'move'").select("key", "new_key")
    out = df.join(moves, "key", "left").withColumn("key", F.coalesce("new_key", "key")).drop("new_key")
    on = [c for c in ("model", "key") if c in df.columns]
    return out.select(df.columns).dropDuplicates(on)
