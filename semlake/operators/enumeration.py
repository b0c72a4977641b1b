"""Incremental enumeration: what is new in a module against all it builds on, appended to what is known.

The keys that a module inherits go into a bitmap of BITS bits a key, made and tested with built-in functions, so a new key is
told from an inherited one without a join; the few that the bitmap can't tell are anti-joined exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.functions import keys, text
from semlake.operators.common import checkpoint_path, cut, remove, small
from semlake.schemas import CASE_SPLIT, ELIMINATION, INDUCTION, INTRODUCTION
from semlake.sources.store import Store

BITS, BLOCK = 16, 32_768
_RULE = {"introduction": INTRODUCTION, "elimination": ELIMINATION, "induction": INDUCTION, "case_split": CASE_SPLIT}


def ancestors(parents: DataFrame, most: int = 1000) -> DataFrame:
    """(module, ancestor) of all that modules build on, from (module, parent); only new pairs are followed."""
    spark, path = parents.sparkSession, checkpoint_path(parents.sparkSession)
    seen = rim = cut(parents.select("module", F.col("parent").alias("ancestor")).distinct(), f"{path}/0")
    up = parents.select(F.col("module").alias("ancestor"), "parent")
    for step in range(1, most + 1):
        new = rim.join(up, "ancestor").select("module", F.col("parent").alias("ancestor")).distinct()
        rim = cut(new.join(seen, ["module", "ancestor"], "left_anti"), f"{path}/{step}")
        if rim.isEmpty():
            return seen
        seen = spark.read.schema(seen.schema).parquet(*[f"{path}/{i}" for i in range(step + 1)])
    raise ValueError(f"more than {most} steps")


def _bit(on: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(bits))


def bitmap(df: DataFrame, on: list[str], bits: int) -> DataFrame:
    """(block, map): one bit for the hash of each row, in blocks of BLOCK bits."""
    at = df.select(_bit(on, bits).alias("at"))
    return at.groupBy(F.floor(F.col("at") / BLOCK).cast("bigint").alias("block")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BLOCK))).alias("map"))


def with_bit(df: DataFrame, on: list[str], made: DataFrame, bits: int) -> DataFrame:
    """df with ``_seen``: false for rows that were surely not in the bitmap."""
    out = df.withColumn("_at", _bit(on, bits)).withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("bigint"))
    out = out.join(small(made.select(F.col("block").alias("_block"), F.col("map").alias("_map")), 2048), "_block", "left")
    byte = F.expr(f"conv(hex(substring(_map, cast(pmod(_at, {BLOCK}) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    bit = F.expr("cast(pmod(_at, 8) as int)")
    return out.withColumn("_seen", F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(1) == 1, F.lit(False))).drop("_at", "_block", "_map")


def inherited(members: DataFrame, above: DataFrame) -> DataFrame:
    """(module, key) of all members of a module's ancestors."""
    each = members.select(F.col("module").alias("ancestor"), "key")
    return each.join(small(above), "ancestor").select("module", "key").distinct()


def new_members(members: DataFrame, parents: DataFrame) -> DataFrame:
    """The members (module, key, ..) that none of the module's ancestors has, each once."""
    path = checkpoint_path(members.sparkSession)
    old = cut(inherited(members, cut(ancestors(parents), f"{path}/above")), f"{path}/old")
    bits = max(BLOCK, BITS * old.count())
    on = ["module", "key"]
    marked = cut(with_bit(members.dropDuplicates(on), on, cut(bitmap(old, on, bits), f"{path}/bitmap"), bits), f"{path}/marked")
    unsure = marked.where("_seen").join(old, on, "left_anti")
    out = cut(marked.where("not _seen").unionByName(unsure).drop("_seen"), f"{path}/out")
    for part in ("old", "bitmap", "marked"):
        remove(members.sparkSession, f"{path}/{part}")
    return out


def with_rules(facts: DataFrame, name: str = "name", shaped: Column | None = None) -> DataFrame:
    """Facts, and once more under the rule kind that their name tells; inductions and case splits only if ``shaped`` holds."""
    kind = text.rule_kind(F.col(name))
    if shaped is not None:
        kind = F.when(kind.isin("induction", "case_split") & ~F.coalesce(shaped, F.lit(False)), F.lit("none")).otherwise(kind)
    out = facts
    for label, tag in _RULE.items():
        out = out.unionByName(facts.where(kind == label).withColumns({"key": keys.retag(F.col("key"), tag), "kind": F.lit(tag)}))
    return out


def update(store: Store, members: DataFrame, parents: DataFrame, table: str = "members", shaped: Column | None = None) -> int:
    """Append what is new, with its rules, to the store's table (module, key, name, kind); returns the rows. Nothing new, no commit."""
    new = with_rules(new_members(members, parents), shaped=shaped)
    if store.version(table):
        new = new.join(store.read(table).select("module", "key"), ["module", "key"], "left_anti")
    new = cut(new, checkpoint_path(members.sparkSession))
    n = new.count()
    if n:
        store.change().upsert(table, new, ("module", "key")).commit()
    return n
