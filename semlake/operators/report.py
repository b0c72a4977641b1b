"""Counts, costs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semlake.functions import keys


def owners(records: DataFrame) -> DataFrame:
    """(hash, key): the modules a record counts for, each once: constituents of XOR keys, else the prefix."""
    xor = keys.is_xor_keyed(F.col("kind"))
    hashes = F.when(xor, F.array_distinct(F.transform("constituents", lambda c: c["hash"]))).otherwise(F.array(keys.prefix(F.col("key"))))
    return records.select(F.explode(hashes).alias("hash"), "key")


def module_report(records: DataFrame, status: DataFrame, names: DataFrame) -> DataFrame:
    """One row a module in any of the three tables: name (hex where unknown), entities, status; by name."""
    counts = owners(records).groupBy("hash").agg(F.count("*").alias("entities"))
    out = counts.join(status.withColumnRenamed("key", "hash"), "hash", "full").join(names.select("hash", "name"), "hash", "full")
    label = F.coalesce("name", F.lower(F.hex("hash")))
    return out.withColumns({"name": label, "entities": F.coalesce("entities", F.lit(0)), "finished": F.coalesce("finished", F.lit(False)), "wip": keys.is_wip(F.col("hash"))}).orderBy("name")


def totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("modules"), F.count_if("finished").alias("done"), F.count_if("wip").alias("wip"), F.sum("entities").alias("entities"))


def removal_counts(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Records under each target module; a record counts under every one that it matches."""
    return owners(records).join(targets.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("n"))


def blocked(missing: DataFrame, finished: DataFrame, module: str, name: str, most: int = 10) -> DataFrame:
    """Missing entities of unfinished modules: total, the first names, and how many more."""
    left = missing.join(finished.select(module), module, "left_anti")
    order = W.partitionBy(module).orderBy(name)
    first = left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy(module).agg(F.array_sort(F.collect_list(name)).alias("first"))
    count = left.groupBy(module).agg(F.count("*").alias("total"))
    return count.join(first, module).withColumn("more", F.greatest(F.col("total") - most, F.lit(0)))


def percentiles(df: DataFrame, value: str, limits: Sequence[int] = (1000, 2000, 3000)) -> DataFrame:
    """Exact, linearly interpolated quartiles, and counts over the limits."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.agg(q.alias("q"), F.max(value).alias("max"), F.sum(value).alias("total"), *[F.count_if(F.col(value) > n).alias(f"over_{n}") for n in limits])
    return out.select(F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), *out.columns[1:])


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    return df.groupBy(length.alias("length")).agg(F.count("*").alias("n"))


def to_embed(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.count_if(F.col(text).isNotNull()).alias("renderable"), F.count_if(F.col(text).isNull()).alias("unrenderable"))


def usage(df: DataFrame, by: Sequence[str], counters: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters])


def collection_hits(members: DataFrame, match: Column, collection: str) -> DataFrame:
    """Collections with at least one matching member, and how many match."""
    return members.groupBy(collection).agg(F.count_if(match).alias("n")).where("n > 0")


def store_sizes(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model").agg(F.count("*").alias("entries"), F.sum(F.size("q") * 2).alias("bytes"))
