"""Parquet folders in hash buckets, sorted within each bucket.

Spark knows the buckets of a table in its catalog, so a folder is registered there under a name that follows from its
path. Joins, anti-joins and grouping on the keys then read matching buckets side by side: the stored side is neither
shuffled nor, where a bucket is one file, sorted again.

Spark 4.1 also takes a union of equally bucketed tables to be bucketed, but a union of columnar scans puts their
tasks one after another, and grouping it without a shuffle then gives a key twice. ``read`` turns that off."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Lets a scan of single-file buckets say that they are sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _name(path: str) -> str:
    return "semlake_" + hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()


def _list(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def write(df: DataFrame, path: str, keys: Sequence[str], buckets: int, aligned: bool = False) -> None:
    """Write a folder of buckets. They are one file each if the rows are dealt out by the keys first; aligned says that each of df's
    tasks already holds one bucket, as after joining or grouping buckets, and leaves that out."""
    forget(df.sparkSession, path)
    if not aligned:
        df = df.repartition(buckets, *keys)
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(_name(path))


def read(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int) -> DataFrame:
    """The folder as a bucketed table; its columns are those of the schema."""
    spark.conf.set(ORDERED, "true")
    spark.conf.set(UNION_PARTITIONING, "false")
    name = _name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    at = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet CLUSTERED BY ({_list(keys)}) SORTED BY ({_list(keys)}) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def forget(spark: SparkSession, path: str) -> None:
    """Take a folder out of the catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS `{_name(path)}`")
