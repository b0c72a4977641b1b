"""A SparkSession with the settings the engine expects; an existing session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Adaptive execution on, UTC, Arrow on. Leave shuffle_partitions to the cluster unless testing."""
    build = SparkSession.builder.appName("semlake").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    build = build.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        build = build.master(master)
    if shuffle_partitions:
        build = build.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        build = build.config(k.replace("__", "."), v)
    return build.getOrCreate()
