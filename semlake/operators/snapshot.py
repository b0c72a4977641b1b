"""Snapshots: gates before reading, merge with "finished wins", statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.schemas import SCHEMA_VERSION, VECTOR_FORMAT


def check_manifest(manifest: dict) -> None:
    for field, want in (("schema_version", SCHEMA_VERSION), ("vector_format", VECTOR_FORMAT)):
        if str(manifest.get(field)) != want:
            raise ValueError(f"snapshot has {field} {manifest.get(field)!r}; {want!r} is needed")


def check_vectors(vectors: DataFrame, dimension: int) -> None:
    """All vectors have the model's dimension."""
    row = vectors.agg(F.count_if(F.size("q") != dimension).alias("wrong"), F.count_distinct(F.size("q")).alias("lengths")).first()
    if row["wrong"]:
        raise ValueError(f"{row['wrong']} vectors have another length than {dimension} ({row['lengths']} lengths)")


def merge(local: DataFrame, remote: DataFrame, on: Sequence[str], finished: str | None = None) -> DataFrame:
    """Full join of two snapshots with ``action``: added, kept_local, overwritten, same, local_only.

    finished: the boolean column of status rows; a status row finished here and not there
    stays as it is. Equality is null-safe over all columns."""
    on = list(on)
    values = [c for c in local.columns if c not in on]
    left = local.select(*on, F.struct(*values).alias("l"))
    right = remote.select(*on, F.struct(*values).alias("r"))
    both = left.join(right, on, "full")
    keep = F.lit(False)
    if finished is not None:
        keep = F.coalesce(F.col(f"l.{finished}"), F.lit(False)) & ~F.coalesce(F.col(f"r.{finished}"), F.lit(False))
    action = F.when(F.col("r").isNull(), "local_only").when(F.col("l").isNull(), "added").when(keep, "kept_local").when(~F.col("l").eqNullSafe(F.col("r")), "overwritten").otherwise("same")
    both = both.withColumn("action", action)
    pick = F.when(F.col("action").isin("added", "overwritten"), F.col("r")).otherwise(F.col("l"))
    return both.withColumn("v", pick).select(*on, *(F.col(f"v.{c}").alias(c) for c in values), "action")


def statistics(merged: DataFrame) -> DataFrame:
    return merged.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "overwritten", "kept_local")])
