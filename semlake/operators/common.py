"""Size-checked broadcasts and repeated materialisation, shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to have at most so many rows.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether a side has no more rows than the bound, counting no further than it."""
    most = BROADCAST_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast a small side; a larger one is left to a shuffle join."""
    return F.broadcast(df) if is_small(df, most) else df


def checkpoint_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary folder only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="semlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """Where this application keeps what its queries write on the way."""
    return f"{checkpoint_base(spark)}/semlake-{spark.sparkContext.applicationId}"


def checkpoint_path(spark: SparkSession) -> str:
    """A new folder name below the application's scratch root."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application's queries have left in the shared folder. DataFrames that still read it can't be used any more, so
    call it when the results are written."""
    remove(spark, scratch_root(spark))


def ship(spark: SparkSession) -> None:
    """Put this package's parent folder into the Python workers' path, beside what the cluster has set up."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: the plan of an iteration stays as short as one step."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
