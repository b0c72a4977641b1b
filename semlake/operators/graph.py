"""Dependency graphs: closures, work plans, contraction, levels and bounded expansion, by iterative joins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.operators.common import checkpoint_path, cut


def cone(edges: DataFrame, roots: DataFrame, excluded: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(node, depth): all ancestors of the roots, themselves included. edges (parent, child).
    Excluded nodes are walked through and left out at the end. Semi-naive: only the new rim is joined."""
    spark, path = edges.sparkSession, checkpoint_path(edges.sparkSession)
    seen = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)), f"{path}/0")
    rim = seen
    for depth in range(1, most + 1):
        new = rim.join(edges, rim["node"] == edges["child"]).select(edges["parent"].alias("node")).distinct()
        rim = cut(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), f"{path}/{depth}")
        if rim.isEmpty():
            break
        seen = spark.read.schema(seen.schema).parquet(*[f"{path}/{d}" for d in range(depth + 1)])
    else:
        raise ValueError(f"more than {most} steps")
    return seen.join(excluded.select("node"), "node", "left_anti") if excluded is not None else seen


def plan(cone_: DataFrame, finished: DataFrame, force: bool = False) -> DataFrame:
    return cone_ if force else cone_.join(finished.select("node"), "node", "left_anti")


def contract(edges: DataFrame, keep: DataFrame, most: int = 1000) -> DataFrame:
    """(parent, child) between kept nodes: edges through other nodes lead to the nearest kept ancestors."""
    spark, path = edges.sparkSession, checkpoint_path(edges.sparkSession)
    kept = cut(keep.select("node").distinct(), f"{path}/kept")
    # Every edge knows whether its parent is kept, so that no step asks for it again.
    top = kept.select(F.col("node").alias("parent"), F.lit(True).alias("end"))
    marked = cut(edges.select("parent", "child").distinct().join(top, "parent", "left").select("parent", "child", F.coalesce("end", F.lit(False)).alias("end")), f"{path}/edges")
    first = cut(marked.join(kept.select(F.col("node").alias("child")), "child", "left_semi").select("parent", "child", "end"), f"{path}/met-0")
    ups = marked.select(F.col("parent").alias("up"), F.col("child").alias("parent"), F.col("end").alias("_end"))
    met = [f"{path}/met-0"]
    read = lambda paths: spark.read.schema(first.schema).parquet(*paths)
    for step in range(1, most + 1):
        open_ = read(met[-1:]).where("not end").select("parent", "child")
        if open_.isEmpty():
            return read(met).where("end").select("parent", "child").distinct()
        new = open_.join(ups, "parent").select(F.col("up").alias("parent"), "child", F.col("_end").alias("end")).distinct()
        seen = read(met).where("not end").select("parent", "child")
        # What ends is not followed, so it may come again: it is made distinct once, at the end.
        cut(new.join(seen.withColumn("end", F.lit(False)), ["parent", "child", "end"], "left_anti").select("parent", "child", "end"), f"{path}/met-{step}")
        met.append(f"{path}/met-{step}")
    raise ValueError(f"more than {most} steps")


def levels(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """(node, level): parents before children, a level after the last of the parents; a cycle raises an error."""
    spark, path = edges.sparkSession, checkpoint_path(edges.sparkSession)
    inner = edges.join(nodes.select(F.col("node").alias("child")), "child", "left_semi").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    left, inner = cut(nodes.select("node").distinct(), f"{path}/left-0"), cut(inner.select("parent", "child").distinct(), f"{path}/edges-0")
    done = []
    for level in range(most):
        if left.isEmpty():
            break
        ready = cut(left.join(inner.select(F.col("child").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)), f"{path}/level-{level}")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        done.append(f"{path}/level-{level}")
        left = cut(left.join(ready.select("node"), "node", "left_anti"), f"{path}/left-{level + 1}")
        inner = cut(inner.join(ready.select(F.col("node").alias("parent")), "parent", "left_anti"), f"{path}/edges-{level + 1}")
    return spark.read.schema("node " + nodes.schema["node"].dataType.simpleString() + ", level int").parquet(*done) if done else nodes.select("node", F.lit(0).alias("level")).limit(0)


def expand(edges: DataFrame, roots: DataFrame, most_nodes: int = 300) -> DataFrame:
    """(node, depth, rank): breadth first to a number of nodes; the nearest first, class dependencies (rank 0)
    before others, then by name. edges (child, parent, rank)."""
    spark, path = edges.sparkSession, checkpoint_path(edges.sparkSession)
    seen = cut(roots.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(0).alias("rank")), f"{path}/0")
    rim, depth = seen, 0
    while seen.count() < most_nodes:
        depth += 1
        e = edges.select(F.col("child").alias("node"), "parent", "rank")
        new = rim.select("node").join(e, "node").groupBy(F.col("parent").alias("node")).agg(F.min("rank").alias("rank"))
        rim = cut(new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "rank"), f"{path}/{depth}")
        if rim.isEmpty():
            break
        seen = spark.read.schema(seen.schema).parquet(*[f"{path}/{d}" for d in range(depth + 1)])
    return seen.orderBy("depth", "rank", "node").limit(most_nodes)


def delta(current: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """What is new here: current members without those of any parent, each once."""
    return current.join(parents.select(*on), on, "left_anti").dropDuplicates(on)


def usage(costs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Totals of the run over its nodes."""
    return costs.join(nodes.select("node"), "node", "left_semi").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in costs.columns if c != "node"])


def complete(edges: DataFrame, cone_: DataFrame, finished: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Do the work of a cone level by level, parents first, and return what it cost, (node, counters..).

    Finished nodes are relays: they are not worked on again, but those below them still wait for those above. work gets the
    nodes of a level and returns (node, ok, counters..); if one is not ok the run ends with an error and no later level is begun."""
    spark, path = edges.sparkSession, checkpoint_path(edges.sparkSession)
    todo = cut(cone_.select("node").join(finished.select("node"), "node", "left_anti"), f"{path}/todo")
    order = cut(levels(contract(edges, todo), todo), f"{path}/order")
    done = []
    for level in range((order.agg(F.max("level")).first()[0] if not order.isEmpty() else -1) + 1):
        made = cut(work(order.where(F.col("level") == level).select("node")), f"{path}/level-{level}")
        if (bad := made.where(~F.coalesce("ok", F.lit(False))).orderBy("node").select("node").first()) is not None:
            raise RuntimeError(f"failed at node {bad[0]!r}; later levels are not begun")
        done.append(made.drop("ok"))
    return functools.reduce(DataFrame.unionByName, done) if done else todo
