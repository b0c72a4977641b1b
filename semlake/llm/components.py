"""Connected components of a table of links, by alternating large and small stars.

Kiveris et al., Connected Components in MapReduce and Beyond (2014): each round rewires every vertex to
the least neighbour it knows; the rounds end when no edge changes, after about log(n) of them. That is tested
on the edges themselves once their number and the sum of their hashes stay the same. Each
round's edges are written to the shared folder, and those of the round before are removed. Minima are combined before the shuffle and the join that hands
them back can be split, so a vertex with very many neighbours does not need one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import materialise, remove


def _least(edges: DataFrame, u: str) -> DataFrame:
    """For each u the least of itself and its neighbours."""
    v = "v" if u == "u" else "u"
    return edges.groupBy(F.col(u).alias("w")).agg(F.least(F.min(v), F.first(u)).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.where("v > u").join(_least(both, "u"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, "u")
    out = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, component) of every node in links (u, v), the component being its least node."""
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{path}/edges-0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    before, step, changed = mark(edges), 0, True
    while before[0] and changed:
        step += 1
        after = materialise(_small_star(_large_star(edges)), f"{path}/edges-{step}")
        now = mark(after)
        changed = now != before or not after.join(edges, ["u", "v"], "left_anti").isEmpty()
        remove(links.sparkSession, f"{path}/edges-{step - 1}")
        edges, before = after, now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
