"""Digests of entities over their dependencies, and what has become stale.

The digest of an entity covers its own definition and the digests of all it depends on (a Merkle graph), so it changes with
anything below it. Entities that depend on each other are one component: its digest covers the definitions of all
members and what they depend on outside. Nodes that nothing depends on are set aside in layers, as long as that takes out a good
part of what is left, and need one join each at the end. In the core that stays, digests are made from the leaves up, a level at a
time; components are only looked for in what is left when no leaf is, by colouring. ``refresh`` recomputes the cone of what has
changed and keeps all others.

nodes (node string, own string); edges (node, dep). Names in dep that are no nodes count by their name. Steps are written to
the shared folder and removed when they are no longer read; the results read what is left there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.operators.common import checkpoint_path, cut, remove

DIGESTS = "node string, own string, deps array<string>, digest string, component string, shared string"
#: A layer is set aside if it is at least this share of what is left.
LAYER = 1 / 8
_INNER, _LAYER, _GONE = 0, 1, 2


def _covered(own: Column, below: Column) -> Column:
    return F.sha2(F.concat_ws("\n", own, F.array_join(F.array_sort(below), "\n")), 256)


def described(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, own, deps): a row for each node, its dependencies sorted and distinct."""
    deps = edges.groupBy("node").agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    return nodes.select("node", "own").join(deps, "node", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def _reach(edges: DataFrame, start: DataFrame, path: str, most: int) -> DataFrame:
    """(node) of all that edges (a, b) lead to from the start (node), itself included."""
    spark = edges.sparkSession
    seen = rim = cut(start.select("node").distinct(), f"{path}/0")
    for step in range(1, most + 1):
        new = rim.join(edges, rim["node"] == edges["a"]).select(edges["b"].alias("node")).distinct()
        rim = cut(new.join(seen, "node", "left_anti"), f"{path}/{step}")
        if rim.isEmpty():
            return seen
        seen = spark.read.schema("node string").parquet(*[f"{path}/{i}" for i in range(step + 1)])
    raise ValueError(f"more than {most} steps")


def components(edges: DataFrame, path: str, most: int = 1000) -> DataFrame:
    """(node, component) of the nodes of edges (a, b) that lie on a cycle; the component is its greatest node.

    Nodes without a way in or out are trimmed; then each node takes the greatest node it can reach as its colour. A
    node that has its own colour is in one component with all of that colour that it reaches. Those are taken out, until none is left."""
    spark, parts, step = edges.sparkSession, [], 0
    left = cut(edges.where("a <> b").select("a", "b").distinct(), f"{path}/left-0")
    for round_ in range(most):
        while True:  # trim
            step += 1
            inside = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a")
            cycle = left.join(inside, "a", "left_semi").join(inside.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
            after = cut(cycle, f"{path}/left-{step}")
            same = after.count() == left.count()
            remove(spark, f"{path}/left-{step - 1}")
            left = after
            if same:
                break
        if left.isEmpty():
            break
        names = left.select(F.col("a").alias("node")).distinct()
        colour = cut(names.withColumn("colour", F.col("node")), f"{path}/colour-{round_}-0")
        for i in range(1, most):
            up = left.join(colour, left["b"] == colour["node"]).groupBy(left["a"].alias("node")).agg(F.max("colour").alias("more"))
            after = cut(colour.join(up, "node", "left").select("node", F.greatest("colour", "more").alias("colour")), f"{path}/colour-{round_}-{i}")
            changed = not after.join(colour, ["node", "colour"], "left_anti").isEmpty()
            remove(spark, f"{path}/colour-{round_}-{i - 1}")
            colour = after
            if not changed:
                break
        of = lambda n: colour.select(F.col("node").alias(n), F.col("colour").alias(f"c{n}"))  # noqa: E731, B023
        within = cut(left.join(of("a"), "a").join(of("b"), "b").where("ca = cb").select("a", "b"), f"{path}/within-{round_}")
        reached = _reach(within, colour.where("node = colour"), f"{path}/reach-{round_}", most)
        parts.append(f"{path}/part-{round_}")
        got = cut(reached.join(colour, "node").select("node", F.col("colour").alias("component")), parts[-1])
        left = left.join(got.select(F.col("node").alias("a")), "a", "left_anti").join(got.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
        step += 1
        left = cut(left, f"{path}/left-{step}")
        for gone in ("colour", "within", "reach"):
            remove(spark, f"{path}/{gone}-{round_}" if gone != "colour" else f"{path}/colour-{round_}-{i}")
    else:
        raise ValueError(f"more than {most} rounds")
    found = spark.read.schema("node string, component string").parquet(*parts) if parts else spark.createDataFrame([], "node string, component string")
    sizes = found.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
    return found.join(sizes, "component").select("node", "component")


def _from_leaves(todo: DataFrame, known: DataFrame, path: str, most: int) -> DataFrame:
    """(unit, digest) of todo (unit, own, deps of units), given known (unit, digest). Units that wait for each other stay out."""
    spark, done = todo.sparkSession, []
    left = cut(todo, f"{path}/left-0")
    links = cut(left.select("unit", F.explode("deps").alias("dep")), f"{path}/links-0")
    # A dependency that is neither known nor to be done counts by its name.
    names = left.select(F.col("unit").alias("dep")).union(known.select(F.col("unit").alias("dep")))
    strange = links.join(names, "dep", "left_anti").select("dep").distinct().select(F.col("dep").alias("unit"), F.sha2(F.concat(F.lit("missing\n"), "dep"), 256).alias("digest"))
    held = cut(known.select("unit", "digest").unionByName(strange), f"{path}/known")
    # (unit, below): digests of dependencies so far, one row each.
    below = cut(links.join(held.withColumnRenamed("unit", "dep"), "dep").select("unit", F.col("digest").alias("below")), f"{path}/below-0")
    links = cut(links.join(held.select(F.col("unit").alias("dep")), "dep", "left_anti").select("unit", "dep"), f"{path}/links-1")
    remove(spark, f"{path}/links-0")
    for level in range(1, most + 1):
        ready = left.join(links.select("unit").distinct(), "unit", "left_anti")
        every = spark.read.schema("unit string, below string").parquet(*[f"{path}/below-{i}" for i in range(level)])
        got = ready.select("unit", "own").join(every, "unit", "left").groupBy("unit", "own").agg(F.collect_list("below").alias("d"))
        got = cut(got.select("unit", _covered(F.col("own"), F.col("d")).alias("digest")), f"{path}/done-{level}")
        if got.isEmpty():
            break
        done.append(f"{path}/done-{level}")
        left = cut(left.join(got.select("unit"), "unit", "left_anti"), f"{path}/left-{level}")
        cut(links.join(got.withColumnRenamed("unit", "dep"), "dep").select("unit", F.col("digest").alias("below")), f"{path}/below-{level}")
        links = cut(links.join(got.select(F.col("unit").alias("dep")), "dep", "left_anti").select("unit", "dep"), f"{path}/links-{level + 1}")
        remove(spark, f"{path}/left-{level - 1}")
        remove(spark, f"{path}/links-{level}")
    else:
        raise ValueError(f"more than {most} levels")
    return spark.read.schema("unit string, digest string").parquet(*done) if done else spark.createDataFrame([], "unit string, digest string")


def _single(units: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return units.select(F.col("unit").alias("node"), "digest", none.alias("component"), none.alias("shared"))


def _digested(todo: DataFrame, known: DataFrame, path: str, most: int = 1000) -> DataFrame:
    """(node, digest, component, shared) of todo (node, own, deps), given known (node, digest) of all others; the last two are null off the cycles."""
    spark = todo.sparkSession
    todo = cut(todo, f"{path}/todo")
    plain = _from_leaves(todo.withColumnRenamed("node", "unit"), known.withColumnRenamed("node", "unit"), f"{path}/plain", most)
    rest = todo.join(plain.select(F.col("unit").alias("node")), "node", "left_anti")
    if rest.isEmpty():
        return _single(plain)
    rest = cut(rest, f"{path}/rest")
    edges = rest.select(F.col("node").alias("a"), F.explode("deps").alias("b"))
    inside = edges.join(rest.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    comp = cut(components(inside, f"{path}/components", most), f"{path}/component")
    unit = rest.join(comp, "node", "left").withColumn("unit", F.when(F.col("component").isNotNull(), F.concat(F.lit("component "), "component")).otherwise(F.col("node")))
    unit = cut(unit, f"{path}/units")
    named = unit.select(F.col("node").alias("dep"), F.col("unit").alias("to"))
    deps = unit.select("unit", F.explode("deps").alias("dep")).join(named, "dep", "left").select("unit", F.coalesce("to", "dep").alias("dep")).where("unit <> dep").groupBy("unit").agg(F.collect_set("dep").alias("deps"))
    own = unit.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "node", F.sha2("own", 256)))), "\n").alias("joined"), F.first("own").alias("first"), F.first("component").alias("component"))
    own = own.select("unit", F.when(F.col("component").isNotNull(), F.col("joined")).otherwise(F.col("first")).alias("own"))
    units = own.join(deps, "unit", "left").select("unit", "own", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
    got = _from_leaves(units, known.withColumnRenamed("node", "unit").unionByName(plain), f"{path}/merged", most)
    each = unit.join(got, "unit").select("node", F.when(F.col("component").isNotNull(), F.sha2(F.concat_ws("\n", "own", "digest"), 256)).otherwise(F.col("digest")).alias("digest"), "component", F.when(F.col("component").isNotNull(), F.col("digest")).alias("shared"))
    return _single(plain).unionByName(each)


def _written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """As ``cut``, in less space and in a folder for each value of ``by``."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _bytes(got: DataFrame) -> DataFrame:
    return got.withColumns({c: F.unhex(c) for c in ("digest", "shared")}).select("node", "digest", "component", "shared")


def _off_cycles(df: DataFrame) -> DataFrame:
    return df.withColumns({"component": F.lit(None).cast("string"), "shared": F.lit(None).cast("binary")})


def _set_aside(first: DataFrame, path: str, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """The core and the layers of nodes, the first layer at the top; first (part, node, deps, ..), the first step. A layer is led to by those
    above it alone, and what the core leads to is in the core."""
    layers, left = [], first
    for step in range(1, most + 1):
        n = {r["part"]: r["count"] for r in left.where(F.col("part") != _GONE).groupBy("part").count().collect()}
        layers.append(left.where(F.col("part") == _LAYER).drop("part"))
        left = left.where(F.col("part") == _INNER).drop("part")
        if not n.get(_INNER) or n.get(_LAYER, 0) < LAYER * sum(n.values()):
            break
        used = left.select(F.explode("deps").alias("node")).distinct().withColumn("used", F.lit(True))
        left = _written(left.join(used, "node", "left").withColumn("part", F.when(F.col("used"), _INNER).otherwise(_LAYER)).drop("used"), f"{path}/{step}", "part")
    return left, layers


def _used(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dep").alias("node")).distinct().withColumn("used", F.lit(True))


def _over(layer: DataFrame, known: DataFrame) -> DataFrame:
    """The layer (node, own, deps, ..) with its digest, given known (node, digest, shared) of all that it leads to and that is a node.
    Digests are in bytes. A component counts once, by the digest that its members share; a last byte marks it."""
    links = layer.select("node", F.explode("deps").alias("dep"))
    missing = F.unhex(F.sha2(F.concat(F.lit("missing\n"), "dep"), 256))
    counts = F.coalesce(F.concat("shared", F.lit(b"\1")), "digest").alias("counts")
    below = links.join(known.select(F.col("node").alias("dep"), counts), "dep", "left").select("node", F.coalesce("counts", missing).alias("below"))
    # Dealt out before they are collected: a task has few digests of one node, so collecting them earlier saves nothing.
    got = below.repartition("node").groupBy("node").agg(F.collect_list("below").alias("below"))
    every = F.coalesce("below", F.array().cast("array<binary>"))
    single, shared = F.filter(every, lambda x: F.length(x) == 32), F.array_distinct(F.filter(every, lambda x: F.length(x) > 32))
    each = F.concat(F.transform(single, _hex), F.transform(shared, lambda x: _hex(F.substring(x, 1, 32))))
    return layer.join(got, "node", "left").withColumn("digest", F.unhex(_covered(F.col("own"), each))).drop("below")


def digests(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, own, deps, digest, component, shared) of all nodes; on a cycle, the component's greatest node and the digest that its members share."""
    spark: SparkSession = nodes.sparkSession
    path = checkpoint_path(spark)
    first = described(nodes.where("node is not null"), edges).join(_used(edges), "node", "left").withColumn("part", F.when(F.col("used"), _INNER).otherwise(_LAYER)).drop("used")
    core, layers = _set_aside(_written(first, f"{path}/nodes", "part"), f"{path}/layers", most)
    got = _digested(core, spark.createDataFrame([], "node string, digest string"), f"{path}/work", most)
    known = _written(core.join(_bytes(got), "node"), f"{path}/out/core")
    done = [f"{path}/out/core"]
    for i, layer in reversed([*enumerate(layers)]):
        done.append(f"{path}/out/{i}")
        _written(_off_cycles(_over(layer, known)), done[-1])
        known = spark.read.schema(known.schema).parquet(*done)
    for part in ("work", "nodes", "layers"):
        remove(spark, f"{path}/{part}")
    return known.withColumns({c: _hex(F.col(c)) for c in ("digest", "shared")})


def refresh(nodes: DataFrame, edges: DataFrame, before: DataFrame, most: int = 1000) -> DataFrame:
    """(node, own, deps, digest, component, shared, recomputed, stale) from digests that were made before: a node is recomputed if it, or anything it
    leads to, is new, gone or defined in another way, and stale if its digest is another than before (or there was none)."""
    spark = nodes.sparkSession
    path = checkpoint_path(spark)
    every = described(nodes.where("node is not null"), edges)
    old = before.select("node", F.col("own").alias("o"), F.col("deps").alias("d"), F.unhex("digest").alias("old"), "component", F.unhex("shared").alias("shared"))
    both = every.join(old, "node", "full").join(_used(edges), "node", "left")
    same = F.col("old").isNotNull() & F.col("own").eqNullSafe(F.col("o")) & F.col("deps").eqNullSafe(F.col("d"))
    part = F.when(F.col("deps").isNull(), _GONE).when(F.col("used"), _INNER).otherwise(_LAYER)
    both = _written(both.select("node", "own", "deps", "old", "component", "shared", (~same).alias("changed"), part.alias("part")), f"{path}/nodes", "part")
    core, layers = _set_aside(both, f"{path}/layers", most)
    # In the core, the cone is walked; those that stay are known by their old digest.
    gone = both.where(F.col("part") == _GONE).select("node")
    up = core.select(F.explode("deps").alias("a"), F.col("node").alias("b"))
    cone = cut(_reach(up, core.where("changed").select("node").union(gone), f"{path}/cone", most), f"{path}/changed/core")
    todo = core.join(cone, "node", "left_semi").select("node", "own", "deps", "old")
    as_known = ["node", F.col("old").alias("digest"), "component", "shared"]
    known = _written(core.join(cone, "node", "left_anti").select(*as_known), f"{path}/known/core")
    # Dependencies in components that stay count by these.
    unit = F.concat(F.lit("component "), "component")
    members = known.where("component is not null").select(F.col("node").alias("dep"), unit.alias("to"))
    deps = todo.select("node", F.explode("deps").alias("dep")).join(members, "dep", "left").groupBy("node").agg(F.collect_set(F.coalesce("to", "dep")).alias("deps"))
    units = known.where("component is not null").select(unit.alias("node"), _hex(F.col("shared")).alias("digest")).distinct()
    held = known.where("component is null").select("node", _hex(F.col("digest")).alias("digest")).union(units)
    got = _digested(todo.select("node", "own").join(deps, "node", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>"))), held, f"{path}/work", most)
    new = _written(todo.join(_bytes(got), "node"), f"{path}/new/core")
    done, stay = [f"{path}/new/core"], [f"{path}/known/core"]
    for i, layer in reversed([*enumerate(layers)]):
        # A layer is reached by one step from all below it.
        met = layer.select("node", F.explode("deps").alias("dep")).join(cone.select(F.col("node").alias("dep")), "dep", "left_semi").select("node")
        hit = cut(met.union(layer.where("changed").select("node")).distinct(), f"{path}/changed/{i}")
        below = known.union(new.select(*known.columns))
        done.append(f"{path}/new/{i}")
        _written(_off_cycles(_over(layer.join(hit, "node", "left_semi").select("node", "own", "deps", "old"), below)), done[-1])
        if i:
            stay.append(f"{path}/known/{i}")
            _written(layer.join(hit, "node", "left_anti").select(*as_known), stay[-1])
        cone = spark.read.schema("node string").parquet(*[f"{path}/changed/{j}" for j in ("core", *range(i, len(layers)))])
        new, known = spark.read.schema(new.schema).parquet(*done), spark.read.schema(known.schema).parquet(*stay)
    for part_ in ("work", "layers", "cone", "changed", "known"):
        remove(spark, f"{path}/{part_}")
    kept = both.where(F.col("part") != _GONE).join(new.select("node"), "node", "left_anti").select("node", "own", "deps", F.col("old").alias("digest"), "component", "shared", F.lit(False).alias("recomputed"), F.lit(False).alias("stale"))
    made = new.select("node", "own", "deps", "digest", "component", "shared", F.lit(True).alias("recomputed"), F.coalesce(F.col("old") != F.col("digest"), F.lit(True)).alias("stale"))
    return kept.union(made).withColumns({c: _hex(F.col(c)) for c in ("digest", "shared")})
