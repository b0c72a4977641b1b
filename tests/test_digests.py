import hashlib
import random

import pytest
from pyspark.sql import functions as F

from semlake.operators import digests as dg


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tarjan(deps):
    """Components by plain reachability."""
    reach = {}
    for n in deps:
        seen, todo = set(), [n]
        while todo:
            for d in deps.get(todo.pop(), ()):
                if d in deps and d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[n] = seen
    return {n: frozenset([n, *(m for m in reach[n] if n in reach[m])]) for n in deps}, reach


def plain(own, deps):
    comp, _ = tarjan(deps)
    memo = {}

    def unit(c):
        if c not in memo:
            inner = {d for n in c for d in deps[n]} - c
            below = sorted({d if d not in deps else min(comp[d]): (digest(d) if len(comp.get(d, [d])) == 1 else unit(comp[d])) for d in inner}.values())
            mine = own[next(iter(c))] if len(c) == 1 else "\n".join(sorted(f"{n}={sha(own[n])}" for n in c))
            memo[c] = sha("\n".join([mine, "\n".join(below)]))
        return memo[c]

    def digest(n):
        if n not in deps:
            return sha(f"missing\n{n}")
        return unit(comp[n]) if len(comp[n]) == 1 else sha("\n".join([own[n], unit(comp[n])]))

    return {n: digest(n) for n in deps}


def frames(spark, own, deps):
    nodes = spark.createDataFrame(list(own.items()), "node string, own string")
    return nodes, spark.createDataFrame([(n, d) for n, ds in deps.items() for d in ds], "node string, dep string")


def graph(seed, n=40):
    rnd = random.Random(seed)
    deps = {f"n{i}": {f"n{rnd.randrange(max(1, i))}" for _ in range(rnd.randrange(3))} - {f"n{i}"} for i in range(n)}
    for a, b in ((3, 20), (20, 3), (10, 12), (12, 11), (11, 10), (25, 12), (10, 3), (30, 33), (33, 30)):  # components, one above another
        deps[f"n{a}"].add(f"n{b}")
    deps["n0"].add("outside")
    deps["n5"].add("n5")
    return {k: f"def {k}" for k in deps}, deps


@pytest.mark.parametrize("seed", [1])
def test_digests_and_refresh(spark, seed):
    own, deps = graph(seed)
    deps = {k: v - {k} for k, v in deps.items()}
    before = dg.digests(*frames(spark, own, deps))
    assert {r.node: r.digest for r in before.collect()} == plain(own, deps)
    comp, reach = tarjan(deps)
    assert max(map(len, comp.values())) > 1
    new_own, new_deps = dict(own), {k: set(v) for k, v in deps.items()}
    new_own["n30"] = "another"
    del new_own["n39"], new_deps["n39"]
    new_own["n99"], new_deps["n99"] = "new", {"n1"}
    after = dg.refresh(*frames(spark, new_own, new_deps), before).collect()
    want = plain(new_own, new_deps)
    assert {r.node: r.digest for r in after} == want
    old = plain(own, deps)
    assert {r.node for r in after if r.stale} == {n for n in want if want[n] != old.get(n)}
    cone = {n for n in new_deps if n in ("n30", "n99") or "n30" in tarjan(new_deps)[1][n] or "n39" in reach.get(n, ())}
    assert {r.node for r in after if r.recomputed} == cone and len(cone) < len(new_deps)
    assert not [r for r in after if r.stale and not r.recomputed]
    same = dg.refresh(*frames(spark, own, deps), before)
    assert same.where("recomputed or stale").count() == 0


def test_self_reference_and_empty(spark):
    nodes, edges = frames(spark, {"a": "x", "b": "y"}, {"a": {"a"}, "b": set()})
    out = {r.node: r.digest for r in dg.digests(nodes, edges).collect()}
    assert len(out) == 2
    assert dg.digests(nodes.limit(0), edges.limit(0)).count() == 0
    assert dg.components(edges.select(F.col("node").alias("a"), F.col("dep").alias("b")), dg.checkpoint_path(spark)).count() == 0


def test_components_that_stay_count_once_by_their_shared_digest(spark):
    own = {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5"}
    deps = {"a": {"b"}, "b": {"a"}, "c": {"a", "b"}, "d": {"c"}, "e": {"f"}, "f": {"e", "a", "b"}}
    own["f"] = "6"
    before = dg.digests(*frames(spark, own, deps))
    after = dg.refresh(*frames(spark, own | {"c": "another", "f": "too"}, deps), before)
    assert {r.node: r.digest for r in after.collect()} == plain(own | {"c": "another", "f": "too"}, deps)
    assert {r.node for r in after.where("recomputed").collect()} == {"c", "d", "e", "f"}


def test_nodes_nothing_depends_on_take_one_step(spark):
    """A chain of ten numbers and many that lead to its end: the many are in no step from level to level."""
    own = {f"c{i}": "x" for i in range(10)} | {f"t{i}": "y" for i in range(200)}
    deps = {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(10)} | {f"t{i}": {"c9"} for i in range(200)}
    nodes, edges = frames(spark, own, deps)
    every = dg.described(nodes, edges).join(dg._used(edges), "node", "left").withColumn("part", F.when(F.col("used"), 0).otherwise(1)).drop("used")
    core, layers = dg._set_aside(every, dg.checkpoint_path(spark), 100)
    assert layers[0].count() == 200 and core.count() + sum(x.count() for x in layers[1:]) == 10
    assert {r.node: r.digest for r in dg.digests(nodes, edges).collect()} == plain(own, deps)
