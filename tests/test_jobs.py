import random

import pytest
from pyspark.sql import functions as F

from semlake.operators import description, enumeration
from semlake.schemas import INDUCTION, INTRODUCTION
from semlake.sources.store import Store


def key(i, module=0):
    return bytearray(bytes([module]) * 16 + b"\2" + i.to_bytes(15, "big"))


def test_bitmaps_have_no_false_negatives(spark):
    held = spark.range(3000).select(F.col("id").alias("module"), F.col("id").alias("key"))
    bits = 48_000
    made = enumeration.bitmap(held, ["module", "key"], bits)
    every = spark.range(6000).select(F.col("id").alias("module"), F.col("id").alias("key"))
    out = enumeration.with_bit(every, ["module", "key"], made, bits).select("key", "_seen").collect()
    assert all(r._seen for r in out if r.key < 3000) and sum(r._seen for r in out) < 3600


@pytest.mark.parametrize("bits", [16, 1])
def test_new_members_equal_the_full_difference(spark, monkeypatch, bits):
    monkeypatch.setattr(enumeration, "BITS", bits)
    rnd = random.Random(6)
    parents = {1: [0], 2: [0], 3: [1, 2], 4: [3], 5: []}
    members = {m: {rnd.randrange(300) for _ in range(120)} for m in range(6)}
    rows = spark.createDataFrame([(m, k) for m, ks in members.items() for k in ks for _ in range(1 + k % 2)], "module int, key int")
    above = {m: set() for m in members}
    for m in sorted(parents):
        for p in parents[m]:
            above[m] |= {p} | above[p]
    up = spark.createDataFrame([(m, p) for m, ps in parents.items() for p in ps], "module int, parent int")
    assert {(r.module, r.ancestor) for r in enumeration.ancestors(up).collect()} == {(m, a) for m, s in above.items() for a in s}
    got = sorted((r.module, r.key) for r in enumeration.new_members(rows, up).collect())
    assert got == sorted((m, k) for m, ks in members.items() for k in ks if not any(k in members[a] for a in above[m]))


def test_updates_append_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    schema = "module string, key binary, name string, kind int, rule boolean"
    rows = [("A", key(1), "A.conjI", 2, False), ("A", key(2), "A.nat_induct", 2, True), ("A", key(3), "A.bad_induct", 2, False), ("B", key(1), "A.conjI", 2, False), ("B", key(9), "B.x", 2, False)]
    up = spark.createDataFrame([("B", "A")], "module string, parent string")
    shaped = F.col("rule")
    assert enumeration.update(store, spark.createDataFrame(rows, schema), up, shaped=shaped) == 6
    got = {(r.module, r.name, r.kind) for r in store.read("members").collect()}
    assert got == {("A", "A.conjI", 2), ("A", "A.conjI", INTRODUCTION), ("A", "A.nat_induct", 2), ("A", "A.nat_induct", INDUCTION), ("A", "A.bad_induct", 2), ("B", "B.x", 2)}
    before = store.head()[0]
    assert enumeration.update(store, spark.createDataFrame(rows, schema), up, shaped=shaped) == 0 and store.head()[0] == before
    more = [*rows, ("B", key(10), "B.y", 2, False)]
    assert enumeration.update(store, spark.createDataFrame(more, schema), up, shaped=shaped) == 1 and store.read("members").count() == 7


def entries(spark, n):
    return spark.createDataFrame([(key(i), f"e{i}", i) for i in range(n)], "key binary, label string, i int")


def test_descriptions_go_on_until_all_have_one(spark, tmp_path):
    store, asked = Store(spark, f"file://{tmp_path}/s"), []

    def answerer(left, round_):
        """Drops most, repeats and mislabels some, and breaks down in the third round."""
        asked.append(left.count())
        if len(asked) == 3:
            raise OSError("lost")
        some = left.orderBy("i").limit(5)
        return some.select("label", F.lit("old").alias("answer"), F.lit(1).alias("seq")).union(some.select("label", F.concat(F.lit("a"), "i"), F.lit(2))).union(left.select(F.concat(F.lit("no"), "label"), F.lit("x"), F.lit(3)))

    with pytest.raises(OSError, match="lost"):
        description.describe(store, entries(spark, 17), answerer)
    out = description.describe(store, entries(spark, 17), answerer).collect()
    assert sorted(r.answer for r in out) == sorted(f"a{i}" for i in range(17)) and asked == [17, 12, 7, 7, 2]
    assert description.describe(store, entries(spark, 17), answerer).count() == 17 and len(asked) == 5


def test_descriptions_that_stall_end_in_an_error(spark, tmp_path):
    store, rounds = Store(spark, f"file://{tmp_path}/s"), []

    def answerer(left, round_):
        rounds.append(round_)
        return left.where("i <> 3").select("label", F.lit("x").alias("answer"), F.lit(0).alias("seq"))

    with pytest.raises(description.Unanswered, match="1 entries have no answer after 4 rounds.*e3"):
        description.describe(store, entries(spark, 6), answerer, most_stalls=4)
    assert len(rounds) == 5 and store.read("answers").count() == 5
    twice = entries(spark, 2).withColumn("label", F.lit("same"))
    with pytest.raises(ValueError, match="two entries"):
        description.describe(store, twice, answerer)
    assert description.describe(Store(spark, f"file://{tmp_path}/n"), entries(spark, 1).limit(0), answerer).count() == 0
