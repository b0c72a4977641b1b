"""Predicates and texts, each against plain values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from semlake.functions import text
from semlake.operators import filters, joins, rank, records
from semlake.sources import entities


def test_infra_facts(spark):
    flags = ["concealed", "hidden", "inaccessible", "infra_module", "declared", "mentions", "adt", "inductive"]
    rows = [("A.x", None, 5, False), *[("A.x", f, 5, f not in ("adt", "inductive")) for f in flags], ("A.x_def", "adt", 5, True), ("A.x_def", "inductive", 5, True), ("A.cong", "inductive", 5, True), ("A.cong", "adt", 5, False), ("A.big", None, 1001, True), ("A.even", None, 1000, False)]
    df = spark.createDataFrame([(n, f or "", s, w) for n, f, s, w in rows], "name string, flag string, size int, want boolean")
    got = filters.is_infra_fact(F.col("name"), *[F.col("flag") == f for f in flags], F.col("size"))
    assert df.where(got != F.col("want")).count() == 0
    ind = df.select(filters.is_infra_induction(F.lit("Basic_BNFs.x"), F.lit(False)), filters.is_infra_induction(F.lit("A.x"), F.lit(True)), filters.is_infra_induction(F.lit("A.x"), F.lit(False))).first()
    assert tuple(ind) == (True, True, False)


def test_updates_are_due(spark):
    at = dt.datetime(2024, 1, 2)
    rows = [(True, at - dt.timedelta(hours=2), "a", "b", True), (True, at - dt.timedelta(minutes=2), "a", "b", False), (True, None, "a", "b", True), (False, None, "a", "b", False), (True, None, "a", "a", False), (True, None, None, "b", True)]
    df = spark.createDataFrame([(*r[:2], at, *r[2:]) for r in rows], "auto boolean, last timestamp, now timestamp, etag string, remote string, want boolean")
    assert df.where(filters.update_due(F.col("auto"), F.col("last"), F.col("now"), 3600, F.col("etag"), F.col("remote")) != F.col("want")).count() == 0


def test_tables_of_entities(spark):
    df = spark.createDataFrame([("A", 1, "x", b"1"), ("A", 2, "y", b"2"), ("B", 1, "x", b"3")], "module string, kind int, name string, key binary")
    assert [r.name for r in entities.declared_in(df, "A").orderBy("name").collect()] == ["x", "y"] and entities.declared_in(df, "A", 2).count() == 1
    axioms = spark.createDataFrame([("x", "A", "ax1"), ("x", "C", "ax2"), ("y", "A", "ax3")], "name string, module string, axiom string")
    assert sorted(r.axiom for r in joins.own_definitions(df, axioms).collect()) == ["ax1", "ax3"]
    assert [r.name for r in rank.dedup_against(df, df.where("kind = 1"), "key").collect()] == ["y"]
    sources = spark.createDataFrame([("a.thy", "d1", 1), ("a.ML", "d2", 1)], "name string, digest string, big int")
    assert [tuple(r) for r in entities.session_sources(sources).collect()] == [("a.thy", "d1")]
    keys = spark.createDataFrame([(bytes(16) + bytes([k]) + bytes(15),) for k in (8, 1, 0x12)] + [(b"short",)], "key binary")
    assert records.purge_xor_kinds(keys, [8, 0x12]).count() == 2


def test_texts(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(text.sanitize_model(F.lit("a/b")), text.restore_model(F.lit("a__b"))) == ("a__b", "a/b")
    assert one(text.strip_trailing_begin(F.lit("theory X\nbegin \n")), text.strip_trailing_begin(F.lit("begin"))) == ("theory X", "begin")
    assert one(text.strip_lone_surrogates(F.lit("a😀b"))) == ("a😀b",)
    assert one(text.agent_label(F.lit("lemma"), F.lit("x")), text.agent_label(F.lit(None).cast("string"), F.lit("x"))) == ("lemma x", "unknown x")
    assert one(text.encode_fact(F.array(F.lit("v")), F.lit("s"))) == ("###Variables\nv\n\n###Statement\ns",)
    assert one(text.within_limit(F.lit("t"), F.lit(13), 10, "H")) == ("#H\nt",)
    with pytest.raises(Exception, match="more than 10 tokens"):
        one(text.within_limit(F.lit("t"), F.lit(14), 10, "H"))
    assert one(text.dependencies(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a")))) == (["a", "b"],)
    a, b = one(text.entity_digest(F.lit(1), F.lit(""), F.lit("x")), text.entity_digest(F.lit(1), F.lit(None), F.lit("x")))
    assert a != b
