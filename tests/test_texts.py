import re
import numpy as np
from pyspark.sql import functions as F

from semlake import schemas
from semlake.functions import terms, text
from semlake.operators import records


def test_digests_notice_content_and_ignore_variable_names(spark):
    df = spark.createDataFrame([("f/3 ?x/0 ?y/0 ?x/0",), ("f/3 ?b/0 ?a/0 ?b/0",), ("f/3 ?b/0 ?a/0 ?a/0",), ("f/3 ?b/0",)], "t string")
    a, b, c, d = (r[0] for r in df.select(terms.alpha_digest(F.col("t"))).collect())
    assert a == b and c != a and len(a) == 32 and d is None
    one = lambda *x: spark.range(1).select(text.entity_digest(F.lit(1), *x)).first()[0]
    none = F.lit(None).cast("string")
    assert len({one(F.lit("a"), F.lit("b")), one(F.lit("ab"), F.lit("")), one(F.lit("a"), none), one(none, F.lit("a"))}) == 4
    deps = spark.range(1).select(text.dependencies(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a")))).first()[0]
    assert deps == ["a", "b"]


def test_shrink_drops_lines_from_the_front(spark):
    pieces = lambda s: re.findall(r"\S+|\s", s)
    texts = ["a b c", None, "", "###Premises\na b\nc d\n###Conclusion\ne", "###P\n\na b c d e f\ng\n\n###C\nh i", "x " * 40, "###only a heading that is far too long for the limit", "a\nb\nc\nd\ne\nf\ng\nh"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (1, 4, 7, 9, 30):

        def want(t, goal):
            if t is None or len(pieces(t)) <= limit:
                return t
            for n in range(1, t.count("\n") + 2) if goal else ():  # drop what can go of the first n lines
                head, rest = t.split("\n")[:n], t.split("\n")[n:]
                gone = [x for x in head if x and not x.startswith("###")]
                if head[-1] in gone[-1:] and len(pieces(t)) - sum(len(pieces(x)) for x in gone) <= limit:
                    return "\n".join([x for x in head if not x or x.startswith("###")] + rest)
            return "".join(pieces(t)[:limit])

        for goal in (True, False):
            got = {r.i: r.shrunk for r in text.shrink(df, "t", pieces, limit, goal).collect()}
            assert got == {i: want(t, goal) for i, t in enumerate(texts)}


def test_float32_vectors_are_migrated(spark):
    v = np.array([3.0, 4.0], "<f4")
    rows = [("m", bytearray(b"a"), bytearray(v.tobytes())), ("m", bytearray(b"b"), bytearray(np.array([1, -2], "<i2").tobytes())), ("m", bytearray(b"c"), bytearray(b"123"))]
    out, counts = records.migrate_float32(spark.createDataFrame(rows, "model string, key binary, value binary"), 2)
    got = {bytes(r.key): list(r.q) for r in out.collect()}
    assert got == {b"a": [round(0.95 * 0.6 * 32768), round(0.95 * 0.8 * 32768)], b"b": [1, -2]}
    assert {r.state: r.n for r in counts.collect()} == {"keep": 1, "unmigrated": 1, "wrong": 1}


def test_cached_split(spark):
    recs = spark.createDataFrame([(bytearray(b"a"), 1, "a", "x", "i", None, None, None, None), (bytearray(b"b"), 1, "b", "y", None, None, None, None, None)], schemas.RECORDS)
    entries = spark.createDataFrame([(bytearray(b"a"), "z"), (bytearray(b"b"), "y"), (bytearray(b"c"), "w")], "key binary, expr string")
    cached, todo, stale = records.split_cached(entries, recs)
    keys = lambda df: sorted(bytes(r.key) for r in df.collect())
    assert (keys(cached), keys(todo), keys(stale)) == ([b"a"], [b"b", b"c"], [b"a"])
    assert keys(records.unanswered(entries, recs)) == [b"b", b"c"]


def test_hit_rate_cuts_a_document_once(spark):
    from semlake.operators import filters
    from semlake.plans import texts

    rows = [(["the and", "a.b x", "", "no"], "x the, and a.b"), (["a"], None), ([None, "a"], "a b"), (["a"], "ab"), (["a b"], "ab b"), ([""], ""), ([""], None), (None, "x")]
    df = spark.createDataFrame(rows, "p array<string>, d string")
    assert [r.rate for r in df.select(filters.hit_rate(F.col("p"), F.col("d")).alias("rate")).collect()] == [0.75, 0, 0.5, 0, 0, 1, 0, None]
    plan = texts.token_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(text") == 1
