import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from semlake.llm import fingerprint as fp
from tests.llm import brute, helpers
from tests.llm.test_neardup import shingles


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.choice((0, 1, 4, 5, 9, 80, 900)))) for _ in range(60)] + [None, "", "𝔘 é ok", helpers.LONG]
    ids = rnd.sample(range(-500, 10_000), len(texts))
    d = helpers.write(spark, tmp_path, helpers.table(spark, texts, ids))
    got = {r.doc_id: r for r in fp.op8_fingerprints(spark, d).collect()}
    order = sorted(zip(ids, (t or "" for t in texts), strict=True))
    seen = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        small = max(len(shingles(t) | shingles(x)) for x in (edited, after)) <= fp.K
        for near, x in ((r.near_edited, edited), (r.near_next, after)):
            assert abs(near - jaccard(shingles(t), shingles(x))) <= (1e-9 if small else 0.2)
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert len([x for x in r.fingerprint.split(",") if x]) == min(fp.K, len(shingles(t)))


def test_edges(spark, tmp_path):
    rows = fp.op8_fingerprints(spark, helpers.write(spark, tmp_path / "a", helpers.edge(spark))).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[4]) == 2 and {r.near_next for r in by[4]} == {1.0, 0.0} and by[0][0].near_edited == 1.0
    assert fp.op8_fingerprints(spark, helpers.write(spark, tmp_path / "b", helpers.empty(spark))).collect() == []
    one = fp.op8_fingerprints(spark, helpers.write(spark, tmp_path / "c", helpers.table(spark, ["a b"]))).first()
    assert one.edited_sha256 == hashlib.sha256(b"a a").hexdigest() and one.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    whole = " ".join(f"w{i}" for i in range(4000))
    parts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(a, min(a + 504, 4000)))) for a in range(0, 3996, 500)], "g int, text string")
    merged = fp.merge_parts(fp.with_fingerprint(parts, "text", "fp"), "g", "fp").first().fp
    df = fp.with_fingerprint(spark.createDataFrame([(whole, " ".join(f"w{i}" for i in range(1000)))], "text string, part string"), "text", "a")
    df = fp.with_fingerprint(df, "part", "b")
    r = df.select("a", fp.distinct_shingles(F.col("a")).alias("n"), fp.containment(F.col("b"), F.col("a")).alias("in"), fp.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert merged == r.a == r.m and abs(r.n / 3996 - 1) < 0.35 and r["in"] > 0.6


def hashed(words):
    """Spark's xxhash64 of an array of strings: each element with the hash before it as seed, from 42."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints_hold_the_least_hashes(spark):
    rnd = random.Random(11)
    texts = [None, "", " \t", "One TWO three", "a b c d e", "É B c D e F", *(" ".join(f"w{rnd.randrange(n)}" for _ in range(n)) for n in (6, 130, 140, 900, 6000)), "x y " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.fp for r in fp.with_fingerprint(df, "t", "fp").collect()}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", (t or "").translate(brute.UPPER)) if x]
        runs = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
        assert got[i] == sorted(map(hashed, runs))[: fp.K], i
