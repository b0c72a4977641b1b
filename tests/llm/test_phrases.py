import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from semlake.llm import phrases as ph
from tests.llm import helpers

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        mine = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) == 3 and p in (q[:2], q[1:]) and b >= least and 100 * b >= 50 * a for q, b in count.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            mine.append((" ".join(p), a, l, r, n[lang], score))
        mine.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *m) for i, m in enumerate(mine[:top], 1)]
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    common = ["The", "of", "and", "a", "É", "a"]
    rare = [f"word{i}" for i in range(25)]
    fixed = ["New York City", "machine learning", "a a a", "of the", "ice\tcream", "San  Francisco bay"]
    out = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(common if rnd.random() < 0.6 else rare) for _ in range(rnd.randrange(1, 60))]
        out.append(("".join(p + rnd.choice([" ", " ", " ", ", ", ". ", "\n", "\r", "  "]) for p in parts), rnd.choice(["en", "en", "de", None, ""])))
    return [*out, (None, "en"), ("", "de"), (" \t. ", None), (helpers.LONG, "en"), (helpers.LONG, "en"), ("x" * 5000 + " y", "xx")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, n int")


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("case", ["whole table", "small table", "dealt out", "no table"])
def test_equals_counting(spark, monkeypatch, case):
    rows = corpus(7, 120)
    most = {"whole table": None, "small table": 6, "dealt out": 12, "no table": 0}[case]
    if case != "whole table":
        monkeypatch.setattr(ph, "PLACE", 200)
    if case in ("dealt out", "no table"):
        monkeypatch.setattr(ph, "SPLIT", 30)
        monkeypatch.setattr(ph, "DENSE", 4)
    monkeypatch.setattr(ph, "STEP_BYTES", 2000)
    want = plain(rows, top=40)
    assert got(ph.phrases(frame(spark, rows), top=40, most=most)) == want
    assert {w[0] for w in want} >= {"en", "de", "und", ""} and len(want) > 60


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{d}/documents.parquet')")
    want = sorted(con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({ph.OP12_SQL})").fetchall())
    assert got(ph.op12_phrases(spark, d)) == want and len(want) > 100


def test_fragments_hold_each_gram_once():
    rnd = random.Random(3)
    for _ in range(50):
        ids = np.array([rnd.choice([-1, 0, 1, 2, 3, 1 << 62]) for _ in range(rnd.randrange(1, 30))], np.int64)
        five, n = ph.combine(ph.fragments(ids))
        if not five.shape[1]:
            continue
        grams, count = ph.mine(five, n)
        have = {tuple(x for x in g if x >= 0): c for g, c in zip(grams.T.tolist(), count.tolist(), strict=True)}
        want = Counter(tuple(ids[i : i + k].tolist()) for k in (2, 3) for i in range(len(ids) - k + 1) if (ids[i : i + k] >= 0).all())
        assert have == want


def test_scores_beyond_64_bits(spark):
    a, big = 3_000_000_017, 9_000_000_000_123
    words = spark.createDataFrame([("en", i, f"w{i}", big + i) for i in range(3)], "lang string, id bigint, word string, n bigint")
    found = spark.createDataFrame([("en", 0, 1, -1, a)], "lang string, w1 bigint, w2 bigint, w3 bigint, a bigint")
    assert ph.scored(found, words).first().score == 10**6 * a * a // (big * (big + 1))
    near = spark.createDataFrame([("en", 0, 1, -1, big)], "lang string, w1 bigint, w2 bigint, w3 bigint, a bigint")
    assert ph.scored(near, words).first().score == 10**6 * big * big // (big * (big + 1)) == 999_999


def test_edges(spark):
    assert ph.phrases(frame(spark, [])).count() == 0
    assert ph.phrases(frame(spark, [(None, None), ("", "en"), (" . ", "en")])).count() == 0
