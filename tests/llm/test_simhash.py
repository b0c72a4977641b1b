import random
import re

import numpy as np
import pytest
import xxhash

from semlake.llm import simhash as sh
from tests.llm import helpers


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """The component of each row: the position of its first row."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ÀÉ", "ok"]
    out = [[rnd.choice(vocab) for _ in range(rnd.choice((2, 9, 60, 1200)))] for _ in range(8)]
    while len(out) < n:
        w = list(rnd.choice(out[-30:]))
        for _ in range(rnd.choice((0, 1, 1, 2, 4))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(w)
    return [" ".join(w) if k % 3 else " \t".join(w).upper() for k, w in enumerate(out)]


def test_equals_all_pairs(spark, tmp_path):
    rows = list(enumerate([*texts(3, 150), None, "", " \n", "one two", "ONE two", "a b c d", "a b c d e", helpers.LONG, helpers.LONG + " x"]))
    prints = [plain_print(t) for _, t in rows]
    d = helpers.write(spark, tmp_path, helpers.table(spark, [t for _, t in rows]))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op11_simhash(spark, d).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute(prints), strict=True)}
    assert len({c for _, c in got.values()}) < len(got) - 20


@pytest.mark.parametrize("chunk", [4, 64])
def test_many_chunks(spark, tmp_path, monkeypatch, chunk):
    """A ball of near fingerprints and some that are five bits away, all in the same buckets, in very small chunks."""
    monkeypatch.setattr(sh, "CHUNK", chunk)
    rnd = random.Random(chunk)
    centre = rnd.getrandbits(64)
    prints = list({centre ^ sum(1 << b for b in rnd.sample(range(20, 64), rnd.choice((1, 3, 5, 7)))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    path = f"file://{tmp_path}/x"
    found = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in sh.fingerprint_components(df, path).collect()}
    want: dict[int, set[int]] = {}
    for p, c in zip(prints, brute(prints), strict=True):
        want.setdefault(c, set()).add(p)
    have: dict[int, set[int]] = {}
    for p in prints:
        have.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_bit_slices():
    rnd = np.random.default_rng(5)
    fp = rnd.integers(0, 2**64, 200, dtype=np.uint64)
    fp[100:] = fp[:100] ^ (np.uint64(1) << rnd.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 100).astype(np.uint64))
    for radius in (0, 1, 4, 7):
        of = sh.planes(fp)
        for i in range(0, 200, 7):
            hit = sh.close(np.repeat(fp[i : i + 1], 4), of, np.arange(4), np.full(4, 2**64 - 1, np.uint64), radius)
            lanes = np.unpackbits(hit.view(np.uint8), bitorder="little")[:200]
            assert (lanes == (np.bitwise_count(fp ^ fp[i]) <= radius)).all()


def test_every_number_of_parts_is_exact():
    rnd = random.Random(1)
    for count in (10, 10**6, 10**9, 10**12):
        m, masks = sh.parts_for(count)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a ^ sum(1 << i for i in rnd.sample(range(64), 4))
            assert any((a ^ b) & mask & (2**64 - 1) == 0 for mask in masks)
    assert [sh.parts_for(c)[0] for c in (10, 10**6, 10**9, 10**12)] == [1, 2, 3, 4]


def test_edges(spark):
    out = sh.classes(helpers.edge(spark)).collect()
    assert len(out) == 8
    of = {r.doc_id: (r.sh_print, r.sh_component) for r in out}
    assert of[0] == of[1] == of[2] == (0, 0)
    null = next(r for r in out if r.doc_id is None)
    assert null.sh_print & (2**64 - 1) == plain_print("a null id") and null.sh_component is None
    assert sh.classes(helpers.empty(spark)).count() == 0
    again = sh.classes(helpers.table(spark, ["same text here now", "same text here now", "other words in this"], [None, 7, 7])).collect()
    assert sorted((r.sh_component is None, r.sh_component) for r in again) == [(False, 7)] * 3


def test_clashing_columns(spark):
    docs = helpers.edge(spark)
    out = sh.with_simhash(docs.selectExpr("*", "1 AS sh", "2 AS fp"))
    assert sorted(out.columns) == sorted([*docs.columns, "sh", "fp"]) and {r.fp for r in out.collect()} == {2}
