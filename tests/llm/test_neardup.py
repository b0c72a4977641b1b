import random

import numpy as np

import corpus_pipeline
from semlake.llm import neardup as nd
from semlake.llm.components import components
from tests.llm import helpers


def words(t):
    low = (t or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (size, component) by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if i is not None and j is not None and s and r and 100 * len(s & r) >= 85 * len(s | r):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def corpus(seed, n):
    """Chains of edits of a few long texts: near copies of near copies, some just under the threshold."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [[rnd.choice(vocab) for _ in range(rnd.choice((3, 12, 120, 300)))] for _ in range(6)]
    while len(out) < n:
        w = list(rnd.choice(out[-40:]))
        for _ in range(rnd.choice((0, 1, 1, 2, 3, 6))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(w)
    return [" ".join(w) if k % 3 else "  ".join(w).upper() for k, w in enumerate(out)]


def test_equals_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)  # many blocks in the larger buckets
    rows = list(enumerate([*corpus(5, 160), None, "", " \n", "one two", "ONE two", "one two three"]))
    d = helpers.write(spark, tmp_path, helpers.table(spark, [t for _, t in rows]))
    out = nd.op2_near_dedup(spark, d).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_edges(spark):
    got = {(r.doc_id, r.nd_shingles, r.nd_component) for r in nd.classes(helpers.edge(spark)).collect()}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (4, 11, 4), (5, 1, 5), (None, 1, None)} <= got
    assert nd.classes(helpers.empty(spark)).collect() == []
    kept = nd.near_dedup(helpers.edge(spark).unionByName(helpers.table(spark, [helpers.SENTENCE, "A NULL id"], [9, 10])))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 4, 5, 10]
    assert kept.where("doc_id is null").count() == 1 and kept.columns == helpers.edge(spark).columns


def test_stage_links_from_eighty_percent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rnd = random.Random(11)
    texts = []
    for base in range(24):
        # Each text has lost the first words of the one before: similarity (n - cut) / n of neighbours, less beyond.
        w = [f"b{base}x{rnd.randrange(10**6)}" for _ in range(204)]
        cut = rnd.choice((33, 36, 39, 42, 48))
        texts += [" ".join(w), " ".join(w[cut:]), " ".join(w[cut + (len(w) - cut) // 6 :])]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    shares = [100 * len(a & b) / len(a | b) for a, b in zip(sets, sets[1:], strict=False)]
    assert sum(80 <= s < 85 for s in shares) > 20 and any(70 < s < 80 for s in shares)
    for j in range(len(sets)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    docs = helpers.table(spark, texts)
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert kept == {i for i, r in enumerate(root) if i == r}
    assert nd.near_dedup(docs, 85).count() > len(kept)
    # The query keeps its own threshold.
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.op2_near_dedup(spark, helpers.write(spark, tmp_path, docs)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[100:], rnd.integers(0, 2**63, 100, dtype=np.uint64)]))
    same = (nd.signature(a) == nd.signature(b)).mean()
    assert abs(same - 900 / 1100) < 0.12
    assert (nd.signature(a) == nd.signature(a[::-1].copy())).all()


def test_blocks_report_a_forest():
    s = [np.arange(100, dtype=np.uint64) + np.uint64(i) for i in range(20)]
    links = nd.block_links([np.arange(20)], [np.arange(20)], [s])
    assert len(links) == 19
    links = nd.block_links([np.arange(10), np.arange(10, 20)], [np.zeros(10, int), np.ones(10, int)], [s[:10], s[10:]])
    assert len(links) == 1


def test_components(spark, tmp_path):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), f"file://{tmp_path}/cc").collect()}
    assert got == want
