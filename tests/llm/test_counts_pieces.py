import hashlib
import random
from itertools import pairwise

import numpy as np
import pytest
import sentencepiece

from semlake.llm import common, counts, pieces
from semlake.llm.common import IntTable
from tests.llm import helpers


def brute(counter, token):
    token = counts.SPACE + token
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        char = token[end - 1]
        n = 1 if char in counter.score else len(char.encode())
        found = [(best[-1][0] + (counter.score[char] if char in counter.score else n * counter.least), -(n - best[-1][1]))]
        found += [(best[s][0] + counter.score[token[s:end]], -(1 - best[s][1])) for s in range(end - 1) if token[s:end] in counter.score]
        best.append(max(found))
    return -best[-1][1]


def test_trie_equals_plain_dynamic_programming():
    counter, rnd = counts.TrieCounter(counts.default_model()), random.Random(4)
    tokens = {"".join(rnd.choice("theandñ日ing\no▁") for _ in range(rnd.randint(0, 14))) for _ in range(3000)}
    assert all(brute(counter, t) == n for t, n in counter.terminals(tokens))


def test_counts_on_edge_cases(spark, monkeypatch):
    rows = {(r.doc_id, r.tc_pretokens, r.tc_tokens) for r in counts.count_tokens(helpers.edge(spark)).collect()}
    assert {(0, 0, 0), (1, 0, 0)} <= rows
    assert len(counts.count_tokens(helpers.edge(spark)).collect()) == 8
    assert counts.count_tokens(helpers.empty(spark)).collect() == []
    counter = counts.TrieCounter(counts.default_model())
    want = counter.count(["a b", "the the thing", helpers.LONG])
    monkeypatch.setattr(counts, "STORED", 3)
    assert [counter.count([t])[0] for t in ("a b", "the the thing", helpers.LONG)] == want


def test_backtracking_equals_the_library(monkeypatch):
    coder, rnd = pieces.BacktrackEncoder(pieces.default_model()), random.Random(5)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    vocab = sorted(coder.pieces)
    texts = [" " * 50, "a" * 3000, "日" * 800 + "ab" * 800, "▁▁x y", "\x00", "é́Ａ𝔘", helpers.LONG, "", "\n\n a\n", "a\n b  c\n", "\n▁"]
    texts += ["".join(rnd.choice("aabbcdehinorst e▁ \n\t.éñ日本𝔘x019<>/") for _ in range(rnd.randint(0, 30))) for _ in range(6000)]
    texts += ["".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 6))) for _ in range(3000)]
    want = [[*sp.encode(t), 2] for t in texts]
    for few, step in ((pieces.FEW, 500), (1 << 30, 500), (0, 2000)):  # together, and one by one
        monkeypatch.setattr(pieces, "FEW", few)
        coder.store.clear()
        for i in range(0, len(texts), step):
            ids, bounds = coder.encode(texts[i : i + step])
            got = [ids[a:b].tolist() for a, b in pairwise(bounds.tolist())]
            assert got == want[i : i + step]
    assert [coder.decode(x) for x in want] == [sp.decode(x) for x in want]


def test_pairs_equal_merging_anew():
    coder, rnd = pieces.BacktrackEncoder(pieces.default_model()), random.Random(6)
    pairs = [(rnd.randrange(coder.n), rnd.randrange(coder.n)) for _ in range(8000)]
    # Cutting a piece in two gives pairs that are likely to merge.
    for p in rnd.sample(coder.pieces, 4000):
        for q in rnd.sample(coder.pieces, 1):
            text = p + q
            pairs += [(coder.rank[text[:k]], coder.rank[text[k:]]) for k in range(1, len(text)) if text[:k] in coder.rank and text[k:] in coder.rank]
    a, b = np.array(pairs).T
    want = [pieces.remerge(coder.pieces[x] + coder.pieces[y], coder.score)[0] == [coder.pieces[x], coder.pieces[y]] for x, y in pairs]
    assert coder.fit(a, b).tolist() == want and coder.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_automaton_gives_the_longest_pattern_at_each_place(monkeypatch):
    rnd = random.Random(7)
    for window in (3, 64):
        monkeypatch.setattr(pieces.Automaton, "WINDOW", window)
        for _ in range(60):
            patterns = [list(p) for p in {tuple(rnd.randrange(3) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))}]
            text = [rnd.randrange(4) for _ in range(rnd.randint(1, 200))]
            got = pieces.Automaton(patterns, 4).longest(np.array(text)).tolist()
            for i, number in enumerate(got):
                fit = [p for p in patterns if text[i : i + len(p)] == p[::-1]]
                assert (patterns[number] if number >= 0 else None) == max(fit, key=len, default=None)


def test_table_starts_afresh_when_full():
    make = lambda words: (np.array([len(w) for w in words for _ in w]), np.array([len(w) for w in words]))
    held = common.WordIds(make, 5, 9)
    for texts in ([["a", "bb", None], [None]], [["bb", "ccc", "a"], []], [["dddd", "e", "bb", None]], [], [[]]):
        ids, bounds = held.look_up(texts)
        assert [ids[a:b].tolist() for a, b in pairwise(bounds.tolist())] == [[x for w in t for x in ([9] if w is None else [len(w)] * len(w))] for t in texts]
        assert len(held.number) <= 6


def test_pieces_query_on_edge_cases(spark, tmp_path):
    d = helpers.write(spark, tmp_path, helpers.edge(spark))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op10_sentencepiece(spark, d).collect()}
    one, nothing = hashlib.sha256(b"2").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert {(0, 1, one, nothing), (1, 1, one, nothing)} <= got
    assert pieces.encode_documents(helpers.empty(spark)).collect() == []
    out = pieces.encode_documents(helpers.table(spark, ["the thing"])).first()
    assert out.sp_decoded == "the thing" and out.sp_ids[-1] == 2 and out.pos == 1


@pytest.mark.parametrize("case", ["small", "large values", "large keys", "negative keys", "one value too large", "empty"])
def test_tables_of_integers_hold_what_was_put_in(case):
    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 1 << 40, 3000))
    values = rnd.integers(0, 1 << 20, len(keys))
    if case == "large values":
        values += 1 << 33
    elif case == "one value too large":
        values[7] = 1 << 20
    elif case == "large keys":
        keys[-5:] = (1 << 44) + np.arange(5)
    elif case == "negative keys":
        keys -= 1 << 39
    elif case == "empty":
        keys, values = keys[:0], values[:0]
    t = IntTable(keys, values, -1)
    assert (t.get(keys) == values).all()
    asked = np.unique(np.concatenate([keys, keys + 1, np.arange(50)]))
    held = dict(zip(keys.tolist(), values.tolist(), strict=True))
    assert t.get(asked).tolist() == [held.get(k, -1) for k in asked.tolist()]
    assert t.get(asked[:0]).tolist() == []
