import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from semlake.llm import align
from tests.llm import helpers


@pytest.fixture(scope="module")
def libraries():
    a, b = align.default_models()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b), {i: k for k, i in t.get_vocab().items()}


def plain(libraries, texts):
    """Whole texts by the libraries, all pairs of tokens by their ranges."""
    t, sp, names = libraries
    of = align.byte_alphabet()
    docs, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        sa = [bytes(of[c] for c in names[i]) for i in a]
        sb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(sa) != want or b"".join(sb) != want:
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([*map(len, sa)]), np.cumsum([*map(len, sb)])
        links = [(x, y) for x, ea, na in zip(a, ends_a, map(len, sa), strict=True) for y, eb, nb in zip(b, ends_b, map(len, sb), strict=True) if max(ea - na, eb - nb) < min(ea, eb)]
        counts.update(links)
        shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, last = [], 0
        for e in shared:
            groups.append(",".join(str(x) for x, n in zip(a, ends_a, strict=True) if last < n <= e) + "|" + ",".join(str(x) for x, n in zip(b, ends_b, strict=True) if last < n <= e))
            last = e
        docs.append((len(a), len(b), len(shared), links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*d[:3], len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]))
    return out, counts


def texts(seed, n):
    rnd = random.Random(seed)
    bits = ["the", "Straße", "naïve", "日本語", "🙂", "don't", "12345", "<|endoftext|>", "<s>", "<0x41>", "x_y", "...", "ﬁ", " ", "é", "é", "\x85", "　", "A" * 30, "\x00"]
    gaps = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\t", "   ", "", "\r\n", "  "]
    return ["".join(rnd.choice(bits) + rnd.choice(gaps) for _ in range(rnd.choice((1, 5, 30)))) for _ in range(n)]


CASES = [None, "", " ", "  ", " a", "a ", "a  ", "▁", "x ▁ y", "a▁b", "\n", " \n x", "x\n\n   y", "﻿ x", "ok", "ok"]


def test_equals_whole_texts(spark, tmp_path, libraries, monkeypatch):
    monkeypatch.setattr(align, "MEMORY", 60)  # units are forgotten many times
    given = [*CASES, *texts(1, 150)]
    d = helpers.write(spark, tmp_path, helpers.table(spark, given))
    want, _ = plain(libraries, given)
    got = {r.doc_id: r for r in align.op13_token_alignment(spark, d).collect()}
    assert len(got) == len(given)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6], given[i]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_shards_hold_the_counts(spark, tmp_path, libraries):
    given = texts(2, 60)
    docs = helpers.table(spark, given)
    counts = align.count_pairs(docs, f"file://{tmp_path}/counts")
    want, pairs = plain(libraries, given)
    keys = np.array(sorted(y << 32 | x for x, y in pairs), np.int64)
    shards = align.Shards(*counts[:3])
    assert len(counts.names) > 1
    assert shards.get(keys).tolist() == [pairs[(k & 0xFFFFFFFF, k >> 32)] for k in keys.tolist()]
    assert shards.get(np.sort(keys + 1))[~np.isin(np.sort(keys + 1), keys)].sum() == 0
    assert all(counts.best[y] == max(n for (_, b), n in pairs.items() if b == y) for _, y in pairs)
    out = align.align_documents(docs.withColumnRenamed("h", "al_n_a"), counts).orderBy("doc_id").collect()
    assert [r.al_groups for r in out] == [w[6] for w in want] and out[0].al_n_a == want[0][0]


def test_edges(spark, tmp_path):
    docs = helpers.edge(spark)
    counts = align.count_pairs(docs, f"file://{tmp_path}/a")
    out = {(r.doc_id, r.al_n_links) for r in align.align_documents(docs, counts).collect()}
    assert (0, 0) in out and (1, 0) in out and len([1 for i, _ in out if i == 4]) == 1
    assert next(n for i, n in out if i == 3) > 60_000
    none = helpers.empty(spark)
    assert align.align_documents(none, align.count_pairs(none, f"file://{tmp_path}/b")).count() == 0


def test_runs_are_summed_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(b << 32 | a, 1 + a) for a in range(5) for b in range(9) for _ in range(11)]
        counts = align.sorted_counts(spark.createDataFrame(rows, "key bigint, n bigint"), f"file://{tmp_path}/s", 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = np.array(sorted({k for k, _ in rows}), np.int64)
    assert align.Shards(*counts[:3]).get(keys).tolist() == [11 * (1 + (k & 0xFFFFFFFF)) for k in keys.tolist()]
    assert counts.best.tolist() == [55] * 9
    assert pa.memory_map(f"{tmp_path}/s/{counts.names[0]}.keys").size() % 8 == 0
