import hashlib
import re

import pytest

from semlake.llm import decontaminate as dc
from tests.llm import helpers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, who = words(t), set(), set()
        for i, item in items:
            v = words(item)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    who.add(str(i))
        out.append((len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, helpers.SENTENCE), (2, "The QUICK brown fox jumps over the lazy dog while nobody"), (10, "Short é Item"), (11, None), (12, "..."), (13, helpers.SENTENCE)]
TEXTS = ["pre " + helpers.SENTENCE.upper() + " post", helpers.SENTENCE[:30], "a short, é ITEM? short É item", "short é item short é item", None, "", "!!", helpers.LONG + " " + helpers.SENTENCE, "nothing"]


@pytest.fixture
def folder(spark, tmp_path):
    return helpers.write(spark, tmp_path, helpers.table(spark, TEXTS + TEXTS[:1], [*range(len(TEXTS)), 0]), benchmark=spark.createDataFrame(ITEMS, "item_id bigint, text string"))


@pytest.mark.parametrize("shuffled", [False, True])
def test_query_equals_brute_force(spark, folder, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(dc, "broadcast_within", lambda t, n: t)
    rows = dc.op9_decontamination(spark, folder).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS, ITEMS)
    assert len(rows) == len(TEXTS) + 1


def test_empty_tables_and_columns(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert dc.decontaminate(helpers.empty(spark), bench).collect() == []
    out = dc.decontaminate(helpers.edge(spark), bench.limit(0)).collect()
    assert len(out) == 8 and all(r.dc_hit == [] and r.pos == 1 for r in out)
    assert sum(r.dc_hit != [] for r in dc.decontaminate(helpers.edge(spark), bench).collect()) == 2
