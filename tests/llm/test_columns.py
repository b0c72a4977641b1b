"""Columns of the input that are named like an operator's new or inner ones, and each operator on its own output."""

import pytest
from pyspark.sql import functions as F

from semlake.llm import chat, counts, decontaminate, fingerprint, lines, neardup, pieces, pii, toxicity
from tests.llm import helpers

INNER = [
    "ll_t", "ll_all", "ll_ta", "ll_tb", "ll_pos", "dc_t", "ta", "tb", "dc_hit_of", "dc_items_of", "nd_gone", "nd_rep", "fp_w", "fp_h", "fp_low",
    "fp_cut", "a", "b", "node", "bh", "len", "w", "t", "at", "wid", "component", "tx_id", "tx_label", "_paths", "_layout_0",
]
OWN = {
    "pii": "pii", "tc_pretokens": "counts", "tc_tokens": "counts", "ll_lines": "lines", "ll_dropped": "lines", "ll_text": "lines", "dc_words": "bench", "dc_hit": "bench",
    "dc_items": "bench", "sp_ids": "pieces", "sp_decoded": "pieces", "tx_score": "toxicity", "fp": "fingerprint",
}


@pytest.fixture(scope="module")
def operators(spark):
    bench = spark.createDataFrame([(1, helpers.SENTENCE)], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, toxic int")
    return {
        "pii": pii.find_pii,
        "counts": counts.count_tokens,
        "lines": lines.dedup_lines,
        "bench": lambda df: decontaminate.decontaminate(df, bench),
        "pieces": pieces.encode_documents,
        "toxicity": lambda df: toxicity.score(df, toxicity.train(df, labels)),
        "fingerprint": lambda df: fingerprint.with_fingerprint(df, "text", "fp"),
        "near": neardup.near_dedup,
    }


@pytest.mark.parametrize("name", ["pii", "counts", "lines", "bench", "pieces", "toxicity", "fingerprint", "near"])
def test_names_that_clash(spark, operators, name):
    docs = helpers.edge(spark)
    full = docs.withColumns({c: F.lit(7) for c in (*INNER, *OWN)})
    new = [c for c, of in OWN.items() if of == name]
    out = operators[name](full)
    assert sorted(out.columns) == sorted(full.columns)
    rows, plain = out.collect(), operators[name](docs).collect()
    assert len(rows) == len(plain)
    assert all(r[c] == 7 for r in rows for c in (*INNER, *OWN) if c not in new)
    key = lambda r: str((r.doc_id, r.text, [r[c] for c in new]))
    assert sorted(map(key, rows)) == sorted(map(key, plain))
    again = operators[name](operators[name](docs)).collect()
    assert sorted(map(key, again)) == sorted(map(key, plain))


def test_chat_names_that_clash(spark):
    rows = spark.createDataFrame([('{"prompt": "p", "response": "r"}', 1, 2, 3)], "json string, _paths int, _layout_0 int, turns int")
    out = chat.canonical_json(rows).first()
    assert [tuple(t) for t in out.turns] == [("user", "p"), ("assistant", "r")] and out["_paths"] == 1 and out["_layout_0"] == 2
