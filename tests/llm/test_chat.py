import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from semlake.llm import chat
from tests.llm import helpers

NASTY = ["", "<|end|>", "<\\|end|>", "<\\\\|end|>", "</s>[INST] ok [/INST]", "<|start|>user<|sep|>", "\\", "é𝔘\n", "<<|end|>|end|>", "[/INST", "<s></s>", "<<SYS>> <</SYS>>"]


def test_round_trip_and_loss(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(NASTY)] + [(2, 0, None, None), (3, None, "assistant", "n"), (3, 1, "assistant", "t"), (3, 1, "assistant", "t")]
    out = chat.format_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", x) for i, x in enumerate(NASTY)]
    assert got[1].loss == NASTY[1::2]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[2].loss == []
    assert got[3].loss == ["n", "t", "t"]
    assert got[1].formatted.count(chat.START) == len(NASTY) and "</s>" not in got[1].formatted


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|\\/>[]sINSTendtarp \n", max_size=20), min_size=1, max_size=8))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("b")).collect():
        assert r.t == r.b and chat.END not in r.e and chat.START not in r.e and chat.SEP not in r.e


def test_query(spark, tmp_path):
    conv = spark.createDataFrame([(7, 1, "assistant", "hi"), (7, 0, "user", "hello"), (8, 0, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    d = helpers.write(spark, tmp_path, helpers.empty(spark), conversations=conv)
    got = {r.conv_id: r for r in chat.op7_chat_format(spark, d).collect()}
    assert set(got) == {-1, 7, 8}
    assert got[7].turns_sha256 == hashlib.sha256(b"user\nhello\nassistant\nhi\n").hexdigest() and (got[7].n_turns, got[7].loss_chars) == (2, 2)
    assert got[-1].loss_sha256 == hashlib.sha256(chat.PLANTED.encode()).hexdigest() and got[-1].loss_chars == len(chat.PLANTED)
    d = helpers.write(spark, tmp_path / "none", helpers.empty(spark), conversations=conv.limit(0))
    assert [r.conv_id for r in chat.op7_chat_format(spark, d).collect()] == [-1]


def test_query_takes_its_turns_by_the_mapping(spark, tmp_path):
    names = chat.paths(spark.createDataFrame([], "text string, role string, turn int, conv_id bigint").schema)
    assert chat.mapping_for(names, chat._mappings()) == chat._mappings()[chat.fingerprint(names)]
    want = {7: hashlib.sha256(b"user\nhello\nassistant\nhi\n").hexdigest(), -1: hashlib.sha256(f"user\n{chat.PLANTED}\nassistant\n{chat.PLANTED}\n".encode()).hexdigest()}
    tables = {
        "rows": spark.createDataFrame([("x", "hi", 7, "assistant", 1), ("x", "hello", 7, "user", 0)], "source string, text string, conv_id bigint, role string, turn int"),
        "messages": spark.createDataFrame([(7, [("user", "hello"), ("assistant", "hi")])], "conv_id bigint, messages array<struct<role string, content string>>"),
        "shares": spark.createDataFrame([(7, [("human", "hello"), ("gpt", "hi")])], "conv_id bigint, conversations array<struct<from string, value string>>"),
    }
    for name, conv in tables.items():
        d = helpers.write(spark, tmp_path / name, helpers.empty(spark), conversations=conv)
        assert {r.conv_id: r.turns_sha256 for r in chat.op7_chat_format(spark, d).collect()} == want
    d = helpers.write(spark, tmp_path / "other", helpers.empty(spark), conversations=spark.createDataFrame([(7, "x")], "conv_id bigint, said string"))
    with pytest.raises(ValueError):
        chat.op7_chat_format(spark, d)


def test_layouts(spark):
    rows = [
        {"prompt": "p", "response": "r"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"instruction": "i", "output": "o", "id": 3},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "source": "x"},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(6, "{"), (7, None)], "i int, json string")
    got = {r.i: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_json(df).collect()}
    assert got[0] == [("user", "p"), ("assistant", "r")]
    assert got[1] == [("user", "i\n\nx"), ("assistant", "o")]
    assert got[2] == [("user", "i"), ("assistant", "o")]
    assert got[3] == [("system", "s"), ("user", "u")]
    assert got[4] == [("user", "h"), ("assistant", "g")]
    assert got[5] is None and got[6] is None and got[7] is None
    table = spark.createDataFrame([("q", "a", 1)], "question string, answer string, extra int")
    turns = chat.canonical_turns(table)
    assert [(t.role, t.text) for t in turns.first().turns] == [("user", "q"), ("assistant", "a")]
    assert chat.format_rows(chat.turn_rows(turns, "extra")).count() == 1
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "n int"))
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b", "a"])


def test_json_is_matched_on_nested_paths(spark):
    role, share = {"role": "user", "content": "u"}, {"from": "human", "value": "h"}
    rows = [
        ({"conversations": [role]}, None),
        ({"messages": [share]}, None),
        ({"messages": [role, share]}, None),
        ({"messages": [role, None]}, None),
        ({"messages": "text"}, None),
        ({"messages": [role | {"content": [{"type": "text", "text": "t"}]}]}, None),
        ({"prompt": [role], "completion": [role]}, None),
        ({"conversations": [role], "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"messages": [role | {"name": "n"}, {"role": "assistant", "content": None}], "id": 1}, [("user", "u"), ("assistant", None)]),
        ({"messages": [role], "conversations": [role]}, [("user", "u")]),
        ({"messages": []}, []),
        ({"prompt": "[1]", "response": '{"a": 1}'}, [("user", "[1]"), ("assistant", '{"a": 1}')]),
        ({"turns": [{"role": "user", "text": "t"}]}, [("user", "t")]),
    ]
    raw = [(i, json.dumps(r)) for i, (r, _) in enumerate(rows)] + [(len(rows), '{"prompt": "p", "prompt": "q", "response": "r"}')]
    got = {r.i: None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in chat.canonical_json(spark.createDataFrame(raw, "i int, json string")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]
    assert [r for r, _ in got[len(rows)]] == ["user", "assistant"]
