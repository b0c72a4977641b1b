import random

import pytest

from semlake.functions import codec, terms
from semlake.operators import patterns


def build(rnd, depth, names):
    """(text, nested tuple) of a random term."""
    if depth == 0 or rnd.random() < 0.3:
        s = rnd.choice(names)
        return f"{s}/0", (s,)
    s, n = rnd.choice([("f", 2), ("g", 1), ("h", 3), ("\\b", 1)])
    parts = [build(rnd, depth - 1, names) for _ in range(n)]
    return " ".join([f"{s}/{n}", *(p[0] for p in parts)]), (s, *(p[1] for p in parts))


def subterms(t):
    yield t
    for x in t[1:]:
        yield from subterms(x)


def plain_match(p, t, bound):
    if len(p) == 1 and p[0][0] == "?":
        return bound.setdefault(p[0], t) == t
    return p[0] == t[0] and len(p) == len(t) and all(plain_match(a, b, bound) for a, b in zip(p[1:], t[1:], strict=True))


def written(t):
    return " ".join([f"{t[0]}/{len(t) - 1}", *(written(x) for x in t[1:])])


def test_matches_equal_trying_everywhere(spark):
    rnd = random.Random(4)
    made = [build(rnd, 4, ["a", "b", "%x"]) for _ in range(60)]
    asked = [build(rnd, 2, ["a", "?p", "?q", "?p"]) for _ in range(25)] + [("?v/0", ("?v",)), ("zz/0", ("zz",))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)] + [(100, "f/2 a/0"), (101, None), (102, "")], "id bigint, term string")
    wanted = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)], "pattern bigint, text string")
    found = patterns.matches(df, wanted, "id", "term")
    got = sorted((r.pattern, r.id, r.at, tuple(sorted(r.bindings.items()))) for r in found.collect())
    want = []
    for p, (_, pattern) in enumerate(asked):
        for i, (_, t) in enumerate(made):
            for at, sub in enumerate(subterms(t)):
                bound = {}
                if plain_match(pattern, sub, bound):
                    want.append((p, i, at, tuple(sorted((v, written(x)) for v, x in bound.items()))))
    assert got == sorted(want) and len(got) > 100
    rates = {r.id: r.hit for r in patterns.hit_rates(found, len(asked), "id").collect()}
    assert all(abs(rates[i] - len({p for p, j, *_ in got if j == i}) / len(asked)) < 1e-9 for i in rates)


def test_normal_forms():
    same = ["all/1 \\x/1 f/2 ?a/0 %b/0", "all/1 \\y/1 f/2 ?c/0 %a/0"]
    assert len({terms.normal(terms.parse(t)) for t in same}) == 1
    other = ["all/1 \\x/1 f/2 ?a/0 ?a/0", "all/1 \\x/1 f/2 ?a/0 ?b/0", "all/1 \\x/1 f/2 %a/0 ?b/0", "all/1 \\x/1 f/2 'a/0 ?b/0", "f/2 #0/0 #1/0", "f/2 #1/0 #0/0"]
    assert len({terms.normal(terms.parse(t)) for t in other}) == len(other)
    for bad in (None, "", "f", "f/1", "f/0 g/0", "f/x", "/0", "f/2 a/0"):
        assert terms.parse(bad) is None
    deep = terms.parse("g/1 " * 20_000 + "a/0")
    assert deep.size[0] == 20_001 and terms.match_at(terms.parse("g/1 ?x/0"), deep, 0)["?x"].startswith("g/1 ")


@pytest.mark.parametrize(("text", "want"), [
    ("imp/2 ?P/1 x/0 ?P/1 y/0", True), ("imp/2 ?P/1 x/0 ?Q/1 y/0", False), ("?P/0", False), ("imp/2 all/1 \\x/1 imp/2 a/0 judgment/1 ?P/0 judgment/1 ?P/0", True),
    ("imp/2 a/0 imp/2 ?P/0 ?P/0", True), ("all/1 \\x/1 imp/2 c/1 ?P/0 ?P/0", False), ("imp/2 ?P/0 c/1 ?P/0", False),
])
def test_rule_shapes(text, want):
    assert terms.is_rule(terms.parse(text)) is want


VALUES = [None, True, False, 0, 127, 128, -1, -32, -33, 255, 2**16, 2**31, 2**40, -(2**40), 1.5, "", "é" * 20, "x" * 300, "y" * 70_000, b"", b"z" * 300, [], list(range(20)), [1, [2, ["a"]]], {}, {"k": 1, b"b": [2]}, {str(i): i for i in range(20)}]


def test_values_round_trip_and_every_cut_is_noticed():
    for v in VALUES:
        packed = codec.pack(v)
        assert codec.unpack(memoryview(packed)) == (v, len(packed))
        for n in range(0, len(packed), max(1, len(packed) // 50)):
            with pytest.raises(codec.Unreadable):
                codec.unpack(memoryview(packed[:n]))
    for bad in (b"\xc1", b"\x91" * 100 + b"\xc0", b"\xa1\xff", b"\xdd\xff\xff\xff\xff", b"\x81\x90\xc0"):
        with pytest.raises(codec.Unreadable):
            codec.unpack(memoryview(bad))


def test_records_of_all_forms(spark):
    full = {"kind": 8, "name": "n", "expr": None, "interpretation": "i", "provenance": {"template_uk": b"t", "locale_uk": None, "qualifier": "q"}, "constituents": [{"name": "m", "hash": b"h" * 16}], "experience": "e", "goal_patterns": ["p"]}
    assert codec.read_record(memoryview(codec.write_record(full))) == full
    old = codec.pack([b"x" and 1, b"name", "expr", b"meaning", {b"locale_uk": b"l", b"qualifier": b"q"}])
    got = codec.read_record(memoryview(old))
    assert (got["name"], got["interpretation"], got["provenance"], got["goal_patterns"]) == ("name", "meaning", {"template_uk": None, "locale_uk": b"l", "qualifier": "q"}, None)
    legacy = codec.read_record(memoryview(codec.pack([8, "n", '["a","b"]'])))
    assert legacy["goal_patterns"] == ["a", "b"] and legacy["expr"] is None
    corrupt = codec.read_record(memoryview(codec.pack([8, "n", "not json{"])))
    assert corrupt["goal_patterns"] is None and corrupt["expr"] == "not json{"
    bad = [codec.pack("text"), codec.pack([99, "n"]), codec.pack([1, 5]), codec.pack([1, "n", None, None, None, [1]]), codec.pack([1, "n"]) + b"\xc0", codec.pack([1, "n"])[:-1], b"", None]
    rows = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate([*bad, old])], "i int, value binary")
    out = codec.decode(rows)
    got = {r.i: (r.record is None, r.reason) for r in out.collect()}
    assert got == {0: (True, "not a tuple"), 1: (True, "unknown kind"), 2: (True, "wrong type of a text"), 3: (True, "wrong type of constituents"), 4: (True, "bytes after the tuple"), 5: (True, "cut short"), 6: (True, "cut short"), 7: (True, "no value"), 8: (False, None)}
    assert {r.reason: r.n for r in codec.unreadable(out).collect()}["cut short"] == 2


def test_matching_without_an_index_moves_no_term(spark):
    df = spark.createDataFrame([(i, f"f/2 a/0 {'a' if i % 3 else 'b'}/0") for i in range(30)] + [(30, "a/"), (31, "f/2 f/2 b/0 b/0 a/0")], "id bigint, term string")
    wanted = spark.createDataFrame([(1, "f/2 ?x/0 ?x/0"), (2, "?y/0"), (3, "f/2 zz/0 ?x/0"), (4, "not/ a term")], "pattern bigint, text string")
    found = patterns.matches(df, wanted, "id", "term")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda out: sorted((r.pattern, r.id, r.at, tuple(r.bindings.items())) for r in out.collect())
    got = rows(found)
    assert got == rows(patterns.matches(df, wanted, "id", "term", patterns.posting(df, "id", "term")))
    assert [r for r in got if r[0] == 1] == [(1, i, 0, (("?x", "a/0"),)) for i in range(30) if i % 3] + [(1, 31, 1, (("?x", "b/0"),))] and sum(r[0] == 2 for r in got) == 95


def test_values_are_read_in_small_batches():
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays([pa.array(range(1001))], names=["i"])
    parts = [*codec._slices(iter([whole, whole.slice(0, 0)]))]
    assert max(p.num_rows for p in parts) <= codec.ROWS and [x for p in parts for x in p.column("i").to_pylist()] == [*range(1001)]
