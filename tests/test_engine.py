import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semlake import providers, schemas
from semlake.api import Domain, Searcher
from semlake.functions import keys, q15, text
from semlake.operators import filters, graph, index, joins, rank, records, snapshot, topk
from semlake.schemas import ModelConfig

H1, H2, H3 = (bytes([i]) * 16 for i in (2, 4, 6))


def xor(*hashes):
    out = bytes(16)
    for h in hashes:
        out = bytes(a ^ b for a, b in zip(out, h, strict=True))
    return out


def experience(name, *hashes, kind=8, prefix=None):
    return bytearray((prefix if prefix is not None else xor(*hashes)) + bytes([kind]) + name.encode().ljust(15, b"\0"))


def frame(spark, rows, schema=schemas.RECORDS):
    names = [c.split()[0] for c in schema.split(", ")] if schema is not schemas.RECORDS else ["key", "kind", "name", "expr", "interpretation", "provenance", "constituents", "experience", "goal_patterns"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def recs(spark):
    mention = lambda *hs: [("m", bytearray(h)) for h in hs]
    return frame(spark, [
        {"key": experience("one", H1), "kind": 8, "name": "one", "interpretation": "i", "constituents": mention(H1), "goal_patterns": ["a = b"]},
        {"key": experience("two", H1, H2), "kind": 8, "name": "two", "interpretation": "i", "constituents": mention(H1, H2), "goal_patterns": ["c"]},
        {"key": experience("glob"), "kind": 8, "name": "glob", "interpretation": "i", "constituents": []},
        {"key": experience("old", prefix=H3), "kind": 8, "name": "old", "interpretation": "i"},
        {"key": bytearray(H1 + b"\1const"), "kind": 1, "name": "T.const", "expr": "nat", "interpretation": "a constant"},
        {"key": bytearray(b"\3" * 16 + b"\1wip"), "kind": 1, "name": "T.wip"},
    ])


def names(df):
    return sorted(r.name for r in df.collect())


def test_quantized_scores_equal_numpy(spark):
    rnd = np.random.default_rng(0)
    v = rnd.standard_normal((60, 64)).astype(np.float32)
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<float>").select("id", q15.quantize(F.col("v")).alias("q"))
    wide = v.astype(np.float64)
    want = np.rint(0.95 * wide / (np.linalg.norm(wide, axis=1, keepdims=True) + 1e-12) * 32768).astype(int)
    got = np.array([r.q for r in df.orderBy("id").collect()])
    assert (got == want).all()
    raw = ((want * want[3] + 16384) >> 15).sum(1)
    for query in (want[3].tolist(), F.array(*[F.lit(int(x)) for x in want[3]])):
        assert [r[0] for r in df.orderBy("id").select(q15.dot(F.col("q"), query)).collect()] == raw.tolist()
    best = [(int(i), int(raw[i])) for i in np.lexsort((np.arange(60), -raw))[:5]]
    top = topk.top_k(df, want[3].tolist(), 5, "id").collect()
    assert [(r.id, r.raw) for r in top] == best and top[0].score == 1.0
    assert topk.top_k(df, want[3].tolist(), 0, "id").count() == 0 and topk.top_k(df, want[3].tolist(), 100, "id").count() == 60
    assert topk.of_kinds(df, [], "id").count() == 0
    with pytest.raises(Exception, match="vector length"):
        df.select(q15.dequantize(F.col("q"), 65)).collect()


def test_top_k_plan_keeps_k_rows_a_task(spark):
    df = spark.createDataFrame([(1, [1, 2])], "id int, q array<int>")
    assert "TakeOrderedAndProject" in topk.top_k(df, [1, 2], 3, "id")._jdf.queryExecution().executedPlan().toString()


def test_document_text_and_templates(spark, recs):
    prov = providers.HashingProvider(ModelConfig("m", 16))
    got = {r.name: r.text for r in Searcher(recs, spark.createDataFrame([], schemas.VECTORS), prov).document_texts(recs).join(recs, "key").collect()}
    assert got["T.const"] == "constant T.const: nat\na constant" and got["T.wip"] is None and got["glob"] is None
    assert got["one"] == f"{text.EXPERIENCE_HEAD}\n- a = b\n{text.EXPERIENCE_TAIL}\ni"
    assert text.render_kinds([1, 2, 3]) == "constants, theorems and types" and text.render_kinds([0x12, 0x22, 0x32, 0x42]) == "inference rules"
    assert text.render_kinds([]) == text.DEFAULT_PHRASE
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.apply_template(F.lit("x {task} {y}"), "I: {task} Q: {text}", "query", "find")) == "I: find Q: x {task} {y}"
    with pytest.raises(ValueError):
        text.template_task("has {text}")
    with pytest.raises(ValueError):
        text.apply_template(F.lit("x"), "{text}", "other")
    assert one(text.truncate(F.lit("é" * 501))) == "é" * 500 + "…"
    assert one(text.endpoint_domain(F.lit("HTTPS://API.X.Y:443/v1"))) == "api.x.y" and one(text.endpoint_domain(F.lit("http://h:8080/"))) == "h:8080"
    assert one(text.human_size(F.lit(3 << 30))) == "3.00 GiB"
    assert one(text.tri_state(F.lit(" On "))) is True and one(text.tri_state(F.lit(""))) is False
    with pytest.raises(Exception, match="not a boolean"):
        one(text.tri_state(F.lit("maybe")))
    assert one(text.encode_goal(F.array(F.lit("x")), F.array(F.lit("p")), F.lit("c"))) == "###Variables\nx\n\n###Premises\np\n\n###Conclusion\nc"


def test_keys(spark):
    df = spark.createDataFrame([(bytearray(H1), bytearray(b"\xff" * 16))], "a binary, b binary")
    r = df.select(keys.half(F.col("b"), 0), keys.xor_prefix(F.array("a", "b")), keys.xor_prefix(F.array().cast("array<binary>")), keys.is_wip(F.col("a")), keys.is_wip(F.col("b"))).first()
    assert r[0] == -1 and bytes(r[1]) == xor(H1, b"\xff" * 16) and bytes(r[2]) == bytes(16) and (r[3], r[4]) == (False, True)


def test_index_and_availability(spark, recs):
    exp = recs.where("kind = 8")
    posting = index.posting(exp)
    loaded = lambda *hs: spark.createDataFrame([(bytearray(h),) for h in hs], "hash binary")
    got = lambda *hs: sorted(r.name for r in index.candidates(posting, loaded(*hs)).join(exp, "key").collect())
    assert got(H1) == ["glob", "one", "two"] and got(H2) == ["glob", "two"] and got() == ["glob"]
    assert names(index.available(exp, loaded(H1))) == ["glob", "one"] and names(index.available(exp, loaded(H1, H2))) == ["glob", "one", "two"]
    assert index.consistency(recs).first().asDict() == {"n_records": 6, "n_experiences": 4, "legacy": 1, "mismatches": 0}
    assert index.difference(exp.where("constituents is not null"), posting).count() == 0


def test_repair_moves_and_keeps_conflicts(spark):
    rows = [(experience("a", prefix=H2), "moved"), (experience("b", prefix=H2), "left"), (experience("b", H1), "other"), (experience("d", prefix=H2), "same"), (experience("d", H1), "same")]
    df = spark.createDataFrame([(k, 8, n, [("m", bytearray(H1))]) for k, n in rows], "key binary, kind int, name string, constituents array<struct<name:string,hash:binary>>")
    plan = index.repair_plan(df)
    assert sorted((r.name, r.action) for r in plan.join(df, "key").collect()) == [("left", "conflict"), ("moved", "move"), ("same", "move")]
    fixed = index.repaired(df, plan)
    assert names(fixed) == ["left", "moved", "other", "same"] and index.consistency(fixed).first().mismatches == 1
    assert index.repair_plan(index.repaired(fixed, index.repair_plan(fixed))).where("action = 'move'").count() == 0


def test_mutations(spark, recs):
    new = frame(spark, [{"key": bytearray(H1 + b"\1const"), "kind": 1, "name": "renamed"}, {"key": bytearray(H2 + b"\1x"), "kind": 1, "name": "x"}])
    up = records.upsert(recs, new)
    assert names(up) == ["glob", "old", "one", "renamed", "two", "T.wip", "x"][:0] + sorted(["glob", "old", "one", "renamed", "two", "T.wip", "x"])
    assert sorted(map(str, records.upsert(up, new).collect())) == sorted(map(str, up.collect()))
    assert names(records.delete(recs, new)) == sorted(["glob", "old", "one", "two", "T.wip"])
    assert "T.wip" not in names(records.clean_wip(recs))
    left, _ = records.remove_modules(recs, recs.select("key"), [H1])
    assert names(left) == sorted(["glob", "old", "T.wip"])
    moved = records.rekey_constituent(recs, H1, H3)
    assert names(moved) == ["one", "two"] and index.consistency(moved.drop("old_key")).first().mismatches == 0
    assert [bytes(r.key)[:16] for r in records.copy_prefix(recs, H1, H3).where("name = 'T.const'").orderBy("key").collect()] == [H1, H3]
    legacy = frame(spark, [{"key": experience("l"), "kind": 8, "name": "l", "expr": '["p", "q"]'}, {"key": experience("c"), "kind": 8, "name": "c", "expr": "not json{"}])
    got = {r.name: (r.expr, r.goal_patterns) for r in records.unpack_patterns(legacy).collect()}
    assert got == {"l": (None, ["p", "q"]), "c": ("not json{", None)}


def test_ledgers(spark):
    status = spark.createDataFrame([(bytearray(H1), 1, 0, 0, 2, 0.5, True, "a")], schemas.MODULE_STATUS)
    done = records.mark_interpreted(status, spark.createDataFrame([(bytearray(H2),), (bytearray(b"\1" * 16),)], "key binary"))
    assert {(bytes(r.key), r.finished, r.input_tokens) for r in done.collect()} == {(H1, True, 1), (H2, True, 0)}
    deltas = spark.createDataFrame([(bytearray(H1), 5, 0, 0, 1, 0.25, "b", dt.datetime(2024, 1, 2))], "key binary, input_tokens long, cache_creation_tokens long, cache_read_tokens long, output_tokens long, cost_usd double, model string, ts timestamp")
    r = records.add_costs(status, deltas).first()
    assert (r.input_tokens, r.cost_usd, r.finished, r.model) == (6, 0.75, True, "b")


def test_merge_rules(spark):
    schema = "key int, v int, finished boolean"
    local = spark.createDataFrame([(1, 1, True), (2, 1, None), (3, 1, False), (4, None, None)], schema)
    remote = spark.createDataFrame([(1, 9, False), (2, 2, None), (4, None, None), (5, 5, True)], schema)
    merged = snapshot.merge(local, remote, ["key"], "finished")
    assert {(r.key, r.v, r.action) for r in merged.collect()} == {(1, 1, "kept_local"), (2, 2, "overwritten"), (3, 1, "local_only"), (4, None, "same"), (5, 5, "added")}
    assert tuple(snapshot.statistics(merged).first()) == (1, 1, 1)
    again = snapshot.merge(merged.drop("action"), remote, ["key"], "finished")
    assert tuple(snapshot.statistics(again).first()) == (0, 0, 1)
    with pytest.raises(ValueError):
        snapshot.check_manifest({"schema_version": "1"})


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (5, 6)], "parent int, child int")
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node int")
    assert sorted(r.node for r in graph.cone(edges, node(4), node(2)).collect()) == [1, 3, 4]
    assert sorted(map(tuple, graph.contract(edges, node(1, 4)).collect())) == [(1, 4)]
    assert sorted(map(tuple, graph.levels(edges, node(1, 2, 3, 4)).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([(1, 2), (2, 1)], "parent int, child int"), node(1, 2))


def test_order_and_fusion(spark):
    df = spark.createDataFrame([("k", -1, 5, 0), ("k", 7, 9, 1), ("k", 3, 9, 2), ("j", -1, 4, 0), ("j", -1, 4, 1)], "key string, goal_off int, word_off int, input_pos int")
    assert {(r.key, r.input_pos) for r in rank.keep_best_entry(df, "key").collect()} == {("k", 2), ("j", 0)}
    with pytest.raises(ValueError, match="not unique"):
        rank.assert_unique(df, ["key"])
    a, b = (spark.createDataFrame(x, "id int, score double") for x in ([(1, 1.0), (2, 0.5)], [(2, 0.8), (3, 0.4)]))
    out = rank.mesh([(0.5, a), (0.5, b)], "id", 3, spark.createDataFrame([(9,)], "id int")).collect()
    assert [r.id for r in out] == [9, 2, 1]
    spans = spark.createDataFrame([("n", 0, 10_000, "long"), ("n", 10_000, 10_001, "dot"), ("m", 5, 5, "empty")], "node string, start int, end int, c string")
    at = spark.createDataFrame([("n", 9_999), ("n", 10_000), ("n", 10_001), ("m", 5)], "node string, off int")
    assert [(r.off, r.c) for r in joins.span_at(at, spans, "node").orderBy("off").collect()] == [(5, None), (9_999, "long"), (10_000, "dot"), (10_001, None)]
    one = spark.range(1).select(filters.modules_include(F.lit("A.Beta"), ["x", "bet"]), filters.modules_include(F.lit("A"), [])).first()
    assert tuple(one) == (True, True)


def test_search(spark, recs):
    rnd = random.Random(1)
    words = ["list", "map", "append", "prime", "group", "ring", "order"]
    rows = [{"key": bytearray(H1 + b"\1" + bytes([i])), "kind": 1 + i % 3, "name": f"T.n{i}", "interpretation": " ".join(rnd.choice(words) for _ in range(5))} for i in range(30)]
    df = frame(spark, rows).unionByName(recs.where("name = 'one'"))
    cand = df.where("kind <> 8").select("key", "kind", "name", F.lit("T").alias("module"), (F.col("kind") == 1).alias("is_local"), F.lit(0).alias("ord"))
    prov = providers.HashingProvider(ModelConfig("h", 64))
    none = spark.createDataFrame([], schemas.VECTORS)
    bare = Searcher(df, none, prov).lookup("prime ring", 4, [1, 2], cand)
    assert [round(r.score, 2) for r in bare.results.collect()] == [0.5] * 4 and bare.total == 20
    search = Searcher(df, none, prov)
    search.fill(cand)
    search.vectors = search.vectors.cache()
    got = search.lookup("prime ring", 5, [1, 2, 3], cand).results.collect()
    assert len(got) == 5 and got[0].score >= got[-1].score and {"prime", "ring"} & set(got[0].interpretation.split())
    only = search.lookup("prime ring", 5, [1, 2, 3], cand, Domain("restricted", df.where("name = 'T.n3'"))).results
    assert names(only) == ["T.n3"] and search.lookup("x", 3, [], cand).results.count() == 0
    ranked = Searcher(df, search.vectors, prov, providers.OverlapReranker()).lookup("prime ring", 3, [1, 2, 3], cand)
    assert ranked.results.count() == 3 and not ranked.warnings
    with_exp = search.lookup("prime", 40, [1, 8], cand, loaded=spark.createDataFrame([(bytearray(H1),)], "hash binary"))
    assert with_exp.total == 11


def _counting(tmp_path):
    """A provider that leaves one line per embedded text in a file."""
    from semlake.providers import HashingProvider
    from semlake.schemas import ModelConfig

    class Counting(HashingProvider):
        def embed(self, texts):
            with open(tmp_path / "asked", "a") as f:
                f.writelines(f"{t!r}\n" for t in texts)
            return super().embed(texts)

    return Counting(ModelConfig("count-16", 16)), lambda: (tmp_path / "asked").read_text().splitlines()


def test_each_text_is_embedded_once(spark, tmp_path):
    from semlake.providers import cached_embed, fill_vectors

    provider, asked = _counting(tmp_path)
    texts = spark.createDataFrame([(bytearray([i]), f"text {i}") for i in range(7)], "key binary, text string")
    none = spark.createDataFrame([], "model string, key binary, q array<smallint>")
    made = fill_vectors(texts, none, provider)
    assert made.count() == made.count() == len(made.collect()) == 7
    assert sorted(asked()) == sorted(repr(f"text {i}") for i in range(7))
    cache = spark.createDataFrame([], "model string, text string, vec array<float>, expires_at timestamp")
    every, fresh = cached_embed(spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), cache, provider, dt.datetime(2024, 1, 1))
    assert every.count() == 3 and fresh.count() == 2 and len(every.collect()) == 3
    assert len(asked()) == 9


def test_rekeying_refuses_legacy_records_of_the_index(spark):
    rows = [(bytearray(b"k" * 16 + b"\x08" + bytes([i]) * 15), c) for i, c in enumerate(([("m", bytearray(H1))], None, None))]
    df = spark.createDataFrame(rows, "key binary, constituents array<struct<name:string,hash:binary>>")
    indexed = spark.createDataFrame([(bytearray(H1), r[0]) for r in rows[:2]], "hash binary, key binary")
    assert records.rekey_constituent(df, H1, H2, indexed.limit(1)).count() == 1 == records.rekey_constituent(df, H1, H2).count()
    with pytest.raises(Exception, match="no constituents"):
        records.rekey_constituent(df, H1, H2, indexed).collect()


def test_batch_search_in_blocks_equals_single_searches(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "VECTOR_ROWS", 5)
    rows = [(i, [rnd.randint(-40, 40) * 700 for _ in range(4)]) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(10)]  # ties
    df = spark.createDataFrame(rows, "id bigint, q array<int>").repartition(3)
    queries = df.where("id % 7 = 0").select(F.col("id").alias("ask"), F.col("q").alias("qv"))
    got = {(r.ask, r["rank"]): (r.id, r.raw) for r in topk.top_k_batch(df, queries, 3, "id", "ask").collect()}
    held = dict(rows)
    for ask in range(0, 50, 7):
        want = [(r.id, r.raw) for r in topk.top_k(df, held[ask], 3, "id").collect()]
        assert [got[ask, i] for i in (1, 2, 3)] == want
    assert topk.top_k_batch(df, queries, 0, "id", "ask").count() == 0 == topk.top_k_batch(df, queries.limit(0), 3, "id", "ask").count()
    odd = df.unionByName(spark.createDataFrame([(90, [1, 2]), (91, [1, 2, 3]), (92, [5]), (93, None)], "id bigint, q array<int>")).repartition(1)
    more = {(r.ask, r["rank"]): (r.id, r.raw) for r in topk.top_k_batch(odd, queries, 3, "id", "ask", dimension=4).collect()}
    assert more == got
    few = topk.top_k_batch(odd, queries.limit(1), 100, "id", "ask").collect()
    assert sorted(r.id for r in few) == list(range(50))


@pytest.mark.parametrize("most", [10, 1000])
def test_running_sums_over_a_hot_group(spark, monkeypatch, most):
    monkeypatch.setattr(rank, "GROUP_ROWS", most)
    rows = [(None if i % 5 == 0 else "hot", i, i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, c int")
    got = {(r.g, r.i): r.batch for r in rank.batches(df, 7, "g", "i").collect()}
    spent = {(r.g, r.i): r.spent for r in rank.within_budget(df, "c", 100, "g", "i").collect()}
    for g in (None, "hot"):
        mine, total = [r for r in rows if r[0] == g], 0
        for n, (_, i, c) in enumerate(mine):
            total += c
            assert got[g, i] == n // 7
            assert spent.get((g, i)) == (total if total <= 100 else None)


def test_completion_stops_at_the_first_failing_level(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string")
    cone_ = graph.cone(edges, spark.createDataFrame([("d",)], "node string"))
    finished = spark.createDataFrame([("b",)], "node string")
    seen = []

    def work(bad):
        def run(nodes):
            seen.append(sorted(r.node for r in nodes.collect()))
            return nodes.select("node", (F.col("node") != bad).alias("ok"), F.lit(2).alias("tokens"))

        return run

    out = graph.complete(edges, cone_, finished, work("-"))
    assert sorted(r.node for r in out.collect()) == ["a", "c", "d"] and seen == [["a"], ["c"], ["d"]]
    assert graph.usage(out, cone_).first().tokens == 6
    seen.clear()
    with pytest.raises(RuntimeError, match="'c'"):
        graph.complete(edges, cone_, finished, work("c"))
    assert seen == [["a"], ["c"]]


def test_tool_decisions(spark):
    df = spark.createDataFrame([("Read",), ("Write",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(filters.tool_decision(F.col("t"), ["Read", "Grep"])).collect()]
    assert got == [("allow", None), ("deny", "tool not allowed: Write"), ("deny", "tool not allowed: (none)")]


def test_premises_are_embedded_once_and_global_ones_kept(spark, tmp_path):
    provider, asked = _counting(tmp_path)
    rows = spark.createDataFrame([("p", True), ("p", False), ("q", False), ("r", True)], "proposition string, is_global boolean")
    cache = spark.createDataFrame([("count-16", "r", [0.0] * 16)], "model string, proposition string, vec array<float>")
    every, kept = providers.premise_vectors(rows, cache, provider)
    assert every.count() == 4 and [r.proposition for r in kept.collect()] == ["p"] and sorted(asked()) == ["'p'", "'q'"]


def test_domains_by_number():
    assert [Domain.tagged(i).mode for i in range(3)] == ["context", "extended", "restricted"]


def test_infra_collections_types_and_methods(spark):
    rows = [("HOL.no_atp", False, False), ("HOL.simps", False, False), ("Pure.x", False, False), ("T.cong_a", False, False), ("T.coinduct_upto", False, False), ("T.x", False, True), ("T.y", True, False), ("Cong.no_atp", False, False)]
    df = spark.createDataFrame(rows, "name string, c boolean, h boolean")
    collection = filters.is_infra_collection(F.col("name"), F.col("c"), F.col("h"), F.lit(False))
    assert {r.name for r in df.where(~collection).collect()} == {"HOL.simps", "Cong.no_atp"}
    scoped = df.select("name", filters.is_infra_scoped(F.col("c"), F.col("h"), F.lit(False)).alias("plain"), filters.is_infra_scoped(F.col("c"), F.col("h"), F.lit(False), F.col("name") == "HOL.simps").alias("type"))
    assert {r.name for r in scoped.where("plain").collect()} == {"T.x", "T.y"}
    assert {r.name for r in scoped.where("type").collect()} == {"T.x", "T.y", "HOL.simps"}
    methods = spark.createDataFrame([("auto", "HOL", None), ("mine", "T", None), ("lost", None, None), ("deep", "T", True)], "name string, module string, hidden boolean")
    methods = methods.withColumns({"concealed": F.lit(False), "inaccessible": F.lit(False)})
    base = spark.createDataFrame([("HOL",), ("HOL",), (None,)], "module string")
    assert sorted(r.name for r in filters.infra_methods(methods, base).collect()) == ["auto", "deep", "lost"]


def test_one_request_of_texts_is_in_python_at_a_time(spark):
    from semlake.providers import HashingProvider, embed_texts
    from semlake.schemas import ModelConfig

    config = ModelConfig("hash-8", 8, max_request_size=3)
    df = spark.range(10).select("id", F.concat(F.lit("word "), F.col("id")).alias("text"), F.lit(None).cast("timestamp").alias("at"))
    out = embed_texts(df, "text", HashingProvider(config))
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    want = HashingProvider(config).embed([f"word {i}" for i in range(10)])
    assert [r.vec for r in out.orderBy("id").collect()] == want.tolist()


def test_contraction_keeps_its_plan_short(spark):
    """A chain and a cycle of nodes that are not kept; the result reads what the steps have written, whatever their number."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(3, 2), (9, 3), (0, 6)], "parent int, child int")
    out = graph.contract(edges, spark.createDataFrame([(0,), (6,), (9,)], "node int"))
    assert sorted(map(tuple, out.collect())) == [(0, 6), (9, 6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
