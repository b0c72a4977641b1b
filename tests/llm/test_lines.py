import hashlib
import re
from collections import Counter

from semlake.llm import lines
from tests.llm import helpers


def brute(texts, least=10):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for ls in split for k in {key(s) for s in ls} if k)
    out = []
    for ls in split:
        kept = [s for s in ls if count[key(s)] < least]
        out.append((len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    texts = [f"own line {i}\n  Shared É Line \t\nanother {i % 7}\n\nshared é line" if i % 2 else f"SHARED É line\r\n{'twice' if i < 18 else 'x'}\ntwice" for i in range(40)]
    texts += [None, "", "\n", "\n\n", helpers.LONG.replace("and", "\n"), "Shared É Line", "shared É line"]
    d = helpers.write(spark, tmp_path, helpers.table(spark, texts))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.op4_line_dedup(spark, d).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sum(g[1] for g in got.values()) > 40


def test_edges_repeated_rows_and_columns(spark):
    # Ten repeated rows are ten documents.
    df = helpers.table(spark, ["same\nmine"] * 10 + [None], [1] * 10 + [None])
    out = lines.dedup_lines(df).collect()
    assert [(r.doc_id, r.ll_lines, r.ll_dropped, r.ll_text) for r in out if r.doc_id] == [(1, 2, 2, "")] * 10
    assert [(r.pos, r.h, r.ll_text) for r in out if r.doc_id is None] == [(1, "x", "")]
    assert lines.dedup_lines(helpers.empty(spark)).collect() == []


def test_shuffled_paths_give_the_same(spark, monkeypatch):
    df = helpers.table(spark, [f"a{i}\nshared" for i in range(12)])
    want = sorted(map(tuple, lines.dedup_lines(df).collect()))
    monkeypatch.setattr(lines, "broadcast_within", lambda t, n: t)
    assert sorted(map(tuple, lines.dedup_lines(df).collect())) == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "a bigint, b bigint, n bigint")


def test_runs_compact_and_survive_a_half_done_merge(spark, tmp_path):
    runs = lines.LineRuns(spark, f"file://{tmp_path}/runs", min_docs=3, buckets_=4)
    for batch in ([(1, 1, 1), (2, 2, 3)], [(1, 1, 1), (2, 2, 5)], [(1, 1, 1)], [(3, 3, 1)]):
        runs.add(frame(spark, batch))
    assert [r[:3] for r in runs.runs()] == [(2, 0, 3)]
    # (2, 2) is frequent after the first batch and is not added again.
    assert sorted(map(tuple, runs.read(runs.runs()[0]).collect())) == [(1, 1, 3), (2, 2, 3), (3, 3, 1)]
    for batch in ([(3, 3, 2), (1, 1, 1)], [(4, 4, 2)], [(4, 4, 1), (5, 5, 1)]):
        runs.add(frame(spark, batch))
    assert [r[:3] for r in runs.runs()] == [(0, 6, 6), (1, 4, 5), (2, 0, 3)]
    assert sorted(map(tuple, runs.frequent().collect())) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert [r[:3] for r in runs.runs()] == [(3, 0, 6)]
    # An input that a crash left behind is covered by the merged run, a run without _SUCCESS does not count.
    frame(spark, [(1, 1, 1)]).write.parquet(f"file://{tmp_path}/runs/1-0-1")
    (tmp_path / "runs/0-7-7").mkdir()
    assert [r[:3] for r in runs.runs()] == [(3, 0, 6)]
    runs.drop()
    assert runs.runs() == [] and runs.frequent().count() == 0


def test_runs_are_neither_shuffled_nor_sorted(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    runs = lines.LineRuns(spark, f"file://{tmp_path}/runs", min_docs=2, buckets_=4)
    runs.add(frame(spark, [(i, i, 1 + i % 2) for i in range(500)]))
    runs._write(frame(spark, [(i, i, 1) for i in range(0, 900, 3)]), 0, 1, 1)
    one, two = runs.runs()
    batch = runs.without_known(frame(spark, [(i, i, 1) for i in range(300)]))
    for df in (batch, runs.merged(one, two)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in plan]
        scans = [i for i, x in enumerate(plan) if "FileScan" in x]
        assert len(scans) == 2 and all("Bucketed: true" in plan[i] for i in scans)
        for i in scans:
            above = []
            for j in range(i - 1, -1, -1):  # up to the join
                if depth[j] < depth[i] and (not above or depth[j] < above[-1][0]):
                    above.append((depth[j], plan[j]))
                    if "Join" in plan[j]:
                        break
            assert "SortMergeJoin" in above[-1][1] and not [x for _, x in above if "Exchange" in x or "Sort [" in x]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == old
    assert sorted(r.n for r in runs.merged(one, two).where("a in (3, 4, 6, 899, 897)").collect()) == [1, 1, 2, 3]


def test_batches_follow_from_the_text(spark, monkeypatch):
    df = helpers.table(spark, ["x" * 100] * 20)
    assert lines.batches_of(df) == lines.BATCHES and lines.batches_of(helpers.empty(spark)) == lines.BATCHES
    monkeypatch.setattr(lines, "BATCH_BYTES", 250)
    assert lines.batches_of(df) == 8
    many = helpers.table(spark, [f"a{i}\nshared\n{'pair' if i % 2 else 'odd'}" for i in range(24)])
    assert {r.ll_text for r in lines.dedup_lines(many).collect()} == {f"a{i}" for i in range(24)}


def test_no_python_on_the_main_path(spark):
    plan = lines.dedup_lines(helpers.table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
