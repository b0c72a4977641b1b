"""Every maintenance command on a small store."""

import pytest
from pyspark.sql import functions as F

from semlake import cli, schemas
from semlake.functions import keys
from semlake.operators import index
from semlake.sources.store import Conflict, Store
from tests.test_engine import H1, H2, H3, experience, frame


@pytest.fixture()
def store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    mention = lambda *hs: [("m", bytearray(h)) for h in hs]
    recs = frame(spark, [
        {"key": experience("one", H1), "kind": 8, "name": "one", "interpretation": "i", "constituents": mention(H1), "goal_patterns": ["a = b"]},
        {"key": experience("two", H1, H2), "kind": 8, "name": "two", "interpretation": "i", "constituents": mention(H1, H2), "goal_patterns": ["c"]},
        {"key": experience("bare", H2), "kind": 8, "name": "bare", "interpretation": "i", "constituents": mention(H2)},
        {"key": bytearray(H1 + b"\1const"), "kind": 1, "name": "T.const", "expr": "nat", "interpretation": "a constant"},
        {"key": bytearray(b"\3" * 16 + b"\1wip"), "kind": 1, "name": "T.wip", "interpretation": "w"},
    ])
    status = spark.createDataFrame([(bytearray(H1), 1, 0, 0, 2, 0.5, True, "a"), (bytearray(H2), 1, 0, 0, 2, 0.5, False, "a")], schemas.MODULE_STATUS)
    names = spark.createDataFrame([(bytearray(H1), "A.T", None), (bytearray(H2), "A.U", None), (bytearray(H3), "A.T", None)], schemas.MODULE_NAMES)
    store.change().replace("records", recs).replace("module_status", status).replace("module_names", names, ("hash",)).commit()
    return store


def run(store, *argv, **more):
    return cli.main([store.root, *argv], store.spark, **more)


def names(store):
    return sorted(r.name for r in store.read("records").collect())


def vector_keys(store, model="a/b"):
    return {bytes(r.key) for r in store.read(cli.vector_table(model)).collect()}


def test_list_status_and_prune(store, capsys):
    assert run(store, "list") == run(store, "status") == 0
    out = capsys.readouterr().out
    assert "A.U" in out and "records 1 0 deltas" in out
    store.upsert("module_status", store.read("module_status").limit(1))
    assert run(store, "compact") == 0 and store.tables()["module_status"]["deltas"] == []
    assert run(store, "prune", "--keep", "1") == 0 and len(store.commits()) == 1


def test_embed_asks_first_and_lists_what_has_no_text(store, capsys, tmp_path):
    asked = []
    assert run(store, "embed", "a/b", "--dimension", "16", confirm=lambda c: asked.append(c)) == 0
    assert "no text: bare" in capsys.readouterr().out and not cli.models(store) and len(asked) == 1
    assert run(store, "embed", "a/b", "--dimension", "16", confirm=lambda c: True) == 0
    assert cli.models(store) == ["a/b"] and len(vector_keys(store)) == 4
    assert {r.total_tokens > 0 for r in store.read("embed_status").collect()} == {True}
    assert run(store, "embed", "a/b", "--dimension", "16", "--yes") == 0 and "embedded 0" in capsys.readouterr().out
    assert run(store, "keys", "a/b", f"{tmp_path}/keys") == 0
    assert store.spark.read.json(f"{tmp_path}/keys").count() == 4


def test_remove(store, capsys):
    run(store, "embed", "a/b", "--dimension", "16", "--yes")
    assert run(store, "remove", "A.") == 1 and "ambiguous" in capsys.readouterr().out
    before = store.head()[0]
    assert run(store, "remove", "A.U") == 0 and store.head()[0] == before
    assert run(store, "remove", "A.U", "--yes") == 0 and store.head()[0] == before + 1
    assert names(store) == ["T.const", "T.wip", "one"] and len(vector_keys(store)) == 3
    assert [bytes(r.key) for r in store.read("module_status").collect()] == [H1]


def test_fsck_reindex_and_clean(store):
    run(store, "embed", "a/b", "--dimension", "16", "--yes")
    assert run(store, "fsck") == 0 and run(store, "reindex") == 0
    moved = store.read("records").withColumn("key", F.when(F.col("name") == "one", keys.with_prefix(F.col("key"), F.lit(H3))).otherwise(F.col("key")))
    vecs = store.read(cli.vector_table("a/b"))
    wrong = vecs.withColumn("key", F.when(F.col("key") == F.lit(bytes(experience("one", H1))), F.lit(bytes(experience("one", prefix=H3)))).otherwise(F.col("key")))
    store.change().replace("records", moved).replace(cli.vector_table("a/b"), wrong).commit()
    assert run(store, "fsck") == 1 and run(store, "fsck", "--fix") == 0
    assert bytes(experience("one", H1)) in vector_keys(store) and store.read("posting").count() == 4
    assert run(store, "clean-wip") == 0 and "T.wip" not in names(store) and len(vector_keys(store)) == 3


def test_push_and_pull(store, spark, tmp_path, capsys):
    run(store, "embed", "a/b", "--dimension", "16", "--yes")
    remote = f"file://{tmp_path}/remote"
    assert run(store, "push", remote) == 0 and run(store, "status", remote) == 0 and "remote 1" in capsys.readouterr().out
    other = Store(spark, f"file://{tmp_path}/o")
    assert run(other, "pull", remote) == 0 and names(other) == names(store) and vector_keys(other) == vector_keys(store)
    new = frame(spark, [{"key": bytearray(H2 + b"\1new"), "kind": 1, "name": "T.new", "interpretation": "n"}])
    other.upsert("records", new)
    assert run(other, "push", remote) == 0
    with pytest.raises(Conflict, match="pull first"):
        run(store, "push", remote)
    assert run(store, "pull", remote) == 0 and "T.new" in names(store) and run(store, "push", remote) == 0
    # Vectors that are all of a wrong length are refused before anything is written.
    bad = store.read(cli.vector_table("a/b")).withColumn("q", F.slice("q", 1, 8))
    other.change().replace(cli.vector_table("a/b"), bad).commit()
    run(other, "pull", remote) if other.head()[1]["facts"]["pulled"] == 3 else None
    third = Store(spark, f"file://{tmp_path}/t")
    run(third, "pull", remote)
    third.change().replace(cli.vector_table("a/b"), bad).replace("records", new).commit()
    assert run(third, "push", remote) == 0
    before = store.head()
    with pytest.raises(ValueError, match="another length"):
        run(store, "pull", remote)
    assert store.head() == before


def test_migrate_moves_records_vectors_and_index_at_once(store, monkeypatch):
    run(store, "embed", "a/b", "--dimension", "16", "--yes")
    before = (names(store), vector_keys(store))
    with monkeypatch.context() as m:
        m.setattr("semlake.sources.store.Files.write_new", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            run(store, "migrate", H3.hex())
    assert (names(store), vector_keys(store)) == before
    assert run(store, "migrate", H2.hex()) == 1  # nothing else of that name
    assert run(store, "migrate", H3.hex()) == 0
    got = {bytes(r.key): r.name for r in store.read("records").collect()}
    assert got == {bytes(experience("one", H3)): "one", bytes(experience("two", H3, H2)): "two", bytes(experience("bare", H2)): "bare", H1 + b"\1const": "T.const", H3 + b"\1const": "T.const", b"\3" * 16 + b"\1wip": "T.wip"}
    assert vector_keys(store) == set(got) - {bytes(experience("bare", H2))}
    assert index.difference(store.read("records").where("kind = 8"), store.read("posting")).count() == 0
