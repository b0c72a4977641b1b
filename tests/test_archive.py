import json

import pytest
from pyspark.sql import functions as F

from semlake.sources import archive
from semlake.sources.store import Conflict


@pytest.fixture()
def table(spark):
    return spark.range(200).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.array(F.col("id").cast("smallint")).alias("q"), F.struct(F.lit("x").alias("name"), F.lit(None).cast("string").alias("none")).alias("s")).repartition(3)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.schema.simpleString() == b.schema.simpleString()


def test_round_trip_and_damage(spark, tmp_path, table):
    path = f"file://{tmp_path}/a"
    archive.write_archive(table, path)
    same(archive.read_archive(spark, path), table)
    assert archive.verify(spark, path) == 200
    with pytest.raises(Exception, match="already"):
        archive.write_archive(table, path)
    member = next((tmp_path / "a").glob("part-*"))
    data = bytearray(member.read_bytes())
    data[len(data) // 2] ^= 1
    member.write_bytes(data)
    with pytest.raises(Exception, match="wrong checksum"):
        archive.verify(spark, path)
    with pytest.raises(Exception, match="wrong checksum"):
        archive.read_archive(spark, path).count()
    member.write_bytes(data[:-1])
    with pytest.raises(Exception, match="the index says"):
        archive.read_archive(spark, path)
    none = f"file://{tmp_path}/none"
    archive.write_archive(table.where("false"), none)
    assert archive.read_archive(spark, none).count() == 0


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../../x", "a//b", "", "./x", "a\\b"])
def test_names_stay_inside(tmp_path, name):
    (tmp_path / archive.INDEX).write_text(json.dumps({"schema": "{}", "members": [{"name": name, "bytes": 1, "sha256": "", "rows": 0}]}))
    with pytest.raises(archive.Broken, match="unsafe"):
        archive.read_index(str(tmp_path))


def test_a_lost_writer_leaves_no_archive(spark, tmp_path, table):
    path = f"file://{tmp_path}/a"
    with pytest.raises(Exception, match="killed"):
        archive.write_archive(table.withColumn("x", F.when(F.col("q")[0] == 150, F.raise_error(F.lit("killed"))).otherwise(F.lit("y"))), path)
    with pytest.raises(Exception, match="never finished"):
        archive.read_archive(spark, path).count()


def test_push_refuses_a_stale_base(spark, tmp_path, table):
    remote = archive.Remote(spark, f"file://{tmp_path}/r")
    with pytest.raises(FileNotFoundError):
        remote.pull()
    assert remote.push({"records": table}, 0, schema_version="2") == 1
    number, manifest, tables = remote.pull()
    assert (number, manifest["tables"]["records"]["rows"], manifest["schema_version"]) == (1, 200, "2")
    same(tables["records"], table)
    assert remote.push({"records": table.limit(5)}, 1) == 2
    with pytest.raises(Conflict, match="pull first"):
        remote.push({"records": table}, 1)
    assert remote.pull()[2]["records"].count() == 5
    # Another push while this one writes.
    late = archive.Remote(spark, f"file://{tmp_path}/r")
    late.head = lambda: (2, {})
    assert remote.push({"records": table}, 2) == 3
    with pytest.raises(Conflict, match="faster"):
        late.push({"records": table}, 2)
    assert len(list((tmp_path / "r" / "sets").iterdir())) == 3
