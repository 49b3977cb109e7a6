import os

import pytest
from pyspark.sql import functions as F

from groundline.errors import EmptyCollectionError, IndexBuildError, MissingCollectionError
from groundline.operators.versions import VersionedIndex

COLUMNS = "chunk_id string, text string, section string, embedding array<float>"


def rows_of(spark, items):
    return spark.createDataFrame([(k, t, "s", [1.0, float(len(t))]) for k, t in items], COLUMNS)


def held(table, version=None):
    return {r["chunk_id"]: r["text"] for r in table.read(version).collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    out = VersionedIndex(spark, str(tmp_path / "index"))
    out.create(rows_of(spark, [(f"c{i}", f"t{i}") for i in range(400)]), buckets=32)
    return out


def test_upsert_writes_its_buckets_alone(spark, table):
    before, first = files(table.path), table.manifest()
    new = rows_of(spark, [(f"c{i}", "changed") for i in range(3)] + [("x", "new")])
    second = table.upsert(new)
    assert second.version == 1 and held(table) == {f"c{i}": "changed" if i < 3 else f"t{i}" for i in range(400)} | {"x": "new"}
    touched = {b for b, fs in second.layers.items() if fs != first.layers.get(b)}
    assert 1 <= len(touched) <= 4 and all(second.layers[b][:-1] == first.layers.get(b, []) for b in touched)
    assert before <= files(table.path) and spark.read.parquet(*(files(table.path) - before)).count() == 4
    # the same again, and what is already there, makes no version
    assert table.upsert(new).version == 1 and table.upsert(rows_of(spark, [("c9", "t9")])).version == 1
    assert held(table, 0) == {f"c{i}": f"t{i}" for i in range(400)}


def test_tombstones_and_compaction(spark, table):
    gone = spark.createDataFrame([("c1",), ("c2",), ("none",)], "chunk_id string")
    assert table.delete(gone).version == 1 and "c1" not in held(table) and len(held(table)) == 398
    assert table.delete(gone).version == 1
    table.upsert(rows_of(spark, [("c1", "again")]))
    whole = held(table)
    assert whole["c1"] == "again" and "c2" not in whole
    packed = table.compact()
    assert packed.version == 3 and all(len(fs) == 1 for fs in packed.layers.values()) and held(table) == whole and table.compact().version == 3
    before = files(table.path)
    went = table.vacuum(keep=1)
    assert went and len(files(table.path)) < len(before) and held(table) == whole and table.versions() == [3]


def test_a_failed_write_leaves_the_old_version(spark, table):
    bad = rows_of(spark, [("c1", "changed"), ("c2", "x")]).withColumn("text", F.when(F.col("chunk_id") == "c2", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    assert table.versions() == [0] and held(table)["c1"] == "t1"


def test_the_second_of_two_writers_is_refused(spark, table):
    base = table.manifest()
    table.manifest = lambda version=None: base  # both start from one version
    table.upsert(rows_of(spark, [("c1", "one")]))
    with pytest.raises(IndexBuildError, match="another writer"):
        table.upsert(rows_of(spark, [("c1", "two")]))
    del table.manifest
    assert held(table)["c1"] == "one" and not [n for n in os.listdir(f"{table.path}/commits") if n.startswith(".") and not n.endswith(".crc")]


def test_edges(spark, tmp_path, table):
    with pytest.raises(IndexBuildError, match="there is an index"):
        table.create(rows_of(spark, []))
    with pytest.raises(IndexBuildError, match="no columns"):
        table.upsert(rows_of(spark, [("a", "b")]).withColumn("more", F.lit(1)))
    with pytest.raises(Exception, match="no id"):
        table.upsert(rows_of(spark, [(None, "b")]))
    with pytest.raises(Exception, match="no metadata for a"):
        table.upsert(rows_of(spark, [("a", "b")]).withColumn("section", F.lit("")))
    twice = table.upsert(rows_of(spark, [("d", "b"), ("d", "a")]))
    assert held(table)["d"] == "a" and twice.version == 1
    none = VersionedIndex(spark, str(tmp_path / "none"))
    with pytest.raises(MissingCollectionError):
        none.open()
    with pytest.raises(MissingCollectionError):
        table.read(9)
    none.create(rows_of(spark, []))
    with pytest.raises(EmptyCollectionError):
        none.open()
    assert none.upsert(rows_of(spark, [("a", "b")])).version == 1 and held(none) == {"a": "b"}
