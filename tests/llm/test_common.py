from groundline.llm import common


def test_a_worker_drops_what_other_operators_kept():
    kept = {"a": [1], "b": [2]}
    common.enter("a", kept["a"].clear)
    common.enter("a", kept["a"].clear)
    assert kept["a"] == [1]
    common.enter("b", kept["b"].clear)
    assert kept == {"a": [], "b": [2]}
    common.enter("c")
    assert kept["b"] == []


def test_released_tables_are_gone(spark):
    import os

    table = common.materialize(spark.range(5).toDF("x"), "test")
    path = table.written_at.removeprefix("file:")
    buckets = common.bucketed(spark.range(5).toDF("x"), "test", "x")
    assert table.count() == buckets.count() == 5 and os.path.isdir(path)
    common.release(table, buckets, None, spark.range(1))
    assert not os.path.isdir(path) and not spark.catalog.tableExists(buckets.table_name)


def test_names_that_are_free():
    assert common.fresh("key", ["a", "KEY", "_key"]) == "__key" and common.fresh("x", []) == "x"
