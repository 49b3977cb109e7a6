"""What a session needs before it runs this package's functions in Python workers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Python workers that see the driver's folders find this package beside its parent.

    On a cluster the package must be installed or sent with --py-files, as usual; the entry made here does no harm there.
    """
    environment = spark.sparkContext.environment
    have = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if HOME not in have:
        environment["PYTHONPATH"] = os.pathsep.join([*have, HOME])
    return spark


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer pieces than there are cores is dealt to all of them; others, as any large one, stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only on a local master.  Its files go with the driver's JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(found := tempfile.mkdtemp(prefix="groundline-"))
    path = f"{found.rstrip('/')}/groundline/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(table: DataFrame, name: str) -> DataFrame:
    """A table that several branches read, written once and read again, so that lost executors cost nothing."""
    table.write.parquet(path := scratch(table.sparkSession, name))
    out = table.sparkSession.read.schema(table.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what `kept` wrote; nothing that reads these tables may run any more."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
