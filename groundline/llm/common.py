"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.session import importable, spread

#: Documents of one Arrow batch are handled in slices of about so many bytes of text.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(importable(spark).read.parquet(f"{sf_dir}/{table}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master."""
    if (found := spark.conf.get("spark.checkpoint.dir", None)) or (found := spark.sparkContext.getCheckpointDir()):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(path := tempfile.mkdtemp(prefix="groundline-"))
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/groundline/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it a write's shuffle files go from all executors when the write ends, by Spark's own setting; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The files go by `release`, once what reads them is written, or when the driver's JVM ends.
    """
    spark = importable(df.sparkSession)
    path = f"{shared_dir(spark)}/groundline/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Written like `materialize`, in buckets of a column, as many as there are shuffle partitions: grouping by it moves no row."""
    spark = importable(df.sparkSession)
    table = f"groundline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/groundline/{table}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tidy(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.written_at, out.table_name = path, table
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialised tables; nothing that reads them may run any more."""
    for t in tables:
        if t is not None and (name := getattr(t, "table_name", None)):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if t is not None and (path := getattr(t, "written_at", None)):
            where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A key with more than this share of the rows is hot; there are fewer hot keys than this, whatever the size.
HOT_SHARE = 1000


def attach(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, lane: Column, apart: Column | None = None) -> DataFrame:
    """Rows with the other columns of a table that has one row for each key, null where it lacks the key.

    `count` says how many rows have a key, of `total`.  The table's rows for hot keys, fewer than a thousand, are broadcast; rows with such
    keys, and those that `apart` says have no key there, are dealt by `lane`, and all others by their key, none of which is hot.
    """
    others = [c for c in table.columns if c not in keys]
    hot = table.filter(F.col(count) * HOT_SHARE > total)
    rest = table.filter(F.col(count) * HOT_SHARE <= total).withColumn("_lane", F.lit(-1).cast("long"))
    near = rows.join(F.broadcast(hot.withColumnsRenamed({c: f"_hot_{c}" for c in others})), keys, "left")
    alone = F.col(f"_hot_{count}").isNotNull() | (F.lit(False) if apart is None else apart)
    near = near.withColumn("_lane", F.when(alone, F.pmod(lane, F.lit(1 << 31))).otherwise(-1).cast("long"))
    out = near.join(rest, [*keys, "_lane"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in others])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(text: Column) -> Column:
    return text.cast("binary")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema(ddl))


def arrow_schema_of(table: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(table)


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, led by as many signs as it takes to differ from all names taken (which are the same in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


_clear: dict[str, Callable[[], None]] = {}


def enter(operator: str, clear: Callable[[], None] | None = None) -> None:
    """Called in workers: a process that goes over from one operator to another drops what the others kept there."""
    others = [name for name in _clear if name != operator]
    for name in others:
        _clear.pop(name)()
    if others:
        gc.collect()
        trim()
    if clear:
        _clear[operator] = clear


def trim() -> None:
    """Free memory goes back to the system, where the C library can do that: idle workers would hold it."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def numbered(rows: DataFrame) -> DataFrame:
    """Columns by place, c0, c1 and so on: mapInArrow finds no column whose name has a dot."""
    return rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterable[pa.RecordBatch]:
    """Cut batches so that a slice's texts have about `most` bytes; a longer text has a slice of its own.

    Meanwhile the collector of cycles rests: it would scan the words that operators keep again and again.
    """
    import numpy as np
    import pyarrow.compute as pc

    gc.disable()
    try:
        for number, b in enumerate(batches, 1):
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
                yield b.slice(start, end - start)
                start = end
            if number % 32 == 0:
                gc.collect()
    finally:
        gc.enable()
        trim()
