"""Which files of an embedding cache may hold some keys: a Bloom filter for each file, beside the cache.

A filter has ten to twenty bits for each key, a few thousandths of the vectors' bytes.  The filters stand in a hidden folder of the cache, which readers of
the cache pass over, and name their files without a folder, so that a cache may be moved.  A file without a filter (its writer was lost
between the two) may hold anything and is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.settings import DEFAULT, Settings

BITS_PER_KEY, PROBES = 10, 7
#: Keys of one file at most, so that a filter is made in one task.
KEYS_PER_FILE = 200_000
#: What a wanted key takes where it is sent to every worker.
KEY_BYTES = 128
_FILTER_DDL = "file string, n_keys long, bits binary"


def folder_of(path: str) -> str:
    return f"{path.rstrip('/')}/_filters"


def probes(keys: Iterable[str]) -> np.ndarray:
    """PROBES whole numbers of 64 bits for each key."""
    both = np.frombuffer(b"".join(hashlib.blake2b(k.encode(errors="replace"), digest_size=16).digest() for k in keys), "<u8").reshape(-1, 2)
    return both[:, :1] + (both[:, 1:] | np.uint64(1)) * np.arange(PROBES, dtype=np.uint64)


def filter_of(keys: Iterable[str]) -> bytes:
    """A power of two of bits."""
    at = probes(keys)
    size = 1 << max(6, int(BITS_PER_KEY * max(1, len(at)) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(at & np.uint64(size - 1)).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, at: np.ndarray) -> np.ndarray:
    """For each key, by its probes: is it in the filter, for all that this can tell?"""
    held = np.frombuffer(bits, np.uint8)
    place = at & np.uint64(len(held) * 8 - 1)
    return ((held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def files_of(table: DataFrame) -> dict[str, str]:
    """Paths by file name."""
    return {p.rpartition("/")[2]: p for p in table.inputFiles()}


def filters(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_FILTER_DDL).parquet(folder_of(path))
    except AnalysisException:
        return None


def add_filters(spark: SparkSession, path: str) -> None:
    """A filter for each file of the cache that has none."""
    import pandas as pd

    have = filters(spark, path)
    known = set() if have is None else {r["file"] for r in have.select("file").collect()}
    new = [p for name, p in files_of(spark.read.parquet(path)).items() if name not in known]
    if not new:
        return

    def made(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file": [part["file"].iloc[0]], "n_keys": [len(part)], "bits": [filter_of(part["text_key"])]})

    keys = spark.read.parquet(*new).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "text_key")
    keys.filter("text_key is not null").groupBy("file").applyInPandas(made, _FILTER_DDL).write.mode("append").parquet(folder_of(path))


def append(fresh: DataFrame, path: str) -> None:
    """Rows of the cache, then the filters of their files; no rows write nothing."""
    if not fresh.isEmpty():
        fresh.write.mode("append").option("maxRecordsPerFile", KEYS_PER_FILE).parquet(path)
        add_filters(fresh.sparkSession, path)


def candidates(spark: SparkSession, path: str, wanted: DataFrame, settings: Settings = DEFAULT) -> list[str]:
    """Paths of the files that may hold a wanted key (text_key).

    The keys go to every worker if they are few; else all files are taken, as nearly each would have one of them.
    """
    table = files_of(spark.read.parquet(path))
    have = filters(spark, path)
    most = settings.broadcast_bytes // KEY_BYTES
    keys = [r["text_key"] for r in wanted.filter("text_key is not null").select("text_key").distinct().limit(most + 1).collect()]
    if have is None or len(keys) > most:
        return list(table.values())
    at = spark.sparkContext.broadcast(probes(keys))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [bool(may_hold(bits, at.value).any()) for bits in b.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(hit, pa.bool_())], names=["file", "hit"])

    found = {r["file"]: r["hit"] for r in have.mapInArrow(run, "file string, hit boolean").collect()}
    return [p for name, p in table.items() if found.get(name, True)]


def lookup(spark: SparkSession, path: str, wanted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The cache without files that hold no wanted key; every row of a wanted key is in it."""
    schema = spark.read.parquet(path).schema
    paths = candidates(spark, path, wanted, settings)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
