"""The index as a versioned table: buckets of Parquet layers, and one manifest for each commit.

A row lies in the bucket of its id's hash.  An upsert writes the rows that are new or differ, as a layer on the buckets that they lie
in and on no others; a deletion writes tombstones the same way.  A commit is a manifest that names the layers of every bucket, renamed into
place once all files are written, so a reader sees the old version or the new one, a failed write leaves the old one as it was, and of
two writers that start from one version the second is refused.  A read takes each id's row from its newest layer; compaction writes buckets
of several layers as one, and what no kept manifest names is deleted by `vacuum`.

Defined results: of rows with one id in one upsert that with the least text counts; a null id, or a row whose metadata are all empty, is
an error; an upsert that changes nothing makes no version; columns that the table lacks are refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.errors import EmptyCollectionError, IndexBuildError, MissingCollectionError
from groundline.operators.index import REQUIRED, one_for_each_id

BUCKETS = 64
KEY = "chunk_id"
#: Columns of the files beside those of the table.
GONE, BUCKET, LAYER = "_gone", "_bucket", "_layer"


@dataclass
class Manifest:
    """A version: for each bucket its layers, oldest first."""

    version: int
    schema: str
    buckets: int
    layers: dict[str, list[str]]

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


class VersionedIndex:
    """An index at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(folder))) if self._files.exists(self._at(folder)) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> Manifest:
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise MissingCollectionError(f"there is no version {'' if version is None else version} at {self.path}")
        name = f"commits/{have[-1] if version is None else version:012d}.json"
        with_lines = self.spark.read.text(f"{self.path}/{name}", wholetext=True)
        return Manifest(**json.loads(with_lines.first()[0]))

    def _commit(self, manifest: Manifest) -> Manifest:
        """Write the manifest beside its place and rename it, which fails if another commit came first."""
        draft, place = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{manifest.version:012d}.json")
        out = self._files.create(draft)
        out.write(manifest.text().encode())
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        plain[0] = self._hadoop.Options.Rename.NONE
        try:
            context.rename(draft, place, plain)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise IndexBuildError(f"version {manifest.version} was committed by another writer") from e
            raise
        return manifest

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Rows as files of their buckets; the folder of each bucket that has any."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{BUCKET}=")}

    def _checked(self, rows: DataFrame, fields: list[str]) -> DataFrame:
        if extra := [c for c in rows.columns if c not in fields]:
            raise IndexBuildError(f"the index has no columns {', '.join(extra)}")
        told = [F.coalesce(F.size(c) > 0 if dict(rows.dtypes)[c].startswith("array") else F.col(c).cast("string") != "", F.lit(False)) for c in REQUIRED if c in rows.columns]
        empty = ~F.greatest(*told, F.lit(False)) if told else F.lit(False)
        key = F.when(F.col(KEY).isNull(), F.raise_error(F.lit("a row has no id"))).when(empty, F.raise_error(F.concat(F.lit("no metadata for "), F.col(KEY).cast("string")))).otherwise(F.col(KEY))
        return one_for_each_id(rows).withColumn(KEY, key)

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> Manifest:
        """Version 0; an index that is there already is an error."""
        if self.versions():
            raise IndexBuildError(f"there is an index at {self.path}")
        found = self._write(self._checked(rows, rows.columns).withColumn(GONE, F.lit(False)), buckets)
        return self._commit(Manifest(0, rows.schema.json(), buckets, {b: [f] for b, f in found.items()}))

    def _rows(self, manifest: Manifest, only: set[str] | None = None) -> DataFrame:
        """Rows of some buckets as they are now: buckets of one layer as they lie, the others by the newest layer of each id."""
        kind = T.StructType.fromJson(json.loads(manifest.schema))
        stored = T.StructType([*kind.fields, T.StructField(GONE, T.BooleanType())])
        chosen = {b: fs for b, fs in manifest.layers.items() if only is None or b in only}
        read = lambda paths: self.spark.read.schema(stored).parquet(*[f"{self.path}/{p}" for p in paths])
        out = [read([fs[0] for fs in chosen.values() if len(fs) == 1])] if any(len(fs) == 1 for fs in chosen.values()) else []
        if deep := [fs for fs in chosen.values() if len(fs) > 1]:
            layers = [read([fs[n] for fs in deep if len(fs) > n]).withColumn(LAYER, F.lit(n)) for n in range(max(map(len, deep)))]
            every = layers[0]
            for x in layers[1:]:
                every = every.unionByName(x)
            newest = Window.partitionBy(KEY).orderBy(F.col(LAYER).desc())
            out.append(every.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", LAYER))
        if not out:
            return self.spark.createDataFrame([], kind)
        whole = out[0] if len(out) == 1 else out[0].unionByName(out[1])
        return whole.filter(~F.col(GONE)).drop(GONE)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        return self._rows(self.manifest(version))

    def open(self) -> DataFrame:
        """The newest version; missing and empty ones have errors of their own."""
        out = self.read()
        if out.isEmpty():
            raise EmptyCollectionError(f"the index at {self.path} has no rows")
        return out

    def _layered(self, base: Manifest, rows: DataFrame) -> Manifest:
        """A version with these rows (and tombstones) on top, or the one before it if there are none."""
        found = self._write(rows, base.buckets)
        if not found:
            return base
        return self._commit(Manifest(base.version + 1, base.schema, base.buckets, base.layers | {b: [*base.layers.get(b, []), f] for b, f in found.items()}))

    def _touched(self, ids: DataFrame, base: Manifest) -> set[str]:
        """The buckets of some ids: one number for each bucket at most."""
        return {str(r[0]) for r in ids.select(F.pmod(F.xxhash64(KEY), F.lit(base.buckets)).alias("b")).distinct().collect()}

    def upsert(self, rows: DataFrame) -> Manifest:
        """Rows in place of those of the same ids; only those that are new or differ are written, on their buckets alone."""
        base = self.manifest()
        kind = T.StructType.fromJson(json.loads(base.schema))
        full = self._checked(rows, kind.names).select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        digest = lambda df: df.withColumn("_same", F.sha2(F.to_json(F.struct(*kind.names), {"ignoreNullFields": "false"}), 256))
        now = digest(self._rows(base, self._touched(full, base))).select(KEY, "_same")
        changed = digest(full).join(now, [KEY, "_same"], "left_anti").drop("_same").withColumn(GONE, F.lit(False))
        return self._layered(base, changed)

    def delete(self, ids: DataFrame) -> Manifest:
        """Without the rows of these ids; ids that are not there change nothing."""
        base = self.manifest()
        kind = T.StructType.fromJson(json.loads(base.schema))
        now = self._rows(base, self._touched(ids, base)).join(ids.select(KEY).distinct(), KEY, "left_semi")
        stones = [(F.col(f.name) if f.name == KEY else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields]
        return self._layered(base, now.select(*stones, F.lit(True).alias(GONE)))

    def compact(self, layers: int = 2) -> Manifest:
        """Buckets of so many layers or more as one; their tombstones go."""
        base = self.manifest()
        deep = {b for b, fs in base.layers.items() if len(fs) >= layers}
        if not deep:
            return base
        found = self._write(self._rows(base, deep).withColumn(GONE, F.lit(False)), base.buckets)
        rest = {b: fs for b, fs in base.layers.items() if b not in deep}
        return self._commit(Manifest(base.version + 1, base.schema, base.buckets, rest | {b: [f] for b, f in found.items()}))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the newest manifests and the layers that none of those names; the folders that went."""
        *old, = self.versions()[:-keep] if keep else []
        used = {f for v in self.versions()[-keep:] for fs in self.manifest(v).layers.values() for f in fs}
        for v in old:
            self._files.delete(self._at(f"commits/{v:012d}.json"), False)
        gone = []
        for folder in self._names("data"):
            for bucket in self._names(f"data/{folder}"):
                if bucket.startswith(f"{BUCKET}=") and (name := f"data/{folder}/{bucket}") not in used:
                    self._files.delete(self._at(name), True)
                    gone.append(name)
        return gone
