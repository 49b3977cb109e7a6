"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers, identical ones are grouped with their multiplicities, Lloyd's rounds run over the distinct
vectors with sums of integers weighted by those, and the assignments are joined back to the ids.  All numbers are
integers from the quantisation on, so results hang neither on the order of rows nor on the number of tasks.

Defined results: a vector that is null, of another length, or with a component that is null or not finite is left out, and gives no
row; an id of null is a row like any other but starts no centroid; repeated rows count each; rows of one id start centroids in the
order of their vectors; fewer vectors than centroids start fewer centroids, and where none has an id the cluster is null; an empty
table gives no rows; a centroid without vectors stays where it is.  A component beyond `LIMIT` is an error, as squared distances
would not fit a long.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.llm import common

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Components are below this in size; 64 squared differences of 256 times that stay below 2**63.
LIMIT = 1 << 19
#: Products of integers up to this size, summed over the components, are exact in doubles.
EXACT = 1 << 22


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of `scale` times the components, for the vectors that are kept."""

    def whole(x: Column) -> Column:
        return F.when(F.abs(x) < LIMIT, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is not below {LIMIT}")))

    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter((F.size("v") == dim) & finite).select("vec_id", F.transform("v", lambda x: whole(x).cast("int")).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equally near ones the first) and its squared distance."""
    small = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT
    product = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64) if small else x @ centroids.T
    far = (x * x).sum(axis=1)[:, None] - 2 * product + (centroids * centroids).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def vectors_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Multiplicity and weighted sum of the vectors of each centroid: a row for each centroid comes to the driver, whatever the table's size."""
    dim = centroids.shape[1]
    ddl = "cluster int, n long, s array<long>"
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            x, weight = vectors_of(b, dim), b.column("n").to_numpy()
            best, _ = nearest(x, centroids)
            np.add.at(n, best, weight)
            np.add.at(total, best, x * weight[:, None])
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(n[have]), pa.array(list(total[have]), pa.list_(pa.int64()))], schema=out)

    exact = [F.sum(F.col("s")[j].cast("decimal(38,0)")) for j in range(dim)]
    rows = distinct.mapInArrow(run, ddl).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*exact).alias("s")).collect()
    return {r["cluster"]: (r["n"], [int(x) for x in r["s"]]) for r in rows}


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """v, n, cluster and distance of each distinct vector."""
    ddl = "v array<int>, n long, cluster int, distance long"
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, far = nearest(vectors_of(b, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column("v").cast(out.field(0).type), b.column("n"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], schema=out)

    return distinct.select("v", "n").mapInArrow(run, ddl)


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = rows.sparkSession
    kept = quantised(rows, id_col, vector_col, dim, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.filter(F.col("vec_id").isNotNull()).select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not start:
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    distinct = common.materialize(kept.groupBy("v").agg(F.count("*").alias("n")), "distinct")
    for _ in range(rounds):
        for c, (n, total) in sums(distinct, centroids).items():
            centroids[c] = [x // n for x in total]
    # one row for each distinct vector; the last reader is the result itself
    placed = common.materialize(assigned(distinct, centroids), "assigned")
    common.release(distinct)
    each = placed.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("inertia")).collect()
    inertia = {r["cluster"]: int(r["inertia"]) for r in each}
    total = sum(inertia.values())
    named = [(c, inertia.get(c, 0), total, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = common.attach(kept, placed, ["v"], "n", sum(r["n"] for r in each), F.xxhash64("vec_id"))
    # a row for each centroid, so its size is the parameter's
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
