"""Pivots: a few centres fitted on a bounded sample, by which vectors are dealt to blocks whose products can be bounded.

A vector y dealt to pivot q lies within the pivot's radius of its centre, so no product of x with such a y is over x.q + |x| * radius.
Blocks of bounded size meet only where that bound lets them, and every pair of rows beyond it is left out without being looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.session import kept

#: Rows that centres are fitted on, at most; every row is dealt all the same.
SAMPLE_ROWS = 16_384
MOST_PIVOTS = 256
#: Bytes of vectors in one block, in doubles; a task holds two blocks and a strip of their product.
BLOCK_BYTES = 4 << 20
STRIP = 128
#: What a product's order of terms may change, and more.
SLACK = 1e-9


def lloyd(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres of some rows; they start at rows spread evenly over the sample's order, which is that of hashes."""
    x = np.unique(x, axis=0) if len(x) <= k else x
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds if len(x) > len(centres) else 0):
        nearest = nearest_centre(x, centres)
        n = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(half - x[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def sample(table: DataFrame, item_id: str, most: int = SAMPLE_ROWS, n: int | None = None) -> np.ndarray:
    """Vectors of the rows whose ids hash lowest, at most so many; the same ones however the table is dealt.

    Of n rows (counted unless told) only those of the lowest hashes are sent, one and a half times as many as are taken, not the lowest of each task.
    """
    n = table.select(item_id).count() if n is None else n
    rows = table.select(F.xxhash64(item_id).alias("h"), F.col(item_id).alias("i"), F.col("embedding"))
    share = 1.5 * (most + 100) / max(1, n)
    if share < 1:
        low = rows.filter(F.col("h") < int(share * (1 << 64)) - (1 << 63))
        rows = low if low.count() >= most else rows
    taken = rows.orderBy("h", "i").limit(most).select("embedding").collect()
    return np.array([r["embedding"] for r in taken], float) if taken else np.zeros((0, 0))


@dataclass
class Dealt:
    """Items with pivot and slice, and what is known of each pivot: at most MOST_PIVOTS rows."""

    items: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    slices: np.ndarray
    kind: str
    #: Of each pivot the block that its first slice lies in; small pivots share one.  And the type of the vectors.
    blocks: np.ndarray
    vector: str


def bounds(x: np.ndarray, centres: np.ndarray, radius: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The greatest product that each row of x can have with any item of each pivot; a pivot without items has none."""
    length = np.sqrt((x * x).sum(axis=1))
    return np.where(rows[None, :] > 0, x @ centres.T + length[:, None] * radius[None, :] + SLACK, -np.inf)


def blocks_of(centres: np.ndarray, rows: np.ndarray, slices: np.ndarray, block_rows: int) -> np.ndarray:
    """The first block of each pivot: one of several slices has blocks of its own, and small ones share a block with those that are nearest."""
    out, free, n = np.zeros(len(centres), int), list(np.flatnonzero(slices == 1)), 0
    while free:
        first = free[0]
        apart = ((centres[free] - centres[first]) ** 2).sum(axis=1)
        near = [free[k] for k in np.argsort(apart, kind="stable")]
        taken = near[: max(1, int((np.cumsum(rows[near]) <= block_rows).sum()))]
        out[taken] = n
        free, n = [p for p in free if p not in set(taken)], n + 1
    for p in np.flatnonzero(slices > 1):
        out[p], n = n, n + slices[p]
    return out


def deal(table: DataFrame, item_id: str, pivots: int | None = None, block_bytes: int = BLOCK_BYTES) -> Dealt:
    """Items (_i, _v) with the pivot that is nearest (_p), a slice of its rows (_s), so that no slice is larger than a block on average, and their block (_b).

    The dealt items are written once: the radii, both sides of a join and its second step read them.
    """
    import pandas as pd

    kind, n = dict(table.dtypes)[item_id], table.select(item_id).count()
    taken = sample(table, item_id, n=n)
    centres = lloyd(taken, min(MOST_PIVOTS, pivots or max(1, math.isqrt(n) // 2))) if len(taken) else taken

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["_v"].to_numpy()).astype(float)
                p = nearest_centre(x, centres)
                yield b.assign(_p=p, _r=np.sqrt(((x - centres[p]) ** 2).sum(axis=1)))

    vector = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = table.select(F.col(item_id).alias("_i"), F.col("embedding").cast(vector).alias("_v"))
    placed = kept(rows.mapInPandas(run, f"_i {kind}, _v {vector}, _p int, _r double"), "dealt")
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in placed.groupBy("_p").agg(F.max("_r").alias("r"), F.count("*").alias("n")).collect():
        radius[r["_p"]], count[r["_p"]] = r["r"], r["n"]
    block_rows = max(1, block_bytes // (8 * max(1, taken.shape[1])))
    slices = np.maximum(1, -(-count // block_rows))
    number = F.element_at(F.array(*[F.lit(int(s)) for s in slices]), F.col("_p") + 1) if len(slices) else F.lit(1)
    items = placed.select("_i", "_v", "_p", F.pmod(F.xxhash64("_i"), number).cast("int").alias("_s"))
    blocks = blocks_of(centres, count, slices, block_rows)
    first = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("_p") + 1) if len(blocks) else F.lit(0)
    return Dealt(items.withColumn("_b", first + F.col("_s")), centres, radius * (1 + 1e-12) + 1e-12, count, slices, kind, blocks, vector)


def reached(items: DataFrame, dealt: Dealt) -> DataFrame:
    """Items with the pivots (_reach) whose bound reaches the item's _limit: a list for each item, so that no vector is repeated here."""
    import pandas as pd

    known = dealt.centres, dealt.radius, dealt.rows

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                hit = bounds(np.stack(b["_v"].to_numpy()).astype(float), *known) >= b["_limit"].to_numpy(float)[:, None]
                yield b.assign(_reach=[np.flatnonzero(h).astype(np.int32) for h in hit])

    rows = items.select("_i", "_v", "_p", "_s", "_b", F.col("_limit").cast("double").alias("_limit"))
    return rows.mapInPandas(run, f"_i {dealt.kind}, _v {dealt.vector}, _p int, _s int, _b int, _limit double, _reach array<int>")


def meeting(items: DataFrame, dealt: Dealt) -> DataFrame:
    """A row for each item and each pivot (_q) whose bound reaches the item's _limit: the only pivots that the item has to meet."""
    return reached(items, dealt).select("_i", "_v", "_p", "_s", F.explode("_reach").alias("_q"))


def wanted(dealt: Dealt) -> Column:
    """The blocks, each once, in which the slices of the pivots of _reach lie."""
    held = [F.array(*[F.lit(int(b + s)) for s in range(n)]) for b, n in zip(dealt.blocks, dealt.slices, strict=True)]
    if not held:
        return F.array().cast("array<int>")
    return F.array_distinct(F.flatten(F.transform("_reach", lambda p: F.element_at(F.array(*held), p + 1))))


def skipped(met: DataFrame, dealt: Dealt) -> tuple[int, int]:
    """How many pairs of an item and another pivot's blocks were left out, of how many."""
    every = int(dealt.rows.sum()) * len(dealt.centres)
    return every - met.count(), every
