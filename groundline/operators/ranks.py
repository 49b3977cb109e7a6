"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions import vectors as vx
from groundline.session import kept

#: Groups up to this many rows are ranked in one task; of larger ones there are few, whatever the table's size.
MOST_ROWS = 1 << 20
BUCKETS = 1024
#: A range with so many values or fewer is sorted.
FEW = 10_000


def percentiles(rows: DataFrame, column: str, percent: float, group: list[str], most_rows: int = MOST_ROWS, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """group columns and value: the value at rank ceil(percent / 100 * n) of each group's values, nulls left out.

    Groups over `most_rows` are never gathered.  Their values are counted in ranges, the range that holds the rank is cut into ranges again, and
    so on until few values or one value are left; each pass is a partial aggregation of as many rows as there are ranges.  Values are finite
    numbers; a group without values has no row.
    """
    values = rows.filter(F.col(column).isNotNull()).select(*group, F.col(column).alias("_x"))
    counted = values.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    rank = F.greatest(F.ceil(F.lit(percent / 100) * F.col("_n")), F.lit(1)).cast("long")
    state = kept(counted.filter(F.col("_n") > most_rows).withColumn("_rank", rank), "large")
    if state.isEmpty():
        return values.groupBy(*group).agg(vx.nearest_rank("_x", percent).alias("value"))
    same = [F.col(f"v.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    met: Column = F.lit(True)
    for c in same:
        met = met & c
    # at most one row for each `most_rows` rows of the table
    rest = values.alias("v").join(F.broadcast(state.alias("s")), met, "left_anti")
    small = rest.groupBy(*group).agg(vx.nearest_rank("_x", percent).alias("value"))
    inside = lambda: values.alias("v").join(F.broadcast(state.alias("s")), met).filter("v._x between s._lo and s._hi").select(*[F.col(f"v.{g}").alias(g) for g in group], "v._x", "s._lo", "s._hi", "s._rank", "s._n")
    while not state.filter((F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        share = (F.col("_x") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(5e-324)) * buckets
        ranges = inside().withColumn("_b", F.least(F.floor(share), F.lit(buckets - 1))).groupBy(*group, "_b").agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.first("_rank").alias("_rank"))
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b"))
        ranges = ranges.withColumn("_upto", upto).filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        state = kept(ranges.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).select(*group, "_n", "_lo", "_hi", "_rank"), "large")
    # one value is left, or few that are sorted
    last = inside().groupBy(*group).agg(F.when(F.max("_n") > few, F.min("_lo")).otherwise(F.element_at(F.sort_array(F.collect_list(F.when(F.col("_n") <= few, F.col("_x")))), F.max("_rank").cast("int"))).alias("value"))
    return small.unionByName(last)
