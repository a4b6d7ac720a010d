"""Running totals and ranks that do not put one key's rows into one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import cut_lineage


def total_before(
    df: DataFrame, keys: list[str], order: list[str], cell: Column, sums: Mapping[str, str]
) -> DataFrame:
    """Adds, for each ``sums`` item (new column -> column), its total over the key's earlier rows.

    ``cell`` is a value that grows with ``order`` (say, the hour). Totals per (key, cell) are aggregated
    before the shuffle; only those small rows are ordered per key. Inside a cell a window does the rest,
    so a hot key is spread over its cells.
    """
    rows = df.withColumn("_cell", cell)
    per_cell = rows.groupBy(*keys, "_cell").agg(*[F.sum(col).alias(f"_{name}") for name, col in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_cell.select(
        *keys, "_cell", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    within = (
        Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_cell"]]
    joined = rows.alias("r").join(opening.alias("o"), on).select(
        "r.*", *[F.col(f"o._{n}") for n in sums]
    )
    for name, col in sums.items():
        earlier = F.coalesce(F.sum(col).over(within), F.lit(0))
        joined = joined.withColumn(name, F.col(f"_{name}") + earlier)
    return joined.drop("_cell", *[f"_{n}" for n in sums])


def rank_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Row number within ``keys`` by ``order`` (a total order), also for keys that hold most of the rows.

    Rows are range-partitioned by (keys, order), which splits a hot key; each slice is numbered by itself
    and then shifted by the sizes of the key's earlier slices. The range bounds are sampled, so the
    sliced rows are written out once before they are read twice.
    """
    sliced = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        sliced.groupBy(*keys, "_slice")
        .count()
        .select(*keys, "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    )
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_slice"]]
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.alias("r")
        .join(shift.alias("s"), on)
        .select("r.*", "s._shift")
        .withColumn(out, F.col("_shift") + F.row_number().over(within))
        .drop("_slice", "_shift")
    )
