"""Ordered scans over keys of any size.

A plain window hands all rows of a key to one task. Here the rows are first
range-partitioned by key and order, which also cuts a hot key into slices of
even size. Each slice is scanned on its own, and a second, much smaller pass
carries the totals from slice to slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.session import materialize


def running_position(df: DataFrame, keys: list[str], order: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """Number the rows of each key from one."""
    return running_sum(df, keys, order, {out: F.lit(1)}, ties)


def running_sum(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], ties: list[str] | None = None
) -> DataFrame:
    """Running totals per key in the given order, including the current row.

    The sliced rows are written once, because both passes must see the same
    slices even if an executor is lost in between.
    """
    ties = ties or []
    rows = df.withColumns({f"_v_{name}": value.cast("long") for name, value in sums.items()})
    rows = materialize(
        rows.repartitionByRange(*keys, order, *ties).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    totals = rows.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    within = (
        Window.partitionBy(*keys, "_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    )
    scanned = rows.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(within) for n in sums})
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return scanned.join(carried, same).select(
        *df.columns, *[(F.col(f"_w_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    )
