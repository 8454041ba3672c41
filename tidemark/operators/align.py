"""Joins that align series in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its keys at or before it.

    One shuffle: both sides are put together and the last right row is carried forward.
    """
    carried = [F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values]
    a = left.withColumn("_left", F.lit(1)).select("*", F.lit(None).cast("boolean").alias("_is"), *carried)
    blanks = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, at)]
    b = right.select(*keys, at, *blanks, F.lit(0).alias("_left"), F.lit(True).alias("_is"), *[F.col(v).alias(f"_{v}") for v in values])
    both = a.unionByName(b)
    frame = Window.partitionBy(*keys).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_is"), F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(frame)
    return both.withColumn("_last", last).filter("_left = 1").select(*left.columns, "_last.*")


def forward_fill(rows: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({v: F.last(v, ignorenulls=True).over(frame) for v in values})


def interpolate(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Fills nulls of ``value`` on the line between its neighbours by days; null outside them."""
    by = Window.partitionBy(*keys).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.unix_date(at).alias("d")))
    near = rows.withColumns(
        {
            "_a": F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)),
            "_b": F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    step = (F.col("_b.v") - F.col("_a.v")) * (F.unix_date(at) - F.col("_a.d")) / F.nullif(F.col("_b.d") - F.col("_a.d"), F.lit(0))
    return near.withColumn(value, F.coalesce(F.col(value), F.col("_a.v") + step)).drop("_a", "_b")


def reconcile(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Full-outer comparison of two ``symbol, qty`` tables; a missing quantity counts as 0."""
    a = ours.select("symbol", F.col("qty").alias("_a"))
    b = theirs.select("symbol", F.col("qty").alias("_b"))
    status = F.when(F.col("_b").isNull(), "internal_only").when(F.col("_a").isNull(), "broker_only").when(F.col("_a") != F.col("_b"), "mismatch")
    return a.join(b, "symbol", "full_outer").select(
        "symbol",
        F.coalesce("_a", F.lit(0)).alias("internal_qty"),
        F.coalesce("_b", F.lit(0)).alias("broker_qty"),
        status.otherwise("match").alias("status"),
    )
