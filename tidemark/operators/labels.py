"""Event labels that look ahead a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W


def triple_barrier(daily: DataFrame, profit: Column | float = 0.02, loss: Column | float = 0.02, horizon: int = 10) -> DataFrame:
    """The first barrier that the next ``horizon`` closes touch: ``upper``, ``lower`` or ``time``.

    ``touch_idx`` counts rows from the entry. Entries without any later row have none of it. An entry at a
    close of 0 touches nothing, and its return is null.
    """
    ahead = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, horizon)
    path = F.collect_list("close").over(ahead)
    returns = F.transform("path", lambda p: F.try_divide(p, F.col("close")) - 1)
    hit = lambda test: F.array_position(F.transform("returns", test), True)
    touched = (
        daily.withColumn("path", path)
        .withColumn("returns", returns)
        .withColumn("touch_idx", hit(lambda r: (r >= profit) | (r <= -loss)))
    )
    idx = F.when(F.col("touch_idx") > 0, F.col("touch_idx")).otherwise(F.size("path").cast("long"))
    at_touch = F.try_element_at("returns", F.col("touch_idx").cast("int"))
    return (
        touched.withColumn("found", F.col("touch_idx") > 0)
        .withColumn("touch_idx", idx)
        .filter("touch_idx > 0")
        .withColumn("return_at_touch", at_touch)
        .withColumn("touch_type", F.when(~F.col("found"), "time").when(F.col("return_at_touch") > 0, "upper").otherwise("lower"))
        .withColumn("label", F.when(F.col("touch_type") == "upper", 1).when(F.col("touch_type") == "lower", -1).otherwise(0).cast("long"))
        .select("symbol", "date", "label", "touch_type", "touch_idx", "return_at_touch")
    )


def touch_summary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("symbol", "touch_type").agg(
        F.count(F.lit(1)).alias("n"), F.mean("return_at_touch").alias("mean_return"), F.mean("touch_idx").alias("mean_idx")
    )


def volatility_barriers(returns: DataFrame, n: int = 20, multiple: float = 1.5, horizon: int = 10) -> DataFrame:
    """Triple barriers at a multiple of each row's trailing volatility.

    A missing volatility is the symbol's median one; none is under 1e-8.
    """
    rows = returns.withColumn("_vol", W.rolling(F.stddev_samp, F.col("ret"), n))
    median = rows.groupBy("symbol").agg(F.median("_vol").alias("_median"))
    usual = F.coalesce("_vol", "_median", F.lit(0.0))
    scaled = rows.join(median, "symbol").withColumn("_barrier", multiple * F.greatest(usual, F.lit(1e-8)))
    return triple_barrier(scaled, F.col("_barrier"), F.col("_barrier"), horizon)
