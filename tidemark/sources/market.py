"""Bars and series over the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(rows: DataFrame, keys: list[str], price: str, order: str, volume) -> DataFrame:
    """One bar per key: the first, highest, lowest and last price in ``order``, and the volume."""
    return rows.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        volume.alias("volume"),
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderkey"
    )
    return ohlcv(rows, ["symbol", "date"], "o_totalprice", "o_orderkey", F.count(F.lit(1)))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"))


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with a volume, the number in their properties."""
    rows = table(spark, sf_dir, "events")
    volume = F.get_json_object("props", "$.k").cast("double").alias("volume")
    return rows.select("event_id", "ts", "user_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"), volume)
