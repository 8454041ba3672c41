"""Bars of coarser resolution that never cross a session or a day."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bars

# The names of the resolutions.
RESOLUTIONS = {"1min": 1, "2min": 2, "3min": 3, "5min": 5, "10min": 10, "15min": 15, "30min": 30, "1h": 60}


def minutes_of(resolution: str) -> int:
    """Minutes of a resolution by name, or of a positive number with ``min`` or ``m`` or alone; anything else raises ValueError."""
    if resolution in RESOLUTIONS:
        return RESOLUTIONS[resolution]
    found = re.fullmatch(r"\s*(\d+)\s*(?:m|min)?\s*", str(resolution), re.ASCII)
    if not found or not int(found[1]):
        raise ValueError(f"no resolution: {resolution!r}; known are {', '.join(RESOLUTIONS)}")
    return int(found[1])


def minute_bars(ticks: DataFrame) -> DataFrame:
    """One-minute bars of ticks: ``symbol, ts, open, high, low, close, volume, trade_count, vwap, date, session``.

    ``vwap`` weighs prices by volume; without volume it is null.
    """
    first_last = F.struct("ts", "event_id")
    found = ticks.groupBy("symbol", F.date_trunc("minute", "ts").alias("at")).agg(
        F.min_by("price", first_last).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", first_last).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.try_divide(F.sum(F.col("price") * F.col("volume")), F.nullif(F.sum("volume"), F.lit(0.0))).alias("vwap"),
    )
    return found.withColumnRenamed("at", "ts").withColumns({"date": F.to_date("ts"), "session": bars.session("ts")})


def resample(rows: DataFrame, minutes: int, within: str = "session") -> DataFrame:
    """``rows`` (as of ``minute_bars``) in bars of ``minutes``.

    ``within`` tells what a bar may not cross: ``session`` (of a day), ``date``, or ``none``. A
    group of one row stays as it is, with its own time; else bars begin at multiples of ``minutes``
    from midnight (of the symbol's first day, for ``none``). Bars without a close are left out.
    """
    keys = {"session": ["symbol", "date", "session"], "date": ["symbol", "date"], "none": ["symbol"]}[within]
    start = F.col("date").cast("timestamp")
    if within == "none":
        start = F.min("date").over(Window.partitionBy("symbol")).cast("timestamp")
    place = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(start)) / (60 * minutes))
    begins = F.timestamp_seconds(F.unix_timestamp("start") + F.col("place") * 60 * minutes)
    weighted = F.sum(F.col("vwap") * F.col("volume"))
    found = (
        rows.withColumn("start", start)
        .withColumn("place", place)
        .groupBy(*keys, "start", "place")
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("trade_count").alias("trade_count"),
            F.try_divide(weighted, F.nullif(F.sum("volume"), F.lit(0.0))).alias("vwap"),
            F.min("ts").alias("own_time"),
            F.min("vwap").alias("own_vwap"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    alone = F.lit(False) if within == "none" else F.sum("n").over(Window.partitionBy(*keys)) == 1
    return found.withColumn("alone", alone).filter("close IS NOT NULL").select(
        *keys,
        F.when(F.col("alone"), F.col("own_time")).otherwise(begins).alias("ts"),
        *["open", "high", "low", "close", "volume", "trade_count"],
        F.when(F.col("alone"), F.col("own_vwap")).otherwise(F.col("vwap")).alias("vwap"),
    )
