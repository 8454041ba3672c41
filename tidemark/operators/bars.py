"""Bar construction, session tags, validation and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.market import ohlcv

#: Minutes of the day at which the sessions begin.
PREMARKET, REGULAR, AFTERHOURS, CLOSED = 240, 570, 960, 1200


def minute_of_day(ts: str):
    return F.hour(ts) * 60 + F.minute(ts)


def session(ts: str, with_closed: bool = False):
    minute = minute_of_day(ts)
    tag = F.when(minute < REGULAR, "premarket").when(minute < AFTERHOURS, "regular").otherwise("afterhours")
    return F.when((minute < PREMARKET) | (minute >= CLOSED), "closed").otherwise(tag) if with_closed else tag


def local_parts(rows: DataFrame, ts: str, zone: str, source: str = "UTC") -> DataFrame:
    """Adds ``local_ts`` (without a zone) and its ``date, time, hour, minute`` in ``zone``, daylight saving included.

    A timestamp without a zone is read as one of ``source``, one with a zone is an instant. Nulls stay null.
    """
    instant = dict(rows.dtypes)[ts] == "timestamp"
    local = F.convert_timezone(None if instant else F.lit(source), F.lit(zone), F.col(ts).cast("timestamp_ntz"))
    found = rows.withColumn("local_ts", local)
    return found.withColumns(
        {"date": F.to_date("local_ts"), "time": F.date_format("local_ts", "HH:mm:ss"), "hour": F.hour("local_ts"), "minute": F.minute("local_ts")}
    )


def time_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """OHLCV bars with trade count and volume-weighted price, aligned to multiples of ``minutes``.

    Bars without volume have no weighted price; ticks without that column give bars without both.
    """
    width = minutes * 60
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp(F.date_trunc("minute", "ts")) / width) * width)
    rows = ticks.withColumn("bar", bucket)
    value = F.sum(F.col("price") * F.col("volume"))
    weighted = [F.sum("volume").alias("volume"), F.try_divide(value, F.nullif(F.sum("volume"), F.lit(0.0))).alias("vwap")]
    weighted = weighted if "volume" in ticks.columns else []
    return rows.groupBy("symbol", "bar").agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"),
        F.count(F.lit(1)).alias("trade_count"),
        *weighted,
    )


def tick_bars(ticks: DataFrame, size: int) -> DataFrame:
    """Bars of ``size`` ticks of a symbol each; the last may be shorter.

    Ticks are numbered within their day and days are offset by the counts before them, so that no
    task has to order a symbol's whole history.
    """
    rows = ticks.withColumn("_day", F.to_date("ts"))
    counts = rows.groupBy("symbol", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("symbol", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("ts", "event_id")) - 1
    numbered = rows.withColumn("_at", place).join(starts, ["symbol", "_day"])
    return numbered.groupBy("symbol", F.floor((F.col("_start") + F.col("_at")) / size).alias("bar")).agg(
        F.min("ts").alias("began"),
        F.min_by("price", F.struct("ts", "event_id")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"),
        F.count(F.lit(1)).alias("trade_count"),
    )


def validate(bars: DataFrame, max_move: float = 0.5) -> DataFrame:
    """Drops rows without usable prices or volume, repairs highs and lows, then drops extreme moves.

    A move is measured once, against the preceding surviving row of the symbol; the first row stays.
    """
    prices = ("open", "high", "low", "close")
    usable = F.lit(True)
    for name in prices:
        x = F.col(name)
        usable &= x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x > 0)
    repaired = bars.filter(usable & (F.col("volume") > 0)).withColumns(
        {"high": F.greatest(*prices), "low": F.least(*prices), "fixed": (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))}
    )
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return repaired.withColumn("_before", before).filter("_before IS NULL OR abs(close / _before - 1) <= %r" % max_move).drop("_before")


def keep_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key, by a single aggregation with map-side combining instead of a sort."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*order, F.struct(*others).alias("_row"))).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best._row.*")


def information_threshold(rows: DataFrame, amount, date: str) -> DataFrame:
    """Amount per day: the automatic size of an information bar."""
    return rows.groupBy("symbol").agg((F.sum(amount) / F.count_distinct(F.to_date(date))).alias("threshold"))


__all__ = ["information_threshold", "keep_last", "ohlcv", "session", "tick_bars", "time_bars", "validate"]
