"""Structured Streaming forms of the live operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Bars of ``minutes``; a bar is emitted once the watermark has passed its end."""
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{minutes} minutes"))
        .agg(
            F.min_by("price", F.struct("ts", "event_id")).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", F.struct("ts", "event_id")).alias("close"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .select("symbol", F.col("window.start").alias("bar"), "open", "high", "low", "close", "trade_count")
    )


def unique_ticks(ticks: DataFrame, late: str = "3 days") -> DataFrame:
    """Drops ticks whose ``event_id`` came before within the watermark; state is bounded by it."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["event_id"])


def corrected_bars(bars: DataFrame, late: str = "3 days") -> DataFrame:
    """The last version of each bar of ``symbol, ts``: a later ``arrived`` overrides, until the watermark closes the bar."""
    rows = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    others = [c for c in bars.columns if c not in ("symbol", "ts", "arrived")]
    last = F.max_by(F.struct(*others), "arrived").alias("last")
    return rows.groupBy("symbol", "ts").agg(last).select("symbol", "ts", "last.*")


def fresh_signals(signals: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """Signals not within ``interval_seconds`` of the last recorded one of their symbol and kind.

    ``signals`` has ``symbol, signal, at_us`` (microseconds); micro-batches count
    as they arrive, so a signal older than the last recorded one is dropped. State is one number per symbol and kind; a
    key's rows of one micro-batch are ordered in memory, so bound the batch by the source's trigger options.
    """

    def record(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for at in sorted(at for part in parts for at in part["at_us"]):
            if last is None or at - last >= interval_seconds * 1_000_000:
                kept.append(at)
                last = at
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"symbol": key[0], "signal": key[1], "at_us": pd.Series(kept, dtype="int64")})

    return (
        signals.filter("at_us IS NOT NULL")
        .groupBy("symbol", "signal")
        .applyInPandasWithState(record, "symbol string, signal string, at_us long", "last long", "append", GroupStateTimeout.NoTimeout)
    )
