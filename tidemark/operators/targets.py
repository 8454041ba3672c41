"""Targets: barrier labels in three modes, adaptive barriers, timing targets, soft targets, guarded CUSUM events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import align
from tidemark.operators.bars import minute_of_day


# Fixed values of the timing targets: shares of the price, and batches above each volatility.
STOP_ROOM, PROFIT_ROOM, BASE_SIZE, USUAL_VOLATILITY = 0.002, 0.001, 0.10, 0.015
BATCHES = ((0.01, 2), (0.015, 3), (0.02, 4))


def barrier_labels(
    closes: DataFrame, take: Column | float = 0.02, stop: Column | float = 0.02, horizon: int = 10, events: DataFrame | None = None
) -> DataFrame:
    """The first barrier the next ``horizon`` closes touch, with a label in each mode.

    Missing closes are filled forward first, leading ones left out. ``touch_type`` is ``tp``, ``sl``
    or ``expiry``; a close that touches both takes profit. ``touch_idx`` counts rows from the entry,
    the last row of a symbol has no label. ``binary`` is 1 for ``tp``; ``ternary`` is 1, -1 or 0;
    ``continuous`` is the return at the touch. ``events`` (``symbol, date``) restricts the entries,
    not the prices. After a close of 0 there are no returns: it touches nothing and its return is null.
    """
    extra = [c for c in closes.columns if c not in ("symbol", "date", "close")]
    filled = align.forward_fill(closes.select("symbol", "date", "close", *extra), ["symbol"], "date", ["close"]).filter("close IS NOT NULL")
    path = F.collect_list("close").over(W.ordered().rowsBetween(1, horizon))
    rows = filled.withColumn("path", path).filter(F.size("path") > 0)
    returns = F.transform("path", lambda p: F.try_divide(p, F.col("close")) - 1)
    take, stop = (x if isinstance(x, Column) else F.lit(x) for x in (take, stop))
    first = lambda test: F.nullif(F.array_position(F.transform("returns", test), True), F.lit(0))
    rows = rows.withColumn("returns", returns).withColumns({"up": first(lambda r: r >= take), "down": first(lambda r: r <= -stop)})
    if events is not None:
        rows = rows.join(events.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
    touch = F.coalesce(F.least("up", "down"), F.size("path").cast("long"))
    kind = F.when(F.col("up") <= F.coalesce("down", "up"), "tp").when(F.col("down").isNotNull(), "sl").otherwise("expiry")
    at_touch = F.element_at("returns", F.col("touch_idx").cast("int"))
    return rows.withColumns({"touch_idx": touch, "touch_type": kind}).select(
        "symbol",
        "date",
        *extra,
        "touch_type",
        "touch_idx",
        at_touch.alias("return_at_touch"),
        F.col("close").alias("entry_price"),
        F.element_at("path", F.col("touch_idx").cast("int")).alias("touch_price"),
        (F.col("touch_type") == "tp").cast("long").alias("binary"),
        F.when(F.col("touch_type") == "tp", 1).when(F.col("touch_type") == "sl", -1).otherwise(0).cast("long").alias("ternary"),
        at_touch.alias("continuous"),
    )


def timing_targets(bars: DataFrame, long: bool = True, entry: tuple = (0, 120), leave: tuple = (180, 385), least_bars: int = 10) -> DataFrame:
    """The best entry of each day in the first window and the best exit in the second one, after it where it can be.

    Minutes count from 09:30. Days of fewer than ``least_bars`` bars, or without a bar in either
    window, have no target. Short targets enter at the highest high and leave at the lowest low.

    From the path between both follow the stop that would have held (the worst move against the
    trade and ``STOP_ROOM``) and the profit to take; from the day's volatility the size and the
    number of batches; from the mean price of the entry window whether batches would have
    mattered. What is divided by a price of 0 is null, and so is all that rests on it.
    """
    minute = (minute_of_day("ts") - 570 + F.second("ts") / 60).alias("minute")
    rows = bars.select("symbol", "date", "ts", "open", "high", "low", "close", minute)
    move = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("symbol", "date").orderBy("ts"))) - 1
    rows = rows.withColumn("move", move)
    inside = lambda w: F.col("minute").between(*w)
    buy, sell = ("low", "high") if long else ("high", "low")
    pick_entry, pick_exit = (F.min_by, F.max_by) if long else (F.max_by, F.min_by)
    # Of equal prices the first bar counts: a later one must lose the comparison.
    entry_key = F.struct(buy, "minute") if long else F.struct(buy, -F.col("minute"))
    exit_key = F.struct(sell, -F.col("minute")) if long else F.struct(sell, "minute")
    entries = rows.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"),
        pick_entry(F.struct("ts", "minute", F.col(buy).alias("price")), F.when(inside(entry), entry_key)).alias("entry"),
        F.min_by("open", "ts").alias("day_open"),
        F.max_by("close", "ts").alias("day_close"),
        F.max("high").alias("day_high"),
        F.min("low").alias("day_low"),
        (F.stddev_samp("move") * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("day_volatility"),
        F.mean(F.when(inside(entry), F.col("close"))).alias("mean_entry"),
        F.count_if(inside(leave)).alias("n_exits"),
    ).filter((F.col("n") >= least_bars) & F.col("entry").isNotNull() & (F.col("n_exits") > 0))
    later = F.when(F.col("ts") > F.col("entry.ts"), exit_key)
    best = lambda key: pick_exit(F.struct("ts", "minute", F.col(sell).alias("price")), key)
    exits = (
        rows.filter(inside(leave))
        .join(entries.select("symbol", "date", "entry"), ["symbol", "date"])
        .groupBy("symbol", "date")
        .agg(best(later).alias("after"), best(exit_key).alias("any"))
        .select("symbol", "date", F.coalesce("after", "any").alias("exit"))
    )
    way = 1 if long else -1
    trades = entries.join(exits, ["symbol", "date"])
    held = rows.join(trades.select("symbol", "date", "entry", "exit"), ["symbol", "date"]).filter(F.col("ts").between(F.col("entry.ts"), F.col("exit.ts")))
    worst = held.groupBy("symbol", "date").agg((F.min("low") if long else F.max("high")).alias("worst"))
    price = F.col("entry.price")
    trades = trades.join(worst, ["symbol", "date"], "left").withColumns(
        {
            "best_return": F.try_divide(way * (F.col("exit.price") - price), price),
            # An exit before the entry has no path between them.
            "adverse": F.try_divide(F.coalesce(way * (price - F.col("worst")), F.lit(0.0)), price),
            "possible": F.try_divide(F.col("day_high") - F.col("day_low"), F.col("day_low" if long else "day_high")),
            "benefit": F.try_divide(F.abs(F.col("mean_entry") - price), price),
            "day_range": F.col("day_high") - F.col("day_low"),
        }
    )
    move, volatility = F.abs("best_return"), F.col("day_volatility")
    calm = W.clip(F.try_divide(F.lit(USUAL_VOLATILITY), F.when(volatility.isNotNull(), F.greatest(volatility, F.lit(0.005)))), 0.5, 1.5)
    batches = F.lit(1)
    for level, number in BATCHES:
        batches = F.when(volatility > level, number).otherwise(batches)
    return trades.select(
        "symbol",
        "date",
        F.col("entry.price").alias("entry_price"),
        F.col("entry.minute").alias("entry_minute"),
        F.col("exit.price").alias("exit_price"),
        F.col("exit.minute").alias("exit_minute"),
        "best_return",
        F.try_divide(way * (F.col("day_close") - F.col("day_open")), F.col("day_open")).alias("open_to_close"),
        "day_range",
        F.try_divide(F.col("day_range"), F.col("day_open")).alias("day_range_pct"),
        "day_volatility",
        F.col("adverse").alias("max_adverse"),
        F.when(F.col("adverse").isNotNull(), F.least(F.lit(0.05), F.col("adverse") + STOP_ROOM)).alias("stop_pct"),
        W.clip(move - PROFIT_ROOM, 0.005, 0.05).alias("take_profit_pct"),
        W.clip(BASE_SIZE * calm * W.clip(move / 0.01, 0.5, 2.0), 0.05, 0.25).alias("position_pct"),
        F.col("benefit").alias("batching_benefit"),
        (F.col("benefit") > 0.001).alias("should_batch"),
        F.when(volatility.isNotNull(), batches).cast("long").alias("batches"),
        F.col("possible").alias("max_possible_return"),
        F.try_divide(F.col("best_return"), F.when(F.col("possible").isNotNull(), F.greatest("possible", F.lit(0.001)))).alias("capture_efficiency"),
    )


def soft_targets(days: DataFrame, threshold: float = 0.0025, steepness: float = 50.0, smoothing: float = 0.1) -> DataFrame:
    """Adds hard, sigmoid and smoothed targets and their weights to rows with ``day_return`` and high and low times."""
    move = F.col("day_return")
    up, timing = move > threshold, F.col("low_before_high")
    smooth = lambda hard: (1 - smoothing) * hard.cast("double") + smoothing / 2
    return days.withColumns(
        {
            "target_up": up,
            "target_timing": timing,
            "soft_target_up": 1 / (1 + F.exp(-steepness * (move - threshold))),
            "smoothed_target_up": smooth(up),
            "smoothed_target_timing": smooth(timing),
            "sample_weight": W.clip(F.abs(move - threshold) * 100, 0.3, 1.0),
            "timing_weight": W.clip(F.abs(F.col("high_minutes") - F.col("low_minutes")) / 200, 0.3, 1.0),
        }
    )


def blended_volatility(returns: DataFrame, windows: tuple = (5, 10, 21, 63)) -> Column:
    """Mean of the trailing deviations that exist; each needs half its window."""
    found = F.array(*[W.rolling(F.stddev_samp, F.col("ret"), n, max(2, n // 2)) for n in windows])
    some = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def adaptive_labels(returns: DataFrame, base: float = 0.01, horizon: int = 5, low: float = 0.002, high: float = 0.05) -> DataFrame:
    """Barrier labels whose barriers follow the blended volatility relative to the symbol's median one.

    The ratio is kept within 0.1 to 10 (1 where it is unknown), the barriers within ``low`` to
    ``high``.
    """
    rows = returns.select("symbol", "date", "close", "ret").withColumn("vol", blended_volatility(returns))
    median = rows.groupBy("symbol").agg(F.median("vol").alias("median"))
    ratio = W.clip(F.try_divide(F.col("vol"), F.greatest("median", F.lit(1e-8))), 0.1, 10.0)
    scaled = rows.join(median, "symbol").withColumn("vol_ratio", F.coalesce(ratio, F.lit(1.0))).withColumn("barrier", W.clip(base * F.col("vol_ratio"), low, high))
    found = barrier_labels(scaled.select("symbol", "date", "close", "vol_ratio", "barrier"), F.col("barrier"), F.col("barrier"), horizon)
    soft = 1 / (1 + F.exp(-50 * F.col("return_at_touch")))
    sure = F.when(F.col("touch_type") == "expiry", 0.5).otherwise(0.9)
    return found.withColumns({"soft": soft, "confidence": sure})


def _guarded(threshold: float, least_events: int, most_filtered: float):
    def run(_, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        moves = np.nan_to_num(frame["ret"].to_numpy(float))
        thresholds = threshold * 0.5 ** np.arange(21)
        events = np.zeros((21, len(moves)), bool)
        up, down = np.zeros(21), np.zeros(21)
        # All 21 thresholds in one pass over the symbol's days.
        for i, move in enumerate(moves):
            up, down = np.maximum(0, up + move), np.minimum(0, down + move)
            hit_up, hit_down = up >= thresholds, down <= -thresholds
            events[:, i] = hit_up | hit_down
            up[hit_up], down[hit_down] = 0, 0
        counts = events.sum(axis=1)
        if threshold == 0 or counts[0] < least_events:
            kept, level = np.ones(len(moves), bool), -1
        elif 1 - counts[0] / len(moves) <= most_filtered:
            kept, level = events[0], 0
        else:
            enough = np.flatnonzero(counts[1:] >= np.ceil(len(moves) * (1 - most_filtered))) + 1
            level = int(enough[0]) if len(enough) else -1
            kept = events[level] if level >= 0 else np.ones(len(moves), bool)
        yield frame.loc[kept, ["symbol", "date", "ret"]].assign(halvings=level)

    return run


def guarded_events(returns: DataFrame, threshold: float = 0.02, least_events: int = 50, most_filtered: float = 0.8) -> DataFrame:
    """``symbol, date, ret, halvings`` of the days a symmetric CUSUM filter keeps, with its safety rails.

    A threshold of 0 or fewer than ``least_events`` events keep every day (``halvings`` -1). If more
    than ``most_filtered`` of the days would go, the threshold is halved up to 20 times until few
    enough do, or else every day stays. Missing returns count as 0. The filter resets and so runs
    through a symbol's days in order; daily rows of one symbol are few.
    """
    rows = returns.select("symbol", "date", "ret").repartition("symbol").sortWithinPartitions("symbol", "date")
    return rows.groupBy("symbol").applyInPandas(
        lambda key, frame: next(_guarded(threshold, least_events, most_filtered)(key, iter([frame.sort_values("date")]))),
        "symbol string, date date, ret double, halvings long",
    )
