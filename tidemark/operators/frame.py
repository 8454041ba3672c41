"""The daily frame: one row per symbol and trading day from intraday bars, with lags by trading day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import minute_of_day

# The clock times of the aggregates, as hhmm.
KEY_TIMES = ("0945", "1015", "1100", "1130", "1230", "1330", "1430", "1530")
ENTRY_TIMES = ("1015", "1230")
FLAT = 0.001


def direction(move: Column) -> Column:
    return F.when(move > FLAT, 1).when(move < -FLAT, -1).otherwise(0)


def _minutes(hhmm: str) -> int:
    return int(hhmm[:2]) * 60 + int(hhmm[2:])


def session_days(bars: DataFrame) -> DataFrame:
    """Per symbol and day the aggregates of each session that everything else follows from."""
    session = Window.partitionBy("symbol", "date", "session")
    minute = minute_of_day("ts") + F.second("ts") / 60
    rows = (
        bars.withColumn("from_end", F.row_number().over(session.orderBy(F.desc("ts"))))
        .withColumn("rises", (F.col("close") > F.lag("close").over(session.orderBy("ts"))).cast("double"))
        .withColumn("minute", minute)
    )

    def of(name: str, value: Column | str, test: Column | None = None) -> Column:
        where = F.col("session") == name
        value = F.col(value) if isinstance(value, str) else value
        return F.when(where if test is None else where & test, value)

    found = []
    for short, name in (("pm", "premarket"), ("ah", "afterhours"), ("reg", "regular")):
        found += [
            F.count(of(name, "ts")).alias(f"{short}_n"),
            F.min_by(of(name, "open"), of(name, "ts")).alias(f"{short}_open"),
            F.max_by(of(name, "close"), of(name, "ts")).alias(f"{short}_close"),
            F.max(of(name, "high")).alias(f"{short}_high"),
            F.min(of(name, "low")).alias(f"{short}_low"),
            F.coalesce(F.sum(of(name, "volume")), F.lit(0.0)).alias(f"{short}_vol"),
        ]
    found += [
        F.sum(of("premarket", F.col("close") * F.col("volume"))).alias("pm_value"),
        F.mean(of("premarket", "rises")).alias("pm_rising"),
        *[F.min_by(of("premarket", "open", F.col("from_end") <= n), of("premarket", "ts", F.col("from_end") <= n)).alias(f"pm_open_{n}") for n in (30, 60)],
        F.min(of("regular", "minute")).alias("open_minute"),
        # The first bar with the highest high and the one with the lowest low.
        F.max_by(of("regular", "minute"), F.when(F.col("session") == "regular", F.struct("high", -F.col("minute")))).alias("high_minute"),
        F.min_by(of("regular", "minute"), F.when(F.col("session") == "regular", F.struct("low", F.col("minute")))).alias("low_minute"),
    ]
    for t in KEY_TIMES:
        upto = F.floor("minute") <= _minutes(t)
        found += [
            F.max_by(of("regular", "close", upto), of("regular", "ts", upto)).alias(f"close_{t}"),
            F.max(of("regular", "high", upto)).alias(f"high_{t}"),
            F.min(of("regular", "low", upto)).alias(f"low_{t}"),
        ]
    found += [F.max(of("regular", "high", F.floor("minute") >= _minutes(t))).alias(f"high_from_{t}") for t in ENTRY_TIMES]
    return rows.groupBy("symbol", "date").agg(*found)


def daily_frame(bars: DataFrame, swing: float = 0.005, least_session: int = 5, least_regular: int = 50) -> DataFrame:
    """The features and flags of each trading day with at least ``least_regular`` regular bars.

    Sessions of fewer than ``least_session`` bars count as missing. Lags count the symbol's days
    that have any bar; what a lagged day lacks is 0.
    """
    days = session_days(bars)
    by_day = Window.partitionBy("symbol").orderBy("date")
    zero = lambda test, value: F.when(test, value).otherwise(0.0)
    col = F.col
    pm, ah, reg = col("pm_n") >= least_session, col("ah_n") >= least_session, col("reg_n") > 0
    pm_move, ah_move = (F.try_divide(col(f"{s}_close") - col(f"{s}_open"), col(f"{s}_open")) for s in ("pm", "ah"))
    average = F.try_divide(col("pm_value"), col("pm_vol") + 1)
    out = {
        "pm_return": zero(pm, pm_move),
        "pm_range": zero(pm, F.try_divide(col("pm_high") - col("pm_low"), col("pm_open"))),
        "pm_direction": F.when(pm, direction(pm_move)).otherwise(0),
        "pm_vwap_dev": zero(pm, F.try_divide(col("pm_close") - average, average)),
        "pm_high_low_ratio": zero(pm, F.try_divide(col("pm_high"), col("pm_low") + 0.01)),
        "pm_volume": zero(pm, col("pm_vol")),
        "pm_bar_count": F.when(pm, col("pm_n")).otherwise(0),
        **{f"pm_mom_{n}": zero(pm, F.try_divide(col("pm_close") - col(f"pm_open_{n}"), col(f"pm_open_{n}"))) for n in (30, 60)},
        "pm_trend_consistency": zero(pm, F.coalesce(col("pm_rising"), F.lit(0.5))),
        "_ah_return": zero(ah, ah_move),
        "_ah_range": zero(ah, F.try_divide(col("ah_high") - col("ah_low"), col("ah_open"))),
        "_ah_direction": F.when(ah, direction(ah_move)).otherwise(0),
        "_ah_volume": zero(ah, col("ah_vol")),
        "day_return": F.try_divide(col("reg_close") - col("reg_open"), col("reg_open")),
        "day_range": F.try_divide(col("reg_high") - col("reg_low"), col("reg_open")),
        "day_volume": col("reg_vol"),
        "_last_close": F.when(reg, col("reg_close")),
        "high_minutes": col("high_minute") - col("open_minute"),
        "low_minutes": col("low_minute") - col("open_minute"),
        "low_before_high": col("low_minute") < col("high_minute"),
    }
    for t in KEY_TIMES:
        some, c = col(f"close_{t}").isNotNull(), col(f"close_{t}")
        from_open = lambda x: zero(some, F.try_divide(x - col("reg_open"), col("reg_open")))  # noqa: E731, B023
        out |= {
            f"return_at_{t}": from_open(c),
            f"high_to_{t}": from_open(col(f"high_{t}")),
            f"low_to_{t}": from_open(col(f"low_{t}")),
            f"range_to_{t}": zero(some, F.try_divide(col(f"high_{t}") - col(f"low_{t}"), col("reg_open"))),
            f"return_from_low_{t}": zero(some & (col(f"low_{t}") > 0), F.try_divide(c - col(f"low_{t}"), col(f"low_{t}"))),
        }
    for t in ENTRY_TIMES:
        c = col(f"close_{t}")
        out[f"max_gain_from_{t}"] = zero(c.isNotNull() & col(f"high_from_{t}").isNotNull(), F.try_divide(col(f"high_from_{t}") - c, c))
    rows = days.select("symbol", "date", "reg_n", "pm_n", "pm_close", "reg_open", *[value.alias(name) for name, value in out.items()])

    lagged = lambda name, k: F.coalesce(F.lag(name, k).over(by_day), F.lit(0))
    lags = {}
    for k in (1, 2, 3, 5):
        lags |= {f"ah_{what}_lag{k}": lagged(f"_ah_{what}", k) for what in ("return", "range", "direction", "volume")}
        lags |= {f"pm_{what}_lag{k}": lagged(f"pm_{what}", k) for what in ("return", "direction")}
    # The lag of ten days is that of five, as five days are kept.
    for k, use in ((1, 1), (2, 2), (3, 3), (5, 5), (10, 5)):
        lags |= {f"day_{what}_lag{k}": lagged(f"day_{what}", use) for what in ("return", "range")}
    before = F.lag("_last_close").over(by_day)
    rows = rows.withColumns(lags | {"_before": before})
    agree = (col("pm_direction") == col("ah_direction_lag1")) & (col("pm_direction") != 0)
    same = [((col(f"pm_direction_lag{k}") == col("pm_direction")) & (col("pm_direction") != 0)).cast("int") for k in (1, 2, 3)]
    return (
        rows.withColumns(
            {
                "overnight_return": zero(pm & col("_before").isNotNull(), F.try_divide(col("pm_close") - col("_before"), col("_before"))),
                "gap_pct": zero(col("_before").isNotNull(), F.try_divide(col("reg_open") - col("_before"), col("_before"))),
                "pm_ah_agree": agree.cast("int"),
                "pm_direction_streak": same[0] + same[1] + same[2],
                "is_up_day": col("day_return") > swing,
                "is_down_day": col("day_return") < -swing,
            }
        )
        .filter(col("reg_n") >= least_regular)
        .drop("reg_n", "pm_n", "pm_close", "reg_open", "_before", "_last_close", "_ah_return", "_ah_range", "_ah_direction", "_ah_volume")
    )
