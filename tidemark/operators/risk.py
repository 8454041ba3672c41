"""Tail risk, distribution shift and range volatility over one symbol's daily rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rolling_cvar(returns: DataFrame, n: int = 60, share: float = 0.05) -> DataFrame:
    """Adds ``cvar``: the mean size of the worst returns of the ``n`` rows before this one, null until there are ``n``.

    Missing returns count as rows but not as returns; two returns are the least.
    """
    before = W.ordered().rowsBetween(-n, -1)
    rows = returns.withColumns(
        {"_past": F.collect_list("ret").over(before), "_cut": F.percentile("ret", share).over(before), "_rows": F.count(F.lit(1)).over(before)}
    )
    worst = F.filter("_past", lambda x: x <= F.col("_cut"))
    cvar = F.when((F.col("_rows") >= n) & (F.size("_past") >= 2), F.abs(total(worst) / F.size(worst)))
    return rows.withColumn("cvar", cvar).drop("_past", "_cut", "_rows")


def window_distance(returns: DataFrame, n: int = 20) -> DataFrame:
    """Adds ``distance``: the 1-Wasserstein distance of the last ``n`` returns from the ``n`` before them.

    Samples of one size are compared in sorted order; null until both windows are full.
    """
    rows = returns.filter("ret IS NOT NULL").withColumns(
        {
            "_now": F.collect_list("ret").over(W.trailing(n)),
            "_before": F.collect_list("ret").over(W.ordered().rowsBetween(-(2 * n - 1), -n)),
        }
    )
    gaps = F.zip_with(F.array_sort("_now"), F.array_sort("_before"), lambda a, b: F.abs(a - b))
    return rows.withColumn("distance", F.when(F.size("_before") == n, total(gaps) / n)).drop("_now", "_before")


def transport(a: str, b: str) -> Column:
    """The 1-Wasserstein distance of two columns of arrays without nulls, each with a value at least.

    Arrays of one size are compared in sorted order; others by the area between their distribution functions.
    """
    sorted_gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x - y))
    points = F.array_sort(F.concat(a, b))
    share = lambda of, z: F.size(F.filter(of, lambda x: x <= z)) / F.size(of)
    steps = F.transform(F.slice(points, F.lit(1), F.size(points) - 1), lambda z, i: F.abs(share(a, z) - share(b, z)) * (F.get(points, i + 1) - z))
    return F.when(F.size(a) == F.size(b), total(sorted_gaps) / F.size(a)).otherwise(total(steps))


WASSERSTEIN = [f"wreg_{c}" for c in "distance_20d distance_60d distance_z regime_change regime_duration stability mean_shift vol_shift".split()]


def wasserstein_regime(returns: DataFrame, short: int = 20, long: int = 60, threshold: float = 2.0, history: int = 120, least: int = 10) -> DataFrame:
    """``symbol, date`` and how far the ``short`` and ``long`` returns before a day lie from as many before them, with the regime changes that follow.

    A day is a change if its short distance is more than ``threshold`` deviations above the mean of the last ``history`` days'. The day's own return takes no part;
    missing returns are left out of their window, which needs two. Null until both windows lie within the history, the duration until the first change.
    """
    by = W.ordered()
    rows = returns.withColumn("_row", F.row_number().over(by))
    for n in (short, long):
        now, past = by.rowsBetween(-n, -1), by.rowsBetween(-2 * n, -n - 1)
        rows = rows.withColumns({"_a": F.collect_list("ret").over(now), "_b": F.collect_list("ret").over(past)})
        full = (F.col("_row") > 2 * n) & (F.size("_a") >= 2) & (F.size("_b") >= 2)
        found = {f"wreg_distance_{n}d": F.when(full, transport("_a", "_b"))}
        if n == short:
            for name, aggregate in (("mean", F.mean), ("vol", F.stddev_samp)):
                found[f"wreg_{name}_shift"] = F.when(full, aggregate("ret").over(now) - aggregate("ret").over(past))
        rows = rows.withColumns(found)
    x, usual = F.col(f"wreg_distance_{short}d"), W.trailing(history)
    spread = F.stddev_samp(x).over(usual)
    z = F.when(spread < 1e-12, 0.0).otherwise((x - F.mean(x).over(usual)) / spread)
    rows = rows.withColumn("wreg_distance_z", F.when(x.isNotNull() & (F.count(x).over(usual) >= least), z))
    rows = rows.withColumn("wreg_regime_change", F.when(F.col("wreg_distance_z").isNotNull(), (F.col("wreg_distance_z") > threshold).cast("double")))
    changed = F.max(F.when(F.col("wreg_regime_change") == 1, F.col("_row"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"wreg_stability": 1 / (1 + x), "wreg_regime_duration": F.when(F.col("wreg_regime_change").isNotNull(), (F.col("_row") - changed).cast("double"))})
    names = [c.replace("20d", f"{short}d").replace("60d", f"{long}d") for c in WASSERSTEIN]
    return rows.select("symbol", "date", *names)


def range_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Adds ``parkinson`` and ``garman_klass`` volatilities of the last ``n`` bars."""
    span, body = F.pow(F.log(F.try_divide(F.col("high"), F.col("low"))), 2), F.pow(F.log(F.try_divide(F.col("close"), F.col("open"))), 2)
    parkinson = F.sqrt(W.rolling(F.mean, span, n) / (4 * math.log(2)))
    inner = W.rolling(F.mean, 0.5 * span - (2 * math.log(2) - 1) * body, n)
    return bars.withColumns({"parkinson": parkinson, "garman_klass": F.sqrt(F.when(inner.isNotNull(), F.greatest(inner, F.lit(0.0))))})


def drawdown_size(drawdown: Column, base: float = 1.0, worst: float = 0.2, power: float = 1.0) -> Column:
    """Position size that falls from ``base`` to 0 as the drawdown (at most 0) nears ``-worst``."""
    return base * F.pow(1 - F.least(-drawdown / worst, F.lit(1.0)), power)
