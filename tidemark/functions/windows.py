"""Time-series window expressions: every frame is over one symbol in date order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

EPSILON = 1e-10


def ordered(symbol: str = "symbol", at: str = "date") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(at)


def trailing(n: int, symbol: str = "symbol", at: str = "date") -> WindowSpec:
    return ordered(symbol, at).rowsBetween(-(n - 1), 0)


def rolling(aggregate, x: Column, n: int, min_periods: int | None = None) -> Column:
    """``aggregate`` over the last ``n`` rows, null until ``min_periods`` (default ``n``) values are there."""
    frame = trailing(n)
    return F.when(F.count(x).over(frame) >= (n if min_periods is None else min_periods), aggregate(x).over(frame))


def pct_change(x: Column, k: int = 1) -> Column:
    before = F.lag(x, k).over(ordered())
    return F.try_divide(x, before) - 1


def clip(x: Column, low: float, high: float) -> Column:
    # greatest() and least() skip nulls, so a null must be kept by hand.
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def zscore(x: Column, n: int, limit: float = 4.0) -> Column:
    """Distance from the rolling mean in rolling standard deviations, clipped; 0 where undefined."""
    z = (x - rolling(F.mean, x, n)) / (rolling(F.stddev_samp, x, n) + EPSILON)
    return F.coalesce(clip(z, -limit, limit), F.lit(0.0))


def rsi(gain: Column, loss: Column, n: int = 14) -> Column:
    """Relative strength index from simple means of gains and losses."""
    strength = rolling(F.mean, gain, n) / (rolling(F.mean, loss, n) + EPSILON)
    return 100 - 100 / (1 + strength)


def regime(z: Column, threshold: float) -> Column:
    return F.when(z > threshold, 1).when(z < -threshold, -1).otherwise(0)


def exponential(rows: DataFrame, value: str, spans: dict[str, int]) -> DataFrame:
    """Adds unadjusted exponential means of ``value`` by span, each seeded by the symbol's first value.

    They depend on all earlier rows, so a symbol's rows (days, not ticks) run through one task in order.
    """
    schema = StructType([*rows.schema.fields, *[StructField(name, DoubleType()) for name in spans]])

    def run(frame):
        frame = frame.sort_values("date")
        return frame.assign(**{name: frame[value].ewm(span=span, adjust=False).mean() for name, span in spans.items()})

    return rows.groupBy("symbol").applyInPandas(run, schema)


def correlation(a: Column, b: Column, frame: WindowSpec) -> Column:
    """Pearson's correlation over a frame of the rows that have both; null where either does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.sqrt(F.var_pop(x).over(frame) * F.var_pop(y).over(frame))
    return F.try_divide(F.covar_pop(x, y).over(frame), spread)
