"""Feature families over daily bars: flow, season, moments, structure, rotation and circuit breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.calendar import MEETINGS, nth_weekday


def order_flow(bars: DataFrame) -> DataFrame:
    """Adds bulk-classified flow: where the close lies in the bar's range says what share was bought."""
    span = F.greatest(F.col("high") - F.col("low"), F.lit(W.EPSILON))
    rows = bars.withColumns({"buy": (F.col("close") - F.col("low")) / span, "sell": (F.col("high") - F.col("close")) / span})
    bought, sold = F.col("volume") * F.col("buy"), F.col("volume") * F.col("sell")
    rows = rows.withColumn("imbalance", (bought - sold) / F.greatest(bought + sold, F.lit(W.EPSILON)))
    x = F.col("imbalance")
    z = lambda n, least: F.coalesce(
        W.clip((x - W.rolling(F.mean, x, n, least)) / (W.rolling(F.stddev_samp, x, n, least) + W.EPSILON), -4, 4), F.lit(0.0)
    )
    return rows.withColumns(
        {
            "flow_5": W.rolling(F.sum, x, 5, 1),
            "flow_20": F.coalesce(W.rolling(F.sum, x, 20, 5), F.lit(0.0)),
            "z20": z(20, 5),
            "z60": z(60, 10),
        }
    ).withColumn("regime", W.regime(F.col("z60"), 1.0))


# Month, first and last day, and weekday (Monday is 0) of the days before market holidays.
HOLIDAY_EVES = (
    (1, 1, 1, None),
    (5, 25, 31, 4),
    (7, 2, 3, None),
    (11, 22, 30, 2),
    (12, 23, 24, None),
    (12, 30, 31, None),
)


def seasonality(days: DataFrame) -> DataFrame:
    """Adds flags of calendar anomalies; they read nothing but the row's date."""
    date = F.col("date")
    month, day, weekday = F.month(date), F.dayofmonth(date), F.weekday(date)
    holiday = F.lit(False)
    for in_month, first, last, on in HOLIDAY_EVES:
        inside = (month == in_month) & day.between(first, last)
        holiday |= inside if on is None else inside & (weekday == on)
    meetings = F.array(*[F.lit(d).cast("date") for d in MEETINGS])
    return days.withColumns(
        {
            "turn_of_month": (day <= 3) | (day >= 27),
            "january": month == 1,
            "before_meeting": F.array_contains(meetings, date) | F.array_contains(meetings, F.date_add(date, 1)),
            "before_holiday": holiday,
            "santa_claus": ((month == 12) & (day >= 25)) | ((month == 1) & (day <= 2)),
            "quad_witching": month.isin(3, 6, 9, 12) & (date == nth_weekday(F.trunc(date, "month"), 4, 3)),
            "summer": month.between(5, 10),
            "weekday": F.least(weekday, F.lit(4)).cast("long"),
        }
    )


def moments(returns: DataFrame) -> DataFrame:
    """Adds rolling population skewness and excess kurtosis; 0 until a window holds enough returns."""
    x = F.col("ret")
    return returns.withColumns(
        {
            "skew20": F.coalesce(W.rolling(F.skewness, x, 20), F.lit(0.0)),
            "skew60": F.coalesce(W.rolling(F.skewness, x, 60), F.lit(0.0)),
            "kurtosis20": F.coalesce(W.rolling(F.kurtosis, x, 20), F.lit(0.0)),
        }
    )


def percentile_rank(x: Column, n: int, least: int) -> Column:
    """Rank of the current value among the last ``n``, ties averaged, as a share of their count."""
    seen = F.collect_list(x).over(W.trailing(n))
    below, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return F.when(F.size(seen) >= least, (below + (equal + 1) / 2) / F.size(seen))


def range_structure(bars: DataFrame) -> DataFrame:
    """Adds the range's percentile among 60 bars, and how many of 21 bars were the narrowest of 7."""
    rows = bars.withColumn("range", F.try_divide(F.col("high") - F.col("low"), F.col("close")))
    rows = rows.withColumn("narrow", F.coalesce((F.col("range") == W.rolling(F.min, F.col("range"), 7)).cast("double"), F.lit(0.0)))
    return rows.withColumns(
        {"range_percentile": percentile_rank(F.col("range"), 60, 30), "narrow_count": W.rolling(F.sum, F.col("narrow"), 21, 10)}
    )


def rotation(returns: DataFrame, k: int = 3) -> DataFrame:
    """One row per date: mean return of the ``k`` leaders and laggards, their spread and the dispersion."""
    day = returns.filter("ret IS NOT NULL").groupBy("date").agg(
        F.array_sort(F.collect_list("ret")).alias("_sorted"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("dispersion")
    )
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)
    low, high = F.slice("_sorted", 1, k), F.slice("_sorted", F.greatest(F.size("_sorted") - k + 1, F.lit(1)), k)
    return day.select("date", mean(high).alias("leaders"), mean(low).alias("laggards"), "dispersion").withColumn(
        "spread", F.col("leaders") - F.col("laggards")
    )


def circuit_breaker(returns: DataFrame, streak: int = 3, daily_loss: float = 0.5, drawdown: float = 0.9) -> DataFrame:
    """Adds ``losses`` (losing rows in a row), ``drawdown`` and the first ``reason`` to halt trading, if any."""
    rows = returns.filter("ret IS NOT NULL").withColumn("_n", F.row_number().over(W.ordered()))
    running = W.ordered().rowsBetween(Window.unboundedPreceding, 0)
    last_gain = F.coalesce(F.max(F.when(F.col("ret") >= 0, F.col("_n"))).over(running), F.lit(0))
    rows = rows.withColumns({"losses": (F.col("_n") - last_gain).cast("long"), "_peak": F.max("close").over(running)})
    rows = rows.withColumn("drawdown", F.try_divide(F.col("close"), F.col("_peak")) - 1)
    reason = (
        F.when(F.col("losses") >= streak, "loss_streak").when(F.col("ret") <= -daily_loss, "daily_loss").when(F.col("drawdown") <= -drawdown, "drawdown")
    )
    return rows.withColumn("reason", reason).drop("_n", "_peak")


def disagreement(rows: DataFrame, members: list[str]) -> DataFrame:
    """Adds spread, agreement and vote entropy of ensemble members' probabilities."""
    n = len(members)
    mean = sum(F.col(m) for m in members) / n
    bulls = sum((F.col(m) > 0.5).cast("int") for m in members)
    share = bulls / n
    entropy = F.when((bulls == 0) | (bulls == n), 0.0).otherwise(-(share * F.log2(share) + (1 - share) * F.log2(1 - share)))
    return rows.withColumns(
        {
            "ens_std": F.sqrt(sum(F.pow(F.col(m) - mean, 2) for m in members) / n),
            "ens_range": F.greatest(*members) - F.least(*members),
            "ens_agreement": F.greatest(bulls, n - bulls) / n,
            "ens_entropy": entropy,
        }
    )


def l_moments(returns: DataFrame, n: int = 20) -> DataFrame:
    """Adds L-variation, L-skewness and L-kurtosis of the ``n`` returns before the row, itself left out, and the z-score of L-skewness."""
    seen = F.collect_list("_r").over(W.ordered().rowsBetween(-n, -1))
    rows = returns.withColumn("_r", F.coalesce("ret", F.lit(0.0))).withColumn("_s", F.array_sort(seen))
    total = lambda weight: F.aggregate(F.transform("_s", lambda x, j: weight(j.cast("double")) * x), F.lit(0.0), lambda a, v: a + v) / n
    rows = rows.withColumns(
        {
            "_b0": total(lambda j: F.lit(1.0)),
            "_b1": total(lambda j: j / (n - 1)),
            "_b2": total(lambda j: j * (j - 1) / ((n - 1) * (n - 2))),
            "_b3": total(lambda j: j * (j - 1) * (j - 2) / ((n - 1) * (n - 2) * (n - 3))),
        }
    )
    b0, b1, b2, b3 = (F.col(f"_b{i}") for i in range(4))
    l2, full = 2 * b1 - b0, F.size("_s") == n
    ratio = lambda top: F.when(full & (l2 > W.EPSILON), W.clip(top / l2, -1, 1)).otherwise(0.0)
    found = rows.withColumns(
        {
            "lcv": F.when(full & (F.abs(b0) > W.EPSILON), W.clip(l2 / F.abs(b0), 0, 50)).otherwise(0.0),
            "_lskew": F.when(full & (l2 > W.EPSILON), (6 * b2 - 6 * b1 + b0) / l2).otherwise(0.0),
            "lkurt": ratio(20 * b3 - 30 * b2 + 12 * b1 - b0),
        }
    )
    x = F.col("_lskew")
    spread = W.rolling(F.stddev_samp, x, 60, 30)
    z = (x - W.rolling(F.mean, x, 60, 30)) / F.when(spread == 0, 1e-10).otherwise(spread)
    found = found.withColumns({"lskew": W.clip(x, -1, 1), "lskew_z": F.coalesce(W.clip(z, -5, 5), F.lit(0.0))})
    return found.drop("_r", "_s", "_b0", "_b1", "_b2", "_b3", "_lskew")


def neutralized(rows: DataFrame, x: str, market: str, share: float = 0.01) -> DataFrame:
    """Adds ``winsorized`` (clipped at a symbol's outer quantiles) and its ``residual`` on the market."""
    edges = rows.groupBy("symbol").agg(F.percentile(x, [share, 1 - share]).alias("_edges"))
    clipped = rows.join(edges, "symbol").withColumn("winsorized", F.least(F.greatest(F.col(x), F.get("_edges", 0)), F.get("_edges", 1)))
    fit = clipped.groupBy("symbol").agg(
        F.regr_slope("winsorized", market).alias("_slope"), F.regr_intercept("winsorized", market).alias("_base")
    )
    residual = F.col("winsorized") - F.col("_base") - F.col("_slope") * F.col(market)
    return clipped.join(fit, "symbol").withColumn("residual", residual).drop("_edges", "_slope", "_base")


def _entropy(codes: Column) -> Column:
    """Shannon entropy in bits of the values of an array."""
    n = F.size(codes)
    share = lambda c: F.size(F.filter(codes, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def entropies(returns: DataFrame, n: int = 20, bins: int = 10) -> DataFrame:
    """Adds Shannon entropy of binned returns and permutation entropy of closes over the ``n`` rows before.

    Bins are of equal width between the window's extremes. Patterns are the orders of three closes in
    a row, equal ones in their order of time; their entropy is a share of the greatest possible one.
    """
    before = W.ordered().rowsBetween(-n, -1)
    rows = returns.withColumns({"_r": F.collect_list("ret").over(before), "_c": F.collect_list("close").over(before)})
    low, span = F.array_min("_r"), F.array_max("_r") - F.array_min("_r")
    binned = F.transform("_r", lambda x: F.least(F.floor(F.try_divide(x - low, span) * bins), F.lit(bins - 1)))
    at = lambda i: F.get("_c", i)
    bit = lambda test, value: F.when(test, value).otherwise(0)
    pattern = F.transform(
        F.sequence(F.lit(0), F.lit(n - 3)),
        lambda i: bit(at(i) <= at(i + 1), 1) + bit(at(i) <= at(i + 2), 2) + bit(at(i + 1) <= at(i + 2), 4),
    )
    full = F.size("_c") == n
    rows = rows.withColumns({"_bins": binned, "_pattern": pattern})
    return rows.withColumns(
        {
            "shannon": F.when(full & (F.size("_r") >= 3) & (span >= 1e-15), _entropy(F.col("_bins"))).otherwise(0.0),
            "permutation": F.when(full, _entropy(F.col("_pattern")) / F.log2(F.lit(6.0))).otherwise(0.0),
        }
    ).drop("_r", "_c", "_bins", "_pattern")
