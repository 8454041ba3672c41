"""Column checks, validation statistics, defaults, imputation, outliers, scaling and row weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.quantiles import exact_quantiles

PRICES = ("open", "high", "low", "close")


def normal_columns(rows: DataFrame, required: tuple = (*PRICES, "volume")) -> DataFrame:
    """``rows`` with lower-case column names; raises ValueError where a required one is missing or two become one."""
    names = [c.lower() for c in rows.columns]
    missing = [c for c in required if c not in names]
    if missing or len(set(names)) < len(names):
        raise ValueError(f"missing columns: {missing}" if missing else f"columns differ only in case: {sorted(rows.columns)}")
    return rows.toDF(*names)


def _usable(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def validation_stats(bars: DataFrame, max_move: float = 0.5, repair: bool = True) -> DataFrame:
    """One row per symbol: rows in, out, fixed and dropped, and how many broke each rule, in the order of the checks.

    A row counts for the first rule that drops it. With ``repair`` false, bars whose high or low do
    not enclose open and close are dropped instead of repaired.
    """
    numbers = F.lit(True)
    for c in (*PRICES, "volume"):
        numbers &= _usable(c)
    positive = F.lit(True)
    for c in PRICES:
        positive &= F.col(c) > 0
    broken = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    fate = F.when(~numbers, "not_a_number").when(~positive, "price").when(F.col("volume") <= 0, "volume")
    fate = fate if repair else fate.when(broken, "high_low")
    staged = bars.withColumns({"fate": fate, "broken": F.coalesce(numbers & positive & (F.col("volume") > 0) & broken, F.lit(False))})
    before = F.last(F.when(F.col("fate").isNull(), F.col("close")), ignorenulls=True).over(W.ordered().rowsBetween(Window.unboundedPreceding, -1))
    staged = staged.withColumn("before", before)
    jump = F.col("fate").isNull() & (F.abs(F.try_divide(F.col("close"), F.col("before")) - 1) > max_move)
    staged = staged.withColumn("fate", F.when(jump, "move").otherwise(F.col("fate")))
    n = lambda test: F.count_if(test)
    return staged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows_input"),
        n(F.col("fate").isNull()).alias("rows_output"),
        n(F.col("fate").isNotNull()).alias("rows_dropped"),
        (n(F.col("broken")) if repair else F.lit(0).cast("long")).alias("rows_fixed"),
        *[n(F.col("fate") == name).alias(f"bad_{name}") for name in ("not_a_number", "price", "volume", "move")],
        n(F.col("broken")).alias("bad_high_low"),
    )


def quality_report(bars: DataFrame, least_bars: int = 2) -> DataFrame:
    """Years, days, sparse days and bars with impossible prices of each symbol's bars (with ``bar_count`` a day), and a score of four flags."""
    impossible = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    found = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"),
        (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"),
        F.count_if(F.col("bar_count") < least_bars).alias("sparse_days"),
        F.count_if(impossible).alias("invalid_bars"),
    )
    flags = [F.col("years") >= 1, F.col("days") >= 200, F.col("sparse_days") <= 0.5 * F.col("days"), F.col("invalid_bars") == 0]
    return found.withColumn("quality_score", sum((f.cast("double") for f in flags), F.lit(0.0)) / 4)


def minutes_between(rows: DataFrame, low: int, high: int, opening: int = 570) -> DataFrame:
    """The rows whose ``ts`` lies ``low`` to ``high`` minutes from the opening, both included."""
    return rows.filter((F.hour("ts") * 60 + F.minute("ts") - opening).between(low, high))


def sigmoid(x: Column, steepness: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-steepness * x))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, within 1e-14: Marsaglia's series about 0, a continued fraction beyond 3.5.

    No error function is built in; this stays an expression, so it is computed in the JVM.
    """
    # sum of x**(2k+1) / (1 * 3 * ... * (2k+1)), by Horner's rule from the last term on.
    square, series = x * x, F.lit(1.0)
    for k in range(60, 0, -1):
        series = 1 + square / (2 * k + 1) * series
    density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
    size, fraction = F.abs(x), F.abs(x)
    for k in range(60, 0, -1):
        fraction = size + k / fraction
    tail = density / fraction
    near = 0.5 + density * x * series
    return F.when(size <= 3.5, near).when(size > 38, (x > 0).cast("double")).otherwise(F.when(x > 0, 1 - tail).otherwise(tail))


def defaults(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    """Missing and non-finite numbers of each column become its default."""
    return rows.withColumns({c: F.when(_usable(c), F.col(c)).otherwise(F.lit(float(v))) for c, v in values.items()})


def candidate_columns(rows: DataFrame, excluded: tuple = (), prefixes: tuple = ()) -> list[str]:
    """Numeric columns that are neither excluded by name nor by prefix."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return [c for c, kind in rows.dtypes if (kind in numeric or kind.startswith("decimal")) and c not in excluded and not c.startswith(tuple(prefixes) or ("\0",))]


def complete_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.na.drop(subset=columns)


def synthetic_weights(rows: DataFrame, weight: str = "sample_weight", synthetic: str = "is_synthetic") -> DataFrame:
    """Halves the weight of synthetic rows and keeps it within 0.10 to 0.60; real rows keep theirs."""
    return rows.withColumn(weight, F.when(F.col(synthetic), W.clip(F.col(weight) * 0.5, 0.10, 0.60)).otherwise(F.col(weight)))


def impute(rows: DataFrame, value: str, method: str, keys: list[str], at: str, neighbours: int = 5) -> DataFrame:
    """Fills missing ``value`` by ``ffill`` (then backwards), ``bfill``, ``mean``, ``median``, ``zero``, ``linear`` or ``knn``; what is left becomes 0.

    ``linear`` runs over row numbers and holds the ends. ``knn`` takes the mean of the known values
    nearest in row number, up to ``neighbours`` on either side.
    """
    by = Window.partitionBy(*keys).orderBy(at)
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    x = F.when(_usable(value), F.col(value))
    last, first = F.last(x, ignorenulls=True).over(back), F.first(x, ignorenulls=True).over(ahead)
    if method in ("mean", "median"):
        usual = rows.groupBy(*keys).agg((F.mean(x) if method == "mean" else F.median(x)).alias("_usual"))
        return rows.join(usual, keys).withColumn(value, F.coalesce(x, "_usual", F.lit(0.0))).drop("_usual")
    if method == "linear":
        numbered = rows.withColumn("_n", F.row_number().over(by))
        known = F.when(_usable(value), F.struct(F.col(value).cast("double").alias("v"), F.col("_n").alias("n")))
        near = numbered.withColumns({"_a": F.last(known, ignorenulls=True).over(back), "_b": F.first(known, ignorenulls=True).over(ahead)})
        step = (F.col("_b.v") - F.col("_a.v")) * (F.col("_n") - F.col("_a.n")) / F.nullif(F.col("_b.n") - F.col("_a.n"), F.lit(0))
        return near.withColumn(value, F.coalesce(x, F.col("_a.v") + step, "_a.v", "_b.v", F.lit(0.0))).drop("_n", "_a", "_b")
    if method == "knn":
        side = lambda low, high: F.collect_list(x).over(by.rowsBetween(low, high))
        both = F.concat(side(-neighbours, -1), side(1, neighbours))
        near = F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, v: a + v) / F.size(both))
        return rows.withColumn(value, F.coalesce(x, near, F.lit(0.0)))
    found = {"ffill": F.coalesce(last, first), "bfill": F.coalesce(first, last), "zero": x}[method]
    return rows.withColumn(value, F.coalesce(found, F.lit(0.0)))


def _outlier_bounds(rows: DataFrame, value: str, method: str, keys: list[str], k: float) -> DataFrame:
    x = F.col(value)
    if method == "mad":
        middle = exact_quantiles(rows, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias("_m"))
        away = rows.join(middle, keys).select(*keys, "_m", F.abs(x - F.col("_m")).alias("_away"))
        # The median belongs to its key, so it rides along as one.
        spread = exact_quantiles(away, [*keys, "_m"], "_away", [0.5], "_q").withColumn("_s", F.col("_q")[0] * 1.4826)
        return spread.select(*keys, (F.col("_m") - k * F.col("_s")).alias("_low"), (F.col("_m") + k * F.col("_s")).alias("_high"))
    if method in ("winsorize", "iqr"):
        share = k / 100 if method == "winsorize" else 0.25
        found = exact_quantiles(rows, keys, value, [share, 1 - share], "_q").select(*keys, F.col("_q")[0].alias("_a"), F.col("_q")[1].alias("_b"))
        reach = F.when(F.col("_b") == F.col("_a"), 1.0).otherwise(F.col("_b") - F.col("_a")) * (0 if method == "winsorize" else k)
        return found.select(*keys, (F.col("_a") - reach).alias("_low"), (F.col("_b") + reach).alias("_high"))
    if method not in ("clip", "zscore"):
        raise ValueError(f"unknown method {method!r}")
    spread = F.stddev_pop(value)
    spread = F.when(spread == 0, 1.0).otherwise(spread)
    return rows.groupBy(*keys).agg((F.mean(value) - k * spread).alias("_low"), (F.mean(value) + k * spread).alias("_high"))


def limit_outliers(rows: DataFrame, value: str, method: str, keys: list[str], k: float) -> DataFrame:
    """Clips ``value`` within bounds of its key: ``winsorize`` (percent ``k``), ``clip`` (``k`` population deviations),
    ``iqr`` (``k`` quartile ranges), ``zscore`` (drops rows beyond ``k`` deviations) or ``mad`` (``k`` scaled median deviations).
    """
    return limit_all_outliers(rows, {value: (method, k)}, keys)


def limit_all_outliers(rows: DataFrame, limits: dict[str, tuple[str, float]], keys: list[str]) -> DataFrame:
    """Limits each column of ``limits`` by its method and ``k``, all bounds taken from the rows as they came."""
    out = rows
    for value, (method, k) in limits.items():
        x = F.col(value)
        joined = out.join(_outlier_bounds(rows, value, method, keys, k), keys, "left")
        if method == "zscore":
            joined = joined.filter(x.between(F.col("_low"), F.col("_high")))
        else:
            joined = joined.withColumn(value, F.when(x.isNotNull(), F.least(F.greatest(x, "_low"), "_high")))
        out = joined.drop("_low", "_high")
    return out


def scale(rows: DataFrame, value: str, method: str, keys: list[str]) -> DataFrame:
    """Adds ``scaled``: ``standard``, ``minmax``, ``robust``, ``maxabs``, ``log`` (sign kept), ``rank`` (0 to 1) or ``none`` of ``value``; a zero spread counts as 1."""
    x = F.col(value)
    if method == "log":
        return rows.withColumn("scaled", F.signum(x) * F.log1p(F.abs(x)))
    if method == "none":
        return rows.withColumn("scaled", x)
    if method == "rank":
        return rows.withColumn("scaled", F.when(x.isNotNull(), F.percent_rank().over(Window.partitionBy(*keys, x.isNull()).orderBy(value))))
    if method == "robust":
        q = exact_quantiles(rows, keys, value, [0.25, 0.5, 0.75], "_q")
        reach = F.col("_q")[2] - F.col("_q")[0]
        bounds = q.select(*keys, F.col("_q")[1].alias("_centre"), F.when(reach == 0, 1.0).otherwise(reach).alias("_spread"))
        return rows.join(bounds, keys, "left").withColumn("scaled", (x - F.col("_centre")) / F.col("_spread")).drop("_centre", "_spread")
    centre, spread = {
        "standard": (F.mean(value), F.stddev_pop(value)),
        "minmax": (F.min(value), F.max(value) - F.min(value)),
        "maxabs": (F.lit(0.0), F.max(F.abs(x))),
    }[method]
    bounds = rows.groupBy(*keys).agg(centre.alias("_centre"), F.when(spread == 0, 1.0).otherwise(spread).alias("_spread"))
    return rows.join(bounds, keys).withColumn("scaled", (x - F.col("_centre")) / F.col("_spread")).drop("_centre", "_spread")


def unbiased_moments(x: Column, frame, least: int) -> tuple[Column, Column]:
    """Skewness and excess kurtosis over a frame, corrected for its size; null below ``least`` values or without spread."""
    n = F.count(x).over(frame)
    spread = F.stddev_pop(x).over(frame) > 0
    skew = F.skewness(x).over(frame) * F.sqrt(n * (n - 1.0)) / (n - 2)
    kurt = ((n + 1.0) * F.kurtosis(x).over(frame) + 6) * (n - 1) / ((n - 2.0) * (n - 3))
    return F.when((n >= F.greatest(F.lit(3), F.lit(least))) & spread, skew), F.when((n >= F.greatest(F.lit(4), F.lit(least))) & spread, kurt)


def densify(rows: DataFrame, keys: list[str], at: str, values: list[str], business_days: bool = False, back: bool = False) -> DataFrame:
    """A row for each day between a key's first and last one, values carried forward (and back, if asked), then business days only."""
    spans = rows.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    days = spans.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias(at))
    filled = days.join(rows.select(*keys, at, *values), [*keys, at], "left")
    by = Window.partitionBy(*keys).orderBy(at)
    carried = {}
    for v in values:
        found = F.last(v, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
        carried[v] = F.coalesce(found, F.first(v, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))) if back else found
    filled = filled.withColumns(carried)
    return filled.filter(F.weekday(at) < 5) if business_days else filled
