"""Universes that even out what one scale of time has too much of: weeks, months, sizes of moves, spells of volatility, and all at once.

A universe is a table of pools: the blocks (``_from``, ``_length`` in rows of a key) of each ``kind`` and the days that the kind
shall fill (``_quota``). ``universes`` draws blocks of all pools with replacement, puts them in a drawn order and fills
what is left of the key's days with single drawn days. Draws are hashes of seed, key and place, so reruns agree. Only blocks are
put in order, and the days that they stand for join afterwards. A key that lacks the kinds a universe needs is absent from it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bear import _days

col = F.col
#: Moves beyond ``RISE`` count as up or down, those beyond ``LARGE`` as large, months beyond ``MONTH`` as rallies or drawdowns.
RISE, LARGE, MONTH = 0.0025, 0.01, 0.03
WEEK_DAYS, MONTH_DAYS = 5, 21


def _chunks(days: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Blocks of ``size`` rows with their sum and counts of moves; ``_whole`` is the number of full blocks, the rest is left out."""
    placed = days.withColumns({"_of": F.floor((col("_n") - 1) / size), "_whole": F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / size)})
    x = col("real_return")
    sums = [F.sum(x).alias("_sum"), F.count_if(x > RISE).alias("_up"), F.count_if(x < -RISE).alias("_down")]
    chunks = placed.filter("_of < _whole").groupBy(*keys, "_whole", "_of").agg(F.min("_n").alias("_from"), *sums)
    return chunks.withColumn("_length", F.lit(size))


def _week_kind() -> Column:
    return F.when(col("_up") >= 3, "bull").when(col("_down") >= 3, "bear").otherwise("choppy")


def _month_kind() -> Column:
    return F.when(col("_sum") < -MONTH, "drawdown").when(col("_sum") > MONTH, "rally").otherwise("flat")


def _size_kind(x: Column) -> Column:
    return F.when(F.abs(x) > LARGE, "large").when(F.abs(x) <= RISE, "flat").otherwise("normal")


def _counted(rows: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys)
    return rows.withColumns({f"_{k}": F.count_if(col("kind") == k).over(by) for k in kinds})


def _pools(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "kind", col("_from").cast("long").alias("_from"), col("_length").cast("long").alias("_length"), col("_quota").cast("long").alias("_quota"))


def weeks(bull: float, bear: float) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Weeks of five rows, a share ``bull`` with three rising days or more, ``bear`` with three falling ones, the rest choppy."""

    def pools(days: DataFrame, keys: list[str]) -> DataFrame:
        found = _counted(_chunks(days, keys, WEEK_DAYS).withColumn("kind", _week_kind()), keys, ["bull", "bear", "choppy"])
        found = found.filter("_whole >= 10 AND _bull >= 3 AND _bear >= 3 AND _choppy >= 2")
        n_bull, n_bear = F.floor(col("_whole") * bull), F.floor(col("_whole") * bear)
        n = F.when(col("kind") == "bull", n_bull).when(col("kind") == "bear", n_bear).otherwise(col("_whole") - n_bull - n_bear)
        return _pools(found.withColumn("_quota", n * WEEK_DAYS), keys)

    return pools


def drawdown_months(days: DataFrame, keys: list[str]) -> DataFrame:
    """Months of 21 rows, 40 % of them drawdowns, 30 % rallies, the rest flat.

    With fewer than two rallies, the first half of the flat months stand in for them, and the other way round; failing both, the first drawdown does.
    """
    found = _counted(_chunks(days, keys, MONTH_DAYS).withColumn("kind", _month_kind()), keys, ["drawdown", "rally", "flat"])
    found = found.filter("_whole >= 6 AND _drawdown >= 2").withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("_from")))
    few_rallies, few_flat = col("_rally") < 2, col("_flat") < 2
    first = few_rallies & few_flat & (col("kind") == "drawdown") & (col("_i") == 1)
    half = lambda own, few: (col("kind") == own) & (~few | (col("_i") <= F.floor(col(f"_{own}") / 2)))
    roles = F.array_compact(
        F.array(
            F.when(col("kind") == "drawdown", "drawdown"),
            F.when((~few_rallies & (col("kind") == "rally")) | (few_rallies & ~few_flat & half("flat", few_rallies)) | first, "rally"),
            F.when((~few_flat & (col("kind") == "flat")) | (few_flat & ~few_rallies & half("rally", few_flat)) | first, "flat"),
        )
    )
    n_draw, n_rally = F.greatest(F.lit(1), F.floor(col("_whole") * 0.4)), F.greatest(F.lit(1), F.floor(col("_whole") * 0.3))
    found = found.withColumn("kind", F.explode(roles))
    n = F.when(col("kind") == "drawdown", n_draw).when(col("kind") == "rally", n_rally).otherwise(col("_whole") - n_draw - n_rally)
    return _pools(found.withColumn("_quota", n * MONTH_DAYS), keys)


def swings(kind: str, share: float) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Single days, a ``share`` of them ``large`` or ``flat`` moves, the other two kinds in their own proportion."""
    if kind not in ("large", "flat"):
        raise ValueError(f"unknown kind {kind!r}")
    #: The kind whose part of the remainder is rounded down, and the one that gets what is left.
    second, third = ("normal", "flat") if kind == "large" else ("large", "normal")

    def pools(days: DataFrame, keys: list[str]) -> DataFrame:
        found = _counted(days.withColumn("kind", _size_kind(col("real_return"))), keys, ["large", "normal", "flat"]).filter("_large >= 5 AND _normal >= 10 AND _flat >= 5")
        total = col("_large") + col("_normal") + col("_flat")
        asked = F.floor(total * share)
        next_ = F.floor((total - asked) * (col(f"_{second}") / (col(f"_{second}") + col(f"_{third}"))))
        n = F.when(col("kind") == kind, asked).when(col("kind") == second, next_).otherwise(total - asked - next_)
        return _pools(found.withColumns({"_from": col("_n"), "_length": F.lit(1), "_quota": n}), keys)

    return pools


def volatility_spells(days: DataFrame, keys: list[str], window: int = 10, low: float = 0.12, high: float = 0.22, least_run: int = 3, least_days: int = 30) -> DataFrame:
    """Spells of low, middle and high volatility of ``window`` rows (a year's), a third of the days each; days before a full window are in the middle."""
    by = Window.partitionBy(*keys).orderBy("_n")
    spread = F.when(col("_n") >= window, F.stddev_samp("real_return").over(by.rowsBetween(1 - window, 0))) * F.sqrt(F.lit(252.0))
    found = days.withColumns({"_spread": spread, "_total": F.count(F.lit(1)).over(Window.partitionBy(*keys))}).filter(col("_total") >= least_days)
    found = found.withColumn("kind", F.when(col("_spread") < low, "low").when(col("_spread") > high, "high").otherwise("med"))
    found = found.withColumn("_run", col("_n") - F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("_n")))
    runs = found.groupBy(*keys, "_total", "kind", "_run").agg(F.min("_n").alias("_from"), F.count(F.lit(1)).alias("_length")).filter(col("_length") >= least_run)
    runs = _counted(runs, keys, ["low", "med", "high"]).filter("_low > 0 AND _med > 0 AND _high > 0")
    return _pools(runs.withColumn("_quota", F.floor(col("_total") / 3)), keys)


def cascade(days: DataFrame, keys: list[str], least_days: int = 63, least_kinds: int = 5) -> DataFrame:
    """Single days, as many of each combination of their month's, their week's and their own kind; an incomplete last week or month takes the kind before it."""
    total = days.withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(col("_total") >= least_days)
    for size, name, kind in ((MONTH_DAYS, "_month", _month_kind()), (WEEK_DAYS, "_week", _week_kind())):
        chunks = _chunks(days, keys, size).select(*keys, "_of", kind.alias(name))
        place = F.least(F.floor((col("_n") - 1) / size), F.floor(col("_total") / size) - 1)
        total = total.withColumn("_of", place).join(chunks, [*keys, "_of"]).drop("_of")
    rows = total.withColumn("kind", F.concat_ws("|", "_month", "_week", _size_kind(col("real_return"))))
    kinds = rows.groupBy(*keys).agg(F.count_distinct("kind").alias("_kinds")).filter(col("_kinds") >= least_kinds)
    rows = rows.join(kinds, keys).withColumns({"_from": col("_n"), "_length": F.lit(1), "_quota": F.floor(col("_total") / col("_kinds"))})
    rest = rows.withColumns({"kind": F.lit("rest"), "_quota": col("_total") - col("_quota") * col("_kinds")})
    return _pools(rows.unionByName(rest), keys)


#: The seven universes, with their seeds.
UNIVERSES = {
    "multiscale_weekly_balanced": (3001, weeks(0.40, 0.40)),
    "multiscale_weekly_bear": (3002, weeks(0.30, 0.50)),
    "multiscale_monthly_drawdown": (3010, drawdown_months),
    "multiscale_swing_large": (3020, swings("large", 0.40)),
    "multiscale_swing_flat": (3021, swings("flat", 0.40)),
    "multiscale_vol_regime": (3030, volatility_spells),
    "multiscale_cascade": (3040, cascade),
}


def _draw(what: str, *parts: str) -> Column:
    """A number from 0 to 2**32 - 1, the first eight hexadecimal digits of an MD5 of the row's seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "_seed", F.lit(what), *[col(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def universes(index: DataFrame, keys: list[str], chosen: dict = UNIVERSES) -> DataFrame:
    """``universe, keys, date, real_return, synthetic_return, kind, taken_from``: for each chosen universe (name to seed and pools) every day of a key.

    ``index`` has the key columns, ``date`` and ``ret``; rows without a return are left out. ``kind`` is null for the days that fill up the end.
    """
    days = _days(index, keys)
    pools = reduce(DataFrame.unionByName, [make(days, keys).withColumns({"universe": F.lit(name), "_seed": F.lit(seed)}) for name, (seed, make) in chosen.items()])
    by = ["universe", "_seed", *keys]
    pools = pools.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("_from")))
    sizes = pools.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("_pool"), F.max("_quota").alias("_quota"), F.min("_length").alias("_shortest")).filter(col("_quota") > 0)
    # No block is shorter than the shortest, so so many draws fill the quota.
    draws = sizes.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(col("_quota") / col("_shortest")))))
    draws = draws.withColumn("_i", (_draw("pick", *keys, "kind", "_k") % col("_pool") + 1).cast("int")).drop("_pool", "_shortest", "_quota")
    drawn = draws.join(pools, [*by, "kind", "_i"])
    earlier = Window.partitionBy(*by, "kind").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("_filled", F.coalesce(F.sum("_length").over(earlier), F.lit(0))).filter("_filled < _quota")
    order = Window.partitionBy(*by).orderBy(_draw("place", *keys, "kind", "_k"), "kind", "_k").rowsBetween(Window.unboundedPreceding, -1)
    totals = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    put = drawn.withColumn("_before", F.coalesce(F.sum("_length").over(order), F.lit(0))).join(totals, keys)
    kept = put.filter("_before < _total").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(col("_length"), col("_total") - col("_before")) - 1)))
    slots = kept.select(*by, "kind", (col("_before") + col("_j") + 1).alias("_n"), (col("_from") + col("_j")).alias("_taken"))
    ends = put.groupBy(*by, "_total").agg(F.max(col("_before") + col("_length")).alias("_end")).filter("_end < _total")
    rest = ends.withColumn("_n", F.explode(F.sequence(col("_end") + 1, col("_total"))))
    rest = rest.select(*by, F.lit(None).cast("string").alias("kind"), "_n", (_draw("rest", *keys, "_n") % col("_total") + 1).alias("_taken"))
    source = days.select(*keys, col("_n").alias("_taken"), col("date").alias("taken_from"), col("real_return").alias("synthetic_return"))
    found = slots.unionByName(rest).join(source, [*keys, "_taken"]).join(days, [*keys, "_n"])
    return found.select("universe", *keys, "date", "real_return", "synthetic_return", "kind", "taken_from")
