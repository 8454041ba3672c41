"""Bear universes: an index's own returns drawn again, shifted, amplified or rotated towards falling markets.

``index`` has the key columns, ``date`` and ``ret``; rows without a return are left out. Every universe gives
``keys, date, real_return, synthetic_return``, one row for each of the key's days. Draws are hashes of seed, key and
place, so reruns agree however the rows are dealt. A key with too few days of the kind that a universe needs is absent from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Daily returns beyond this are cut off.
LIMIT = 0.10


def draw(seed: int, what: str, *parts: str) -> Column:
    """A number from 0 to 2**32 - 1, the first eight hexadecimal digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(what), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _limited(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-LIMIT)), F.lit(LIMIT))


def _days(index: DataFrame, keys: list[str]) -> DataFrame:
    known = index.filter("ret IS NOT NULL AND NOT isnan(ret)").select(*keys, "date", F.col("ret").cast("double").alias("real_return"))
    return known.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))


def mean_shift(index: DataFrame, keys: list[str], basis_points: float) -> DataFrame:
    """Every return less a fixed amount; order and clustering stay as they were."""
    return _days(index, keys).withColumn("synthetic_return", _limited(F.col("real_return") - basis_points / 10_000)).drop("_n")


def amplified(index: DataFrame, keys: list[str], losses: float = 1.5, gains: float = 0.7) -> DataFrame:
    """Losses times ``losses``, gains times ``gains``."""
    x = F.col("real_return")
    return _days(index, keys).withColumn("synthetic_return", _limited(x * F.when(x < 0, losses).otherwise(gains))).drop("_n")


def block_bootstrap(
    index: DataFrame, keys: list[str], seed: int, fall: float = 0.02, window: int = 10, after: int = 5, least_days: int = 30, least_run: int = 3, lengths: tuple[int, int] = (5, 20)
) -> DataFrame:
    """Days drawn in blocks from spells of decline, with ``block`` and ``taken_from``, the date a return comes from.

    A day belongs to a spell if it or one of the ``after`` days before it ends ``window`` days whose returns sum to less than
    ``-fall``. Spells of ``least_run`` days or more are drawn with replacement, of each a stretch of ``lengths`` days (all of a
    shorter one). The lengths of the blocks before tell where a block goes, so blocks and not days are put in order.
    """
    days = _days(index, keys)
    by = Window.partitionBy(*keys).orderBy("_n")
    usual = by.rowsBetween(1 - window, 0)
    falling = (F.col("_n") >= window) & (F.sum("real_return").over(usual) < -fall)
    spells = days.withColumn("_falling", falling).withColumn("_bear", F.max("_falling").over(by.rowsBetween(-after, 0))).filter("_bear")
    spells = spells.withColumns({"_spell": F.col("_n") - F.row_number().over(by), "_bears": F.count(F.lit(1)).over(Window.partitionBy(*keys))}).filter(F.col("_bears") >= least_days)
    runs = spells.groupBy(*keys, "_spell").agg(F.min("_n").alias("_from"), F.count(F.lit(1)).alias("_length")).filter(F.col("_length") >= least_run)
    runs = runs.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_from")))
    sizes = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).join(runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_runs")), keys)
    # No block is shorter than this, so so many draws fill all days.
    shortest = min(least_run, lengths[0])
    draws = sizes.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_total") / shortest))))
    drawn = draws.withColumn("_i", draw(seed, "run", *keys, "block") % F.col("_runs") + 1).join(runs, [*keys, "_i"])
    drawn = drawn.withColumn("_take", F.least(lengths[0] + draw(seed, "length", *keys, "block") % (lengths[1] - lengths[0] + 1), "_length"))
    drawn = drawn.withColumn("_start", F.col("_from") + draw(seed, "start", *keys, "block") % (F.col("_length") - F.col("_take") + 1))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    put = drawn.withColumn("_before", F.coalesce(F.sum("_take").over(earlier), F.lit(0))).filter("_before < _total")
    slots = put.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_take"), F.col("_total") - F.col("_before")) - 1)))
    slots = slots.select(*keys, "block", (F.col("_before") + F.col("_k") + 1).alias("_n"), (F.col("_start") + F.col("_k")).alias("_taken"))
    source = days.select(*keys, F.col("_n").alias("_taken"), F.col("date").alias("taken_from"), F.col("real_return").alias("synthetic_return"))
    return slots.join(source, [*keys, "_taken"]).join(days, [*keys, "_n"]).select(*keys, "date", "real_return", "synthetic_return", "block", "taken_from")


def regime_balanced(index: DataFrame, keys: list[str], up: float, down: float, seed: int, threshold: float = 0.0025, least: int = 10) -> DataFrame:
    """The key's own returns drawn so that a share ``up`` of the days rises and ``down`` falls by more than ``threshold``; the rest are flat.

    A hash puts the days in order, the first of them rise, the next fall. Without a flat day to draw from, the flat share goes half to each, an odd one to the rising.
    """
    x = F.col("real_return")
    days = _days(index, keys).withColumn("_kind", F.when(x > threshold, "up").when(x < -threshold, "down").otherwise("flat"))
    counts = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col("_kind") == k).alias(f"_{k}") for k in ("up", "down", "flat")])
    counts = counts.filter((F.col("_up") >= least) & (F.col("_down") >= least))
    n_up, n_down = F.floor(F.col("_total") * up), F.floor(F.col("_total") * down)
    spare = F.when(F.col("_flat") == 0, F.col("_total") - n_up - n_down).otherwise(0)
    falls = n_down + F.floor(spare / 2)
    rises = n_up + spare - F.floor(spare / 2)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(seed, "place", *keys, "_n"), "_n"))
    slots = days.drop("_kind").withColumn("_place", place).join(counts, keys)
    slots = slots.withColumn("_kind", F.when(F.col("_place") <= rises, "up").when(F.col("_place") <= rises + falls, "down").otherwise("flat"))
    size = F.when(F.col("_kind") == "up", F.col("_up")).when(F.col("_kind") == "down", F.col("_down")).otherwise(F.col("_flat"))
    slots = slots.withColumn("_i", draw(seed, "pick", *keys, "_n") % size + 1).select(*keys, "date", "real_return", "_kind", "_i")
    pool = days.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy("_n"))).select(*keys, "_kind", "_i", x.alias("synthetic_return"))
    return slots.join(pool, [*keys, "_kind", "_i"]).drop("_kind", "_i")


def defensive_rotation(members: DataFrame, index: DataFrame, defensive: list, cyclical: list, least_names: int = 3, least_dates: int = 100) -> DataFrame:
    """``date, real_return, synthetic_return`` of a basket whose defensive names hold up and whose cyclical ones fall harder.

    ``0.6 * 0.9`` of the defensive mean plus ``0.4 * 1.4`` of the cyclical one, scaled to the index's deviation; if it still
    rises on average, its mean goes to three basis points below zero. Dates without both baskets take the index less five basis points.
    Without ``least_names`` of either kind or ``least_dates`` dates, nothing is returned. Only one row of moments is broadcast.
    """
    days = index.filter("ret IS NOT NULL AND NOT isnan(ret)").select("date", F.col("ret").cast("double").alias("real_return"))
    known = members.filter("ret IS NOT NULL AND NOT isnan(ret)")
    sides = [F.col("symbol").isin(names) for names in (defensive, cyclical)]
    means = known.groupBy("date").agg(*[F.mean(F.when(side, F.col("ret"))).alias(n) for side, n in zip(sides, ("_d", "_c"), strict=True)])
    both = days.join(means, "date", "left").withColumn("_raw", 0.6 * 0.9 * F.col("_d") + 0.4 * 1.4 * F.col("_c"))
    names = known.agg(*[F.count_distinct(F.when(side, F.col("symbol"))).alias(n) for side, n in zip(sides, ("_nd", "_nc"), strict=True)])
    real = F.when(F.col("_raw").isNotNull(), F.col("real_return"))
    scale = (F.stddev_samp(real) / (F.stddev_samp("_raw") + 1e-10)).alias("_scale")
    moments = both.agg(scale, F.mean("_raw").alias("_mean"), F.count("_raw").alias("_both")).join(F.broadcast(names))
    moments = moments.filter((F.col("_nd") >= least_names) & (F.col("_nc") >= least_names) & (F.col("_both") >= least_dates))
    mean = F.col("_mean") * F.col("_scale")
    scaled = F.col("_raw") * F.col("_scale") - F.when(mean > 0, mean + 0.0003).otherwise(0.0)
    found = both.join(F.broadcast(moments)).withColumn("synthetic_return", F.when(F.col("_raw").isNotNull(), _limited(scaled)).otherwise(F.col("real_return") - 0.0005))
    return found.select("date", "real_return", "synthetic_return")
