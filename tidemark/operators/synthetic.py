"""Synthetic universes: an index rebuilt from a filtered basket of its members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_extremes(members: DataFrame, share: float, least_names: int = 10) -> DataFrame:
    """Drops each date's best and worst ``share`` of members; dates of few names keep all."""
    day = Window.partitionBy("date")
    rows = members.filter("ret IS NOT NULL").withColumns(
        {"_place": F.row_number().over(day.orderBy("ret", "symbol")), "_names": F.count(F.lit(1)).over(day)}
    )
    cut = F.greatest(F.lit(1), F.floor(F.col("_names") * share))
    inside = (F.col("_place") > cut) & (F.col("_place") <= F.col("_names") - cut)
    return rows.filter((F.col("_names") < least_names) | inside).drop("_place", "_names")


def blended_index(members: DataFrame, index: DataFrame, real_weight: float = 0.6, damping: float = 0.8) -> DataFrame:
    """The basket's mean return, scaled to the index's volatility, damped and blended with the index.

    ``index`` has ``date, ret``; dates that either side lacks are left out. One row of two
    deviations is all that is broadcast.
    """
    basket = members.groupBy("date").agg(F.mean("ret").alias("basket"))
    both = basket.join(index.filter("ret IS NOT NULL").select("date", F.col("ret").alias("real")), "date")
    scale = both.agg((F.stddev_samp("real") / (F.stddev_samp("basket") + 1e-10)).alias("_scale"))
    synthetic = F.col("basket") * F.col("_scale") * damping
    return both.join(F.broadcast(scale)).select("date", "real", synthetic.alias("synthetic"), (real_weight * F.col("real") + (1 - real_weight) * synthetic).alias("blended"))


def without_middle(members: DataFrame, share: float, least_names: int = 10) -> DataFrame:
    """Drops the middle ``share`` of each date's members by return; dates of few names keep all."""
    day = Window.partitionBy("date")
    rows = members.filter("ret IS NOT NULL").withColumns(
        {"_place": F.row_number().over(day.orderBy("ret", "symbol")), "_names": F.count(F.lit(1)).over(day)}
    )
    low = F.floor(F.col("_names") * (1 - share) / 2)
    high = F.col("_names") - low
    return rows.filter((F.col("_names") < least_names) | (F.col("_place") <= low) | (F.col("_place") > high)).drop("_place", "_names")


def by_quantile(members: DataFrame, of: str, keep: str, share: float = 0.5) -> DataFrame:
    """The members whose ``volatility`` or ``momentum`` (total return) lies in the ``low`` or ``high`` ``share`` of all."""
    value = F.stddev_samp("ret") if of == "volatility" else F.exp(F.sum(F.log1p("ret"))) - 1
    per = members.filter("ret IS NOT NULL").groupBy("symbol").agg(value.alias("_value"))
    limit = per.agg(F.percentile("_value", share if keep == "low" else 1 - share)).scalar()
    kept = per.withColumn("_limit", limit).filter(F.col("_value") <= F.col("_limit") if keep == "low" else F.col("_value") >= F.col("_limit"))
    return members.join(kept.select("symbol"), "symbol", "left_semi")


def by_correlation(members: DataFrame, share: float = 0.2) -> DataFrame:
    """Drops the ``share`` of members that correlate most and the ``share`` that correlate least with the basket's mean return."""
    rows = members.filter("ret IS NOT NULL")
    basket = rows.groupBy("date").agg(F.mean("ret").alias("_basket"))
    per = rows.join(basket, "date").groupBy("symbol").agg(F.corr("ret", "_basket").alias("_corr"))
    everything = Window.partitionBy(F.lit(0))
    # One row for each member is ordered here, not one for each return.
    placed = per.withColumns({"_place": F.row_number().over(everything.orderBy("_corr", "symbol")), "_names": F.count(F.lit(1)).over(everything)})
    cut = F.floor(F.col("_names") * share)
    return rows.join(placed.filter((F.col("_place") > cut) & (F.col("_place") <= F.col("_names") - cut)).select("symbol", "_corr"), "symbol").withColumnRenamed("_corr", "corr")


def without_member(index: DataFrame, members: DataFrame, weights: DataFrame, sign: int = -1) -> DataFrame:
    """The index's return without (``sign`` -1) or with twice (1) each member's weighted share: ``universe, date, ret``."""
    parts = members.filter("ret IS NOT NULL").join(weights, "symbol").join(index.filter("ret IS NOT NULL").select("date", F.col("ret").alias("_index")), "date")
    return parts.select(F.col("symbol").alias("universe"), "date", (F.col("_index") + sign * F.col("weight") * F.col("ret")).alias("ret"))


def tilted(members: DataFrame, favoured: list[str], factor: float = 2.0) -> DataFrame:
    """The basket's mean return with the favoured members counted ``factor`` times."""
    weight = F.when(F.col("symbol").isin(favoured), factor).otherwise(1.0)
    return members.filter("ret IS NOT NULL").groupBy("date").agg(F.try_divide(F.sum(F.col("ret") * weight), F.sum(weight)).alias("ret"))


def sampled_members(members: DataFrame, share: float, seed: int) -> DataFrame:
    """The ``share`` of the members (one at least) that a hash of seed and name puts first."""
    names = members.select("symbol").distinct()
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.xxhash64(F.lit(seed), "symbol"), "symbol"))
    kept = names.withColumns({"_place": place, "_names": F.count(F.lit(1)).over(everything)}).filter(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_names") * share)))
    return members.join(kept.select("symbol"), "symbol", "left_semi")


def augmented(real: DataFrame, universes: DataFrame, threshold: float = 0.0025, weight: float = 0.5) -> DataFrame:
    """Real rows and, for each universe, the real rows of its dates with its return, recomputed targets and less weight."""
    names = [c for c in real.columns if c not in ("date", "ret")]
    synthetic = real.drop("ret").join(universes.select("universe", "date", "ret"), "date")
    both = real.select(F.lit("real").alias("universe"), "date", "ret", *names, F.lit(1.0).alias("weight")).unionByName(
        synthetic.select("universe", "date", "ret", *names, F.lit(weight).alias("weight"))
    )
    return both.withColumns({"target_up": F.col("ret") > threshold, "target_down": F.col("ret") < -threshold, "is_synthetic": F.col("universe") != "real"})
