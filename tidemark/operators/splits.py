"""Cross-validation splits as columns: each row is told its role in every split, without a join."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W


def combinatorial_folds(rows: DataFrame, groups: int = 6, tested: int = 2, purge: int = 10, embargo: int = 3) -> DataFrame:
    """A row per split of C(groups, tested): ``symbol, date, split, role`` (test, purged or train).

    Groups are contiguous and equal, the last takes the remainder; the ``purge`` rows before and the
    ``embargo`` rows after a tested group train nothing.
    """
    placed = rows.select(
        "symbol", "date", (F.row_number().over(W.ordered()) - 1).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("_total")
    ).filter(F.col("_total") >= groups)
    width = F.floor(F.col("_total") / groups)
    tests = F.array(*[F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, picked)).alias("groups")) for i, picked in enumerate(combinations(range(groups), tested))])
    begin = lambda g: g * width
    end = lambda g: F.when(g == groups - 1, F.col("_total")).otherwise((g + 1) * width)
    n = F.col("_n")
    inside = F.exists("_test.groups", lambda g: (n >= begin(g)) & (n < end(g)))
    beside = F.exists("_test.groups", lambda g: (n >= begin(g) - purge) & (n < end(g) + embargo))
    return placed.withColumn("_test", F.explode(tests)).select(
        "symbol", "date", F.col("_test.split").alias("split"), F.when(inside, "test").when(beside, "purged").otherwise("train").alias("role")
    )


def rank_correlation(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Spearman's correlation by ``keys``, with ties averaged and Fisher's z of it.

    Ranks come from counts of distinct values, so tasks order those instead of all rows.
    """
    for name in (a, b):
        counts = rows.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(name))
        ranks = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(name).alias("_v"), (upto - (F.col("_n") - 1) / 2).alias(f"_rank_{name}"))
        same = F.col(name).eqNullSafe(F.col("_v"))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(ranks, same).drop("_v", *[f"_{k}" for k in keys])
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(f"_rank_{a}", f"_rank_{b}").alias("spearman"))
    bounded = W.clip(F.col("spearman"), -0.9999, 0.9999)
    return found.withColumn("fisher_z", F.atanh(bounded))


def walk_forward(rows: DataFrame, train: int, test: int, step: int, anchored: bool = False) -> DataFrame:
    """A row per window that a row belongs to: ``symbol, date, window, role``, in days from the first date.

    A window whose test would end past the last date is left out. An anchored one trains from the
    first date on. The windows of a row follow from its offset, so none is joined with all rows.
    """
    whole = Window.partitionBy("symbol")
    first, last = F.min("date").over(whole), F.max("date").over(whole)
    placed = rows.select("symbol", "date", F.datediff("date", first).alias("_at"), F.datediff(last, first).alias("_span"))
    newest = F.floor((F.col("_span") - (train + 1 + test)) / step)
    low = F.greatest(F.ceil((F.col("_at") - (train + 1 + test)) / step), F.lit(0))
    high = newest if anchored else F.least(F.floor(F.col("_at") / step), newest)
    start = F.col("window") * step
    role = F.when(F.col("_at") <= start + train, "train").when(F.col("_at") >= start + train + 1, "test")
    return (
        placed.withColumns({"_low": low, "_high": high})
        .filter("_low <= _high")
        .withColumn("window", F.explode(F.sequence("_low", "_high")))
        .select("symbol", "date", "window", role.alias("role"))
    )
