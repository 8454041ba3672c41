"""Exact quantiles and ranks of large groups without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a group is cut into at approximate quantiles; they only tell where to look.
BUCKETS = 64


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "quantiles") -> DataFrame:
    """``keys`` and an array of the linearly interpolated quantiles of ``value`` at ``shares``; nulls are left out.

    Approximate quantiles cut each group into buckets. Counts by bucket tell in which ones the
    wanted ranks lie, and only there are the distinct values put in order, by counts. A value that a
    third of all rows have is one row by then.
    """
    cuts = [F.lit(i / BUCKETS) for i in range(1, BUCKETS)]
    valid = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = valid.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cut = counted.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*cuts), 1000).alias("_cuts"))
    placed = counted.join(cut, keys).withColumn("_b", F.size(F.filter("_cuts", lambda e: e < F.col("_v")))).drop("_cuts")
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_in"))
    totals = totals.withColumns({"_start": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_n": F.sum("_in").over(group)})
    asked = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("_i", "_share")
    spot = F.col("_share") * (F.col("_n") - 1)
    ends = F.array(
        F.struct(F.floor(spot).alias("rank"), (1 - (spot - F.floor(spot))).alias("weight")), F.struct(F.ceil(spot).alias("rank"), (spot - F.floor(spot)).alias("weight"))
    )
    own = [*keys, "_b", "_start", "_in"]
    wanted = totals.select(*own, "_n", asked).select(*own, "_i", F.explode(ends).alias("_end")).select(*own, "_i", "_end.*")
    where = wanted.filter("weight > 0 AND rank >= _start AND rank < _start + _in").drop("_in")
    inside = Window.partitionBy(*keys, "_b", "_i", "rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    looked = placed.join(where, [*keys, "_b"]).withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    found = looked.filter("rank >= _start + _before AND rank < _start + _before + _c")
    each = found.groupBy(*keys, "_i").agg(F.sum(F.col("_v") * F.col("weight")).alias("_q"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x.getField("_q")).alias(out))


def cuts_of(value: str, ranges: int = BUCKETS, sample: int = 1000) -> Column:
    """Approximate quantiles that cut a group into ranges; they only tell where to look."""
    return F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), sample)


def _range_of(value: str, cuts: str) -> Column:
    return F.size(F.filter(cuts, lambda e: e < F.col(value)))


def range_of(value: str, cuts: str, ranges: int = BUCKETS, nulls_last: bool = False) -> Column:
    """How many of the ``cuts`` of ``cuts_of`` lie below the value, by halving; ``ranges`` is a power of two. Nulls are in the first or last range."""
    steps = F.array(*[F.lit(ranges >> i) for i in range(1, ranges.bit_length())])
    below = lambda at, step: F.coalesce(F.get(cuts, at + step - 1) < F.col(value), F.lit(nulls_last))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(below(at, step), step).otherwise(0))


def computed(few: DataFrame) -> DataFrame:
    """A few rows, computed now and once: approximate cuts may differ between two runs, and all who use them need the same."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def amounts_below(counts: DataFrame, keys: list[str], value: str, amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of a key with a smaller ``value``. Each key has one row for each value.

    A key's values are cut into ranges, so only a range's rows are put in order together.
    """
    cuts = counts.groupBy(*keys).agg(cuts_of(value).alias("_cuts"))
    placed = counts.join(cuts, keys).withColumn("_range", _range_of(value, "_cuts")).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "_range").agg(F.sum(amount).alias("_in")).withColumn("_start", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return own.join(starts, [*keys, "_range"]).withColumn(out, F.col(out) + F.col("_start")).drop("_range", "_start")


def ordinal_ranks(rows: DataFrame, keys: list[str], ties: list[str], ranks: dict[str, str]) -> DataFrame:
    """Adds, for each value column of ``ranks``, its rank (from 1, equal values in the order of ``ties``) under the name given there.

    The ranges of all value columns come from one pass. A row's rank is its place within its range after the ranges' counts. Those and
    the cuts, a few rows for each key, travel to the rows.
    """
    cuts = computed(rows.groupBy(*keys).agg(*[cuts_of(value).alias(f"_cuts_{i}") for i, value in enumerate(ranks)]))
    placed = rows.join(F.broadcast(cuts), keys).withColumns({f"_range_{i}": _range_of(value, f"_cuts_{i}") for i, value in enumerate(ranks)})
    placed = placed.drop(*[f"_cuts_{i}" for i in range(len(ranks))])
    out = placed
    for i, (value, name) in enumerate(ranks.items()):
        before = Window.partitionBy(*keys).orderBy(f"_range_{i}").rowsBetween(Window.unboundedPreceding, -1)
        counts = placed.groupBy(*keys, f"_range_{i}").agg(F.count(F.lit(1)).alias("_in"))
        starts = counts.withColumn(f"_start_{i}", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
        place = F.row_number().over(Window.partitionBy(*keys, f"_range_{i}").orderBy(value, *ties))
        out = out.withColumn(name, place).join(F.broadcast(starts), [*keys, f"_range_{i}"]).withColumn(name, F.col(name) + F.col(f"_start_{i}")).drop(f"_range_{i}", f"_start_{i}")
    return out
