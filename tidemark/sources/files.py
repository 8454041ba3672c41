"""The bar store: Parquet by symbol and year with a metadata sidecar, CSV files, refresh and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes ``{path}/bars`` by symbol and year, and ``{path}/metadata`` with a JSON row per symbol.

    Rows are dealt by symbol and month, so a symbol's whole history does not pass through one task.
    """
    stored = bars.withColumn("year", F.year("ts"))
    stored.repartition("symbol", F.trunc("ts", "month")).write.mode(mode).partitionBy("symbol", "year").option("compression", "snappy").parquet(f"{path}/bars")
    found = bars.sparkSession.read.parquet(f"{path}/bars")
    coverage(found).write.mode("overwrite").json(f"{path}/metadata")


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct(F.to_date("ts")).alias("days")
    )


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Stored bars with date and minute; a ``symbol`` prunes the scan to its folders."""
    bars = spark.read.schema(f"{BAR_SCHEMA}, year int").parquet(f"{path}/bars").drop("year")
    if symbol is not None:
        bars = bars.filter(F.col("symbol") == symbol)
    return bars.withColumns({"date": F.to_date("ts"), "minute": F.hour("ts") * 60 + F.minute("ts")})


def read_csv(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def refresh(existing: DataFrame, fresh: DataFrame, lookback_days: int) -> DataFrame:
    """``existing`` with everything from a symbol's first fresh row on replaced, trimmed to the lookback.

    A symbol without fresh rows keeps all its rows; each symbol is trimmed against its own last one.
    """
    starts = fresh.groupBy("symbol").agg(F.min("ts").alias("_from"))
    kept = existing.join(starts, "symbol", "left").filter("_from IS NULL OR ts < _from").drop("_from")
    rows = kept.unionByName(fresh)
    last = rows.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return rows.join(last, "symbol").filter(F.col("ts") >= F.col("_last") - F.make_dt_interval(F.lit(lookback_days))).drop("_last")


def backfill(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of ``chunks``; of rows with one key that of the earliest chunk stays, by one aggregation."""
    numbered = [chunk.withColumn("_chunk", F.lit(i)) for i, chunk in enumerate(chunks)]
    rows = numbered[0]
    for chunk in numbered[1:]:
        rows = rows.unionByName(chunk)
    others = [c for c in chunks[0].columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct("_chunk", *others)).alias("_first")).select(*keys, *[f"_first.{c}" for c in others])


def stale(metadata: DataFrame, now: str, min_days: int, max_age_hours: int) -> DataFrame:
    """Adds ``reason`` why a symbol needs a download (``empty``, ``short`` or ``old``), null if it does not."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("last_ts")
    reason = F.when(F.coalesce("n_bars", F.lit(0)) == 0, "empty").when(F.datediff("last_ts", "first_ts") < min_days, "short").when(age > max_age_hours * 3600, "old")
    return metadata.withColumn("reason", reason)


def members_at(changes: DataFrame, dates: DataFrame) -> DataFrame:
    """``date, symbol`` of the members on each date, from spells ``symbol, joined, left`` (``left`` null: still in).

    A spell is expanded to the dates it covers, so no date is joined with all spells.
    """
    last = dates.agg(F.max("date").alias("_last"))
    days = changes.join(F.broadcast(last)).filter("joined <= least(coalesce(date_sub(left, 1), _last), _last)").select(
        "symbol", F.explode(F.sequence("joined", F.least(F.coalesce(F.date_sub("left", 1), "_last"), "_last"))).alias("date")
    )
    return days.join(dates.select("date").distinct(), "date", "left_semi").select("date", "symbol").distinct()


def latest_versions(artifacts: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` versions of each artifact (``name, version``)."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version")))
    return artifacts.withColumn("_place", place).filter(F.col("_place") <= keep).drop("_place")
