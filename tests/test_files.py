"""The bar store: round trips, refresh, backfill, freshness, membership and versions on small tables."""

import datetime as dt

import pytest

from tidemark.sources import files


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(s, dt.datetime(2023, 12, 30) + dt.timedelta(days=d), 1.0 + d, 2.0 + d, 0.5 + d, 1.5 + d, 10.0) for s in ("A", "B") for d in range(5)]
    return spark.createDataFrame(rows, files.BAR_SCHEMA)


def values(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def test_parquet_round_trip_with_metadata(spark, stored, tmp_path):
    files.write_bars(stored, str(tmp_path))
    found = files.read_bars(spark, str(tmp_path))
    assert values(found, *stored.columns) == values(stored, *stored.columns)
    assert {r["symbol"] for r in files.read_bars(spark, str(tmp_path), "B").collect()} == {"B"}
    assert values(spark.read.json(f"{tmp_path}/metadata"), "symbol", "n_bars", "days") == [("A", 5, 5), ("B", 5, 5)]


def test_one_symbol_reads_its_own_folders(spark, stored, tmp_path):
    files.write_bars(stored, str(tmp_path))
    plan = files.read_bars(spark, str(tmp_path), "B")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def test_csv_round_trip(spark, stored, tmp_path):
    files.write_csv(stored, f"{tmp_path}/csv")
    assert values(files.read_csv(spark, f"{tmp_path}/csv"), *stored.columns) == values(stored, *stored.columns)


def test_refresh_replaces_the_overlap(stored):
    fresh = stored.filter("symbol = 'A' AND ts >= '2024-01-01'").withColumn("volume", stored["volume"] * 2)
    found = files.refresh(stored, fresh, 3)
    assert [v for s, _, v in values(found, "symbol", "ts", "volume") if s == "A"] == [10.0, 20.0, 20.0, 20.0]
    assert [v for s, _, v in values(found, "symbol", "ts", "volume") if s == "B"] == [10.0] * 4
    assert files.refresh(stored.limit(0), fresh.limit(0), 3).count() == 0


def test_backfill_keeps_the_earliest_chunk(stored):
    later = stored.withColumn("volume", stored["volume"] * 3)
    found = files.backfill([stored.filter("symbol = 'A'"), later], ["symbol", "ts"])
    assert {(s, v) for s, v in values(found, "symbol", "volume")} == {("A", 10.0), ("B", 30.0)} and found.count() == 10


def test_stale_reasons(spark):
    day = dt.datetime(2024, 1, 10)
    rows = [("new", 5, day - dt.timedelta(days=9), day), ("old", 5, day - dt.timedelta(days=20), day - dt.timedelta(days=9)), ("short", 5, day, day), ("none", 0, None, None)]
    metadata = spark.createDataFrame(rows, "symbol string, n_bars long, first_ts timestamp, last_ts timestamp")
    assert values(files.stale(metadata, "2024-01-10 01:00:00", 5, 24).na.fill("", ["reason"]), "symbol", "reason") == [
        ("new", ""), ("none", "empty"), ("old", "old"), ("short", "short")
    ]


def test_members_at(spark):
    day = dt.date(2024, 1, 1)
    days = [day + dt.timedelta(days=i) for i in range(6)]
    changes = spark.createDataFrame([("A", days[0], days[3]), ("A", days[5], None), ("B", days[2], None)], "symbol string, joined date, left date")
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    found = {d: [s for x, s in values(files.members_at(changes, dates), "date", "symbol") if x == d] for d in days}
    assert [found[d] for d in days] == [["A"], ["A"], ["A", "B"], ["B"], ["B"], ["A", "B"]]


def test_latest_versions(spark):
    rows = spark.createDataFrame([("m", i) for i in range(5)] + [("n", 7)], "name string, version int")
    assert values(files.latest_versions(rows, 2), "name", "version") == [("m", 3), ("m", 4), ("n", 7)]
