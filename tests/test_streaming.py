"""Streams over the event table against the batch operators and a plain loop."""

import datetime
import os
import tempfile
from pathlib import Path

import oracle
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.sources.market import ticks
from tidemark.operators.validation import drift_against, drift_baseline
from tidemark.plans import catalog, stores
from tidemark.streaming import live, stateful


def stream(spark, table):
    """The table as a stream of files in time order, one in each micro-batch (taken by file time)."""
    folder = tempfile.mkdtemp(prefix="spark-")
    table.repartitionByRange(4, "ts").write.mode("overwrite").parquet(folder)
    for number, file in enumerate(sorted(Path(folder).glob("part-*"))):
        os.utime(file, (1_700_000_000 + 60 * number,) * 2)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, found, name):
    query = found.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start().awaitTermination(120)
    return spark.table(name)


def test_stream_bars(spark):
    rows = ticks(spark, SMALL)
    got = {(r.symbol, r.bar): r[2:] for r in run(spark, live.stream_bars(stream(spark, rows), 60, "1 hour"), "streamed_bars").collect()}
    until = rows.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=2)
    want = {(r.symbol, r.bar): r[2:7] for r in bars.time_bars(rows, 60).collect() if r.bar <= until}
    assert len(want) > 100 and got == want


def test_unique_ticks(spark):
    rows = ticks(spark, SMALL)
    got = run(spark, live.unique_ticks(stream(spark, rows.union(rows)), "60 days"), "unique_ticks")
    assert got.count() == got.select("event_id").distinct().count() == rows.count()


def test_corrected_bars(spark):
    rows = ticks(spark, SMALL).select("symbol", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"), "price").groupBy("symbol", "ts").agg(F.max("price").alias("close"))
    versions = rows.withColumn("arrived", F.lit(1)).union(rows.withColumn("close", F.col("close") + 1).withColumn("arrived", F.lit(2)))
    got = {(r.symbol, r.ts): r.close for r in run(spark, live.corrected_bars(stream(spark, versions), "1 minute"), "corrected_bars").collect()}
    want = {(r.symbol, r.ts): r.close + 1 for r in rows.collect()}
    # The watermark has passed all bars but the last ones.
    assert len(got) >= len(want) - 2 and all(want[key] == close for key, close in got.items())


def test_fresh_signals(spark):
    rows = ticks(spark, SMALL)
    signals = rows.select("symbol", F.when(F.col("price") > 50, "BUY").otherwise("SELL").alias("signal"), "ts")
    streamed = stream(spark, signals).select("symbol", "signal", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    got = {(r.symbol, r.signal, r.at_us) for r in run(spark, live.fresh_signals(streamed, 7200), "fresh_signals").collect()}
    want, last = set(), {}
    for r in signals.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).orderBy("at_us").collect():
        key = (r.symbol, r.signal)
        if key not in last or r.at_us - last[key] >= 7200 * 1_000_000:
            last[key] = r.at_us
            want.add((*key, r.at_us))
    assert 0 < len(want) < rows.count() and got == want


@pytest.fixture
def state_store(spark):
    name, store = stateful.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    yield
    spark.conf.set(name, before)


ACCOUNT = "symbol string, event_id long, ts timestamp, kind string, pnl double, direction string, size double"


def account_rows():
    at = lambda day, minute: datetime.datetime(2024, 1, day, 10, minute)
    rows = [
        ("a", 1, at(1, 0), "trade", 0.01, None, None),
        ("a", 2, at(1, 1), "signal", None, "BUY", 0.2),
        ("a", 3, at(1, 2), "trade", -0.04, None, None),
        ("a", 4, at(1, 3), "signal", None, "HOLD", 0.2),
        ("a", 5, at(1, 4), "signal", None, "SELL", 0.2),
        ("a", 6, at(1, 5), "trade", 0.03, None, None),
        ("a", 7, at(1, 6), "signal", None, "BUY", 0.2),
        ("a", 8, at(3, 0), "signal", None, "BUY", 0.2),
        *[("a", 9 + i, at(3, 1 + i), "trade", -0.001, None, None) for i in range(5)],
        ("a", 14, at(3, 9), "signal", None, "BUY", 0.2),
        ("a", 15, at(4, 0), "trade", -0.2, None, None),
        ("a", 16, at(4, 1), "trade", 0.19, None, None),
        ("a", 17, at(4, 2), "trade", -0.1, None, None),
        ("a", 18, at(4, 2), "signal", None, "BUY", 0.2),
        ("a", 19, at(5, 0), "signal", None, "BUY", 0.2),
        ("b", 20, at(5, 1), "trade", -1.5, None, None),
        ("b", 21, at(5, 2), "signal", None, "BUY", 0.2),
        ("a", 22, at(8, 0), "trade", 0.0, None, None),
    ]
    return rows


def by_loop(rows):
    """The same accounts in a plain loop; days are all those before the last one of the stream."""
    out, accounts = set(), {}
    close = lambda s, k: out.add((k, "day", s["day"], None, None, None, round(s["daily"], 9), s["losses"], s["tripped"]))
    for k, event_id, ts, kind, pnl, direction, size in rows:
        s = accounts.setdefault(k, {"day": ts.date(), "daily": 0.0, "equity": 1.0, "peak": 1.0, "losses": 0, "tripped": None})
        if ts.date() > s["day"]:
            close(s, k)
            s.update(day=ts.date(), daily=0.0, tripped=None if s["tripped"] == "daily_loss" else s["tripped"])
        if kind == "trade":
            s["daily"] += pnl
            s["equity"] += pnl * s["equity"] if s["equity"] > 0 else pnl
            s["peak"] = max(s["peak"], s["equity"])
            s["losses"] = s["losses"] + 1 if pnl < 0 else 0
            continue
        if direction != "HOLD":
            if s["tripped"] is None and -s["daily"] / s["peak"] >= 0.02:
                s["tripped"] = "daily_loss"
            elif s["tripped"] is None and (s["peak"] - s["equity"]) / s["peak"] >= 0.1:
                s["tripped"] = "drawdown"
        blocked = direction != "HOLD" and s["tripped"]
        halved = direction != "HOLD" and not blocked and s["losses"] >= 5
        out.add((k, "signal", ts.date(), event_id, "HOLD" if blocked else direction, size / 2 if halved else size, round(s["daily"], 9), s["losses"], s["tripped"]))
    last = max(r[2] for r in rows)
    for k, s in accounts.items():
        if s["day"] < last.date():
            close(s, k)
    return out


def arrive(spark, rows, schema, folder, number):
    """The rows as one more file of a stream, with a time of its own."""
    before = set(Path(folder).glob("part-*"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    (new,) = set(Path(folder).glob("part-*")) - before
    os.utime(new, (1_700_000_000 + 60 * number,) * 2)


def drain(found, folder):
    writer = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination(180)


def test_circuit_breaker_goes_on_from_its_checkpoint(spark, state_store):
    rows = account_rows()
    folder = tempfile.mkdtemp(prefix="spark-")
    # Three runs of the stream over one checkpoint, each with new files and the state of the run before.
    for number, part in enumerate((rows[:6], rows[6:13], rows[13:])):
        arrive(spark, part, ACCOUNT, f"{folder}/in", number)
        source = spark.readStream.schema(ACCOUNT).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")
        drain(stateful.circuit_breaker(source), folder)
    got = spark.read.parquet(f"{folder}/out").collect()
    found = {(r.symbol, r.kind, r.day, r.event_id, r.direction, r["size"], round(r.daily_pnl, 9), r.losses, r.tripped) for r in got}
    assert len(got) == len(found) and found == by_loop(rows)
    reasons = {r.event_id: r.reason for r in got if r.kind == "signal"}
    assert reasons == {2: None, 4: None, 5: "daily_loss", 7: "daily_loss", 8: None, 14: None, 18: "daily_loss", 19: "drawdown", 21: "daily_loss"}


def test_fills_wait_across_a_restart(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    asked, filled = "order_id long, direction string, expected double, ordered_at timestamp", "order_id long, actual double, filled_at timestamp"
    folder = tempfile.mkdtemp(prefix="spark-")
    parts = [
        ([(1, "long", 10.0, at(1)), (2, "short", 10.0, at(1)), (3, "long", 0.0, at(2)), (5, "long", 10.0, at(2))], [(1, 10.1, at(2)), (1, 10.1, at(2))]),
        ([(4, "long", 10.0, at(20)), (6, "long", 1.0, at(30))], [(2, 10.5, at(3)), (3, 5.0, at(4)), (1, 10.1, at(2)), (9, 1.0, at(5)), (4, 9.0, at(29)), (8, 1.0, at(30))]),
    ]
    for number, (orders, fills) in enumerate(parts):
        arrive(spark, orders, asked, f"{folder}/orders", number)
        arrive(spark, fills, filled, f"{folder}/fills", number)
        read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}")
        drain(stateful.met_expectations(read(asked, "orders"), read(filled, "fills"), "5 days"), folder)
    got = {r.order_id: (r.direction, r.actual, r.slippage_bps, r.favorable) for r in spark.read.parquet(f"{folder}/out").collect()}
    # Order 4's fill came after nine days, order 6 may still be filled.
    assert got == {1: ("LONG", 10.1, 100.0, False), 2: ("SHORT", 10.5, 500.0, True), 3: ("LONG", 5.0, 0.0, True), 4: ("LONG", None, None, None), 5: ("LONG", None, None, None)}


def test_drift_log_is_written_once_after_a_restart(spark):
    schema = "feature string, value double, slice long"
    train = [("x", float(i), 0) for i in range(100)] + [("c", 1.0, 0)] * 5
    base = drift_baseline(spark.createDataFrame(train, schema))
    folder = tempfile.mkdtemp(prefix="spark-")
    parts = [[("x", float(i), 0) for i in range(0, 100, 2)] + [("c", 1.0, 0)], [("x", 95.0, 1)] * 30 + [("c", 2.0, 1)]]
    for number, part in enumerate(parts):
        arrive(spark, part, schema, f"{folder}/in", number)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")
        stateful.watch_drift(source, base, folder, "slice").awaitTermination(120)
    got = {(r.slice, r.feature): (r.psi, r.drifted, r.severity) for r in spark.read.parquet(f"{folder}/log").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/log").count() == 4
    assert got[0, "x"][0] < 0.05 and got[0, "c"] == (0.0, False, "none") and got[1, "x"][1] and got[1, "c"][0] == float("inf") and got[1, "c"][2] == "significant"
    again = {r.feature: r.psi for r in drift_against(base, spark.createDataFrame(parts[1], schema)).collect()}
    assert again == {f: got[1, f][0] for f in "xc"}


@pytest.mark.parametrize("name", ["streamed_fills", "streamed_bars", "streamed_circuit_breaker", "streamed_unique_ticks", "streamed_signals"])
def test_streams_in_several_batches_match_sql(spark, monkeypatch, name):
    monkeypatch.setattr(stores, "ARRIVING", 400)
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert oracle.normal(got) == oracle.normal(oracle.by_sql(catalog.ORACLES[name], SMALL))


def test_streamed_files_arrive_in_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(stores, "ARRIVING", 100)
    rows = spark.range(1000).select(F.floor(F.col("id") * 7919 % 1000 / 4).alias("at"), F.when(F.col("id") > 5, "x").alias("name"))
    stores._streamed(rows, f"{tmp_path}/in", F.col("at"))
    files = sorted(Path(f"{tmp_path}/in").glob("part-*"), key=lambda file: file.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(file)).agg(F.min("at"), F.max("at"), F.count("*")).first() for file in files]
    assert len(spans) == 10 and sum(n for _, _, n in spans) == 1000 and max(n for _, _, n in spans) < 150
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
