"""Queries that go through files and streams: the bar store, CSV, membership, freshness, and streams run to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.validation import drift_baseline
from tidemark.plans.catalog import DAILY, query, rounded
from tidemark.plans.validation import FEATURES, features
from tidemark.sources import files
from tidemark.sources.market import daily_orders, table
from tidemark.streaming import live, stateful


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_orders(spark, sf_dir).select("symbol", F.col("date").cast("timestamp").alias("ts"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))


@query(f"WITH {DAILY} SELECT symbol, date, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM daily WHERE symbol = '1-URGENT'")
def bar_store(spark, sf_dir):
    """Bars written by symbol and year and one symbol read back; the scan reads that symbol's folders alone."""
    path = folder(spark, "bar-store")
    files.write_bars(stored_bars(spark, sf_dir), path)
    return files.read_bars(spark, path, "1-URGENT").select("symbol", "date", "open", "high", "low", "close", "volume")


@query(f"WITH {DAILY} SELECT symbol, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days FROM daily GROUP BY 1")
def bar_store_metadata(spark, sf_dir):
    path = folder(spark, "bar-store")
    files.write_bars(stored_bars(spark, sf_dir), path)
    found = spark.read.schema("symbol string, n_bars long, first_ts timestamp, last_ts timestamp, days long").json(f"{path}/metadata")
    return found.select("symbol", "n_bars", F.to_date("first_ts").alias("first_date"), F.to_date("last_ts").alias("last_date"), "days")


@query(f"WITH {DAILY} SELECT symbol, date, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM daily")
def csv_roundtrip(spark, sf_dir):
    path = folder(spark, "csv")
    files.write_csv(stored_bars(spark, sf_dir), path)
    return files.read_csv(spark, path).withColumn("date", F.to_date("ts")).select("symbol", "date", "open", "high", "low", "close", "volume")


@query(f"""
WITH {DAILY}, known AS (SELECT symbol, count(*) AS n, min(date) AS a, max(date) AS b FROM daily WHERE symbol <> '5-LOW' GROUP BY 1
  UNION ALL SELECT '5-LOW', 0, NULL, NULL UNION ALL SELECT 'brief', 1, DATE '2001-01-01', DATE '2001-01-02')
SELECT symbol, CASE WHEN n = 0 THEN 'empty' WHEN b - a < 365 THEN 'short' WHEN date_diff('second', CAST(b AS TIMESTAMP), TIMESTAMP '2030-01-01 00:00:00') > 24 * 3600 THEN 'old' END AS reason FROM known""")
def stale_symbols(spark, sf_dir):
    known = files.coverage(stored_bars(spark, sf_dir).filter("symbol != '5-LOW'"))
    more = spark.sql("SELECT '5-LOW' AS symbol, 0L AS n_bars, CAST(NULL AS timestamp) AS first_ts, CAST(NULL AS timestamp) AS last_ts, 0L AS days UNION ALL SELECT 'brief', 1L, TIMESTAMP '2001-01-01', TIMESTAMP '2001-01-02', 1L")
    return files.stale(known.unionByName(more), "2030-01-01 00:00:00", 365, 24).select("symbol", "reason")


@query("""
WITH spells AS (
  SELECT c_custkey AS symbol, DATE '1995-01-01' + CAST(c_custkey % 500 AS INTEGER) AS joined,
         CASE WHEN c_custkey % 3 > 0 THEN DATE '1995-01-01' + CAST(c_custkey % 500 + 30 + c_custkey % 90 AS INTEGER) END AS gone FROM customer),
dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE day(o_orderdate) = 15 AND year(o_orderdate) = 1995)
SELECT d.date, s.symbol FROM dates d JOIN spells s ON s.joined <= d.date AND (s.gone IS NULL OR s.gone > d.date)""")
def members_on_dates(spark, sf_dir):
    key = F.col("c_custkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (key % 500).cast("int"))
    spells = table(spark, sf_dir, "customer").select(
        key.alias("symbol"), start.alias("joined"), F.when(key % 3 > 0, F.date_add(start, (30 + key % 90).cast("int"))).alias("left")
    )
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).filter((F.day("date") == 15) & (F.year("date") == 1995)).distinct()
    return files.members_at(spells, dates)


#: Rows of one micro-batch of a streamed table, about.
ARRIVING = 1_000_000
#: Parts that a streamed table is cut into at most.
MOST_PARTS = 1000


def _cuts(rows: DataFrame, order: Column) -> list[int]:
    """Values of ``order`` (a long) between parts of about ``ARRIVING`` rows, from one pass."""
    shares = F.array(*[F.lit(i / MOST_PARTS) for i in range(1, MOST_PARTS)])
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(order, shares, 10_000).alias("at")).first()
    parts = min(MOST_PARTS, -(-found.n // ARRIVING))
    return sorted({found.at[i * MOST_PARTS // parts - 1] for i in range(1, parts)}) if found.at else []


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _streamed(rows: DataFrame, path: str, order: Column, cuts: list[int] | None = None) -> DataFrame:
    """The rows as a stream of files that arrive in the order of ``order`` (a long), one in each micro-batch.

    Files hold about ``ARRIVING`` rows, or what lies between ``cuts``; equal values share a file, so a watermark over them
    finds no row late and lets go of state as it advances. A stream takes files by the times they were written at.
    """
    spark = rows.sparkSession
    cuts = _cuts(rows, order) if cuts is None else cuts
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < order))
        rows.withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(f"{path}-parts")
        parts = spark.read.schema(f"{_ddl(rows)}, _part int").parquet(f"{path}-parts")
        for number in range(len(cuts) + 1):
            parts.filter(F.col("_part") == number).drop("_part").coalesce(1).write.mode("append").parquet(path)
    else:
        rows.repartition(1).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema)


def _finished(found: DataFrame, path: str) -> DataFrame:
    """What the stream has emitted once it has read all there is."""
    writer = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{path}/out")


def _events(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"))
    return rows.select(*(columns or rows.columns))


@query("""
WITH bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS bar, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS trade_count
  FROM events GROUP BY 1, 2)
SELECT * FROM bars WHERE bar + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def streamed_bars(spark, sf_dir):
    """The bars that the watermark has closed at the end of the stream."""
    path = folder(spark, "streamed-bars")
    found = _finished(live.stream_bars(_streamed(_events(spark, sf_dir), f"{path}/in", _micros("ts")), 60, "1 hour"), path)
    return found.withColumn("bar", F.col("bar").cast("timestamp_ntz"))


@query("SELECT event_id, event_type AS symbol, value AS price FROM events")
def streamed_unique_ticks(spark, sf_dir):
    path = folder(spark, "streamed-ticks")
    rows = _events(spark, sf_dir)
    return _finished(live.unique_ticks(_streamed(rows.union(rows), f"{path}/in", _micros("ts")), "60 days"), path).select("event_id", "symbol", "price")


@query("""
WITH minutes AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, max(value) AS close FROM events GROUP BY 1, 2)
SELECT symbol, ts, close + 1 AS close FROM minutes WHERE ts <= (SELECT max(ts) FROM minutes) - INTERVAL 1 DAY""")
def streamed_corrections(spark, sf_dir):
    """Each bar twice, the later version a correction, which overrides."""
    path = folder(spark, "streamed-corrections")
    bars = _events(spark, sf_dir).groupBy("symbol", F.date_trunc("minute", "ts").alias("ts")).agg(F.max("price").alias("close"))
    versions = bars.withColumn("arrived", F.lit(1)).union(bars.withColumn("close", F.col("close") + 1).withColumn("arrived", F.lit(2)))
    found = _finished(live.corrected_bars(_streamed(versions, f"{path}/in", _micros("ts")), "1 day"), path)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
WITH RECURSIVE signals AS (
  SELECT event_type AS symbol, CASE WHEN value > 50 THEN 'BUY' ELSE 'SELL' END AS signal, epoch_us(ts) AS at_us FROM events),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, signal ORDER BY at_us) AS n FROM signals),
kept AS (
  SELECT symbol, signal, n, at_us, at_us AS last, true AS keep FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.symbol, x.signal, x.n, x.at_us, CASE WHEN x.at_us - k.last >= 7200000000 THEN x.at_us ELSE k.last END, x.at_us - k.last >= 7200000000
  FROM kept k JOIN numbered x ON x.symbol = k.symbol AND x.signal = k.signal AND x.n = k.n + 1)
SELECT symbol, signal, at_us FROM kept WHERE keep""")
def streamed_signals(spark, sf_dir):
    path = folder(spark, "streamed-signals")
    signal = F.when(F.col("price") > 50, "BUY").otherwise("SELL").alias("signal")
    rows = _events(spark, sf_dir, "symbol", signal, F.unix_micros("ts").alias("at_us"))
    return _finished(live.fresh_signals(_streamed(rows, f"{path}/in", F.col("at_us")), 7200), path)


@query("""
WITH numbered AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place FROM events)
SELECT event_type AS symbol, event_id, value AS price FROM numbered WHERE place <= 100""")
def prediction_log(spark, sf_dir):
    """The last hundred predictions of each symbol, as a bounded log keeps them."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("event_id")))
    return _events(spark, sf_dir).withColumn("place", place).filter("place <= 100").select("symbol", "event_id", "price")


def _in_state_store(spark: SparkSession, run):
    """``run()`` with the state store that typed state needs; the setting before is put back."""
    name, store = stateful.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth event is a signal, the others are trades of the account."""
    price = F.col("price")
    kind = F.when(F.col("event_id") % 4 == 0, "signal").otherwise("trade").alias("kind")
    direction = F.when(price > 50, "BUY").when(price > 25, "SELL").otherwise("HOLD").alias("direction")
    return _events(spark, sf_dir, "symbol", "event_id", "ts", kind, ((price - 50) / 20000).alias("pnl"), direction, F.lit(0.1).alias("size"))


@query("""
WITH RECURSIVE events_of AS (
  SELECT event_type AS symbol, event_id, ts, CAST(ts AS DATE) AS day, event_id % 4 = 0 AS asks, (value - 50) / 20000 AS pnl,
         CASE WHEN value > 50 THEN 'BUY' WHEN value > 25 THEN 'SELL' ELSE 'HOLD' END AS direction,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
run AS (
  SELECT symbol, 0::BIGINT AS n, NULL::DATE AS day, 0::DOUBLE AS daily, 1::DOUBLE AS equity, 1::DOUBLE AS peak, 0::BIGINT AS losses, NULL::VARCHAR AS tripped FROM events_of WHERE n = 1
  UNION ALL
  SELECT symbol, n, day, daily, equity, greatest(peak, equity), losses,
         CASE WHEN NOT asks OR direction = 'HOLD' OR was IS NOT NULL THEN was WHEN -daily / peak >= 0.02 THEN 'daily_loss' WHEN (peak - equity) / peak >= 0.2 THEN 'drawdown' END
  FROM (SELECT e.symbol, e.n, e.day, e.asks, e.direction, r.peak,
               CASE WHEN r.day IS NULL OR e.day > r.day THEN 0 ELSE r.daily END + CASE WHEN e.asks THEN 0 ELSE e.pnl END AS daily,
               CASE WHEN e.asks THEN r.equity ELSE r.equity + e.pnl * r.equity END AS equity,
               CASE WHEN e.asks THEN r.losses WHEN e.pnl < 0 THEN r.losses + 1 ELSE 0 END AS losses,
               CASE WHEN e.day > r.day AND r.tripped = 'daily_loss' THEN NULL ELSE r.tripped END AS was
        FROM run r JOIN events_of e ON e.symbol = r.symbol AND e.n = r.n + 1)),
told AS (
  SELECT e.symbol, 'signal' AS kind, e.day, e.event_id, CASE WHEN e.direction <> 'HOLD' AND tripped IS NOT NULL THEN 'HOLD' ELSE e.direction END AS direction,
         CASE WHEN e.direction <> 'HOLD' AND tripped IS NULL AND losses >= 5 THEN 0.05 ELSE 0.1 END AS size, CASE WHEN e.direction <> 'HOLD' THEN tripped END AS reason,
         daily, equity, peak, losses, tripped FROM run r JOIN events_of e ON e.symbol = r.symbol AND e.n = r.n WHERE asks
  UNION ALL
  SELECT symbol, 'day', day, NULL, NULL, NULL, NULL, daily, equity, peak, losses, tripped FROM run WHERE n > 0
  QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY n DESC) = 1 AND (lead(day) OVER (PARTITION BY symbol ORDER BY n) > day
    OR CAST(day + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR))
SELECT symbol, kind, day, coalesce(event_id, -1) AS event_id, direction, coalesce(size, -1) AS size, reason, round(daily, 10) AS daily_pnl, round((peak - equity) / peak, 10) AS drawdown, losses, tripped FROM told""")
def streamed_circuit_breaker(spark, sf_dir):
    path = folder(spark, "streamed-breaker")
    found = stateful.circuit_breaker(_streamed(account_events(spark, sf_dir), f"{path}/in", _micros("ts")), drawdown=0.2)
    told = _in_state_store(spark, lambda: _finished(found, path))
    return rounded(told.fillna(-1, ["event_id", "size"]), 10, "daily_pnl", "drawdown")


@query("""
WITH fills AS (SELECT l_orderkey AS order_id, arg_min(l_extendedprice, (l_shipdate, l_extendedprice)) AS actual, min(l_shipdate) AS filled_at FROM lineitem GROUP BY 1),
expected AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN 'LONG' ELSE 'SHORT' END AS direction, o_totalprice / 10 AS expected, o_orderdate AS ordered_at FROM orders),
met AS (SELECT e.*, f.actual, f.filled_at FROM expected e LEFT JOIN fills f ON f.order_id = e.order_id AND f.filled_at BETWEEN e.ordered_at AND e.ordered_at + INTERVAL 732 HOUR),
slips AS (SELECT *, CASE WHEN actual IS NULL THEN NULL WHEN expected = 0 THEN 0 ELSE (actual - expected) / expected * 10000 END AS slip FROM met)
SELECT order_id, direction, expected, actual, round(slip, 2) AS slippage_bps, coalesce(CASE WHEN direction = 'LONG' THEN slip <= 0 ELSE slip >= 0 END, false) AS favorable, ordered_at, filled_at
FROM slips WHERE actual IS NOT NULL OR ordered_at + INTERVAL 732 HOUR < least((SELECT max(o_orderdate) FROM orders), (SELECT max(filled_at) FROM fills)) - INTERVAL 1 DAY""")
def streamed_fills(spark, sf_dir):
    """Orders and their first fills as two streams; an order without a fill within 30 days and a half is told once the watermark has passed."""
    path = folder(spark, "streamed-fills")
    expected = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "long").otherwise("short").alias("direction"), (F.col("o_totalprice") / 10).alias("expected"), F.col("o_orderdate").alias("ordered_at")
    )
    fills = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min_by("l_extendedprice", F.struct("l_shipdate", "l_extendedprice")).alias("actual"), F.min("l_shipdate").alias("filled_at")
    )
    twice = fills.withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_again")
    # Both streams are cut at the same times, so that neither holds the other's watermark back.
    cuts = _cuts(expected, _micros("ordered_at"))
    asked = _streamed(expected, f"{path}/expected", _micros("ordered_at"), cuts)
    filled = _streamed(twice, f"{path}/fills", _micros("filled_at"), cuts)
    found = stateful.met_expectations(asked, filled, "732 hours")
    out = _finished(found, path).fillna(False, ["favorable"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ordered_at", "filled_at")})


@query(f"""
WITH {FEATURES}, plain AS (SELECT feature, half, l_orderkey % 3 AS slice, round(value, 9) AS value FROM features),
edges AS (
  SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda e: round(e, 9)))) AS edges
  FROM plain WHERE half = 0 GROUP BY 1),
placed AS (
  SELECT p.feature, half, slice, CASE WHEN value >= edges[1] AND value <= edges[-1] THEN greatest(least(len(list_filter(edges, lambda e: e <= value)), len(edges) - 1), 1) END AS bin
  FROM plain p JOIN edges USING (feature)),
slices AS (SELECT DISTINCT slice FROM plain WHERE half = 1),
grid AS (SELECT feature, slice, unnest(range(1, len(edges))) AS bin FROM edges CROSS JOIN slices),
e AS (SELECT feature, bin, count(*) AS n FROM placed WHERE half = 0 GROUP BY 1, 2),
a AS (SELECT feature, slice, bin, count(*) AS n FROM placed WHERE half = 1 GROUP BY 1, 2, 3),
shares AS (
  SELECT feature, slice, greatest(coalesce(e.n, 0) / sum(coalesce(e.n, 0)) OVER w, 1e-6) AS e, greatest(coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER w, 1e-6) AS a
  FROM grid LEFT JOIN e USING (feature, bin) LEFT JOIN a USING (feature, slice, bin) WINDOW w AS (PARTITION BY feature, slice)),
psi AS (SELECT feature, slice, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY 1, 2),
judged AS (SELECT *, psi > 0.2 AS drifted, avg(CASE WHEN psi > 0.2 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY slice) AS drift_fraction FROM psi)
SELECT slice, feature, round(psi, 6) AS psi, drifted, drift_fraction, CASE WHEN drift_fraction > 0.2 THEN 'significant' WHEN drift_fraction > 0.1 THEN 'moderate' ELSE 'none' END AS severity
FROM judged""")
def streamed_drift(spark, sf_dir):
    """Three micro-batches of live rows, each judged as it arrives against a baseline that is computed once."""
    path = folder(spark, "streamed-drift")
    rows = features(spark, sf_dir).select("feature", "half", "value", (F.col("l_orderkey") % 3).alias("slice"))
    drift_baseline(rows.filter("half = 0")).write.parquet(f"{path}/baseline")
    live_rows = rows.filter("half = 1").select("feature", "value", "slice")
    for slice_ in range(3):
        live_rows.filter(F.col("slice") == slice_).write.mode("append").parquet(f"{path}/in")
        # The stream goes on from its checkpoint; all files that are new to it are one micro-batch.
        stream = spark.readStream.schema(live_rows.schema).parquet(f"{path}/in")
        stateful.watch_drift(stream, spark.read.parquet(f"{path}/baseline"), path, "slice").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/log").drop("batch"), 6, "psi")
