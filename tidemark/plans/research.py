"""Queries of the risk, calendar, information-bar and imputation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import align, bars, calendar, risk
from tidemark.plans.catalog import DAILY, RETURNS, frame, query, returns, rounded
from tidemark.sources.market import daily_orders, table, ticks


@query(f"""
WITH {RETURNS}, past AS (
  SELECT symbol, date, list(ret) FILTER (ret IS NOT NULL) OVER w AS r, quantile_cont(ret, 0.05) OVER w AS cut, count(*) OVER w AS n FROM returns
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT symbol, date, round(CASE WHEN n >= 60 AND len(r) >= 2 THEN abs(list_avg(list_filter(r, lambda x: x <= cut))) END, 6) AS cvar FROM past""")
def rolling_cvar(spark, sf_dir):
    return rounded(risk.rolling_cvar(returns(spark, sf_dir)), 6, "cvar").select("symbol", "date", "cvar")


@query(f"""
WITH {RETURNS}, pairs AS (
  SELECT symbol, date, list(ret) OVER {frame(20)} AS a,
         list(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) AS b
  FROM returns WHERE ret IS NOT NULL)
SELECT symbol, date, round(CASE WHEN len(b) = 20 THEN
  list_avg(list_transform(list_zip(list_sort(a), list_sort(b)), lambda p: abs(p[1] - p[2]))) END, 6) AS distance FROM pairs""")
def window_distance(spark, sf_dir):
    return rounded(risk.window_distance(returns(spark, sf_dir)), 6, "distance").select("symbol", "date", "distance")


def _regime_sql() -> str:
    """Every distance as the area between two distribution functions."""
    by = "PARTITION BY symbol ORDER BY date"
    parts, found = [], []
    for n in (20, 60):
        frames = {"a": f"({by} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", "b": f"({by} ROWS BETWEEN {2 * n} PRECEDING AND {n + 1} PRECEDING)"}
        parts += [f"list(ret) FILTER (ret IS NOT NULL) OVER {w} AS {c}{n}, avg(ret) OVER {w} AS m{c}{n}, stddev_samp(ret) OVER {w} AS s{c}{n}" for c, w in frames.items()]
        share = lambda c, n=n: f"len(list_filter({c}{n}, lambda x: x <= z)) / len({c}{n})"
        points = f"list_sort(list_concat(a{n}, b{n}))"
        area = f"list_sum(list_transform({points}, lambda z, i: coalesce(abs({share('a')} - {share('b')}) * ({points}[i + 1] - z), 0)))"
        found.append(f"CASE WHEN n > {2 * n} AND len(a{n}) >= 2 AND len(b{n}) >= 2 THEN {area} END AS d{n}")
    return f"""
WITH {RETURNS}, parts AS (SELECT symbol, date, row_number() OVER ({by}) AS n, {", ".join(parts)} FROM returns),
found AS (SELECT symbol, date, n, {", ".join(found)}, CASE WHEN n > 40 THEN ma20 - mb20 END AS mean_shift, CASE WHEN n > 40 THEN sa20 - sb20 END AS vol_shift FROM parts),
scored AS (
  SELECT *, CASE WHEN d20 IS NOT NULL AND count(d20) OVER w >= 10 THEN CASE WHEN stddev_samp(d20) OVER w < 1e-12 THEN 0 ELSE (d20 - avg(d20) OVER w) / stddev_samp(d20) OVER w END END AS z
  FROM found WINDOW w AS ({by} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))
SELECT symbol, date, round(d20, 6) AS wreg_distance_20d, round(d60, 6) AS wreg_distance_60d, round(z, 6) + 0.0 AS wreg_distance_z, CAST(z > 2 AS DOUBLE) AS wreg_regime_change,
       CASE WHEN z IS NOT NULL THEN CAST(n - max(CASE WHEN z > 2 THEN n END) OVER ({by} ROWS UNBOUNDED PRECEDING) AS DOUBLE) END AS wreg_regime_duration,
       round(1 / (1 + d20), 6) AS wreg_stability, round(mean_shift, 6) + 0.0 AS wreg_mean_shift, round(vol_shift, 6) + 0.0 AS wreg_vol_shift
FROM scored"""


@query(_regime_sql())
def wasserstein_regime_features(spark, sf_dir):
    found = rounded(risk.wasserstein_regime(returns(spark, sf_dir)), 6, *risk.WASSERSTEIN)
    return found.withColumns({c: F.col(c) + F.lit(0.0) for c in risk.WASSERSTEIN})


@query(f"""
WITH {DAILY}, parts AS (SELECT *, pow(ln(high / low), 2) AS span, pow(ln(close / open), 2) AS body FROM daily),
rolled AS (
  SELECT *, count(*) OVER w AS n, avg(span) OVER w AS p, avg(0.5 * span - (2 * ln(2) - 1) * body) OVER w AS g
  FROM parts WINDOW w AS {frame(20)})
SELECT symbol, date, round(CASE WHEN n >= 20 THEN sqrt(p / (4 * ln(2))) END, 6) AS parkinson,
       round(CASE WHEN n >= 20 THEN sqrt(greatest(g, 0)) END, 6) AS garman_klass FROM rolled""")
def range_volatility(spark, sf_dir):
    found = risk.range_volatility(daily_orders(spark, sf_dir))
    return rounded(found, 6, "parkinson", "garman_klass").select("symbol", "date", "parkinson", "garman_klass")


@query(f"""
WITH {DAILY}, past AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY date) AS path FROM daily), means AS (
  SELECT *, list_reduce(path, lambda a, x: a + (x - a) * 2 / 13.0::DOUBLE) AS fast, list_reduce(path, lambda a, x: a + (x - a) * 2 / 27.0::DOUBLE) AS slow,
         list_reduce(path, lambda a, x: a + (x - a) * 2 / 201.0::DOUBLE) AS slowest
  FROM past)
SELECT symbol, date, round(fast, 3) AS ema12, round(slow, 3) AS ema26, round(slowest, 3) AS ema200, round(fast - slow, 3) AS macd FROM means""")
def exponential_means(spark, sf_dir):
    rows = W.exponential(daily_orders(spark, sf_dir).select("symbol", "date", "close"), "close", {f"ema{n}": n for n in (12, 26, 200)})
    rows = rows.withColumn("macd", F.col("ema12") - F.col("ema26")).drop("close")
    return rounded(rows, 3, "ema12", "ema26", "ema200", "macd")


@query(f"""
WITH {DAILY}, first AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS m FROM daily),
fridays AS (
  SELECT *, m + CAST((12 - isodow(m)) % 7 AS INTEGER) AS f,
         CAST(m + INTERVAL 1 MONTH AS DATE) + CAST((12 - isodow(m + INTERVAL 1 MONTH)) % 7 AS INTEGER) AS g FROM first)
SELECT symbol, date, isodow(date) - 1 AS weekday, date = f + 14 AS is_expiry,
       date_diff('day', date, CASE WHEN f > date THEN f ELSE g END) AS days_to_payrolls,
       date_diff('day', date, last_day(date)) AS days_to_month_end FROM fridays""")
def calendar_features(spark, sf_dir):
    return calendar.calendar_features(daily_orders(spark, sf_dir).select("symbol", "date"))


@query("""
WITH numbered AS (
  SELECT event_type AS symbol, ts, event_id, value AS price,
         (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 50 AS bar FROM events)
SELECT symbol, bar, min(ts) AS began, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
       count(*) AS trade_count FROM numbered GROUP BY 1, 2""")
def tick_bars(spark, sf_dir):
    return bars.tick_bars(ticks(spark, sf_dir), 50)


@query(f"""
WITH {DAILY}, sparse AS (
  SELECT symbol, date, epoch(date) / 86400 AS d, CASE WHEN volume >= 2 THEN close END AS level FROM daily),
near AS (
  SELECT *, last_value(level IGNORE NULLS) OVER past AS a, last_value(CASE WHEN level IS NOT NULL THEN d END IGNORE NULLS) OVER past AS at_a,
         first_value(level IGNORE NULLS) OVER rest AS b, first_value(CASE WHEN level IS NOT NULL THEN d END IGNORE NULLS) OVER rest AS at_b
  FROM sparse WINDOW past AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     rest AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, date, round(CASE WHEN at_a = at_b THEN a ELSE a + (b - a) * (d - at_a) / (at_b - at_a) END, 3) AS level FROM near""")
def interpolated_series(spark, sf_dir):
    daily = daily_orders(spark, sf_dir).select("symbol", "date", F.when(F.col("volume") >= 2, F.col("close")).alias("level"))
    return rounded(align.interpolate(daily, ["symbol"], "date", "level"), 3, "level")


@query("""
WITH a AS (SELECT c_nationkey AS symbol, count(*) AS qty FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS symbol, count(*) * 15 AS qty FROM supplier GROUP BY 1)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.qty, 0) AS internal_qty, coalesce(b.qty, 0) AS broker_qty,
       CASE WHEN b.symbol IS NULL THEN 'internal_only' WHEN a.symbol IS NULL THEN 'broker_only'
            WHEN a.qty <> b.qty THEN 'mismatch' ELSE 'match' END AS status
FROM a FULL JOIN b ON a.symbol = b.symbol""")
def reconciliation(spark, sf_dir):
    ours = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("symbol")).agg(F.count(F.lit(1)).alias("qty"))
    theirs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("symbol")).agg((F.count(F.lit(1)) * 15).alias("qty"))
    return align.reconcile(ours, theirs)


@query("""
WITH local AS (SELECT event_id, (ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local_ts FROM events)
SELECT event_id, local_ts, CAST(local_ts AS DATE) AS date, strftime(local_ts, '%H:%M:%S') AS time, hour(local_ts) AS hour, minute(local_ts) AS minute FROM local""")
def local_times(spark, sf_dir):
    found = bars.local_parts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "America/New_York")
    return found.drop("ts").withColumns({c: F.col(c).cast("long") for c in ("hour", "minute")})
