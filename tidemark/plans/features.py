"""Queries of feature families, folds with a reset, splits and sizing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import bars, features, folds, labels, monitoring, splits, strategy, synthetic
from tidemark.operators.calendar import MEETINGS
from tidemark.plans.catalog import DAILY, RETURNS, frame, query, returns, rounded
from tidemark.sources import files
from tidemark.sources.market import daily_orders, table, ticks

CUSUM = 2.0


@query(f"""
WITH {DAILY}, shares AS (
  SELECT *, (close - low) / greatest(high - low, 1e-10) AS buy, (high - close) / greatest(high - low, 1e-10) AS sell FROM daily),
flow AS (SELECT *, (volume * buy - volume * sell) / greatest(volume * buy + volume * sell, 1e-10) AS x FROM shares),
rolled AS (
  SELECT *, sum(x) OVER {frame(5)} AS s5, sum(x) OVER w20 AS s20, count(x) OVER w20 AS n20, count(x) OVER w60 AS n60,
         least(greatest((x - avg(x) OVER w20) / (stddev_samp(x) OVER w20 + 1e-10), -4), 4) AS a20,
         least(greatest((x - avg(x) OVER w60) / (stddev_samp(x) OVER w60 + 1e-10), -4), 4) AS a60
  FROM flow WINDOW w20 AS {frame(20)}, w60 AS {frame(60)})
SELECT symbol, date, round(x, 6) AS imbalance, round(s5, 6) AS flow_5, round(CASE WHEN n20 >= 5 THEN s20 ELSE 0 END, 6) AS flow_20,
       round(CASE WHEN n20 >= 5 THEN a20 ELSE 0 END, 4) AS z20, round(CASE WHEN n60 >= 10 THEN a60 ELSE 0 END, 4) AS z60,
       CASE WHEN n60 < 10 THEN 0 WHEN a60 > 1 THEN 1 WHEN a60 < -1 THEN -1 ELSE 0 END AS regime FROM rolled""")
def order_flow(spark, sf_dir):
    found = features.order_flow(daily_orders(spark, sf_dir))
    return rounded(rounded(found, 6, "imbalance", "flow_5", "flow_20"), 4, "z20", "z60").select(
        "symbol", "date", "imbalance", "flow_5", "flow_20", "z20", "z60", "regime"
    )


@query(f"""
WITH {DAILY}, parts AS (
  SELECT symbol, date, month(date) AS m, day(date) AS d, isodow(date) - 1 AS w, CAST(date_trunc('month', date) AS DATE) AS first
  FROM (SELECT symbol, CAST(date + INTERVAL 24 YEAR AS DATE) AS date FROM daily))
SELECT symbol, date, d <= 3 OR d >= 27 AS turn_of_month, m = 1 AS january,
       list_contains([{", ".join(f"DATE '{d}'" for d in MEETINGS)}], date) OR list_contains([{", ".join(f"DATE '{d}'" for d in MEETINGS)}], date + 1) AS before_meeting,
       (m = 7 AND d IN (2, 3)) OR (m = 11 AND d >= 22 AND w = 2) OR (m = 12 AND d IN (23, 24, 30, 31)) OR (m = 1 AND d = 1)
         OR (m = 5 AND d >= 25 AND w = 4) AS before_holiday,
       (m = 12 AND d >= 25) OR (m = 1 AND d <= 2) AS santa_claus,
       m IN (3, 6, 9, 12) AND date = first + CAST((12 - isodow(first)) % 7 AS INTEGER) + 14 AS quad_witching,
       m BETWEEN 5 AND 10 AS summer, least(w, 4) AS weekday FROM parts""")
def seasonality(spark, sf_dir):
    days = daily_orders(spark, sf_dir).select("symbol", F.to_date(F.add_months("date", 24 * 12)).alias("date"))
    return features.seasonality(days)


@query(f"""
WITH {RETURNS}, seen AS (
  SELECT symbol, date, list(ret) OVER {frame(20)} AS a, list(ret) OVER {frame(60)} AS b FROM returns WHERE ret IS NOT NULL),
centred AS (
  SELECT symbol, date, len(a) AS na, len(b) AS nb, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM seen),
powers AS (
  SELECT *, list_avg(list_transform(a, lambda x: x * x)) AS a2, list_avg(list_transform(a, lambda x: pow(x, 3))) AS a3,
         list_avg(list_transform(a, lambda x: pow(x, 4))) AS a4, list_avg(list_transform(b, lambda x: x * x)) AS b2,
         list_avg(list_transform(b, lambda x: pow(x, 3))) AS b3 FROM centred)
SELECT symbol, date, round(CASE WHEN na = 20 THEN a3 / pow(a2, 1.5) ELSE 0 END, 4) AS skew20,
       round(CASE WHEN nb = 60 THEN b3 / pow(b2, 1.5) ELSE 0 END, 4) AS skew60,
       round(CASE WHEN na = 20 THEN a4 / (a2 * a2) - 3 ELSE 0 END, 4) AS kurtosis20 FROM powers""")
def return_moments(spark, sf_dir):
    found = features.moments(returns(spark, sf_dir).filter("ret IS NOT NULL"))
    return rounded(found, 4, "skew20", "skew60", "kurtosis20").select("symbol", "date", "skew20", "skew60", "kurtosis20")


@query(f"""
WITH {DAILY}, ranged AS (SELECT *, (high - low) / close AS x FROM daily),
marked AS (
  SELECT *, CASE WHEN count(*) OVER w7 >= 7 AND x = min(x) OVER w7 THEN 1.0 ELSE 0.0 END AS narrow, list(x) OVER {frame(60)} AS seen
  FROM ranged WINDOW w7 AS {frame(7)})
SELECT symbol, date, round(CASE WHEN len(seen) >= 30 THEN
    (len(list_filter(seen, lambda v: v < x)) + (len(list_filter(seen, lambda v: v = x)) + 1) / 2.0) / len(seen) END, 6) AS range_percentile,
  CASE WHEN count(*) OVER w21 >= 10 THEN CAST(sum(narrow) OVER w21 AS DOUBLE) END AS narrow_count
FROM marked WINDOW w21 AS {frame(21)}""")
def range_structure(spark, sf_dir):
    return rounded(features.range_structure(daily_orders(spark, sf_dir)), 6, "range_percentile").select("symbol", "date", "range_percentile", "narrow_count")


@query(f"""
WITH {RETURNS}, days AS (
  SELECT date, list_sort(list(ret)) AS low, coalesce(stddev_samp(ret), 0) AS s
  FROM returns WHERE ret IS NOT NULL GROUP BY 1)
SELECT date, round(list_avg(low[-3:]), 6) AS leaders, round(list_avg(low[1:3]), 6) AS laggards, round(s, 6) AS dispersion,
       round(list_avg(low[-3:]) - list_avg(low[1:3]), 6) AS spread FROM days""")
def rotation(spark, sf_dir):
    return rounded(features.rotation(returns(spark, sf_dir)), 6, "leaders", "laggards", "dispersion", "spread")


@query(f"""
WITH {RETURNS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM returns WHERE ret IS NOT NULL),
runs AS (
  SELECT *, n - coalesce(max(CASE WHEN ret >= 0 THEN n END) OVER w, 0) AS losses, close / max(close) OVER w - 1 AS dd
  FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, losses, round(dd, 8) AS drawdown,
       CASE WHEN losses >= 3 THEN 'loss_streak' WHEN ret <= -0.5 THEN 'daily_loss' WHEN dd <= -0.9 THEN 'drawdown' END AS reason FROM runs""")
def circuit_breaker(spark, sf_dir):
    return rounded(features.circuit_breaker(returns(spark, sf_dir)), 8, "drawdown").select("symbol", "date", "losses", "drawdown", "reason")


@query("""
WITH p AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12 AS c FROM lineitem),
votes AS (SELECT *, (a + b + c) / 3 AS m, (a > 0.5)::INT + (b > 0.5)::INT + (c > 0.5)::INT AS bulls FROM p)
SELECT order_id, line, round(sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3), 6) AS ens_std,
       round(greatest(a, b, c) - least(a, b, c), 6) AS ens_range, round(greatest(bulls, 3 - bulls) / 3, 4) AS ens_agreement,
       round(CASE WHEN bulls IN (0, 3) THEN 0 ELSE -(bulls / 3 * log2(bulls / 3) + (1 - bulls / 3) * log2(1 - bulls / 3)) END, 6) AS ens_entropy
FROM votes""")
def disagreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        (F.col("l_quantity") / 50).alias("a"),
        (F.col("l_discount") * 10).alias("b"),
        (F.col("l_tax") * 12).alias("c"),
    )
    found = features.disagreement(rows, ["a", "b", "c"]).drop("a", "b", "c")
    return rounded(rounded(found, 6, "ens_std", "ens_range", "ens_entropy"), 4, "ens_agreement")


@query(f"""
WITH RECURSIVE {RETURNS}, numbered AS MATERIALIZED (
  SELECT symbol, date, coalesce(ret, 0) AS r, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM returns),
sums AS (
  SELECT symbol, date, n, greatest(0, r) AS p, least(0, r) AS m FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.symbol, x.date, x.n, greatest(0, CASE WHEN s.p >= {CUSUM} THEN 0 ELSE s.p END + x.r),
         least(0, CASE WHEN s.m <= -{CUSUM} THEN 0 ELSE s.m END + x.r)
  FROM sums s JOIN numbered x ON x.symbol = s.symbol AND x.n = s.n + 1)
SELECT symbol, date, p >= {CUSUM} AS up, m <= -{CUSUM} AS down FROM sums WHERE p >= {CUSUM} OR m <= -{CUSUM}""")
def cusum_events(spark, sf_dir):
    return folds.cusum_events(returns(spark, sf_dir), CUSUM)


def amount_bars_sql(amount: str) -> str:
    return f"""
WITH RECURSIVE hours AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS bar, arg_min(value, ts) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
numbered AS MATERIALIZED (
  SELECT *, CAST({amount} AS DOUBLE) AS amount, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS n FROM hours),
sizes AS MATERIALIZED (SELECT symbol, sum(amount) / count(DISTINCT CAST(bar AS DATE)) AS size FROM numbered GROUP BY 1),
walk AS (
  SELECT symbol, n, amount AS total, 0::BIGINT AS id FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.symbol, x.n, CASE WHEN w.total >= z.size THEN 0 ELSE w.total END + x.amount, CASE WHEN w.total >= z.size THEN w.id + 1 ELSE w.id END
  FROM walk w JOIN numbered x ON x.symbol = w.symbol AND x.n = w.n + 1 JOIN sizes z ON z.symbol = x.symbol)
SELECT symbol, id AS bar, min(h.bar) AS began, arg_min(open, n) AS open, max(high) AS high, min(low) AS low, arg_max(close, n) AS close,
       CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_rows
FROM walk JOIN numbered h USING (symbol, n) GROUP BY 1, 2"""


def hours(spark, sf_dir):
    return bars.time_bars(ticks(spark, sf_dir), 60).drop("vwap").withColumnsRenamed({"bar": "at", "trade_count": "volume"})


@query(amount_bars_sql("close * volume"))
def dollar_bars(spark, sf_dir):
    return folds.amount_bars(hours(spark, sf_dir), F.col("close") * F.col("volume"), "at", ["at"])


@query(amount_bars_sql("volume"))
def volume_bars(spark, sf_dir):
    return folds.amount_bars(hours(spark, sf_dir), F.col("volume"), "at", ["at"])


@query(f"""
WITH {RETURNS}, vol AS (
  SELECT *, CASE WHEN count(ret) OVER {frame(20)} >= 20 THEN stddev_samp(ret) OVER {frame(20)} END AS v,
         row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM returns),
scaled AS (SELECT *, 1.5 * greatest(coalesce(v, median(v) OVER (PARTITION BY symbol), 0), 1e-8) AS barrier FROM vol),
ahead AS (
  SELECT a.symbol, a.date, a.barrier, b.n - a.n AS k, b.close / a.close - 1 AS r
  FROM scaled a JOIN scaled b ON a.symbol = b.symbol AND b.n > a.n AND b.n <= a.n + 10),
touched AS (SELECT symbol, date, min(CASE WHEN r >= barrier OR r <= -barrier THEN k END) AS hit, max(k) AS far FROM ahead GROUP BY 1, 2)
SELECT t.symbol, t.date, CAST(CASE WHEN hit IS NULL THEN 0 WHEN r > 0 THEN 1 ELSE -1 END AS BIGINT) AS label, coalesce(hit, far) AS touch_idx,
       CASE WHEN hit IS NULL THEN 'time' WHEN r > 0 THEN 'upper' ELSE 'lower' END AS touch_type
FROM touched t JOIN ahead a ON a.symbol = t.symbol AND a.date = t.date AND a.k = coalesce(hit, far)""")
def volatility_barriers(spark, sf_dir):
    found = labels.volatility_barriers(returns(spark, sf_dir))
    return found.select("symbol", "date", "label", "touch_idx", "touch_type")


@query(f"""
WITH {DAILY}, placed AS (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS n, count(*) OVER (PARTITION BY symbol) AS total FROM daily),
pairs AS (
  SELECT a.range AS a, b.range AS b, CAST(row_number() OVER (ORDER BY a.range, b.range) - 1 AS INTEGER) AS split
  FROM range(6) a JOIN range(6) b ON a.range < b.range),
edges AS (
  SELECT symbol, date, split, n, a * (total // 6) AS a0, CASE WHEN a = 5 THEN total ELSE (a + 1) * (total // 6) END AS a1,
         b * (total // 6) AS b0, CASE WHEN b = 5 THEN total ELSE (b + 1) * (total // 6) END AS b1 FROM placed, pairs WHERE total >= 6)
SELECT symbol, date, split, CASE WHEN (n >= a0 AND n < a1) OR (n >= b0 AND n < b1) THEN 'test'
  WHEN (n >= a0 - 10 AND n < a1 + 3) OR (n >= b0 - 10 AND n < b1 + 3) THEN 'purged' ELSE 'train' END AS role FROM edges""")
def combinatorial_folds(spark, sf_dir):
    return splits.combinatorial_folds(daily_orders(spark, sf_dir))


@query("""
WITH ranked AS (
  SELECT l_returnflag AS symbol,
         rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
         rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b
  FROM lineitem)
SELECT symbol, count(*) AS n, round(corr(a, b), 8) AS spearman, round(atanh(corr(a, b)), 8) AS fisher_z FROM ranked GROUP BY 1""")
def rank_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), "l_quantity", "l_discount")
    return rounded(splits.rank_correlation(rows, "l_quantity", "l_discount", ["symbol"]), 8, "spearman", "fisher_z")


@query(f"""
WITH {RETURNS}, forward AS (
  SELECT symbol, ret, lead(close, 1) OVER w / close - 1 AS f1, lead(close, 5) OVER w / close - 1 AS f5, lead(close, 20) OVER w / close - 1 AS f20
  FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date)),
found AS (SELECT symbol, count(ret) AS n, corr(ret, f1) AS ic1, corr(ret, f5) AS ic5, corr(ret, f20) AS ic20 FROM forward GROUP BY 1)
SELECT symbol, n, round(ic1, 8) AS ic1, round(ic5, 8) AS ic5, round(ic20, 8) AS ic20,
       CASE WHEN greatest(abs(ic1), abs(ic5), abs(ic20)) >= 0.06 THEN 'STRONG'
            WHEN greatest(abs(ic1), abs(ic5), abs(ic20)) >= 0.03 THEN 'MODERATE' ELSE 'WEAK' END AS verdict FROM found""")
def information_coefficient(spark, sf_dir):
    ahead = {f"f{k}": F.lead("close", k).over(W.ordered()) / F.col("close") - 1 for k in (1, 5, 20)}
    found = returns(spark, sf_dir).withColumns(ahead).groupBy("symbol").agg(
        F.count("ret").alias("n"), *[F.corr("ret", f"f{k}").alias(f"ic{k}") for k in (1, 5, 20)]
    )
    best = F.greatest(*[F.abs(f"ic{k}") for k in (1, 5, 20)])
    verdict = F.when(best >= 0.06, "STRONG").when(best >= 0.03, "MODERATE").otherwise("WEAK")
    return rounded(found.withColumn("verdict", verdict), 8, "ic1", "ic5", "ic20")


@query("""
SELECT event_type AS symbol, CAST(ts AS DATE) AS date, count(*) AS n,
       arg_max(hour(ts) * 60 + minute(ts), (value, -epoch_us(ts))) AS high_minute, arg_min(hour(ts) * 60 + minute(ts), (value, epoch_us(ts))) AS low_minute,
       arg_min(ts, (value, epoch_us(ts))) < arg_max(ts, (value, -epoch_us(ts))) AS low_before_high
FROM events GROUP BY 1, 2""")
def extreme_times(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = ticks(spark, sf_dir).select("symbol", F.to_date("ts").alias("date"), "ts", "price", at.alias("at"))
    found = rows.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("ts", F.struct("price", -F.col("at"))).alias("high_at"),
        F.min_by("ts", F.struct("price", "at")).alias("low_at"),
    )
    minute = lambda c: bars.minute_of_day(c).cast("long")
    return found.select(
        "symbol", "date", "n", minute("high_at").alias("high_minute"), minute("low_at").alias("low_minute"), (F.col("low_at") < F.col("high_at")).alias("low_before_high")
    )


@query(f"""
WITH {RETURNS}, seen AS (
  SELECT symbol, date, list_sort(list(coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS s FROM returns),
pwm AS (
  SELECT symbol, date, len(s) AS n, list_sum(s) / 20 AS b0, list_sum(list_transform(s, lambda x, i: x * (i - 1) / 19.0)) / 20 AS b1,
         list_sum(list_transform(s, lambda x, i: x * (i - 1) * (i - 2) / 342.0)) / 20 AS b2,
         list_sum(list_transform(s, lambda x, i: x * (i - 1) * (i - 2) * (i - 3) / 5814.0)) / 20 AS b3 FROM seen),
l AS (SELECT *, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3, 20 * b3 - 30 * b2 + 12 * b1 - b0 AS l4 FROM pwm),
k AS (SELECT *, CASE WHEN n = 20 AND l2 > 1e-10 THEN l3 / l2 ELSE 0 END AS x FROM l),
z AS (SELECT *, CASE WHEN count(*) OVER w >= 30 THEN (x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w = 0 THEN 1e-10 ELSE stddev_samp(x) OVER w END ELSE 0 END AS z
      FROM k WINDOW w AS {frame(60)})
SELECT symbol, date, round(CASE WHEN n = 20 AND abs(b0) > 1e-10 THEN least(greatest(l2 / abs(b0), 0), 50) ELSE 0 END, 6) AS lcv,
       round(least(greatest(x, -1), 1), 6) AS lskew,
       round(CASE WHEN n = 20 AND l2 > 1e-10 THEN least(greatest(l4 / l2, -1), 1) ELSE 0 END, 6) AS lkurt, round(least(greatest(z, -5), 5), 5) AS lskew_z FROM z""")
def l_moments(spark, sf_dir):
    found = rounded(rounded(features.l_moments(returns(spark, sf_dir)), 6, "lcv", "lskew", "lkurt"), 5, "lskew_z")
    return found.select("symbol", "date", "lcv", "lskew", "lkurt", "lskew_z")


@query(f"""
WITH {RETURNS}, market AS (SELECT date, avg(ret) AS market FROM returns GROUP BY 1),
rows AS (SELECT symbol, date, ret, market FROM returns JOIN market USING (date) WHERE ret IS NOT NULL),
edges AS (SELECT symbol, quantile_cont(ret, 0.01) AS low, quantile_cont(ret, 0.99) AS high FROM rows GROUP BY 1),
clipped AS (SELECT r.*, least(greatest(ret, low), high) AS w FROM rows r JOIN edges USING (symbol)),
fit AS (SELECT symbol, regr_slope(w, market) AS slope, regr_intercept(w, market) AS base FROM clipped GROUP BY 1)
SELECT symbol, date, round(w, 6) AS winsorized, round(w - base - slope * market, 6) AS residual FROM clipped JOIN fit USING (symbol)""")
def neutralized_returns(spark, sf_dir):
    rows = returns(spark, sf_dir).filter("ret IS NOT NULL").select("symbol", "date", "ret")
    market = rows.groupBy("date").agg(F.mean("ret").alias("market"))
    found = features.neutralized(rows.join(market, "date"), "ret", "market")
    return rounded(found, 6, "winsorized", "residual").select("symbol", "date", "winsorized", "residual")


@query(f"""
WITH {DAILY}, members AS (
  SELECT CAST(o_custkey % 40 AS VARCHAR) AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS level FROM orders GROUP BY 1, 2),
moves AS (SELECT *, level / lag(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM members),
real AS (SELECT date, avg(ret) AS real FROM moves WHERE ret IS NOT NULL GROUP BY 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret, symbol) AS place, count(*) OVER (PARTITION BY date) AS names FROM moves WHERE ret IS NOT NULL),
basket AS (
  SELECT date, avg(ret) AS basket FROM placed
  WHERE names < 10 OR (place > greatest(1, floor(names * 0.2)) AND place <= names - greatest(1, floor(names * 0.2))) GROUP BY 1),
both_sides AS (SELECT date, real, basket FROM real JOIN basket USING (date)),
scaled AS (
  SELECT date, real, basket * 0.8 * (SELECT stddev_samp(real) / (stddev_samp(basket) + 1e-10) FROM both_sides) AS synthetic FROM both_sides)
SELECT date, round(real, 6) AS real, round(synthetic, 6) AS synthetic, round(0.6 * real + 0.4 * synthetic, 6) AS blended FROM scaled""")
def synthetic_universe(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).cast("string").alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), "o_totalprice"
    )
    members = rows.groupBy("symbol", "date").agg(F.mean("o_totalprice").alias("close")).withColumn("ret", W.pct_change(F.col("close")))
    index = members.filter("ret IS NOT NULL").groupBy("date").agg(F.mean("ret").alias("ret"))
    return rounded(synthetic.blended_index(synthetic.without_extremes(members, 0.2), index), 6, "real", "synthetic", "blended")


@query(f"""
WITH {DAILY}, trades AS (SELECT symbol, close - open AS pnl, close / open - 1 AS ret FROM daily)
SELECT symbol, count(*) AS n_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
       round(coalesce(avg(pnl) FILTER (pnl > 0), 0), 3) AS avg_win, round(coalesce(avg(-pnl) FILTER (pnl <= 0), 0), 3) AS avg_loss,
       round(coalesce(sum(pnl) FILTER (pnl > 0), 0) / greatest(abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)), 1), 6) AS profit_factor,
       round(sqrt(252) * (avg(ret) - 0.04 / 252) / stddev_pop(ret) FILTER (ret < 0), 6) AS sortino
FROM trades GROUP BY 1""")
def trade_metrics(spark, sf_dir):
    trades = daily_orders(spark, sf_dir).select("symbol", (F.col("close") - F.col("open")).alias("pnl"), (F.col("close") / F.col("open") - 1).alias("ret"))
    found = monitoring.trade_metrics(trades, ["symbol"])
    return rounded(rounded(found, 6, "win_rate", "profit_factor", "sortino"), 3, "avg_win", "avg_loss")


@query(f"""
WITH {DAILY}, spans AS (SELECT symbol, min(date) AS first, max(date) AS last FROM daily GROUP BY 1),
windows AS (
  SELECT symbol, w.range AS k, first + CAST(w.range * 90 AS INTEGER) AS start FROM spans, range(200) w
  WHERE first + CAST(w.range * 90 AS INTEGER) + 451 <= last)
SELECT d.symbol, d.date, k AS "window", CASE WHEN date <= start + 360 THEN 'train' ELSE 'test' END AS role
FROM daily d JOIN windows w ON w.symbol = d.symbol AND d.date >= w.start AND d.date <= w.start + 451""")
def walk_forward(spark, sf_dir):
    return splits.walk_forward(daily_orders(spark, sf_dir), train=360, test=90, step=90)


@query("""
WITH tagged AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date, event_id, value AS price,
         row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS back
  FROM events WHERE hour(ts) * 60 + minute(ts) < 570)
SELECT symbol, date, event_id, price FROM tagged WHERE back <= 30""")
def premarket_tail(spark, sf_dir):
    rows = ticks(spark, sf_dir).withColumn("date", F.to_date("ts")).filter(bars.minute_of_day("ts") < bars.REGULAR)
    back = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("_back", back).filter("_back <= 30").select("symbol", "date", "event_id", "price")


@query(f"""
WITH {RETURNS}, seen AS (
  SELECT symbol, date, list(ret) FILTER (ret IS NOT NULL) OVER w AS r, list(close) OVER w AS c FROM returns
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
spans AS (SELECT *, list_min(r) AS low, list_max(r) - list_min(r) AS span FROM seen),
codes AS (
  SELECT symbol, date, len(c) AS n, span, list_transform(r, lambda x: least(floor((x - low) / span * 10), 9)) AS b,
         list_transform(range(1, 19), lambda i: (c[i] <= c[i + 1])::INT + 2 * (c[i] <= c[i + 2])::INT + 4 * (c[i + 1] <= c[i + 2])::INT) AS p FROM spans)
SELECT symbol, date, round(CASE WHEN n = 20 AND span >= 1e-15 THEN list_aggregate(b, 'entropy') ELSE 0 END, 6) AS shannon,
       round(CASE WHEN n = 20 THEN list_aggregate(p, 'entropy') / log2(6) ELSE 0 END, 6) AS permutation FROM codes""")
def entropies(spark, sf_dir):
    return rounded(features.entropies(returns(spark, sf_dir)), 6, "shannon", "permutation").select("symbol", "date", "shannon", "permutation")


@query(f"""
WITH {DAILY}, moves AS (
  SELECT symbol, date, close / lag(close, 1) OVER w - 1 AS r1, close / lag(close, 3) OVER w - 1 AS r3, close / lag(close, 5) OVER w - 1 AS r5,
         close / lag(close, 10) OVER w - 1 AS r10 FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date)),
means AS (
  SELECT *, CASE WHEN count(r1) OVER w2 >= 2 THEN avg(abs(r1)) OVER w2 END AS m1, CASE WHEN count(r3) OVER w6 >= 6 THEN avg(abs(r3)) OVER w6 END AS m3,
         CASE WHEN count(r5) OVER w10 >= 10 THEN avg(abs(r5)) OVER w10 END AS m5, CASE WHEN count(r10) OVER w20 >= 20 THEN avg(abs(r10)) OVER w20 END AS m10
  FROM moves WINDOW w2 AS {frame(2)}, w6 AS {frame(6)}, w10 AS {frame(10)}, w20 AS {frame(20)})
SELECT symbol, date, round(coalesce(r5, 0), 6) AS mh_return_5d, round(coalesce(m5, 0), 6) AS mh_momentum_5d,
       round(coalesce(list_avg([sign(r1), sign(r3), sign(r5), sign(r10)]), 0), 6) AS mh_agreement, round(coalesce(list_avg([m1, m3, m5, m10]), 0), 6) AS mh_strength
FROM means""")
def horizon_signals(spark, sf_dir):
    shown = ["mh_return_5d", "mh_momentum_5d", "mh_agreement", "mh_strength"]
    return rounded(strategy.horizon_signals(daily_orders(spark, sf_dir)), 6, *shown).select("symbol", "date", *shown)


TRADES_SQL = f"""{RETURNS}, scored AS (
  SELECT *, CASE WHEN lag(ret, 1) OVER w IS NOT NULL THEN 1 / (1 + exp(-least(greatest(lag(ret, 1) OVER w, -5), 5))) END AS swing, CASE WHEN lag(ret, 2) OVER w IS NOT NULL THEN 1 / (1 + exp(-least(greatest(lag(ret, 2) OVER w, -5), 5))) END AS timing,
         CASE WHEN count(ret) OVER b >= 20 THEN stddev_samp(ret) OVER b * sqrt(252) ELSE 0.15 END AS volatility
  FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
signalled AS (
  SELECT *, CASE WHEN swing >= 0.6 AND timing >= 0.5 THEN 'BUY' WHEN swing <= 0.4 THEN 'SELL' ELSE 'HOLD' END AS signal,
         0.0001 * 1.1 * (1 + greatest(0, volatility - 0.15) * 5) AS slip FROM scored),
priced AS (
  SELECT *, CASE signal WHEN 'BUY' THEN 1 ELSE -1 END AS way FROM signalled WHERE signal <> 'HOLD'),
filled AS (SELECT *, open * (1 + way * slip) AS entry, close * (1 - way * slip) AS exit FROM priced),
trades AS (
  SELECT symbol, date, signal, volatility, entry, exit, (way * (exit - entry) - 0.01) * 10000 / entry AS pnl FROM filled)"""


def day_trades_of(spark, sf_dir):
    chance = lambda k: 1 / (1 + F.exp(-W.clip(F.lag("ret", k).over(W.ordered()), -5, 5)))
    rows = returns(spark, sf_dir).withColumns({"swing": chance(1), "timing": chance(2)})
    return strategy.day_trades(rows.withColumn("signal", strategy.signal(F.col("swing"), F.col("timing"))))


@query(f"""WITH {TRADES_SQL}
SELECT symbol, date, signal, round(volatility, 6) AS volatility, round(entry, 4) AS entry, round(exit, 4) AS exit, round(pnl, 4) AS pnl,
       round(pnl / 10000, 8) AS return_pct FROM trades""")
def day_trades(spark, sf_dir):
    return rounded(rounded(rounded(day_trades_of(spark, sf_dir), 4, "entry", "exit", "pnl"), 6, "volatility"), 8, "return_pct")


@query(f"""WITH {TRADES_SQL}, rates AS (
  SELECT symbol, signal, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(pnl) FILTER (pnl > 0) / avg(-pnl) FILTER (pnl <= 0) AS b
  FROM trades GROUP BY 1, 2)
SELECT symbol, signal, n_trades, round(p, 6) AS win_rate, round(CASE WHEN b > 0 THEN least(0.5 * greatest(0, p - (1 - p) / b), 0.25) ELSE 0 END, 6) AS kelly FROM rates""")
def kelly_sizes(spark, sf_dir):
    trades = day_trades_of(spark, sf_dir).withColumn("ret", F.col("return_pct"))
    found = monitoring.trade_metrics(trades, ["symbol", "signal"])
    ratio = F.try_divide("avg_win", "avg_loss")
    return rounded(found.withColumn("kelly", strategy.kelly(F.col("win_rate"), ratio)), 6, "win_rate", "kelly").select("symbol", "signal", "n_trades", "win_rate", "kelly")


@query("""
WITH old AS (SELECT event_type AS symbol, ts, event_id, value AS price FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-25'),
fresh AS (SELECT event_type AS symbol, ts, event_id, value * 2 AS price FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'),
starts AS (SELECT symbol, min(ts) AS first FROM fresh GROUP BY 1),
merged AS (
  SELECT o.* FROM old o LEFT JOIN starts s ON s.symbol = o.symbol WHERE s.first IS NULL OR o.ts < s.first UNION ALL SELECT * FROM fresh),
ends AS (SELECT symbol, max(ts) AS last FROM merged GROUP BY 1)
SELECT m.* FROM merged m JOIN ends USING (symbol) WHERE ts >= last - INTERVAL 20 DAY""")
def cache_refresh(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("symbol", "ts", "event_id", "price").withColumn("_day", F.to_date("ts"))
    old = rows.filter("_day < DATE '2024-01-25'").drop("_day")
    fresh = rows.filter("_day >= DATE '2024-01-20'").drop("_day").withColumn("price", F.col("price") * 2)
    return files.refresh(old, fresh, 20)


@query("""
WITH chunks AS (
  SELECT 0 AS chunk, event_id, value AS price FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT 1, event_id, value + 1 FROM events WHERE event_id % 2 = 0)
SELECT event_id, arg_min(price, chunk) AS price FROM chunks GROUP BY 1""")
def backfill_union(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("event_id", "price")
    return files.backfill([rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 2 = 0").withColumn("price", F.col("price") + 1)], ["event_id"])
