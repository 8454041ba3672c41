"""Queries of column checks, validation statistics, imputation, outliers and scaling, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import cleaning as C
from tidemark.plans.catalog import DAILY, RETURNS, frame, query, returns, rounded
from tidemark.plans.frames import MINUTES, minutes
from tidemark.sources.market import daily_orders, table

#: Daily bars with one defect each on some days.
DEFECTS = DAILY + """, bars AS (
  SELECT symbol, date, open, CASE WHEN day(date) % 11 = 0 THEN low * 0.9 ELSE high END AS high, low,
         CASE WHEN day(date) % 13 = 0 THEN NULL WHEN day(date) % 17 = 0 THEN -close ELSE close END AS close,
         CASE WHEN day(date) % 7 = 0 THEN 0 ELSE volume END AS volume, volume AS bar_count FROM daily)"""


def defective(spark, sf_dir):
    day = F.day("date")
    return daily_orders(spark, sf_dir).select(
        "symbol",
        "date",
        "open",
        F.when(day % 11 == 0, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(day % 13 == 0, None).when(day % 17 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(day % 7 == 0, 0).otherwise(F.col("volume")).cast("double").alias("volume"),
        F.col("volume").alias("bar_count"),
    )


@query(f"WITH {DAILY} SELECT symbol, date, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM daily WHERE volume > 1")
def normal_columns(spark, sf_dir):
    rows = daily_orders(spark, sf_dir).filter("volume > 1").withColumn("volume", F.col("volume").cast("double"))
    return C.normal_columns(rows.toDF(*[c.upper() for c in rows.columns]))


@query(f"""
WITH {DEFECTS}, fates AS (
  SELECT *, CASE WHEN close IS NULL THEN 'nan' WHEN close <= 0 THEN 'price' WHEN volume <= 0 THEN 'volume' END AS fate,
         close > 0 AND volume > 0 AND (high < greatest(open, close) OR low > least(open, close) OR high < low) AS broken FROM bars),
lagged AS (SELECT *, last_value(CASE WHEN fate IS NULL THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fates),
done AS (SELECT *, CASE WHEN fate IS NULL AND abs(close / before - 1) > 0.5 THEN 'move' ELSE fate END AS why FROM lagged)
SELECT symbol, count(*) AS rows_input, count(*) FILTER (why IS NULL) AS rows_output, count(*) FILTER (why IS NOT NULL) AS rows_dropped, count(*) FILTER (broken) AS rows_fixed,
       count(*) FILTER (why = 'nan') AS bad_not_a_number, count(*) FILTER (why = 'price') AS bad_price, count(*) FILTER (why = 'volume') AS bad_volume,
       count(*) FILTER (why = 'move') AS bad_move, count(*) FILTER (broken) AS bad_high_low
FROM done GROUP BY 1""")
def validation_stats(spark, sf_dir):
    return C.validation_stats(defective(spark, sf_dir))


@query(f"""
WITH {DEFECTS}, found AS (
  SELECT symbol, count(*) AS days, date_diff('day', min(date), max(date)) / 365.25 AS years, count(*) FILTER (bar_count < 2) AS sparse_days,
         count(*) FILTER (high < low OR high < greatest(open, close) OR low > least(open, close)) AS invalid_bars FROM bars GROUP BY 1)
SELECT symbol, days, round(years, 6) AS years, sparse_days, invalid_bars,
       (CAST(years >= 1 AS INT) + CAST(days >= 200 AS INT) + CAST(sparse_days <= 0.5 * days AS INT) + CAST(invalid_bars = 0 AS INT)) / 4 AS quality_score FROM found""")
def quality_report(spark, sf_dir):
    return rounded(C.quality_report(defective(spark, sf_dir)), 6, "years")


@query(f"WITH {MINUTES} SELECT symbol, ts, close FROM minutes WHERE hour(ts) * 60 + minute(ts) - 570 BETWEEN 30 AND 90")
def opening_window(spark, sf_dir):
    found = C.minutes_between(minutes(spark, sf_dir), 30, 90).select("symbol", "ts", "close")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: The normal distribution function as its series about 0.
PHI = """CASE WHEN {x} > 6 THEN 1 WHEN {x} < -6 THEN 0 ELSE 0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi())
  * list_sum(list_transform(range(0, 61), lambda k: pow({x}, 2 * k + 1) * pow(2, k) * gamma(k + 1) / gamma(2 * k + 2))) END"""


@query(f"""
WITH {RETURNS}, x AS (SELECT symbol, date, least(greatest(ret, -0.99), 5) AS x FROM returns WHERE ret IS NOT NULL)
SELECT symbol, date, round(1 / (1 + exp(-3 * x)), 8) AS sigmoid, round((exp(2 * x) - 1) / (exp(2 * x) + 1), 8) AS tanh, round({PHI.format(x="x")}, 8) AS phi,
       round(ln(1 + x), 8) AS log1p, CAST(sign(x) AS DOUBLE) AS way
FROM x""")
def squashed(spark, sf_dir):
    x = F.col("x")
    rows = returns(spark, sf_dir).filter("ret IS NOT NULL").select("symbol", "date", F.least(F.greatest("ret", F.lit(-0.99)), F.lit(5.0)).alias("x"))
    found = {"sigmoid": C.sigmoid(x, 3.0), "tanh": F.tanh(x), "phi": C.normal_cdf(x), "log1p": F.log1p(x), "way": F.signum(x)}
    return rounded(rows.withColumns(found).drop("x"), 8, "sigmoid", "tanh", "phi", "log1p")


@query(f"WITH {DEFECTS} SELECT symbol, date, coalesce(close, 0.5) AS close, high FROM bars")
def default_values(spark, sf_dir):
    rows = defective(spark, sf_dir).withColumn("close", F.when(F.col("close").isNull() & (F.day("date") > 13), float("inf")).otherwise(F.col("close")))
    return C.defaults(rows, {"close": 0.5, "high": 1.0}).select("symbol", "date", "close", "high")


@query(f"WITH {DEFECTS} SELECT symbol, date, high, low, close, volume FROM bars WHERE close IS NOT NULL")
def complete_candidates(spark, sf_dir):
    rows = defective(spark, sf_dir)
    columns = C.candidate_columns(rows, excluded=("open",), prefixes=("bar_",))
    return C.complete_rows(rows, columns).select("symbol", "date", *columns)


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN least(greatest((o_orderkey % 20) / 10.0 * 0.5, 0.1), 0.6) ELSE (o_orderkey % 20) / 10.0 END AS sample_weight FROM orders""")
def synthetic_weights(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), (key % 20 / 10.0).alias("sample_weight"), (key % 2 == 0).alias("is_synthetic"))
    return C.synthetic_weights(rows).drop("is_synthetic")


IMPUTED = ("ffill", "bfill", "mean", "median", "zero", "linear", "knn")
_W = "(PARTITION BY symbol ORDER BY date {})"
_BACK, _AHEAD = (_W.format(f"ROWS BETWEEN {x}") for x in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))


@query(f"""
WITH {DAILY}, sparse AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, CASE WHEN volume <> 2 THEN close END AS x FROM daily),
near AS (
  SELECT *, last_value(x IGNORE NULLS) OVER {_BACK} AS a, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER {_BACK} AS na,
         first_value(x IGNORE NULLS) OVER {_AHEAD} AS b, first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER {_AHEAD} AS nb,
         avg(x) OVER (PARTITION BY symbol) AS mean, median(x) OVER (PARTITION BY symbol) AS med,
         sum(x) OVER {_W.format("ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING")} AS s, count(x) OVER {_W.format("ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING")} AS c FROM sparse)
SELECT symbol, date, round(coalesce(a, b, 0), 4) AS ffill, round(coalesce(b, a, 0), 4) AS bfill, round(coalesce(x, mean, 0), 4) AS mean, round(coalesce(x, med, 0), 4) AS median,
       coalesce(x, 0) AS zero, round(coalesce(x, a + (b - a) * (n - na) / nullif(nb - na, 0), a, b, 0), 4) AS linear, round(coalesce(x, s / nullif(c, 0), 0), 4) AS knn FROM near""")
def imputed(spark, sf_dir):
    rows = daily_orders(spark, sf_dir).select("symbol", "date", *[F.when(F.col("volume") != 2, F.col("close")).alias(m) for m in IMPUTED])
    found = reduce(lambda df, m: C.impute(df, m, m, ["symbol"], "date"), IMPUTED, rows)
    return rounded(found, 4, *IMPUTED).select("symbol", "date", *IMPUTED)


@query(f"""
WITH {RETURNS}, x AS (SELECT symbol, date, ret AS x FROM returns WHERE ret IS NOT NULL),
m AS (SELECT symbol, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, avg(x) AS mean, stddev_pop(x) AS s, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, median(x) AS med FROM x GROUP BY 1),
d AS (SELECT symbol, median(abs(x - med)) * 1.4826 AS mad FROM x JOIN m USING (symbol) GROUP BY 1)
SELECT symbol, date, round(least(greatest(x, p5), p95), 6) AS winsorize, round(least(greatest(x, mean - 2 * s), mean + 2 * s), 6) AS clip,
       round(least(greatest(x, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS iqr, round(least(greatest(x, med - 3 * mad), med + 3 * mad), 6) AS mad
FROM x JOIN m USING (symbol) JOIN d USING (symbol) WHERE x BETWEEN mean - 3 * s AND mean + 3 * s""")
def outliers_limited(spark, sf_dir):
    limits = {"winsorize": 5, "clip": 2, "iqr": 1.5, "mad": 3, "zscore": 3}
    rows = returns(spark, sf_dir).filter("ret IS NOT NULL").select("symbol", "date", *[F.col("ret").alias(m) for m in limits])
    found = C.limit_all_outliers(rows, {m: (m, k) for m, k in limits.items()}, ["symbol"]).drop("zscore")
    return rounded(found, 6, *found.columns[2:])


SCALED = ("standard", "minmax", "robust", "maxabs", "log", "rank")


@query(f"""
WITH {RETURNS}, x AS (SELECT symbol, date, ret AS x FROM returns WHERE ret IS NOT NULL),
m AS (SELECT symbol, avg(x) AS mean, stddev_pop(x) AS s, min(x) AS low, max(x) AS high, median(x) AS med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, max(abs(x)) AS far FROM x GROUP BY 1)
SELECT symbol, date, round((x - mean) / s, 6) AS standard, round((x - low) / (high - low), 6) AS minmax, round((x - med) / iqr, 6) AS robust, round(x / far, 6) + 0 AS maxabs,
       round(sign(x) * ln(1 + abs(x)), 6) + 0 AS log, round(percent_rank() OVER (PARTITION BY symbol ORDER BY x), 6) AS rank FROM x JOIN m USING (symbol)""")
def scaled(spark, sf_dir):
    rows = returns(spark, sf_dir).filter("ret IS NOT NULL").select("symbol", "date", "ret")
    found = reduce(lambda df, m: C.scale(df, "ret", m, ["symbol"]).withColumnRenamed("scaled", m), SCALED, rows)
    return rounded(found, 6, *SCALED).select("symbol", "date", *SCALED)


@query(f"""
WITH {RETURNS}, small AS (SELECT symbol, date, ln(1 + ret) AS x FROM returns)
SELECT symbol, date, round(CASE WHEN count(x) OVER w >= 10 THEN skewness(x) OVER w END, 5) + 0 AS skew, round(CASE WHEN count(x) OVER w >= 10 THEN kurtosis(x) OVER w END, 5) + 0 AS kurt
FROM small WINDOW w AS {frame(20)}""")
def unbiased_moments(spark, sf_dir):
    rows = returns(spark, sf_dir).select("symbol", "date", F.log1p("ret").alias("x"))
    skew, kurt = C.unbiased_moments(F.col("x"), W.trailing(20), 10)
    return rounded(rows.select("symbol", "date", skew.alias("skew"), kurt.alias("kurt")), 5, "skew", "kurt")


@query(f"""
WITH {DAILY}, sparse AS (SELECT symbol, date, CASE WHEN volume <> 2 THEN close END AS level FROM daily),
days AS (SELECT symbol, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM sparse GROUP BY 1),
filled AS (
  SELECT d.symbol, d.date, coalesce(last_value(level IGNORE NULLS) OVER {_BACK.replace("symbol", "d.symbol").replace("date", "d.date")},
         first_value(level IGNORE NULLS) OVER {_AHEAD.replace("symbol", "d.symbol").replace("date", "d.date")}) AS level
  FROM days d LEFT JOIN sparse s ON s.symbol = d.symbol AND s.date = d.date)
SELECT * FROM filled WHERE isodow(date) < 6""")
def densified(spark, sf_dir):
    rows = daily_orders(spark, sf_dir).select("symbol", "date", F.when(F.col("volume") != 2, F.col("close")).alias("level"))
    return C.densify(rows, ["symbol"], "date", ["level"], business_days=True, back=True)
