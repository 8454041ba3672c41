"""Queries of validation, monitoring and backtest summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import validation as V
from tidemark.plans.catalog import DAILY, RETURNS, query, returns, rounded
from tidemark.sources.market import daily_orders, table

#: Daily returns of the symbols as small trades.
TRADES = RETURNS + """, trades AS (
  SELECT symbol, date, least(greatest(ret * 0.01, -0.02), 0.02) AS ret, least(greatest(ret * 0.01, -0.02), 0.02) * 1000 AS pnl FROM returns WHERE ret IS NOT NULL)"""


def trades(spark, sf_dir):
    small = F.least(F.greatest(F.col("ret") * 0.01, F.lit(-0.02)), F.lit(0.02))
    rows = returns(spark, sf_dir).filter("ret IS NOT NULL")
    return rows.select("symbol", "date", small.alias("ret"), (small * 1000).alias("pnl"))


@query(f"""
WITH {TRADES}, splits AS (SELECT symbol, year(date) * 12 + month(date) AS split, avg(ret) AS score FROM trades GROUP BY 1, 2),
medians AS (SELECT symbol, median(score) AS m, count(*) AS n FROM splits GROUP BY 1)
SELECT s.symbol, n AS n_splits, round(CASE WHEN n > 1 THEN avg(CASE WHEN score < m THEN 1.0 ELSE 0.0 END) ELSE 0 END, 8) AS pbo
FROM splits s JOIN medians USING (symbol) GROUP BY s.symbol, n""")
def overfitting(spark, sf_dir):
    splits = trades(spark, sf_dir).groupBy("symbol", (F.year("date") * 12 + F.month("date")).alias("split")).agg(F.mean("ret").alias("score"))
    return rounded(V.overfitting(splits, ["symbol"]), 8, "pbo")


@query(f"""
WITH {DAILY}, placed AS (
  SELECT symbol, date, dense_rank() OVER (PARTITION BY symbol ORDER BY date) - 1 AS spot, count(*) OVER (PARTITION BY symbol) AS n FROM daily),
counted AS (SELECT *, CASE WHEN n - 4 * 21 - 4 * 7 < 100 THEN greatest(2, (n - 100) // 28) ELSE 4 END AS splits FROM placed),
dealt AS (SELECT *, unnest(range(splits)) AS s FROM counted),
edges AS (SELECT *, n - s * 23 - 21 AS test_from, n - s * 23 - 26 AS train_to, greatest(0, n - s * 23 - 26 - (100 + 20 * s)) AS train_from FROM dealt),
roles AS (
  SELECT symbol, date, s AS split, CASE WHEN spot >= test_from AND spot < test_from + 21 THEN 'test' WHEN spot >= train_from AND spot < train_to THEN 'train' END AS role
  FROM edges WHERE train_to > train_from),
counts AS (SELECT *, count(*) FILTER (role = 'train') OVER (PARTITION BY symbol, split) AS a, count(*) FILTER (role = 'test') OVER (PARTITION BY symbol, split) AS b FROM roles WHERE role IS NOT NULL)
SELECT symbol, date, split, role FROM counts WHERE a >= 100 AND b > 0""")
def walk_forward_splits(spark, sf_dir):
    return V.walk_forward_splits(daily_orders(spark, sf_dir), splits=4, train=100)


@query("""
WITH models AS (SELECT c_custkey AS model, (c_acctbal + 1000) / 11000 AS stability, (c_custkey % 97) / 97.0 AS fragility, 0.5 + (c_custkey % 20) / 100.0 AS auc,
                CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 7) / 7.0 END AS suite FROM customer)
SELECT model, CAST(CASE WHEN stability >= 0.60 THEN CASE WHEN fragility < 0.40 AND auc >= 0.57 AND (suite IS NULL OR suite >= 0.5) THEN 3 ELSE 2 END ELSE 1 END AS BIGINT) AS tier
FROM models""")
def model_tiers(spark, sf_dir):
    key = F.col("c_custkey")
    suite = F.when(key % 3 != 0, (key % 7) / 7.0)
    tier = V.tier((F.col("c_acctbal") + 1000) / 11000, (key % 97) / 97.0, F.round(0.5 + (key % 20) / 100.0, 12), suite)
    return table(spark, sf_dir, "customer").select(key.alias("model"), tier.alias("tier"))


@query(f"""
WITH {TRADES}, bought AS (
  SELECT symbol AS model, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS wins, coalesce(avg(ret) FILTER (ret > 0), 0) AS win, coalesce(abs(avg(ret) FILTER (ret < 0)), 0.001) AS loss,
         avg(ret) AS mean, stddev_pop(ret) AS std FROM trades WHERE day(date) % 2 = 0 GROUP BY 1),
folds AS (SELECT symbol AS model, year(date) AS y, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS score, avg(CASE WHEN ret > 0.001 THEN 1.0 ELSE 0.0 END) AS noisy FROM trades GROUP BY 1, 2),
cv AS (SELECT model, avg(score) AS cv, stddev_pop(score) AS cv_std, avg(noisy) AS noisy FROM folds GROUP BY 1),
parts AS (
  SELECT model, least(wins, 0.75) / 0.75 AS win_rate, cv * (1 - least(cv_std / (cv + 1e-6), 0.5)) AS robustness,
         least(greatest(win / loss * 0.3 + least(greatest(mean / (std + 1e-6), -3), 3) * 0.7, 0), 1) AS profit_potential,
         greatest(1 - (cv - noisy) / (cv + 1e-6), 0) AS noise_tolerance, 1 - least(0.3, 1.0) AS plateau_stability,
         CASE WHEN 20 * length(model) <= 30 THEN 1 ELSE greatest(1 - (20 * length(model) - 30) / 100.0, 0.5) END AS complexity_penalty
  FROM bought JOIN cv USING (model))
SELECT model, round(win_rate, 6) AS win_rate, round(robustness, 6) AS robustness, round(profit_potential, 6) AS profit_potential, round(noise_tolerance, 6) AS noise_tolerance,
       round(plateau_stability, 6) AS plateau_stability, round(complexity_penalty, 6) AS complexity_penalty,
       round(greatest(0, least(1, 0.25 * win_rate + 0.2 * robustness + 0.15 * profit_potential + 0.15 * noise_tolerance + 0.15 * plateau_stability + 0.1 * complexity_penalty)), 6) AS wmes
FROM parts""")
def composite_score(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumnRenamed("symbol", "model")
    folds = rows.groupBy("model", F.year("date")).agg(F.mean((F.col("ret") > 0).cast("double")).alias("score"), F.mean((F.col("ret") > 0.001).cast("double")).alias("noisy"))
    models = rows.select("model").distinct().select("model", (20 * F.char_length("model")).alias("n_features"), F.lit(0.3).alias("sensitivity"))
    found = V.composite_score(rows.withColumn("bought", F.day("date") % 2 == 0), folds, models)
    return rounded(found, 6, *found.columns[1:])


#: Columns of ``measured`` that drift is looked for in.
NAMES = ["discount", "price", "tax"]
FEATURES = """features AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 2 AS half, l_quantity AS target, unnest(['discount', 'price', 'tax']) AS feature,
         unnest([l_discount, l_extendedprice, round(l_tax + l_quantity / 1000 * (l_orderkey % 2), 6)]) AS value FROM lineitem)"""


def measured(spark, sf_dir):
    """Lines with their half, the target and a column for each feature."""
    half, tax = F.col("l_orderkey") % 2, F.round(F.col("l_tax") + F.col("l_quantity") / 1000 * (F.col("l_orderkey") % 2), 6)
    values = [F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"), tax.alias("tax")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", half.alias("half"), F.col("l_quantity").alias("target"), *values)


def features(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).alias("value")) for name in NAMES])).alias("f")
    return measured(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "half", "target", each).select("*", "f.*").drop("f")


@query(f"""
WITH {FEATURES}, ranked AS (
  SELECT feature, half, row_number() OVER (PARTITION BY feature, half ORDER BY value, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS a,
         row_number() OVER (PARTITION BY feature, half ORDER BY target, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b FROM features),
r AS (SELECT feature, half, count(*) AS n, corr(a, b) AS r FROM ranked GROUP BY 1, 2),
tested AS (
  SELECT x.feature, x.r AS baseline, y.r AS current, (atanh(x.r) - atanh(y.r)) / sqrt(1.0 / greatest(x.n - 3, 1) + 1.0 / greatest(y.n - 3, 1)) AS z
  FROM r x JOIN r y ON x.feature = y.feature AND x.half = 0 AND y.half = 1),
scored AS (SELECT *, abs(z) > 1.96 AS significant, avg(CASE WHEN abs(z) > 1.96 THEN 1.0 ELSE 0.0 END) OVER () AS drift_score FROM tested)
SELECT feature, round(baseline, 6) AS baseline, round(current, 6) AS current, round(current - baseline, 6) AS change, round(z, 4) AS z, significant, round(drift_score, 6) AS drift_score,
       CASE WHEN drift_score < 0.05 THEN 'NONE' WHEN drift_score < 0.2 THEN 'MILD' WHEN drift_score < 0.4 THEN 'MODERATE' ELSE 'SEVERE' END AS severity
FROM scored""")
def concept_drift(spark, sf_dir):
    found = V.ordinal_rank_correlations(measured(spark, sf_dir), NAMES, "target", ["half"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return rounded(rounded(V.concept_drift(found.filter("half = 0"), found.filter("half = 1")), 6, "baseline", "current", "change", "drift_score"), 4, "z")


@query(f"""
WITH {FEATURES}, plain AS (SELECT feature, half, round(value, 9) AS value FROM features UNION ALL SELECT 'fixed', half, 1.0 FROM features WHERE feature = 'tax'),
edges AS (
  SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda e: round(e, 9)))) AS edges
  FROM plain WHERE half = 0 GROUP BY 1),
binned AS (
  SELECT p.feature, half, greatest(least(len(list_filter(edges, lambda e: e <= value)), len(edges) - 1), 1) AS bin, count(*) AS n
  FROM plain p JOIN edges USING (feature) WHERE value >= edges[1] AND value <= edges[-1] GROUP BY 1, 2, 3),
grid AS (SELECT feature, unnest(range(1, len(edges))) AS bin FROM edges WHERE len(edges) > 1),
shares AS (
  SELECT g.feature, greatest(coalesce(e.n, 0) / sum(coalesce(e.n, 0)) OVER (PARTITION BY g.feature), 1e-6) AS e, greatest(coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER (PARTITION BY g.feature), 1e-6) AS a
  FROM grid g LEFT JOIN binned e ON e.feature = g.feature AND e.bin = g.bin AND e.half = 0 LEFT JOIN binned a ON a.feature = g.feature AND a.bin = g.bin AND a.half = 1),
found AS (
  SELECT d.feature, CASE WHEN len(d.edges) > 1 THEN s.psi ELSE 0 END AS psi
  FROM edges d LEFT JOIN (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY 1) s USING (feature)),
judged AS (SELECT *, psi > 0.2 AS drifted, avg(CASE WHEN psi > 0.2 THEN 1.0 ELSE 0.0 END) OVER () AS drift_fraction FROM found)
SELECT feature, round(psi, 6) AS psi, drifted, drift_fraction, CASE WHEN drift_fraction > 0.2 THEN 'significant' WHEN drift_fraction > 0.1 THEN 'moderate' ELSE 'none' END AS severity
FROM judged""")
def drift_monitor(spark, sf_dir):
    rows = features(spark, sf_dir)
    fixed = rows.filter("feature = 'tax'").select(F.lit("fixed").alias("feature"), "half", F.lit(1.0).alias("value"))
    rows = rows.select("feature", "half", "value").unionByName(fixed)
    return rounded(V.drift_monitor(rows.filter("half = 0"), rows.filter("half = 1")), 6, "psi")


@query(f"""
WITH {TRADES}, rolled AS (
  SELECT *, CASE WHEN count(*) OVER w >= 5 THEN avg(ret) OVER w END AS m, CASE WHEN count(*) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS s
  FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, CASE WHEN m > s THEN 'BULL' WHEN m < -s THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime, count(*) AS n_trades, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
       round(avg(ret), 8) AS avg_return, round(sum(pnl), 4) AS total_pnl, round(avg(ret) / (stddev_pop(ret) + 1e-8) * sqrt(252), 6) AS sharpe
FROM rolled GROUP BY 1, 2""")
def regime_stress(spark, sf_dir):
    found = V.regime_stats(V.regime_of_trades(trades(spark, sf_dir), ["symbol"], ["date"]), ["symbol"])
    return rounded(rounded(rounded(found, 6, "win_rate", "sharpe"), 8, "avg_return"), 4, "total_pnl")


@query()
def bootstrap(spark, sf_dir):
    found = V.bootstrap(trades(spark, sf_dir).filter(F.year("date") == 1995), ["symbol"], ["date"], simulations=100)
    return rounded(found, 6, *found.columns[1:])


@query(f"""
WITH {TRADES}, windows AS (
  SELECT symbol, year(date) AS y, sum(ret) * 100 AS total_return_pct, avg(ret) / stddev_pop(ret) AS sharpe, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS n_trades
  FROM trades GROUP BY 1, 2)
SELECT count(*) AS n_windows, round(sum(total_return_pct), 6) AS total_return_pct, round(avg(total_return_pct), 6) AS avg_window_return_pct, round(avg(sharpe), 6) AS avg_sharpe,
       round(stddev_pop(sharpe), 6) AS std_sharpe, round(min(total_return_pct), 6) AS worst_window_return, round(max(total_return_pct), 6) AS best_window_return,
       round(avg(win_rate), 6) AS avg_win_rate, CAST(sum(n_trades) AS BIGINT) AS total_trades,
       round((SELECT sqrt(252) * avg(ret) / (stddev_pop(ret) + 1e-8) FROM trades), 6) AS overall_sharpe
FROM windows""")
def walk_forward_summary(spark, sf_dir):
    rows = trades(spark, sf_dir)
    windows = rows.groupBy("symbol", F.year("date")).agg(
        (F.sum("ret") * 100).alias("total_return_pct"),
        (F.mean("ret") / F.stddev_pop("ret")).alias("sharpe"),
        F.mean((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.count(F.lit(1)).alias("n_trades"),
    )
    found = V.walk_forward_summary(windows, rows)
    return rounded(found, 6, *[c for c in found.columns if c not in ("n_windows", "total_trades")])


@query(f"""
WITH {TRADES}, recent AS (SELECT symbol AS regime, pnl FROM trades ORDER BY date DESC, symbol DESC LIMIT 50)
SELECT regime, CAST(grouping(regime) AS BOOLEAN) AS overall, count(*) AS n_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(pnl), 6) AS avg_pnl
FROM recent GROUP BY CUBE (regime)""")
def attribution(spark, sf_dir):
    return rounded(V.attribution(trades(spark, sf_dir).withColumn("regime", F.col("symbol")), ["date", "symbol"]), 6, "win_rate", "avg_pnl")


@query("""
WITH expected AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN 'LONG' ELSE 'SHORT' END AS direction, o_totalprice / 10 AS expected FROM orders WHERE o_orderkey % 3 > 0),
fills AS (SELECT l_orderkey AS order_id, l_extendedprice AS actual, l_shipdate AS filled_at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_extendedprice) AS place FROM lineitem),
matched AS (SELECT *, CASE WHEN expected = 0 THEN 0 ELSE (actual - expected) / expected * 10000 END AS slip FROM expected JOIN fills USING (order_id) WHERE place = 1)
SELECT order_id, direction, expected, actual, round(slip, 2) AS slippage_bps, CASE WHEN direction = 'LONG' THEN slip <= 0 ELSE slip >= 0 END AS favorable, filled_at FROM matched""")
def matched_fills(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "long").otherwise("short").alias("direction"), (F.col("o_totalprice") / 10).alias("expected")
    )
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("actual"), F.col("l_shipdate").alias("filled_at"))
    return V.matched_fills(expected, fills)


@query("""
WITH numbered AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events)
SELECT event_type, event_id, value FROM numbered WHERE place <= 90""")
def bounded_log(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value", "ts")
    return V.last_per_key(rows, ["event_type"], ["ts", "event_id"], 90).drop("ts")


@query("""
SELECT a.l_returnflag AS symbol, a.l_quantity AS x, a.l_extendedprice AS y, count(*) AS n FROM lineitem a
JOIN (SELECT l_returnflag, l_quantity, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2) b
  ON a.l_returnflag = b.l_returnflag AND a.l_quantity = b.l_quantity AND a.l_extendedprice = b.best
WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_returnflag AS f, l_quantity AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2) c
                  WHERE c.f = a.l_returnflag AND c.q > a.l_quantity AND c.p >= a.l_extendedprice) GROUP BY 1, 2, 3""")
def pareto_front(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return V.pareto_front(rows, ["symbol"], "x", "y").groupBy("symbol", "x", "y").agg(F.count(F.lit(1)).alias("n"))
