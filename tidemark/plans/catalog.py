"""Every registered query of the market-analytics operators with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import align, bars, labels, monitoring
from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.market import daily_orders, table, ticks, traded

FLAGSHIP = "rsi_zscore_labels"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

DAILY = """daily AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2)"""
#: Daily returns by symbol.
RETURNS = DAILY + """, returns AS (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM daily)"""


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_orders(spark, sf_dir).withColumn("ret", W.pct_change(F.col("close")))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {DAILY} SELECT * FROM daily")
def daily_bars(spark, sf_dir):
    return daily_orders(spark, sf_dir)


@query("""
SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS bar, arg_min(value, ts) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, ts) AS close, sum(k) AS volume, count(*) AS trade_count,
       round(sum(value * k) / nullif(sum(k), 0), 6) AS vwap
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1, 2""")
def time_bars(spark, sf_dir):
    found = bars.time_bars(traded(spark, sf_dir), 60)
    return rounded(found, 6, "vwap").withColumn("bar", F.col("bar").cast("timestamp_ntz"))


SESSION_SQL = """CASE WHEN hour(ts) * 60 + minute(ts) < 570 THEN 'premarket' WHEN hour(ts) * 60 + minute(ts) < 960 THEN 'regular'
 ELSE 'afterhours' END"""


@query(f"""
SELECT CAST(ts AS DATE) AS date, event_type AS symbol, {SESSION_SQL} AS session, count(*) AS n, min(value) AS low, max(value) AS high,
       count(*) >= 5 AS enough
FROM events GROUP BY 1, 2, 3""")
def session_aggregates(spark, sf_dir):
    rows = ticks(spark, sf_dir).select(F.to_date("ts").alias("date"), "symbol", bars.session("ts").alias("session"), "price")
    found = rows.groupBy("date", "symbol", "session").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    return found.withColumn("enough", F.col("n") >= 5)


@query(f"""
SELECT CASE WHEN hour(ts) * 60 + minute(ts) < 240 OR hour(ts) * 60 + minute(ts) >= 1200 THEN 'closed' ELSE {SESSION_SQL} END AS session,
       count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days
FROM events GROUP BY 1""")
def live_sessions(spark, sf_dir):
    tagged = ticks(spark, sf_dir).select(bars.session("ts", with_closed=True).alias("session"), F.to_date("ts").alias("date"))
    return tagged.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"))


@query(f"""
WITH {DAILY}, good AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM daily
  WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0)
SELECT symbol, date, open, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close, volume,
       high < greatest(open, close) OR low > least(open, close) AS fixed
FROM good WHERE before IS NULL OR abs(close / before - 1) <= 0.5""")
def validated_bars(spark, sf_dir):
    return bars.validate(daily_orders(spark, sf_dir))


@query("""
SELECT user_id, CAST(ts AS DATE) AS date, arg_max(event_id, ts) AS event_id, max(ts) AS ts, arg_max(value, ts) AS price
FROM events GROUP BY 1, 2""")
def keep_last_upsert(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("user_id", F.to_date("ts").alias("date"), "event_id", "ts", "price")
    return bars.keep_last(rows, ["user_id", "date"], [F.col("ts").alias("_at"), F.col("event_id").alias("_tie")])


@query(f"""
WITH {RETURNS}, moves AS (
  SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS move FROM returns),
rolled AS (
  SELECT *, avg(greatest(move, 0)) OVER w14 AS up, avg(greatest(-move, 0)) OVER w14 AS down, count(move) OVER w14 AS n14,
         avg(close) OVER w20 AS mean20, stddev_samp(close) OVER w20 AS std20, count(close) OVER w20 AS n20
  FROM moves WINDOW w14 AS {frame(14)}, w20 AS {frame(20)})
SELECT symbol, date, close, round(ret, 8) AS ret,
       round(CASE WHEN n14 >= 14 THEN 100 - 100 / (1 + up / (down + 1e-10)) END, 6) AS rsi,
       round(CASE WHEN n20 >= 20 THEN mean20 END, 4) AS sma20,
       round(coalesce(CASE WHEN n20 >= 20 THEN least(greatest((close - mean20) / (std20 + 1e-10), -4), 4) END, 0), 6) AS z20
FROM rolled""")
def rolling_features(spark, sf_dir):
    move = F.col("close") - F.lag("close").over(W.ordered())
    rows = returns(spark, sf_dir).withColumn("move", move)
    rows = rows.withColumns({"gain": F.greatest(F.col("move"), F.lit(0.0)), "loss": F.greatest(-F.col("move"), F.lit(0.0))})
    # A missing move gives no gain; greatest() would make it 0.
    rows = rows.withColumns({c: F.when(F.col("move").isNotNull(), F.col(c)) for c in ("gain", "loss")})
    close = F.col("close")
    return rounded(
        rows.select(
            "symbol",
            "date",
            "close",
            F.round("ret", 8).alias("ret"),
            W.rsi(F.col("gain"), F.col("loss")).alias("rsi"),
            F.round(W.rolling(F.mean, close, 20), 4).alias("sma20"),
            W.zscore(close, 20).alias("z20"),
        ),
        6,
        "rsi",
        "z20",
    )


@query(f"""
WITH {DAILY}, run AS (
  SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date) AS peak,
         sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS way FROM daily)
SELECT symbol, date, peak, round(close / peak - 1, 8) AS drawdown,
       CAST(sum(coalesce(way, 0) * volume) OVER (PARTITION BY symbol ORDER BY date) AS DOUBLE) AS obv FROM run""")
def drawdown_and_obv(spark, sf_dir):
    running = W.ordered().rowsBetween(Window.unboundedPreceding, 0)
    rows = daily_orders(spark, sf_dir).withColumn("peak", F.max("close").over(running))
    way = F.coalesce(F.signum(F.col("close") - F.lag("close").over(W.ordered())), F.lit(0.0))
    rows = rows.withColumn("flow", way * F.col("volume"))
    return rows.select(
        "symbol", "date", "peak", F.round(F.col("close") / F.col("peak") - 1, 8).alias("drawdown"), F.sum("flow").over(running).alias("obv")
    )


@query(f"""
WITH {RETURNS}, marked AS (
  SELECT *, ret > 0 AS up, row_number() OVER (PARTITION BY symbol ORDER BY date)
    - row_number() OVER (PARTITION BY symbol, ret > 0 ORDER BY date) AS island,
    max(CASE WHEN ret > 0.5 THEN row_number END) OVER (PARTITION BY symbol ORDER BY date) AS hit
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS row_number FROM returns))
SELECT symbol, date, CASE WHEN up THEN row_number() OVER (PARTITION BY symbol, up, island ORDER BY date) ELSE 0 END AS up_streak,
       least(coalesce(row_number - hit, 60), 60) AS days_since_jump
FROM marked""")
def streaks(spark, sf_dir):
    n = F.row_number().over(W.ordered())
    rows = returns(spark, sf_dir).withColumn("n", n).withColumn("up", F.col("ret") > 0)
    island = F.col("n") - F.row_number().over(Window.partitionBy("symbol", "up").orderBy("date"))
    hit = F.max(F.when(F.col("ret") > 0.5, F.col("n"))).over(W.ordered().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", island).withColumn("hit", hit)
    streak = F.row_number().over(Window.partitionBy("symbol", "up", "island").orderBy("date"))
    return rows.select(
        "symbol",
        "date",
        F.when(F.col("up"), streak).otherwise(0).cast("long").alias("up_streak"),
        F.least(F.coalesce(F.col("n") - F.col("hit"), F.lit(60)), F.lit(60)).cast("long").alias("days_since_jump"),
    )


@query(f"""
WITH {RETURNS}, market AS (SELECT date, avg(ret) AS market FROM returns GROUP BY 1)
SELECT symbol, date, round(CASE WHEN count(*) OVER w >= 60 THEN corr(ret, market) OVER w END, 6) AS corr60,
       round(CASE WHEN count(*) OVER w >= 60 THEN covar_samp(ret, market) OVER w / (var_samp(market) OVER w + 1e-10) END, 6) AS beta60
FROM returns JOIN market USING (date) WHERE ret IS NOT NULL AND market IS NOT NULL WINDOW w AS {frame(60)}""")
def rolling_beta(spark, sf_dir):
    rows = returns(spark, sf_dir)
    market = rows.groupBy("date").agg(F.mean("ret").alias("market"))
    both = rows.join(market, "date").filter("ret IS NOT NULL AND market IS NOT NULL")
    frame60 = W.trailing(60)
    full = F.count(F.lit(1)).over(frame60) >= 60
    beta = F.covar_samp("ret", "market").over(frame60) / (F.var_samp("market").over(frame60) + W.EPSILON)
    return both.select(
        "symbol", "date", F.round(F.when(full, W.correlation(F.col("ret"), F.col("market"), frame60)), 6).alias("corr60"), F.round(F.when(full, beta), 6).alias("beta60")
    )


@query(f"""
WITH {DAILY}
SELECT symbol, date, round(quantile_cont(close, 0.9) OVER w, 4) AS q90, round(median(close) OVER w, 4) AS med,
       round(CASE WHEN count(*) OVER past >= 20 THEN regr_slope(close, n) OVER past ELSE 0 END, 4) AS slope,
       low = min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS lowest_of_7,
       CASE WHEN count(*) OVER w >= 20 THEN true ELSE false END AS full_window
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM daily)
WINDOW w AS {frame(20)}, past AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def rolling_quantiles_and_slope(spark, sf_dir):
    w = W.trailing(20)
    # The slope over the 20 rows before this one, by row number.
    past = W.ordered().rowsBetween(-20, -1)
    slope = F.when(F.count(F.lit(1)).over(past) >= 20, F.regr_slope(F.col("close"), F.col("n")).over(past)).otherwise(0.0)
    return daily_orders(spark, sf_dir).withColumn("n", F.row_number().over(W.ordered())).select(
        "symbol",
        "date",
        F.round(F.percentile("close", 0.9).over(w), 4).alias("q90"),
        F.round(F.percentile("close", 0.5).over(w), 4).alias("med"),
        F.round(slope, 4).alias("slope"),
        (F.col("low") == F.min("low").over(W.trailing(7))).alias("lowest_of_7"),
        (F.count(F.lit(1)).over(w) >= 20).alias("full_window"),
    )


@query(f"""
WITH {RETURNS}
SELECT date, symbol, rank() OVER (PARTITION BY date ORDER BY ret DESC) AS place,
       round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY date), 6) AS breadth,
       bool_and(ret > 0) OVER (PARTITION BY date) AS all_up
FROM returns WHERE ret IS NOT NULL""")
def cross_section(spark, sf_dir):
    rows = returns(spark, sf_dir).filter("ret IS NOT NULL")
    day = Window.partitionBy("date")
    return rows.select(
        "date",
        "symbol",
        F.rank().over(day.orderBy(F.desc("ret"))).cast("long").alias("place"),
        F.round(F.mean((F.col("ret") > 0).cast("double")).over(day), 6).alias("breadth"),
        F.min(F.col("ret") > 0).over(day).alias("all_up"),
    )


@query("""
WITH quotes AS (SELECT user_id, ts, value AS quote FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
rest AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> (SELECT min(event_type) FROM events))
SELECT r.event_id, r.user_id, r.ts, q.quote, q.ts AS quoted_at
FROM rest r ASOF LEFT JOIN quotes q ON r.user_id = q.user_id AND r.ts >= q.ts""")
def asof_quotes(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    first = rows.agg(F.min("symbol").alias("_first"))
    marked = rows.join(F.broadcast(first)).withColumn("_quote", F.col("symbol") == F.col("_first"))
    quotes = marked.filter("_quote").select("user_id", "ts", F.col("price").alias("quote"), F.col("ts").alias("quoted_at"))
    rest = marked.filter("NOT _quote").select("event_id", "user_id", "ts")
    return align.asof_join(rest, quotes, ["user_id"], "ts", ["quote", "quoted_at"])


@query(f"""
WITH {DAILY}, sparse AS (SELECT symbol, date, close AS level FROM daily WHERE volume >= 2)
SELECT d.symbol, d.date, last_value(s.level IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.date) AS level
FROM daily d LEFT JOIN sparse s ON s.symbol = d.symbol AND s.date = d.date""")
def filled_series(spark, sf_dir):
    daily = daily_orders(spark, sf_dir)
    sparse = daily.filter("volume >= 2").select("symbol", "date", F.col("close").alias("level"))
    joined = daily.select("symbol", "date").join(sparse, ["symbol", "date"], "left")
    return align.forward_fill(joined, ["symbol"], "date", ["level"])


BARRIER_SQL = f"""{DAILY}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM daily),
ahead AS (
  SELECT a.symbol, a.date, b.n - a.n AS k, b.close / a.close - 1 AS r
  FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.n > a.n AND b.n <= a.n + 10),
touched AS (
  SELECT symbol, date, min(CASE WHEN r >= 0.02 OR r <= -0.02 THEN k END) AS hit, max(k) AS far FROM ahead GROUP BY 1, 2),
labelled AS (
  SELECT t.symbol, t.date, coalesce(hit, far) AS touch_idx, a.r AS return_at_touch,
         CASE WHEN hit IS NULL THEN 'time' WHEN a.r > 0 THEN 'upper' ELSE 'lower' END AS touch_type
  FROM touched t JOIN ahead a ON a.symbol = t.symbol AND a.date = t.date AND a.k = coalesce(hit, far))"""


@query(f"""WITH {BARRIER_SQL}
SELECT symbol, date, CAST(CASE touch_type WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS BIGINT) AS label, touch_type, touch_idx,
       round(return_at_touch, 8) AS return_at_touch FROM labelled""")
def triple_barrier(spark, sf_dir):
    return rounded(labels.triple_barrier(daily_orders(spark, sf_dir)), 8, "return_at_touch")


@query(f"""WITH {BARRIER_SQL}
SELECT symbol, touch_type, count(*) AS n, round(avg(return_at_touch), 6) AS mean_return, round(avg(touch_idx), 6) AS mean_idx
FROM labelled GROUP BY 1, 2""")
def touch_summary(spark, sf_dir):
    return rounded(labels.touch_summary(labels.triple_barrier(daily_orders(spark, sf_dir))), 6, "mean_return", "mean_idx")


@query(f"""
WITH {BARRIER_SQL}, before AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS move FROM daily),
rolled AS (
  SELECT symbol, date, count(move) OVER w14 AS n14, avg(greatest(move, 0)) OVER w14 AS up, avg(greatest(-move, 0)) OVER w14 AS down,
         count(*) OVER w20 AS n20, (close - avg(close) OVER w20) / (stddev_samp(close) OVER w20 + 1e-10) AS z
  FROM before WINDOW w14 AS {frame(14)}, w20 AS {frame(20)}),
features AS (
  SELECT symbol, date, CASE WHEN n14 >= 14 THEN round(100 - 100 / (1 + up / (down + 1e-10)), 6) END AS rsi,
         CASE WHEN n20 >= 20 THEN round(least(greatest(z, -4), 4), 6) ELSE 0 END AS z20 FROM rolled)
SELECT symbol, CAST(CASE touch_type WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS BIGINT) AS label, count(*) AS n,
       round(avg(rsi), 4) AS mean_rsi, round(avg(z20), 4) AS mean_z20
FROM features JOIN labelled USING (symbol, date) GROUP BY 1, 2""")
def rsi_zscore_labels(spark, sf_dir):
    """The end-to-end slice: bars, features, labels and a summary by label."""
    features = rolling_features(spark, sf_dir)
    found = features.join(labels.triple_barrier(daily_orders(spark, sf_dir)), ["symbol", "date"])
    return rounded(
        found.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"), F.mean("rsi").alias("mean_rsi"), F.mean("z20").alias("mean_z20")), 4, "mean_rsi", "mean_z20"
    )


@query(f"""
WITH {RETURNS}, curve AS (
  SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY date)) AS equity FROM returns WHERE ret IS NOT NULL),
peaks AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY date), 1) AS peak FROM curve)
SELECT symbol, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 4) AS total_return,
       round(sqrt(252) * avg(ret - 0.04 / 252) / stddev_pop(ret), 6) AS sharpe, round(min(equity / peak - 1), 6) AS max_drawdown,
       round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate
FROM peaks GROUP BY 1""")
def performance(spark, sf_dir):
    found = monitoring.performance(returns(spark, sf_dir).select("symbol", "date", "ret"))
    return rounded(rounded(found, 6, "sharpe", "max_drawdown", "win_rate"), 4, "total_return")


@query("""
WITH scored AS (
  SELECT l_returnflag AS symbol, l_extendedprice AS score, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS hit,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey DESC, l_linenumber DESC) AS place FROM lineitem),
recent AS (SELECT * FROM scored WHERE place <= 500),
pairs AS (
  SELECT p.symbol, avg(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auc
  FROM recent p JOIN recent n ON p.symbol = n.symbol AND p.hit = 1 AND n.hit = 0 GROUP BY 1),
sizes AS (SELECT symbol, count(*) AS n_predictions FROM scored GROUP BY 1),
base AS (SELECT s.symbol, n_predictions, CASE WHEN n_predictions >= 10 THEN auc END AS auc,
                CASE s.symbol WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.54 ELSE 0.5 END AS baseline_auc FROM sizes s LEFT JOIN pairs p USING (symbol))
SELECT symbol, round(auc, 4) AS rolling_auc, baseline_auc, round(coalesce(baseline_auc - auc, 0), 4) AS decay, n_predictions,
       CASE WHEN n_predictions < 10 THEN 'INSUFFICIENT_DATA' WHEN auc IS NULL THEN 'SINGLE_CLASS' WHEN baseline_auc - auc >= 0.05 THEN 'CRITICAL'
            WHEN baseline_auc - auc >= 0.03 THEN 'DEGRADING' ELSE 'NONE' END AS alert,
       n_predictions >= 10 AND auc IS NOT NULL AND baseline_auc - auc >= 0.05 AS should_retrain
FROM base""")
def rolling_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") > 0.05).cast("int").alias("label"), "l_orderkey", "l_linenumber"
    )
    baselines = spark.createDataFrame([("A", 0.6), ("N", 0.54), ("R", 0.5)], "symbol string, baseline_auc double")
    return monitoring.recent_auc(rows, ["l_orderkey", "l_linenumber"], baselines)


@query("""
WITH rows AS (SELECT l_returnflag AS symbol, round(l_quantity * l_discount, 9) AS x, l_orderkey % 2 AS half FROM lineitem),
edges AS (SELECT symbol, list_transform(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda e: round(e, 9)) AS edges FROM rows WHERE half = 0 GROUP BY 1),
binned AS (
  SELECT r.symbol, half, len(list_filter(edges, lambda e: e < x)) AS bin, count(*) AS n FROM rows r JOIN edges USING (symbol) GROUP BY ALL),
grid AS (SELECT symbol, unnest(range(10)) AS bin FROM edges),
shares AS (
  SELECT g.symbol, g.bin,
         greatest(coalesce(e.n, 0) / sum(coalesce(e.n, 0)) OVER (PARTITION BY g.symbol), 1e-6) AS e,
         greatest(coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER (PARTITION BY g.symbol), 1e-6) AS a
  FROM grid g LEFT JOIN binned e ON e.symbol = g.symbol AND e.bin = g.bin AND e.half = 0
              LEFT JOIN binned a ON a.symbol = g.symbol AND a.bin = g.bin AND a.half = 1)
SELECT symbol, round(sum((a - e) * ln(a / e)), 6) AS psi FROM shares GROUP BY 1""")
def stability_index(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), (F.col("l_quantity") * F.col("l_discount")).alias("x"), (F.col("l_orderkey") % 2).alias("half")
    )
    return rounded(monitoring.stability_index(rows.filter("half = 0"), rows.filter("half = 1"), "x"), 6, "psi")


@query(f"""
WITH {DAILY}, numbered AS (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS n, count(*) OVER (PARTITION BY symbol) AS total FROM daily),
folds AS (SELECT *, unnest(range(5)) AS k FROM numbered),
edges AS (SELECT *, k * (total // 5) AS a, CASE WHEN k = 4 THEN total ELSE (k + 1) * (total // 5) END AS b FROM folds WHERE total >= 5)
SELECT symbol, date, CAST(k AS INTEGER) AS fold,
       CASE WHEN n >= a AND n < b THEN 'test' WHEN n < a - 5 OR (k < 4 AND n >= b + 2) THEN 'train' ELSE 'purged' END AS role
FROM edges WHERE a - 5 > 0 OR (k < 4 AND b + 2 < total)""")
def purged_folds(spark, sf_dir):
    return monitoring.purged_folds(daily_orders(spark, sf_dir))


@query("""
SELECT o_orderpriority AS gate, count(*) FILTER (o_orderstatus = 'F') AS n_pass, count(*) FILTER (o_orderstatus = 'O') AS n_block,
       count(*) FILTER (o_orderstatus = 'P') AS n_reduce, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 3) AS block_rate
FROM orders GROUP BY 1""")
def gate_audit(spark, sf_dir):
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("gate"))
        .agg(
            status("F").alias("n_pass"),
            status("O").alias("n_block"),
            status("P").alias("n_reduce"),
            F.round(status("O") / F.count(F.lit(1)), 3).alias("block_rate"),
        )
    )


@query("""
WITH slip AS (SELECT l_shipmode, x FROM (SELECT l_returnflag AS l_shipmode, (l_discount - l_tax) * 10000 AS x FROM lineitem))
SELECT l_shipmode AS direction, count(*) AS n, round(avg(x), 4) AS mean_bps, round(median(x), 4) AS median_bps, round(max(x), 4) AS worst_bps,
       round(avg(CASE WHEN x <= 0 THEN 1.0 ELSE 0.0 END), 6) AS favorable
FROM slip GROUP BY 1""")
def slippage_summary(spark, sf_dir):
    x = (F.col("l_discount") - F.col("l_tax")) * 10000
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("direction"), x.alias("x"))
    found = rows.groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"),
        F.mean("x").alias("mean_bps"),
        F.max("x").alias("worst_bps"),
        F.round(F.mean((F.col("x") <= 0).cast("double")), 6).alias("favorable"),
    )
    middle = exact_quantiles(rows, ["direction"], "x", [0.5], "middle").select("direction", F.get("middle", 0).alias("median_bps"))
    return rounded(found.join(middle, "direction"), 4, "mean_bps", "median_bps", "worst_bps")


@query("""
SELECT d.source, count(*) AS n, count(l.doc_id) AS n_scored, round(avg(l.quality), 6) AS mean_score,
       round(avg(CASE WHEN l.toxic = 1 THEN 1.0 WHEN l.toxic = 0 THEN 0.0 END), 6) AS negative_share
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def headline_aggregates(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic"), F.col("doc_id") == F.col("_id"), "left"
    )
    found = joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("_id").alias("n_scored"), F.mean("quality").alias("mean_score"), F.mean("toxic").alias("negative_share")
    )
    return rounded(found, 6, "mean_score", "negative_share")


@query(f"""
WITH {DAILY}
SELECT symbol, year(date) AS year, count(*) AS days, CAST(sum(volume) AS BIGINT) AS n_bars, sum(CASE WHEN volume < 2 THEN 1 ELSE 0 END)::BIGINT AS sparse_days,
       min(date) AS first_date, max(date) AS last_date
FROM daily GROUP BY 1, 2""")
def coverage(spark, sf_dir):
    daily = daily_orders(spark, sf_dir)
    return daily.groupBy("symbol", F.year("date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("volume").alias("n_bars"),
        F.count_if(F.col("volume") < 2).alias("sparse_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
