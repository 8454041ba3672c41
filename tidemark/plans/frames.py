"""Queries of resampling, the daily frame and targets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import frame as frames
from tidemark.operators import resample, targets
from tidemark.plans.catalog import DAILY, RETURNS, SESSION_SQL, query, returns, rounded
from tidemark.sources.market import daily_orders, traded

MINUTES = f"""minutes AS (
  SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, sum(k) AS volume, count(*) AS trade_count, sum(value * k) / nullif(sum(k), 0) AS vwap,
         CAST(min(ts) AS DATE) AS date, min({SESSION_SQL}) AS session
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1, 2)"""


def minutes(spark, sf_dir):
    return resample.minute_bars(traded(spark, sf_dir))


def _resampled_sql(width: int, keys: str, alone: bool = True, origin: str = "date") -> str:
    own = f"sum(n) OVER (PARTITION BY {keys}) = 1" if alone else "false"
    return f"""WITH {MINUTES}, dated AS (SELECT *, {origin} AS origin FROM minutes),
binned AS (
  SELECT {keys}, origin, CAST(floor(date_diff('second', CAST(origin AS TIMESTAMP), ts) / {60 * width}) AS BIGINT) AS place,
         arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
         CAST(sum(trade_count) AS BIGINT) AS trade_count, sum(vwap * volume) / nullif(sum(volume), 0) AS vwap,
         min(ts) AS own_ts, min(vwap) AS own_vwap, count(*) AS n FROM dated GROUP BY {keys}, origin, place)
SELECT {keys}, CASE WHEN {own} THEN own_ts ELSE CAST(origin AS TIMESTAMP) + to_minutes(place * {width}) END AS ts,
       open, high, low, close, volume, trade_count, round(CASE WHEN {own} THEN own_vwap ELSE vwap END, 6) AS vwap
FROM binned"""


def _plain(found):
    return rounded(found, 6, "vwap").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_resampled_sql(60, "symbol, date, session"))
def session_resampling(spark, sf_dir):
    return _plain(resample.resample(minutes(spark, sf_dir), resample.minutes_of("1h")))


@query(_resampled_sql(15, "symbol, date"))
def date_resampling(spark, sf_dir):
    return _plain(resample.resample(minutes(spark, sf_dir), resample.minutes_of("15min"), "date"))


@query(_resampled_sql(7, "symbol", False, "min(date) OVER (PARTITION BY symbol)"))
def plain_resampling(spark, sf_dir):
    return _plain(resample.resample(minutes(spark, sf_dir), resample.minutes_of("7m"), "none"))


def _frame_sql() -> str:
    of = lambda session, agg: f"{agg} FILTER (session = '{session}')"
    upto = lambda t: f"session = 'regular' AND minute <= {int(t[:2]) * 60 + int(t[2:])}"
    days = []
    for short, name in (("pm", "premarket"), ("ah", "afterhours"), ("reg", "regular")):
        parts = {"n": "count(*)", "open": "arg_min(open, ts)", "close": "arg_max(close, ts)", "high": "max(high)", "low": "min(low)"}
        days += [f"{of(name, agg)} AS {short}_{what}" for what, agg in parts.items()]
        days += [f"coalesce({of(name, 'sum(volume)')}, 0) AS {short}_vol"]
    days += [
        f"{of('premarket', 'sum(close * volume)')} AS pm_value",
        f"{of('premarket', 'avg(CASE WHEN rises THEN 1.0 WHEN NOT rises THEN 0.0 END)')} AS pm_rising",
        *[f"arg_min(open, ts) FILTER (session = 'premarket' AND from_end <= {n}) AS pm_open_{n}" for n in (30, 60)],
        f"{of('regular', 'min(minute)')} AS open_minute",
        f"{of('regular', 'first(minute ORDER BY high DESC, minute)')} AS high_minute",
        f"{of('regular', 'first(minute ORDER BY low, minute)')} AS low_minute",
    ]
    for t in frames.KEY_TIMES:
        days += [f"{agg} FILTER ({upto(t)}) AS {what}_{t}" for what, agg in (("close", "arg_max(close, ts)"), ("high", "max(high)"), ("low", "min(low)"))]
    days += [f"max(high) FILTER (session = 'regular' AND minute >= {int(t[:2]) * 60 + int(t[2:])}) AS high_from_{t}" for t in frames.ENTRY_TIMES]
    way = lambda x: f"CASE WHEN {x} > 0.001 THEN 1 WHEN {x} < -0.001 THEN -1 ELSE 0 END"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE 0 END"
    pm, ah = "pm_n >= 5", "ah_n >= 5"
    move = {s: f"(({s}_close - {s}_open) / {s}_open)" for s in ("pm", "ah", "reg")}
    each = {
        "pm_return": when(pm, move["pm"]),
        "pm_range": when(pm, "(pm_high - pm_low) / pm_open"),
        "pm_direction": when(pm, way(move["pm"])),
        "pm_vwap_dev": when(pm, "(pm_close - pm_value / (pm_vol + 1)) / nullif(pm_value / (pm_vol + 1), 0)"),
        "pm_high_low_ratio": when(pm, "pm_high / (pm_low + 0.01)"),
        "pm_volume": when(pm, "pm_vol"),
        "pm_bar_count": when(pm, "pm_n"),
        **{f"pm_mom_{n}": when(pm, f"(pm_close - pm_open_{n}) / pm_open_{n}") for n in (30, 60)},
        "pm_trend_consistency": when(pm, "coalesce(pm_rising, 0.5)"),
        "x_return": when(ah, move["ah"]),
        "x_range": when(ah, "(ah_high - ah_low) / ah_open"),
        "x_direction": when(ah, way(move["ah"])),
        "x_volume": when(ah, "ah_vol"),
        "day_return": move["reg"],
        "day_range": "(reg_high - reg_low) / reg_open",
        "day_volume": "reg_vol",
        "last_close": "CASE WHEN reg_n > 0 THEN reg_close END",
        "high_minutes": "high_minute - open_minute",
        "low_minutes": "low_minute - open_minute",
        "low_before_high": "low_minute < high_minute",
    }
    for t in frames.KEY_TIMES:
        some = f"close_{t} IS NOT NULL"
        each |= {
            f"return_at_{t}": when(some, f"(close_{t} - reg_open) / reg_open"),
            f"high_to_{t}": when(some, f"(high_{t} - reg_open) / reg_open"),
            f"low_to_{t}": when(some, f"(low_{t} - reg_open) / reg_open"),
            f"range_to_{t}": when(some, f"(high_{t} - low_{t}) / reg_open"),
            f"return_from_low_{t}": when(f"{some} AND low_{t} > 0", f"(close_{t} - low_{t}) / low_{t}"),
        }
    for t in frames.ENTRY_TIMES:
        each[f"max_gain_from_{t}"] = when(f"close_{t} IS NOT NULL AND high_from_{t} IS NOT NULL", f"(high_from_{t} - close_{t}) / close_{t}")
    lag = lambda x, k: f"coalesce(lag({x}, {k}) OVER w, 0)"
    lags = {}
    for k in (1, 2, 3, 5):
        lags |= {f"ah_{x}_lag{k}": lag(f"x_{x}", k) for x in ("return", "range", "direction", "volume")}
        lags |= {f"pm_{x}_lag{k}": lag(f"pm_{x}", k) for x in ("return", "direction")}
    for k, use in ((1, 1), (2, 2), (3, 3), (5, 5), (10, 5)):
        lags |= {f"day_{x}_lag{k}": lag(f"day_{x}", use) for x in ("return", "range")}
    last = {
        "overnight_return": when("pm_n >= 5 AND before IS NOT NULL", "(pm_close - before) / before"),
        "gap_pct": when("before IS NOT NULL", "(reg_open - before) / before"),
        "pm_ah_agree": when("pm_direction = ah_direction_lag1 AND pm_direction <> 0", "1"),
        "pm_direction_streak": " + ".join(f"({when(f'pm_direction_lag{k} = pm_direction AND pm_direction <> 0', '1')})" for k in (1, 2, 3)),
        "is_up_day": "day_return > 0.005",
        "is_down_day": "day_return < -0.005",
    }
    listed = lambda found: ", ".join(f"{x} AS {name}" for name, x in found.items())
    shown = [c for c in [*each, *lags] if not c.startswith("x_") and c != "last_close"]
    whole = ("low_before_high", "pm_direction", "pm_bar_count")
    out = [c if c in whole or "direction" in c else f"round({c}, 8) AS {c}" for c in shown]
    out += [f"{x} AS {c}" if c not in ("overnight_return", "gap_pct") else f"round({x}, 8) AS {c}" for c, x in last.items()]
    return f"""WITH {MINUTES}, placed AS (
  SELECT *, hour(ts) * 60 + minute(ts) AS minute, row_number() OVER (PARTITION BY symbol, date, session ORDER BY ts DESC) AS from_end,
         close > lag(close) OVER (PARTITION BY symbol, date, session ORDER BY ts) AS rises FROM minutes),
days AS (SELECT symbol, date, {", ".join(days)} FROM placed GROUP BY 1, 2),
each AS (SELECT symbol, date, reg_n, pm_n, pm_close, reg_open, {listed(each)} FROM days),
lagged AS (SELECT *, lag(last_close) OVER w AS before, {listed(lags)} FROM each WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, {", ".join(out)} FROM lagged WHERE reg_n >= 5"""


@query(_frame_sql())
def daily_frame(spark, sf_dir):
    found = frames.daily_frame(minutes(spark, sf_dir), least_regular=5)
    numbers = [c for c, kind in found.dtypes if kind == "double"]
    return rounded(found, 8, *numbers)


@query(f"""
WITH {MINUTES}, placed AS (
  SELECT *, hour(ts) * 60 + minute(ts) - 570 AS minute, close / nullif(lag(close) OVER (PARTITION BY symbol, date ORDER BY ts), 0) - 1 AS move FROM minutes),
days AS (
  SELECT symbol, date, count(*) AS n, arg_min(open, ts) AS day_open, arg_max(close, ts) AS day_close, max(high) AS day_high, min(low) AS day_low,
         max(high) - min(low) AS day_range, stddev_samp(move) * sqrt(count(*)) AS vol, avg(close) FILTER (minute BETWEEN 0 AND 120) AS mean_entry,
         first(ts ORDER BY low, ts) FILTER (minute BETWEEN 0 AND 120) AS at, count(*) FILTER (minute BETWEEN 180 AND 385) AS n_exits
  FROM placed GROUP BY 1, 2),
entries AS (SELECT d.*, p.low AS entry_price, p.minute AS entry_minute FROM days d JOIN placed p ON p.symbol = d.symbol AND p.ts = d.at WHERE n >= 10 AND n_exits > 0),
exits AS (
  SELECT e.symbol, e.date, coalesce(first(p.ts ORDER BY p.high DESC, p.ts) FILTER (p.ts > e.at), first(p.ts ORDER BY p.high DESC, p.ts)) AS out
  FROM entries e JOIN placed p ON p.symbol = e.symbol AND p.date = e.date AND p.minute BETWEEN 180 AND 385 GROUP BY 1, 2),
trades AS (
  SELECT e.*, p.high AS exit_price, p.minute AS exit_minute, (p.high - entry_price) / nullif(entry_price, 0) AS best, (day_high - day_low) / nullif(day_low, 0) AS possible,
         abs(mean_entry - entry_price) / nullif(entry_price, 0) AS benefit,
         (SELECT (entry_price - min(h.low)) / nullif(entry_price, 0) FROM placed h WHERE h.symbol = e.symbol AND h.date = e.date AND h.ts BETWEEN e.at AND x.out) AS adverse
  FROM entries e JOIN exits x USING (symbol, date) JOIN placed p ON p.symbol = x.symbol AND p.ts = x.out)
SELECT symbol, date, entry_price, CAST(entry_minute AS DOUBLE) AS entry_minute, exit_price, CAST(exit_minute AS DOUBLE) AS exit_minute,
       round(best, 8) AS best_return, round((day_close - day_open) / nullif(day_open, 0), 8) AS open_to_close, round(day_range, 8) AS day_range,
       round(day_range / nullif(day_open, 0), 8) AS day_range_pct, round(vol, 8) AS day_volatility, round(adverse, 8) AS max_adverse,
       CASE WHEN adverse IS NOT NULL THEN round(least(0.05, adverse + 0.002), 8) END AS stop_pct,
       CASE WHEN best IS NOT NULL THEN round(least(greatest(abs(best) - 0.001, 0.005), 0.05), 8) END AS take_profit_pct,
       CASE WHEN best IS NOT NULL AND vol IS NOT NULL THEN
         round(least(greatest(0.1 * least(greatest(0.015 / greatest(vol, 0.005), 0.5), 1.5) * least(greatest(abs(best) / 0.01, 0.5), 2.0), 0.05), 0.25), 8) END AS position_pct,
       round(benefit, 8) AS batching_benefit, benefit > 0.001 AS should_batch,
       CAST(CASE WHEN vol IS NULL THEN NULL WHEN vol > 0.02 THEN 4 WHEN vol > 0.015 THEN 3 WHEN vol > 0.01 THEN 2 ELSE 1 END AS BIGINT) AS batches,
       round(possible, 8) AS max_possible_return, CASE WHEN possible IS NOT NULL THEN round(best / greatest(possible, 0.001), 8) END AS capture_efficiency
FROM trades""")
def timing_targets(spark, sf_dir):
    found = targets.timing_targets(minutes(spark, sf_dir))
    plain = ("entry_price", "entry_minute", "exit_price", "exit_minute")
    return rounded(found, 8, *[c for c, kind in found.dtypes if kind == "double" and c not in plain])


@query(f"""
WITH frame AS ({_frame_sql()})
SELECT symbol, date, day_return > 0.0025 AS target_up, low_before_high AS target_timing,
       round(1 / (1 + exp(-50 * (day_return - 0.0025))), 6) AS soft_target_up, CASE WHEN day_return > 0.0025 THEN 0.95 ELSE 0.05 END AS smoothed_target_up,
       CASE WHEN low_before_high THEN 0.95 ELSE 0.05 END AS smoothed_target_timing,
       round(least(greatest(abs(day_return - 0.0025) * 100, 0.3), 1), 6) AS sample_weight,
       round(least(greatest(abs(high_minutes - low_minutes) / 200, 0.3), 1), 6) AS timing_weight
FROM frame""")
def soft_targets(spark, sf_dir):
    found = targets.soft_targets(daily_frame(spark, sf_dir))
    columns = ["target_up", "target_timing", "soft_target_up", "smoothed_target_up", "smoothed_target_timing", "sample_weight", "timing_weight"]
    return rounded(found.select("symbol", "date", *columns), 6, *columns[2:])


def _barriers_sql(source: str, take: str, stop: str, horizon: int) -> str:
    """``source``: a table ``prices`` of symbol, date, close without gaps, and what the barriers need."""
    return f"""{source}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM prices),
ahead AS (
  SELECT a.symbol, a.date, b.n - a.n AS k, b.close / a.close - 1 AS r, {take} AS take, {stop} AS stop
  FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.n > a.n AND b.n <= a.n + {horizon}),
first AS (
  SELECT symbol, date, min(CASE WHEN r >= take THEN k END) AS up, min(CASE WHEN r <= -stop THEN k END) AS down, max(k) AS far FROM ahead GROUP BY 1, 2),
touches AS (
  SELECT *, least(coalesce(up, far), coalesce(down, far), far) AS k, CASE WHEN up <= coalesce(down, up) THEN 'tp' WHEN down IS NOT NULL THEN 'sl' ELSE 'expiry' END AS kind FROM first),
labelled AS (
  SELECT t.symbol, t.date, kind AS touch_type, t.k AS touch_idx, h.r AS return_at_touch, CAST(kind = 'tp' AS BIGINT) AS "binary",
         CAST(CASE kind WHEN 'tp' THEN 1 WHEN 'sl' THEN -1 ELSE 0 END AS BIGINT) AS ternary FROM touches t JOIN ahead h ON h.symbol = t.symbol AND h.date = t.date AND h.k = t.k)"""


SPARSE = f"""{DAILY}, prices AS (
  SELECT * FROM (SELECT symbol, date, last_value(CASE WHEN volume <> 2 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS close FROM daily)
  WHERE close IS NOT NULL)"""


@query(f"""WITH {_barriers_sql(SPARSE, '0.3', '0.4', 7)}
SELECT symbol, date, touch_type, touch_idx, round(return_at_touch, 8) AS return_at_touch, round(p.close, 4) AS entry_price,
       round(p.close * (1 + return_at_touch), 4) AS touch_price, "binary", ternary, round(return_at_touch, 8) AS continuous
FROM labelled JOIN prices p USING (symbol, date) WHERE day(date) % 2 = 0""")
def barrier_modes(spark, sf_dir):
    """Labels of every other day, over closes with gaps."""
    daily = daily_orders(spark, sf_dir)
    closes = daily.select("symbol", "date", F.when(F.col("volume") != 2, F.col("close")).alias("close"))
    found = targets.barrier_labels(closes, 0.3, 0.4, 7, events=daily.filter(F.day("date") % 2 == 0))
    return rounded(rounded(found, 8, "return_at_touch", "continuous"), 4, "entry_price", "touch_price")


def _blended() -> str:
    parts = []
    for n in (5, 10, 21, 63):
        w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"CASE WHEN count(ret) {w} >= {max(2, n // 2)} THEN stddev_samp(ret) {w} END")
    return f"list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"


ADAPTIVE = f"""{RETURNS}, blended AS (SELECT symbol, date, close, {_blended()} AS vol FROM returns),
ratios AS (SELECT *, CASE WHEN vol IS NULL THEN 1 ELSE least(greatest(vol / greatest(median(vol) OVER (PARTITION BY symbol), 1e-8), 0.1), 10) END AS vol_ratio FROM blended),
prices AS (SELECT *, least(greatest(0.01 * vol_ratio, 0.002), 0.05) AS barrier FROM ratios)"""


@query(f"""WITH {_barriers_sql(ADAPTIVE, 'a.barrier', 'a.barrier', 5)}
SELECT symbol, date, round(vol_ratio, 6) AS vol_ratio, round(barrier, 8) AS barrier, touch_type, touch_idx, round(return_at_touch, 8) AS return_at_touch,
       "binary", ternary, round(1 / (1 + exp(-50 * return_at_touch)), 6) AS soft, CASE touch_type WHEN 'expiry' THEN 0.5 ELSE 0.9 END AS confidence
FROM labelled JOIN prices p USING (symbol, date)""")
def adaptive_labels(spark, sf_dir):
    found = targets.adaptive_labels(returns(spark, sf_dir)).drop("entry_price", "touch_price", "continuous")
    return rounded(rounded(found, 8, "barrier", "return_at_touch"), 6, "vol_ratio", "soft")


@query(f"""
WITH RECURSIVE {RETURNS}, numbered AS MATERIALIZED (
  SELECT symbol, date, ret, coalesce(ret, 0) AS r, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM returns),
levels AS MATERIALIZED (SELECT unnest(range(21)) AS level),
sums AS (
  SELECT symbol, n, level, 40.0 / pow(2, level) AS t, greatest(0, r) AS p, least(0, r) AS m FROM numbered, levels WHERE n = 1
  UNION ALL
  SELECT x.symbol, x.n, s.level, s.t, greatest(0, CASE WHEN s.p >= s.t THEN 0 ELSE s.p END + x.r), least(0, CASE WHEN s.m <= -s.t THEN 0 ELSE s.m END + x.r)
  FROM sums s JOIN numbered x ON x.symbol = s.symbol AND x.n = s.n + 1),
hits AS (SELECT symbol, n, level, p >= t OR m <= -t AS hit FROM sums),
counts AS (SELECT symbol, level, count(*) FILTER (hit) AS events, count(*) AS total FROM hits GROUP BY 1, 2),
chosen AS (
  SELECT symbol, CASE WHEN max(events) FILTER (level = 0) < 20 THEN -1 WHEN 1 - max(events) FILTER (level = 0) / max(total) <= 0.8 THEN 0
              ELSE coalesce(min(level) FILTER (level > 0 AND events >= ceil(total * (1 - 0.8))), -1) END AS level FROM counts GROUP BY 1)
SELECT x.symbol, x.date, round(x.ret, 8) AS ret, c.level AS halvings
FROM numbered x JOIN chosen c USING (symbol) LEFT JOIN hits h ON h.symbol = x.symbol AND h.n = x.n AND h.level = c.level WHERE c.level = -1 OR h.hit""")
def guarded_events(spark, sf_dir):
    return rounded(targets.guarded_events(returns(spark, sf_dir), 40.0, least_events=20), 8, "ret")
