"""Queries of block structure, path signatures and timing features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators.bars import minute_of_day
from tidemark.plans.catalog import RETURNS, query, returns
from tidemark.plans.frames import MINUTES, minutes
from tidemark.plans.kernels import shown


def _over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY date)" if k else x


def _least(aggregate: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {_over(n)} >= {least} THEN {aggregate}({x}) {_over(n)} END"


def _clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def _true(test: str) -> str:
    return f"CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0 END"


def _z(x: str, n: int, least: int) -> str:
    return _clip(f"({x} - {_least('avg', x, n, least)}) / ({_least('stddev_samp', x, n, least)} + 1e-10)", -4, 4)


def _whole(names: list[str]) -> str:
    return ", ".join(f"coalesce(round(CASE WHEN isfinite({c}) THEN {c} END, 6), 0) + 0.0 AS {c}" for c in names)


def _blocks_sql() -> str:
    found, later = {}, {}
    for n in (3, 5):
        p, b = f"blk_{n}d_", f"blk_boundary_{n}d_"
        moves = [_lag("ret", k) for k in range(n - 1, -1, -1)]
        sizes = f"[{', '.join(f'abs({m})' for m in moves)}]"
        closes = [_lag("close", k) for k in range(n - 1, -1, -1)]
        found |= {
            f"{p}return": f"r{n}",
            f"{p}consistency": f"greatest(count(*) FILTER (way > 0) {_over(n)}, count(*) FILTER (way < 0) {_over(n)}) / {n}",
            f"{p}pattern_score": "(" + " + ".join(f"{_lag('way', k)} * {n - k}" for k in range(n)) + f") / {sum(range(1, n + 1))}",
            f"{p}acceleration": f"{moves[2]} - {moves[0]}" if n == 3 else f"({moves[3]} + {moves[4]}) / 2 - ({moves[0]} + {moves[1]}) / 2",
            f"{p}reversal_boundary": f"CASE WHEN {_lag(f'r{n}', n)} IS NOT NULL THEN CAST(sign(r{n}) IS DISTINCT FROM sign({_lag(f'r{n}', n)}) AS INTEGER) END",
            f"{p}where_extreme": f"CASE WHEN n >= {n} THEN coalesce((list_position({sizes}, list_max({sizes})) - 1) / {n - 1}, 0.5) END",
            f"{p}front_vs_back": f"{moves[0]} - ({moves[1]} + {moves[2]}) / 2" if n == 3 else f"({moves[0]} + {moves[1]}) / 2 - ({moves[2]} + {moves[3]} + {moves[4]}) / 3",
            f"{p}range_position": f"(close - min(low) {_over(n)}) / (max(high) {_over(n)} - min(low) {_over(n)} + 1e-10)",
            f"{p}vol_trend": _clip(f"(volume - {_lag('volume', n - 1)}) / ({_least('avg', 'volume', 20, 5)} + 1e-10)", -3, 3),
            f"{p}vol_concentration": f"max(volume) {_over(n)} / (sum(volume) {_over(n)} + 1e-10)",
            f"{p}vwap_vs_close": f"(sum(close * volume) {_over(n)} / (sum(volume) {_over(n)} + 1e-10) - close) / (close + 1e-10)",
            f"{b}gap": f"({_lag('open', n - 1)} - {_lag('close', n)}) / ({_lag('close', n)} + 1e-10)",
            f"{b}vol_shift": _clip(f"{_lag('volume', n - 1)} / ({_lag('volume', n)} + 1e-10)", 0.1, 10),
            f"{b}revert": _z("close", 5 * n, 5 if n == 3 else 10),
            f"again{n}": f"coalesce(sign(r{n}) = sign({_lag(f'r{n}', n)}) AND r{n} <> 0, false)",
            f"earlier{n}": _lag(f"r{n}", n),
            f"levels{n}": f"CASE WHEN n >= {n} THEN list_transform([{', '.join(closes)}], lambda c: c / {closes[0]}) END",
        }
        window, least = (60, 10) if n == 3 else (50, 15)
        pair = f"CASE WHEN earlier{n} IS NOT NULL THEN r{n} END"
        peaks = f"list_transform(levels{n}, lambda x, i: list_max(levels{n}[1:i]))"
        later |= {
            f"depths{n}": f"list_transform(levels{n}, lambda x, i: (x - list_max(levels{n}[1:i])) / (list_max(levels{n}[1:i]) + 1e-10))",
            f"peaks{n}": peaks,
            f"{b}streak": f"(n - max(CASE WHEN NOT again{n} THEN n END) OVER (PARTITION BY symbol, n % {n} ORDER BY date)) / {n} + 1",
            f"{p}autocorr": f"CASE WHEN count({pair}) {_over(window)} >= {least} THEN corr(r{n}, earlier{n}) {_over(window)} END",
            f"{p}vol_return_agree": f"avg(with_volume) {_over(n)}",
        }
    way = lambda a, b: f"coalesce(sign(r{a}) = sign(r{b}), false)"
    scale = lambda a, b, c: f"({' + '.join(f'CAST({way(x, y)} AS INTEGER)' for x, y in ((a, b), (b, c), (a, c)))}) / 3 * 2 - 1"
    over = lambda x: f"CASE WHEN coalesce({x}, 0) = 0 THEN 1e-10 ELSE {x} END"
    volumes = [f"avg(volume) {_over(n)}" for n in (3, 5, 10)]
    found |= {
        "blk_3d_vs_5d_agreement": f"CASE WHEN {way(3, 5)} THEN 1 ELSE -1 END",
        "blk_sequential_strength": _clip(f"r3 / (nullif({_lag('r3', 3)}, 0) + 1e-10)", -3, 3),
        "blk_cascade_3_5_10": scale(3, 5, 10),
        "blk_cascade_5_10_20": scale(5, 10, 20),
        "blk_cascade_full": "CASE WHEN r3 > 0 AND r5 > 0 AND r10 > 0 AND r20 > 0 THEN 1 WHEN r3 < 0 AND r5 < 0 AND r10 < 0 AND r20 < 0 THEN -1 END",
        "blk_cascade_break_short": f"1 - CAST({way(3, 10)} AS INTEGER)",
        "blk_cascade_break_long": f"1 - CAST({way(10, 20)} AS INTEGER)",
        "blk_cascade_ratio_3_10": _clip(f"r3 / ({over('r10')})", -5, 5),
        "blk_cascade_ratio_5_20": _clip(f"r5 / ({over('r20')})", -5, 5),
        "blk_cascade_vol_expand": _true(f"{volumes[0]} > {volumes[1]} AND {volumes[1]} > {volumes[2]}"),
        "blk_cascade_vol_compress": _true(f"{volumes[0]} < {volumes[1]} AND {volumes[1]} < {volumes[2]}"),
        "blk_cascade_return_rank": f"CASE WHEN n < 5 THEN 0 WHEN ret IS NULL THEN 0.5 ELSE len(list_filter(list(abs(ret)) {_over(5)}, lambda x: x <= abs(ret))) / count(ret) {_over(5)} END",
        "blk_return_roughness": _clip(f"{_least('sum', 'abs(ret)', 5, 2)} / (abs(r5) + 1e-10)", 0, 20),
        "blk_3d_kurtosis": _clip(_least("kurtosis", "ret", 15, 8), -10, 50),
        "blk_5d_dispersion": _least("stddev_samp", "r5", 50, 10),
        "same": _true(f"way = {_lag('way', 1)}"),
        "with_volume": _true(f"way = sign(volume / {_lag('volume', 1)} - 1)"),
    }
    drops = {}
    for n in (3, 5):
        at = f"list_position(depths{n}, list_min(depths{n}))"
        back = f"(levels{n}[{n}] - levels{n}[{at}]) / (peaks{n}[{at}] - levels{n}[{at}] + 1e-10)"
        drops |= {
            f"blk_{n}d_max_drawdown": f"abs(list_min(depths{n}))",
            f"blk_{n}d_recovery_ratio": f"CASE WHEN levels{n} IS NULL THEN 0 WHEN abs(list_min(depths{n})) > 1e-6 THEN least(greatest({back}, 0), 1) ELSE 1 END",
        }
    later["blk_hurst_proxy"] = _least("avg", "same", 20, 5)
    listed = lambda found: ", ".join(f"{x} AS {c}" for c, x in found.items())
    return f"""
WITH {RETURNS}, moved AS (SELECT *, sign(ret) AS way, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, {", ".join(f"close / {_lag('close', k)} - 1 AS r{k}" for k in (3, 5, 10, 20))} FROM returns),
found AS (SELECT *, {listed(found)} FROM moved), later AS (SELECT *, {listed(later)} FROM found), dropped AS (SELECT *, {listed(drops)} FROM later)
SELECT symbol, date, {_whole(blocks.BLOCKS)} FROM dropped"""


@query(_blocks_sql())
def block_structure_features(spark, sf_dir):
    return shown(blocks.block_structure(returns(spark, sf_dir)), 6)


def _signatures_sql() -> str:
    """Windows as lists, every step times the sum of the steps before it."""
    parts = {}
    for n in (5, 10, 20):
        area = lambda a, b, n=n: f"list_sum([{a}{n}[j] * coalesce(list_sum({b}{n}[1:j - 1]), 0) for j in generate_series(1, {n})])"
        parts |= {
            f"psig_sig1_{n}d": f"list_sum(x{n})",
            f"psig_sig2_{n}d": area("x", "y"),
            f"psig_sig2_anti_{n}d": f"{area('x', 'y')} - {area('y', 'x')}",
            f"psig_logsig1_{n}d": f"sign(list_sum(x{n})) * ln(1 + abs(list_sum(x{n})))",
            f"psig_path_length_{n}d": f"list_sum([abs(v) for v in x{n}])",
        }
    lists = ", ".join(f"list({c}) {_over(n)} AS {c}{n}" for n in (5, 10, 20) for c in "xy")
    return f"""
WITH {RETURNS}, usual AS (SELECT symbol, date, coalesce(ret, 0) AS x, CASE WHEN count(*) {_over(20)} >= 20 THEN volume / avg(volume) {_over(20)} ELSE 1 END AS v FROM returns),
steps AS (SELECT symbol, date, x, v - coalesce({_lag("v", 1)}, v) AS y FROM usual),
listed AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, {lists} FROM steps),
found AS (SELECT symbol, date, {", ".join(f"CASE WHEN n >= {c.split('_')[-1][:-1]} THEN {x} END AS {c}" for c, x in parts.items())} FROM listed),
compared AS (SELECT *, psig_sig2_20d / (abs(psig_sig2_5d) + 1e-10) AS psig_sig_ratio, {_z("psig_sig2_anti_20d", 60, 20)} AS psig_momentum_asym FROM found)
SELECT symbol, date, {_whole(blocks.SIGNED)} FROM compared"""


@query(_signatures_sql())
def path_signature_features(spark, sf_dir):
    return shown(blocks.path_signatures(returns(spark, sf_dir)), 6)


def _timing_sql() -> str:
    usual = _least("avg", "volatility_5d", 20, 20)
    return f"""
WITH {RETURNS}, shaped AS (
  SELECT *, ret AS prev_return, (high - low) / open AS prev_range, abs(close - open) / open AS prev_body, (high - greatest(open, close)) / open AS prev_upper_wick,
         (least(open, close) - low) / open AS prev_lower_wick, (close - low) / (high - low + 1e-8) AS body_position, {_least("stddev_samp", "ret", 5, 5)} AS volatility_5d,
         {_least("stddev_samp", "ret", 20, 20)} AS volatility_20d, {_least("avg", "(high - low) / open", 5, 5)} AS range_5d_avg,
         {", ".join(f"close / {_lag('close', n)} - 1 AS momentum_{n}d" for n in (3, 5, 10))}, {", ".join(f"close / ({_least('avg', 'close', n, n)}) - 1 AS close_vs_ma{n}" for n in (5, 20))},
         isodow(date) - 1 AS day_of_week, CAST(isodow(date) = 1 AS INTEGER) AS is_monday, CAST(isodow(date) = 5 AS INTEGER) AS is_friday,
         volume / ({_least("avg", "volume", 20, 20)}) AS volume_ratio, volume / {_lag("volume", 5)} - 1 AS volume_trend, open / {_lag("close", 1)} - 1 AS gap,
         {_true(f"{_lag('low', 1)} <= {_lag('close', 2)} OR {_lag('high', 1)} >= {_lag('close', 2)}")} AS gap_filled_prev
  FROM returns),
found AS (
  SELECT *, volatility_5d / (volatility_20d + 1e-8) AS volatility_ratio, prev_range / (range_5d_avg + 1e-8) AS range_vs_avg, {usual} * 60 AS similar_day_entry, 300 + {usual} * 60 AS similar_day_exit
  FROM shaped)
SELECT symbol, date, {_whole(blocks.TIMED)} FROM found"""


@query(_timing_sql())
def timing_features(spark, sf_dir):
    return shown(blocks.timing_features(returns(spark, sf_dir)), 6)


@query(f"""
WITH {MINUTES}, placed AS (SELECT *, CAST(ts AS DATE) AS date, hour(ts) * 60 + minute(ts) AS minute FROM minutes),
days AS (
  SELECT symbol, date, max(high) FILTER (minute < 570) AS high, min(low) FILTER (minute < 570) AS low, arg_max(close, minute) FILTER (minute < 570) AS close,
         arg_min(open, minute) FILTER (minute < 570) AS open, sum(volume) FILTER (minute < 570) AS early, sum(volume) AS volume, arg_min(close, minute) AS first
  FROM placed GROUP BY 1, 2)
SELECT symbol, date, round((high - low) / close, 6) AS pm_range, round((close - open) / open, 6) + 0.0 AS pm_direction, round(CASE WHEN volume > 0 THEN early / volume END, 6) AS pm_volume_pct,
       round(CASE WHEN first > 0 THEN close / first - 1 END, 6) + 0.0 AS pm_vs_prev_close
FROM days""")
def premarket_shape(spark, sf_dir):
    rows = minutes(spark, sf_dir).withColumns({"date": F.to_date("ts"), "minute": minute_of_day("ts")})
    return shown(blocks.premarket_shape(rows), 6)
