"""Queries of the window kernels: causality, correlation matrices, long memory, regimes.

A symbol's returns are joined by date with those of four others, which stand for the other assets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import families
from tidemark.operators import kernels as K
from tidemark.plans.catalog import DAILY, RETURNS, query, returns

#: The symbols whose returns stand for the other assets.
OTHERS = {"vix": "2-HIGH", "tlt": "3-MEDIUM", "qqq": "4-NOT SPECIFIED", "gld": "5-LOW"}
PANEL = (
    RETURNS
    + ", panel AS (SELECT date, "
    + ", ".join(f"max(CASE WHEN symbol = '{symbol}' THEN ret END) AS {name}" for name, symbol in OTHERS.items())
    + " FROM returns GROUP BY 1), wide AS (SELECT * FROM returns JOIN panel USING (date))"
)


def panel(spark, sf_dir) -> DataFrame:
    rows = returns(spark, sf_dir)
    others = rows.groupBy("date").agg(*[F.max(F.when(F.col("symbol") == symbol, F.col("ret"))).alias(name) for name, symbol in OTHERS.items()])
    return rows.join(others, "date")


def shown(found: DataFrame, digits: int = 8, **others: int) -> DataFrame:
    """All features rounded, ``others`` to digits of their own; adding 0 leaves no negative zeros."""
    return found.withColumns({c: F.round(c, others.get(c, digits)) + 0.0 for c in found.columns if c not in ("symbol", "date")})


@query()
def causal_features(spark, sf_dir):
    return shown(K.causal(panel(spark, sf_dir), [*OTHERS, "volume"]))


def _entropy_sql() -> str:
    def state(x: str) -> str:
        w = "OVER (PARTITION BY symbol)"
        return f"CASE WHEN stddev_pop({x}) {w} < 1e-15 THEN 1 ELSE 1 + CAST({x} > avg({x}) {w} + stddev_pop({x}) {w} AS INTEGER) - CAST({x} < avg({x}) {w} - stddev_pop({x}) {w} AS INTEGER) END"

    names = list(OTHERS)
    by = "PARTITION BY symbol, name, date"
    return f"""
WITH {PANEL}, filled AS (SELECT symbol, date, coalesce(ret, 0) AS ret, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)} FROM wide),
states AS (SELECT symbol, date, {state("ret")} AS t, {", ".join(f"{state(n)} AS {n}" for n in names)} FROM filled),
long AS ({" UNION ALL ".join(f"SELECT symbol, date, '{n}' AS name, t, {n} AS s FROM states" for n in names)}),
coded AS (SELECT *, lag(s) OVER w * 9 + lag(t) OVER w * 3 + t AS code, row_number() OVER w AS n FROM long WINDOW w AS (PARTITION BY symbol, name ORDER BY date)),
windows AS (SELECT symbol, name, date, n, list(code) OVER (PARTITION BY symbol, name ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS codes FROM coded),
counted AS (SELECT symbol, name, date, code, count(*) / 50 AS p FROM (SELECT symbol, name, date, unnest(codes) AS code FROM windows WHERE n > 50) GROUP BY ALL),
terms AS (
  SELECT symbol, name, date, p * ln(p * sum(p) OVER ({by}, code // 3 % 3) / (sum(p) OVER ({by}, code // 3) * sum(p) OVER ({by}, code % 9))) AS term FROM counted),
found AS (SELECT symbol, name, date, greatest(sum(term), 0) AS te FROM terms GROUP BY ALL),
wide_again AS (
  SELECT f.symbol, f.date, {", ".join(f"coalesce(max(te) FILTER (name = '{n}'), 0) AS {n}" for n in names)} FROM filled f LEFT JOIN found g ON g.symbol = f.symbol AND g.date = f.date GROUP BY 1, 2)
SELECT symbol, date, {", ".join(f"round({n}, 8) AS te_{n}_to_spy" for n in names)}, round(greatest({", ".join(names)}), 8) AS te_max_inflow, round(({" + ".join(names)}) / 4, 8) AS te_net_flow
FROM wide_again"""


@query(_entropy_sql())
def transfer_entropy_features(spark, sf_dir):
    return shown(K.transfer_entropy(panel(spark, sf_dir), {name: name for name in OTHERS}))


@query()
def absorption_ratio_features(spark, sf_dir):
    return shown(K.absorption(panel(spark, sf_dir), ["ret", *OTHERS]), 6)


@query()
def absorption_ratio_features_from_bars(spark, sf_dir):
    return shown(K.absorption(returns(spark, sf_dir)), 6)


def _network_sql() -> str:
    series = ["ret", *OTHERS]
    nodes = range(len(series))
    frame = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    pairs = list(combinations(nodes, 2))
    link = lambda i, j: f"r{min(i, j)}{max(i, j)}"
    r = ", ".join(f"corr({series[i]}, {series[j]}) {frame} AS c{i}{j}" for i, j in pairs)
    known = " + ".join(f"CAST(count({s}) {frame} > 0 AS INTEGER)" for s in series)
    levels, last = [], "linked"
    for k in nodes:
        closed = ", ".join(
            f"{link(i, j)} OR ({link(i, k)} AND {link(k, j)}) AS {link(i, j)}" if k not in (i, j) else link(i, j) for i, j in pairs
        )
        levels.append(f"closed{k} AS (SELECT symbol, date, days, n, degrees, {closed} FROM {last})")
        last = f"closed{k}"
    parts = " + ".join(f"CAST(NOT ({' OR '.join(link(i, j) for i in range(j)) or 'false'}) AS INTEGER)" for j in nodes)
    degree = lambda i: " + ".join(f"CAST({link(i, j)} AS INTEGER)" for j in nodes if j != i)
    usual = frame
    return f"""
WITH {PANEL}, correlated AS (
  SELECT symbol, date, count(coalesce({", ".join(series)})) {frame} AS days, {known} AS n, {r} FROM wide),
linked AS (
  SELECT *, [{", ".join(degree(i) for i in nodes)}] AS degrees
  FROM (SELECT symbol, date, days, n, {", ".join(f"coalesce(NOT isnan(c{i}{j}) AND abs(c{i}{j}) > 0.5, false) AS r{i}{j}" for i, j in pairs)} FROM correlated)),
{", ".join(levels)},
measured AS (
  SELECT symbol, date, CASE WHEN days >= 20 AND n >= 2 THEN list_sum(degrees) / (n * (n - 1)) END AS density,
         CASE WHEN days >= 20 AND n >= 2 THEN 1 - 1.0 / ({parts} - ({len(series)} - n)) END AS modularity, CASE WHEN days >= 20 AND n >= 2 THEN list_max(degrees) END AS most
  FROM {last}),
scored AS (
  SELECT *, CASE WHEN count(density) {usual} >= 20 THEN (density - avg(density) {usual}) / (stddev_samp(density) {usual} + 1e-10) END AS z,
         (most - lag(most, 5) OVER (PARTITION BY symbol ORDER BY date)) / {len(OTHERS)} AS hub FROM measured)
SELECT symbol, date, coalesce(round(density, 6), 0) AS netw_density, coalesce(round(density, 6), 0) AS netw_avg_centrality, coalesce(round(z, 4), 0) + 0.0 AS netw_centrality_z,
       coalesce(round(modularity, 6), 0) AS netw_modularity, coalesce(round(hub, 6), 0) + 0.0 AS netw_hub_disconnect FROM scored"""


@query(_network_sql())
def network_features(spark, sf_dir):
    return shown(K.network(panel(spark, sf_dir), list(OTHERS)), 6, netw_centrality_z=4)


@query()
def har_rv_features(spark, sf_dir):
    return shown(K.heterogeneous_variance(returns(spark, sf_dir)), 6)


@query()
def hurst_features(spark, sf_dir):
    return shown(K.hurst(returns(spark, sf_dir)), 6)


@query(f"""
WITH RECURSIVE {DAILY}, moves AS (
  SELECT symbol, date, row_number() OVER w AS n, count(*) OVER (PARTITION BY symbol) AS days, coalesce((close - lag(close) OVER w) / (abs(lag(close) OVER w) + 1e-10), 0) AS move
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date)),
run AS (
  SELECT symbol, 0::BIGINT AS n, 0::BIGINT AS length, 0::DOUBLE AS total, 0::DOUBLE AS squares, 0::BIGINT AS regime, 0::DOUBLE AS probability FROM moves WHERE n = 1 AND days >= 10
  UNION ALL
  SELECT symbol, n, CASE WHEN new THEN 1 ELSE length END, CASE WHEN new THEN move ELSE total END, CASE WHEN new THEN move * move ELSE squares END,
         CASE WHEN new THEN (regime + 1) % 10 ELSE regime END, probability
  FROM (SELECT *, probability > 0.5 AND length > 10 AS new FROM (
    SELECT *, CASE WHEN length > 1 THEN least(1, 0.004 + 0.3 * greatest(0, abs(move - total / length) / (sqrt(greatest(squares / length - total / length * (total / length), 1e-10)) + 1e-10) - 2)) ELSE 0.004 END AS probability
    FROM (SELECT m.symbol, m.n, m.move, r.length + 1 AS length, r.total + m.move AS total, r.squares + m.move * m.move AS squares, r.regime
          FROM run r JOIN moves m ON m.symbol = r.symbol AND m.n = r.n + 1))))
SELECT m.symbol, m.date, CAST(coalesce(least(length, 252), 0) AS DOUBLE) AS cpd_run_length, coalesce(round(probability, 8), 0) AS cpd_prob_change, CAST(coalesce(regime, 0) AS DOUBLE) AS cpd_regime_id
FROM moves m LEFT JOIN run r ON r.symbol = m.symbol AND r.n = m.n""")
def changepoint_features(spark, sf_dir):
    return shown(K.changepoints(returns(spark, sf_dir)))


@query()
def mfdfa_features(spark, sf_dir):
    return shown(K.multifractal(returns(spark, sf_dir)), 6)


_PAST = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"


@query(f"""
WITH {RETURNS}, placed AS (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, coalesce(ret, 0) AS move FROM returns),
past AS (
  SELECT symbol, date, n, quantile_cont(move, 0.33) {_PAST} AS low, quantile_cont(move, 0.67) {_PAST} AS high, list(move) {_PAST} AS moves,
         avg(move) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS now FROM placed),
near AS (
  SELECT symbol, date, n, CASE WHEN n <= 120 THEN 1 WHEN now > high THEN 2 WHEN now < low THEN 0 ELSE 1 END AS state,
         1 / greatest(abs(now - coalesce(list_avg(list_filter(moves, lambda x: x <= low)), low)), 1e-10) AS bear,
         1 / greatest(abs(now - coalesce(list_avg(list_filter(moves, lambda x: x > low AND x <= high)), (low + high) / 2)), 1e-10) AS neutral,
         1 / greatest(abs(now - coalesce(list_avg(list_filter(moves, lambda x: x > high)), high)), 1e-10) AS bull FROM past),
changed AS (SELECT *, n > 121 AND state <> lag(state) OVER (PARTITION BY symbol ORDER BY n) AS moved FROM near),
begun AS (SELECT *, max(CASE WHEN moved OR n <= 121 THEN n END) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING) AS since FROM changed)
SELECT symbol, date, CAST(state AS DOUBLE) AS hmm_state, CASE WHEN n <= 120 THEN 0.33 ELSE round(bull / (bear + neutral + bull), 6) END AS hmm_bull_prob,
       CASE WHEN n <= 120 THEN 0.33 ELSE round(bear / (bear + neutral + bull), 6) END AS hmm_bear_prob, CAST(moved AS DOUBLE) AS hmm_transition_prob,
       CAST(n - since + 1 AS DOUBLE) AS hmm_regime_duration
FROM begun""")
def hmm_features(spark, sf_dir):
    return shown(K.quantile_states(returns(spark, sf_dir)), 6)


def _tails_sql(other: str) -> str:
    usual = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    return f"""
WITH {PANEL}, placed AS (SELECT symbol, date, ret AS a, {other} AS b, row_number() OVER w AS n FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY date)),
windows AS (SELECT symbol, date, n, list(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {{'a': a, 'b': b}} END) {usual} AS pairs FROM placed),
points AS (SELECT symbol, date, unnest(list_filter(pairs, lambda p: p IS NOT NULL)) AS p FROM windows WHERE n >= 60),
ranked AS (
  SELECT symbol, date, count(*) OVER w AS k, rank() OVER (PARTITION BY symbol, date ORDER BY p.a) / (count(*) OVER w + 1) AS x, rank() OVER (PARTITION BY symbol, date ORDER BY p.b) / (count(*) OVER w + 1) AS y
  FROM points WINDOW w AS (PARTITION BY symbol, date)),
tails AS (
  SELECT symbol, date, least(count(*) FILTER (x > 0.9 AND y > 0.9) / (count(*) * 0.1::DOUBLE), 1) AS upper, least(count(*) FILTER (x < 0.1 AND y < 0.1) / (count(*) * 0.1::DOUBLE), 1) AS lower
  FROM ranked WHERE k >= 15 GROUP BY 1, 2),
found AS (SELECT p.symbol, p.date, upper, lower FROM placed p LEFT JOIN tails t ON t.symbol = p.symbol AND t.date = p.date)
SELECT symbol, date, coalesce(round(upper, 6), 0) AS copula_upper_tail, coalesce(round(lower, 6), 0) AS copula_lower_tail, coalesce(round(upper - lower, 6), 0) + 0.0 AS copula_tail_asymmetry,
       coalesce(CASE WHEN count(lower) {usual} >= 30 THEN round((lower - avg(lower) {usual}) / (coalesce(stddev_samp(lower) {usual}, 0) + 1e-10), 4) END, 0) + 0.0 AS copula_tail_z
FROM found"""


@query(_tails_sql("qqq"))
def copula_features(spark, sf_dir):
    return shown(K.tail_dependence(panel(spark, sf_dir), "qqq"), 6, copula_tail_z=4)


@query(_tails_sql("lag(ret) OVER w"))
def copula_features_from_bars(spark, sf_dir):
    return shown(K.tail_dependence(returns(spark, sf_dir)), 6, copula_tail_z=4)


def _wavelet_sql() -> str:
    w = lambda n: f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    s = lambda x, n, least: f"CASE WHEN count({x}) {w(n)} >= {least} THEN stddev_samp({x}) {w(n)} END"
    shape = lambda c, low=-10, high=10: f"CASE WHEN {c} IS NOT NULL THEN round(least(greatest({c}, {low}), {high}), 6) ELSE 0 END + 0.0"
    plain = {"trend_5d": "t5", "trend_3d": "t3", "detail_1d": "d1", "detail_2d": "d2", "trend_momentum": "momentum", "noise_level": "noise", "denoised_return": "smooth", "cross_scale": "cross_scale"}
    return f"""
WITH RECURSIVE {DAILY}, details AS (
  SELECT symbol, date, row_number() OVER o AS n, count(*) OVER (PARTITION BY symbol) AS days, close / lag(close) OVER o - 1 AS d1, close / lag(close, 2) OVER o - 1 AS d2,
         (close - avg(close) {w(5)}) / (abs(close) + 1e-10) AS t5, (close - avg(close) {w(3)}) / (abs(close) + 1e-10) AS t3 FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY date)),
smoothed AS (
  SELECT symbol, n, d1 AS smooth FROM details WHERE n = 2
  UNION ALL SELECT d.symbol, d.n, s.smooth * (9.0 / 11) + d.d1 * (2.0 / 11) FROM smoothed s JOIN details d ON d.symbol = s.symbol AND d.n = s.n + 1),
found AS (
  SELECT symbol, date, days, d1, d2, t5, t3, smooth, {s("d1", 10, 3)} / ({s("t5", 10, 3)} + 1e-10) AS energy, (t5 - lag(t5, 20) OVER (PARTITION BY symbol ORDER BY date)) / 20 AS momentum,
         {s("d1", 20, 5)} AS noise, CASE WHEN count(d1) {w(20)} >= 5 THEN corr(d1, t5) {w(20)} END AS cross_scale
  FROM details LEFT JOIN smoothed USING (symbol, n))
SELECT symbol, date, {", ".join(f"CASE WHEN days >= 21 THEN {shape(c)} ELSE 0 END AS wav_{name}" for name, c in plain.items())},
       CASE WHEN days >= 21 THEN {shape("energy", 0, 20)} ELSE 0 END AS wav_energy_ratio, CASE WHEN days < 21 THEN 0.0 WHEN energy > 1.5 THEN 1.0 WHEN energy < 0.7 THEN -1.0 ELSE 0.0 END::DOUBLE AS wav_regime
FROM found"""


@query(_wavelet_sql())
def wavelet_features(spark, sf_dir):
    return shown(families.wavelets(returns(spark, sf_dir)), 6)
