"""The query of the multi-scale universes over small daily moves, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import multiscale
from tidemark.plans.catalog import DAILY, query, rounded
from tidemark.sources.market import daily_orders


def _draw(what: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', seed, '{what}', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _seed(name: str) -> int:
    return multiscale.UNIVERSES[f"multiscale_{name}"][0]


def _weeks(name: str, bull: float, bear: float) -> str:
    return f"""SELECT 'multiscale_{name}' AS universe, {_seed(name)} AS seed, symbol, kind, first, 5 AS length,
  CASE kind WHEN 'bull' THEN floor(whole * {bull}::DOUBLE) WHEN 'bear' THEN floor(whole * {bear}::DOUBLE) ELSE whole - floor(whole * {bull}::DOUBLE) - floor(whole * {bear}::DOUBLE) END * 5 AS quota
FROM weeks WHERE whole >= 10 AND bulls >= 3 AND bears >= 3 AND choppy >= 2"""


def _swings(name: str, share: float, kind: str, second: str, third: str) -> str:
    asked = f"floor(total * {share}::DOUBLE)"
    next_ = f"floor((total - {asked}) * (n_{second} / (n_{second} + n_{third})))"
    return f"""SELECT 'multiscale_{name}', {_seed(name)}, symbol, size, n, 1, CASE size WHEN '{kind}' THEN {asked} WHEN '{second}' THEN {next_} ELSE total - {asked} - {next_} END
FROM sized WHERE n_large >= 5 AND n_normal >= 10 AND n_flat >= 5"""


_CHUNK = "(n - 1) // {0} < total // {0} GROUP BY symbol, (n - 1) // {0}"
_MONTHS = "CASE role WHEN 'drawdown' THEN greatest(1, floor(whole * 0.4::DOUBLE)) WHEN 'rally' THEN greatest(1, floor(whole * 0.3::DOUBLE)) ELSE whole - greatest(1, floor(whole * 0.4::DOUBLE)) - greatest(1, floor(whole * 0.3::DOUBLE)) END"


@query(f"""
WITH {DAILY}, moves AS (SELECT symbol, date, round(close * 100) % 997 / 24925 - 0.02::DOUBLE AS ret FROM daily),
days AS (SELECT symbol, date, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM moves),
weeks AS (
  SELECT *, count(*) FILTER (kind = 'bull') OVER w AS bulls, count(*) FILTER (kind = 'bear') OVER w AS bears, count(*) FILTER (kind = 'choppy') OVER w AS choppy
  FROM (SELECT symbol, (n - 1) // 5 AS place, min(n) AS first, max(total) // 5 AS whole, CASE WHEN count(*) FILTER (ret > 0.0025) >= 3 THEN 'bull' WHEN count(*) FILTER (ret < -0.0025) >= 3 THEN 'bear' ELSE 'choppy' END AS kind
        FROM days WHERE {_CHUNK.format(5)}) WINDOW w AS (PARTITION BY symbol)),
months AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY first) AS i, count(*) FILTER (kind = 'drawdown') OVER w AS d, count(*) FILTER (kind = 'rally') OVER w AS r, count(*) FILTER (kind = 'flat') OVER w AS f
  FROM (SELECT symbol, (n - 1) // 21 AS place, min(n) AS first, max(total) // 21 AS whole, CASE WHEN sum(ret) < -0.03 THEN 'drawdown' WHEN sum(ret) > 0.03 THEN 'rally' ELSE 'flat' END AS kind
        FROM days WHERE {_CHUNK.format(21)}) WINDOW w AS (PARTITION BY symbol)),
roles AS (
  SELECT *, 'drawdown' AS role FROM months WHERE kind = 'drawdown'
  UNION ALL SELECT *, 'rally' FROM months WHERE CASE WHEN r >= 2 THEN kind = 'rally' WHEN f >= 2 THEN kind = 'flat' AND i <= f // 2 ELSE kind = 'drawdown' AND i = 1 END
  UNION ALL SELECT *, 'flat' FROM months WHERE CASE WHEN f >= 2 THEN kind = 'flat' WHEN r >= 2 THEN kind = 'rally' AND i <= r // 2 ELSE kind = 'drawdown' AND i = 1 END),
sized AS (
  SELECT *, count(*) FILTER (size = 'large') OVER w AS n_large, count(*) FILTER (size = 'normal') OVER w AS n_normal, count(*) FILTER (size = 'flat') OVER w AS n_flat
  FROM (SELECT *, CASE WHEN abs(ret) > 0.01 THEN 'large' WHEN abs(ret) <= 0.0025 THEN 'flat' ELSE 'normal' END AS size FROM days) WINDOW w AS (PARTITION BY symbol)),
spread AS (SELECT *, CASE WHEN n >= 10 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * sqrt(252) END AS s FROM days),
named AS (SELECT *, CASE WHEN s < 0.12 THEN 'low' WHEN s > 0.22 THEN 'high' ELSE 'med' END AS kind FROM spread),
spells AS (
  SELECT *, count(*) FILTER (kind = 'low') OVER w AS low, count(*) FILTER (kind = 'med') OVER w AS med, count(*) FILTER (kind = 'high') OVER w AS high
  FROM (SELECT symbol, max(total) AS total, kind, min(n) AS first, count(*) AS length FROM (SELECT *, n - row_number() OVER (PARTITION BY symbol, kind ORDER BY n) AS run FROM named) GROUP BY symbol, kind, run HAVING count(*) >= 3)
  WINDOW w AS (PARTITION BY symbol)),
combined AS (
  SELECT s.symbol, n, s.total, concat_ws('|', m.kind, w.kind, size) AS kind FROM sized s JOIN months m ON m.symbol = s.symbol AND m.place = least((n - 1) // 21, s.total // 21 - 1)
  JOIN weeks w ON w.symbol = s.symbol AND w.place = least((n - 1) // 5, s.total // 5 - 1) WHERE s.total >= 63),
kinds AS (SELECT symbol, count(DISTINCT kind) AS kinds FROM combined GROUP BY 1 HAVING count(DISTINCT kind) >= 5),
pools AS (
  {_weeks("weekly_balanced", 0.40, 0.40)}
  UNION ALL {_weeks("weekly_bear", 0.30, 0.50)}
  UNION ALL SELECT 'multiscale_monthly_drawdown', {_seed("monthly_drawdown")}, symbol, role, first, 21, {_MONTHS} * 21 FROM roles WHERE whole >= 6 AND d >= 2
  UNION ALL {_swings("swing_large", 0.40, "large", "normal", "flat")}
  UNION ALL {_swings("swing_flat", 0.40, "flat", "large", "normal")}
  UNION ALL SELECT 'multiscale_vol_regime', {_seed("vol_regime")}, symbol, kind, first, length, total // 3 FROM spells WHERE total >= 30 AND low > 0 AND med > 0 AND high > 0
  UNION ALL SELECT 'multiscale_cascade', {_seed("cascade")}, symbol, kind, n, 1, total // kinds FROM combined JOIN kinds USING (symbol)
  UNION ALL SELECT 'multiscale_cascade', {_seed("cascade")}, symbol, 'rest', n, 1, total - total // kinds * kinds FROM combined JOIN kinds USING (symbol)),
placed AS (SELECT *, row_number() OVER (PARTITION BY universe, symbol, kind ORDER BY first) AS i, count(*) OVER (PARTITION BY universe, symbol, kind) AS pool FROM pools),
tickets AS (SELECT universe, seed, symbol, kind, pool, quota, unnest(generate_series(1, CAST(quota AS BIGINT))) AS k FROM (SELECT DISTINCT universe, seed, symbol, kind, pool, quota FROM placed)),
drawn AS (
  SELECT t.universe, t.seed, t.symbol, t.kind, t.k, p.first, p.length, t.quota FROM (SELECT *, {_draw("pick", "symbol", "kind", "k")} % pool + 1 AS i FROM tickets) t
  JOIN placed p ON p.universe = t.universe AND p.symbol = t.symbol AND p.kind = t.kind AND p.i = t.i),
filled AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY universe, symbol, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM drawn),
put AS (
  SELECT f.*, total, coalesce(sum(length) OVER (PARTITION BY universe, f.symbol ORDER BY {_draw("place", "f.symbol", "kind", "k")}, kind, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM filled f JOIN (SELECT symbol, count(*) AS total FROM days GROUP BY 1) USING (symbol) WHERE done < quota),
slots AS (
  SELECT universe, symbol, kind, before + j + 1 AS n, first + j AS taken FROM (SELECT *, unnest(generate_series(0, CAST(length - 1 AS BIGINT))) AS j FROM put) WHERE before + j < total
  UNION ALL SELECT universe, symbol, NULL, n, {_draw("rest", "symbol", "n")} % total + 1
  FROM (SELECT universe, seed, symbol, total, unnest(generate_series(CAST(max(before + length) + 1 AS BIGINT), CAST(total AS BIGINT))) AS n FROM put GROUP BY universe, seed, symbol, total))
SELECT universe, s.symbol, a.date, round(a.ret, 8) AS real_return, round(b.ret, 8) AS synthetic_return, s.kind, b.date AS taken_from
FROM slots s JOIN days a ON a.symbol = s.symbol AND a.n = s.n JOIN days b ON b.symbol = s.symbol AND b.n = s.taken""")
def multiscale_universes(spark, sf_dir):
    moves = daily_orders(spark, sf_dir).select("symbol", "date", (F.round(F.col("close") * 100) % 997 / 24925 - 0.02).alias("ret"))
    return rounded(multiscale.universes(moves, ["symbol"]), 8, "real_return", "synthetic_return")
