"""Queries of the bear universes over the members' monthly returns, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bear
from tidemark.plans.catalog import query, rounded
from tidemark.plans.universes import INDEX, MEMBERS, basket, members

PLACED = MEMBERS + """, days AS (
  SELECT symbol, date, ret AS real_return, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM members WHERE ret IS NOT NULL)"""


def _draw(seed: int, what: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', '{what}', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return rounded(found, 8, "real_return", "synthetic_return").select("symbol", "date", "real_return", "synthetic_return", *more)


@query(f"""
WITH {PLACED}, summed AS (SELECT *, n >= 10 AND sum(real_return) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) < -0.02 AS falling FROM days),
marked AS (SELECT *, bool_or(falling) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS bear FROM summed),
spells AS (SELECT symbol, n, n - row_number() OVER (PARTITION BY symbol ORDER BY n) AS spell, count(*) OVER (PARTITION BY symbol) AS bears FROM marked WHERE bear),
runs AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY first) AS i, count(*) OVER (PARTITION BY symbol) AS runs
         FROM (SELECT symbol, min(n) AS first, count(*) AS length FROM spells WHERE bears >= 30 GROUP BY symbol, spell HAVING count(*) >= 3)),
draws AS (SELECT symbol, total, runs, unnest(generate_series(1, CAST(ceil(total / 3) AS BIGINT))) AS block FROM (SELECT DISTINCT symbol, total, runs FROM days JOIN runs USING (symbol))),
drawn AS (
  SELECT d.symbol, d.total, d.block, first, length, least(5 + {_draw(1001, "length", "d.symbol", "d.block")} % 16, length) AS take
  FROM draws d JOIN runs r ON r.symbol = d.symbol AND r.i = {_draw(1001, "run", "d.symbol", "d.block")} % d.runs + 1),
put AS (SELECT *, first + {_draw(1001, "start", "symbol", "block")} % (length - take + 1) AS start, coalesce(sum(take) OVER (PARTITION BY symbol ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
slots AS (SELECT symbol, block, total, before, start, unnest(generate_series(0, CAST(take - 1 AS BIGINT))) AS k FROM put)
SELECT a.symbol, a.date, round(a.real_return, 8) AS real_return, round(b.real_return, 8) AS synthetic_return, block, b.date AS taken_from
FROM slots s JOIN days a ON a.symbol = s.symbol AND a.n = before + k + 1 JOIN days b ON b.symbol = s.symbol AND b.n = start + k""")
def bear_blocks(spark, sf_dir):
    return _shown(bear.block_bootstrap(members(spark, sf_dir), ["symbol"], 1001), "block", "taken_from")


#: Shares of rising and falling days with the seed of each balanced universe.
BALANCES = {"bear_regime_balanced": (0.45, 0.45, 2001), "bear_regime_heavy": (0.35, 0.55, 2002)}


def _balanced(name: str) -> str:
    up, down, seed = BALANCES[name]
    return f"""
SELECT '{name}' AS universe, s.symbol, s.date, round(s.real_return, 8) AS real_return, round(p.real_return, 8) AS synthetic_return
FROM (
  SELECT *, {_draw(seed, "pick", "symbol", "n")} % CASE kind WHEN 'up' THEN ups WHEN 'down' THEN downs ELSE flats END + 1 AS i
  FROM (
    SELECT symbol, date, n, real_return, ups, downs, flats, CASE WHEN place <= rises THEN 'up' WHEN place <= rises + falls THEN 'down' ELSE 'flat' END AS kind
    FROM (
      SELECT *, floor(total * {up}::DOUBLE) + spare - floor(spare / 2) AS rises, floor(total * {down}::DOUBLE) + floor(spare / 2) AS falls
      FROM (
        SELECT *, CASE WHEN flats = 0 THEN total - floor(total * {up}::DOUBLE) - floor(total * {down}::DOUBLE) ELSE 0 END AS spare,
               row_number() OVER (PARTITION BY symbol ORDER BY {_draw(seed, "place", "symbol", "n")}, n) AS place
        FROM kinds WHERE ups >= 10 AND downs >= 10)))) s
JOIN kinds p ON p.symbol = s.symbol AND p.kind = s.kind AND p.place_in_kind = s.i"""


@query(f"""
WITH {PLACED}, kinded AS (SELECT *, CASE WHEN real_return > 0.0025 THEN 'up' WHEN real_return < -0.0025 THEN 'down' ELSE 'flat' END AS kind FROM days),
kinds AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY n) AS place_in_kind, count(*) FILTER (kind = 'up') OVER w AS ups, count(*) FILTER (kind = 'down') OVER w AS downs,
         count(*) FILTER (kind = 'flat') OVER w AS flats FROM kinded WINDOW w AS (PARTITION BY symbol))
{" UNION ALL ".join(_balanced(name) for name in BALANCES)}
UNION ALL SELECT 'bear_mean_shift_5bp', symbol, date, round(real_return, 8), round(least(greatest(real_return - 0.0005, -0.1), 0.1), 8) FROM days
UNION ALL SELECT 'bear_mean_shift_10bp', symbol, date, round(real_return, 8), round(least(greatest(real_return - 0.001, -0.1), 0.1), 8) FROM days
UNION ALL SELECT 'bear_vol_amplified', symbol, date, round(real_return, 8), round(least(greatest(real_return * CASE WHEN real_return < 0 THEN 1.5 ELSE 0.7 END, -0.1), 0.1), 8) FROM days""")
def bear_universes(spark, sf_dir):
    rows = members(spark, sf_dir)
    found = {name: bear.regime_balanced(rows, ["symbol"], up, down, seed) for name, (up, down, seed) in BALANCES.items()}
    found |= {f"bear_mean_shift_{bps}bp": bear.mean_shift(rows, ["symbol"], bps) for bps in (5, 10)}
    found["bear_vol_amplified"] = bear.amplified(rows, ["symbol"])
    return reduce(DataFrame.unionByName, [_shown(df.withColumn("universe", F.lit(name)), "universe") for name, df in found.items()])


@query(f"""
WITH {INDEX}, means AS (SELECT date, avg(ret) FILTER (symbol < 8) AS d, avg(ret) FILTER (symbol BETWEEN 8 AND 15) AS c FROM members GROUP BY 1),
both_ AS (SELECT b.date, b.ret AS real_return, 0.6 * 0.9 * d + 0.4 * 1.4 * c AS raw FROM basket b LEFT JOIN means USING (date)),
moments AS (SELECT stddev_samp(CASE WHEN raw IS NOT NULL THEN real_return END) / (stddev_samp(raw) + 1e-10) AS scale, avg(raw) AS mean FROM both_ HAVING count(raw) >= 50)
SELECT date, round(real_return, 8) AS real_return,
       round(CASE WHEN raw IS NULL THEN real_return - 0.0005 ELSE least(greatest(raw * scale - CASE WHEN mean * scale > 0 THEN mean * scale + 0.0003 ELSE 0 END, -0.1), 0.1) END, 8) AS synthetic_return
FROM both_, moments""")
def bear_rotation(spark, sf_dir):
    found = bear.defensive_rotation(members(spark, sf_dir), basket(spark, sf_dir), list(range(8)), list(range(8, 16)), least_dates=50)
    return rounded(found, 8, "real_return", "synthetic_return")
