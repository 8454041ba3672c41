"""The query of symbol words, with its SQL."""

from __future__ import annotations

from tidemark.operators import words
from tidemark.plans.catalog import DAILY, query, returns, rounded


def _sql() -> str:
    frame = lambda low, high: f"OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN {low} PRECEDING AND {f'{high} PRECEDING' if high else 'CURRENT ROW'})"
    z = lambda s: f"(s{s} - mean) / spread"
    letter = lambda s: f"CASE WHEN coalesce(spread, 0) < 1e-10 THEN 'c' WHEN s{s} IS NULL OR {z(s)} >= 0.6745 THEN 'd' WHEN {z(s)} >= 0 THEN 'c' WHEN {z(s)} >= -0.6745 THEN 'b' ELSE 'a' END"
    place = lambda i: f"(ascii(word[{i}]) - 97)"
    p, q = " + ".join(f"p{c}" for c in "abcd"), " + ".join(f"q{c}" for c in "abcd")
    return f"""
WITH {DAILY}, numbered AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, CASE WHEN close > 0 THEN ln(close) END AS price FROM daily),
moved AS (SELECT symbol, date, n, CASE WHEN n = 1 THEN 0 ELSE price - lag(price) OVER (PARTITION BY symbol ORDER BY n) END AS x FROM numbered),
parts AS (SELECT symbol, date, n, avg(x) {frame(19, 0)} AS mean, stddev_pop(x) {frame(19, 0)} AS spread, {", ".join(f"avg(x) {frame(19 - 4 * s, 16 - 4 * s)} AS s{s}" for s in range(5))} FROM moved),
words AS (SELECT symbol, date, n, CASE WHEN n >= 20 THEN concat({", ".join(letter(s) for s in range(5))}) END AS word FROM parts),
shares AS (SELECT *, {", ".join(f"coalesce((5 - length(replace(word, '{c}', ''))) / 5, 0) AS p{c}" for c in "abcd")} FROM words),
usual AS (SELECT symbol, date, n, word, {", ".join(f"greatest(p{c}, 1e-12) AS p{c}, greatest(avg(p{c}) {frame(49, 0)}, 1e-12) AS q{c}" for c in "abcd")} FROM shares)
SELECT symbol, date, word AS sax_word, CAST(coalesce({" + ".join(f"{place(i)} * {4 ** (5 - i)}" for i in range(1, 6))}, 0) AS DOUBLE) AS sax_pattern_20d,
       CASE WHEN right(word, 2) IN ('cd', 'dd') THEN 1.0 WHEN right(word, 2) IN ('aa', 'ab') THEN -1.0 ELSE 0.0 END::DOUBLE AS sax_pattern_match,
       round(CASE WHEN n >= 50 THEN greatest({" + ".join(f"p{c} / ({p}) * ln(p{c} / ({p}) / (q{c} / ({q})))" for c in "abcd")}, 0) ELSE 0 END, 6) AS sax_novelty
FROM usual"""


@query(_sql())
def sax_features(spark, sf_dir):
    return rounded(words.symbol_words(returns(spark, sf_dir).select("symbol", "date", "close")), 6, "sax_novelty")
