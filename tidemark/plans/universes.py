"""Queries of the event calendar, synthetic universes, portfolios and registry-style lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calendar, synthetic
from tidemark.operators import strategy as S
from tidemark.plans.catalog import DAILY, RETURNS, query, returns, rounded
from tidemark.sources.market import daily_orders, table

MEETINGS = "[" + ", ".join(f"DATE '{d}'" for d in calendar.MEETINGS) + "]"
_FIRST = "CAST(date_trunc('month', {d}) AS DATE)"


def _nth(d: str, weekday: int, n: int) -> str:
    first = _FIRST.format(d=d)
    return f"({first} + CAST(({weekday} - (isodow({first}) - 1) + 7) % 7 + {7 * (n - 1)} AS INTEGER))"


def _pay(d: str) -> str:
    return f"{d} = {_nth(d, 4, 1)}"


def _cpi(d: str) -> str:
    return f"{d} = {_nth(d, 1, 2)}"


def _gdp(d: str) -> str:
    return f"(month({d}) IN (1, 4, 7, 10) AND {d} = last_day({d}) - CAST((isodow(last_day({d})) - 1 - 3 + 7) % 7 AS INTEGER))"


def _week(test) -> str:
    return [test(f"(monday + {i})") for i in range(5)]


def _any(tests: list[str]) -> str:
    return "CASE WHEN " + " OR ".join(f"({t})" for t in tests) + " THEN 1 ELSE 0 END"


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def _meets(d: str) -> str:
    return f"list_contains(meetings, {d})"


_OPEX = lambda d: f"{d} = {_nth(d, 4, 3)}"
_MAJOR = lambda d: f"({_pay(d)} OR {_cpi(d)} OR {_gdp(d)})"
_MONTH_AHEAD = "CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE)"
_FIRST_OF = _FIRST.format(d="date")


@query(f"""
WITH days AS (
  SELECT DISTINCT CAST(o_orderdate + INTERVAL 24 YEAR AS DATE) AS date, {MEETINGS} AS meetings FROM orders),
placed AS (SELECT *, date - CAST(isodow(date) - 1 AS INTEGER) AS monday, list_min(list_filter(meetings, lambda m: m > date)) AS following, list_max(list_filter(meetings, lambda m: m <= date)) AS last FROM days),
fomc AS (
  SELECT *, {_flag(_meets("date"))} AS fomc_is_meeting_day, {_flag(f"{_meets('(date + 1)')} OR ({_meets('(date + 3)')} AND isodow(date) = 5)")} AS fomc_is_day_before,
         {_flag(_meets("(date - CASE WHEN isodow(date - 1) = 7 THEN 2 ELSE 1 END)"))} AS fomc_is_day_after, coalesce(following - date, 45) AS fomc_days_until_next, coalesce(date - last, 45) AS fomc_days_since_last,
         {_any(_week(_meets))} AS fomc_is_meeting_week FROM placed)
SELECT date, fomc_is_meeting_day, fomc_is_day_before, fomc_is_day_after, fomc_days_until_next, fomc_days_since_last, fomc_is_meeting_week,
       round(fomc_days_until_next / (fomc_days_until_next + fomc_days_since_last + 1), 8) AS fomc_cycle_position,
       {_flag(_OPEX("date"))} AS opex_is_monthly, {_flag(_OPEX("date") + " AND month(date) % 3 = 0")} AS opex_is_quad_witching,
       CASE WHEN {_nth("date", 4, 3)} > date THEN {_nth("date", 4, 3)} ELSE {_nth(_MONTH_AHEAD, 4, 3)} END - date AS opex_days_until_next,
       {_any(_week(_OPEX))} AS opex_is_expiration_week, {_flag(_OPEX("(date + 1)"))} AS opex_is_day_before,
       {_flag(_pay("date"))} AS econ_is_nfp_day, {_flag(_cpi("date"))} AS econ_is_cpi_day,
       {_flag(f"date = {_FIRST_OF} + CASE isodow({_FIRST_OF}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END")} AS econ_is_pmi_day, {_flag(_gdp("date"))} AS econ_is_gdp_day,
       {_flag(_MAJOR("date"))} AS econ_is_major_release, {" + ".join(_flag(t) for t in _week(_MAJOR))} AS econ_releases_this_week
FROM fomc""")
def event_calendar(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date(F.add_months("o_orderdate", 24 * 12)).alias("date")).distinct()
    return rounded(calendar.event_calendar(days), 8, "fomc_cycle_position")


@query(f"""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date FROM days WHERE {_pay("date")} UNION SELECT date FROM days WHERE {_cpi("date")} UNION SELECT date FROM days WHERE {_gdp("date")}""")
def release_dates(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    day = F.col("date")
    found = [days.filter(test(day)) for test in (calendar.is_payrolls, calendar.is_prices, calendar.is_product)]
    return found[0].union(found[1]).union(found[2]).distinct()


#: Monthly returns of customers as many small members of an index.
MEMBERS = """members AS (
  SELECT c_nationkey AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, (sum(o_totalprice) % 997) / 9970 - 0.05 AS ret
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def members(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    total = F.round(F.sum("o_totalprice"), 2)
    return joined.groupBy(F.col("c_nationkey").alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg((total % 997 / 9970 - 0.05).alias("ret"))


MEMBERS = MEMBERS.replace("(sum(o_totalprice) % 997)", "(round(sum(o_totalprice), 2) % 997)")


@query(f"""
WITH {MEMBERS}, placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret, symbol) AS p, count(*) OVER (PARTITION BY date) AS n FROM members)
SELECT symbol, date, round(ret, 8) AS ret FROM placed WHERE n < 10 OR p <= floor(n * 0.3) OR p > n - floor(n * 0.3)""")
def without_middle(spark, sf_dir):
    return rounded(synthetic.without_middle(members(spark, sf_dir), 0.4), 8, "ret")


def _quantile(value: str, test: str) -> str:
    return f"""WITH {MEMBERS}, per AS (SELECT symbol, {value} AS x FROM members GROUP BY 1)
SELECT m.symbol, m.date, round(ret, 8) AS ret FROM members m JOIN per USING (symbol) WHERE {test}"""


@query(_quantile("stddev_samp(ret)", "x <= (SELECT quantile_cont(x, 0.5) FROM per)"))
def low_volatility_members(spark, sf_dir):
    return rounded(synthetic.by_quantile(members(spark, sf_dir), "volatility", "low"), 8, "ret").select("symbol", "date", "ret")


@query(_quantile("exp(sum(ln(1 + ret))) - 1", "x >= (SELECT quantile_cont(x, 0.5) FROM per)"))
def high_momentum_members(spark, sf_dir):
    return rounded(synthetic.by_quantile(members(spark, sf_dir), "momentum", "high"), 8, "ret").select("symbol", "date", "ret")


@query(f"""
WITH {MEMBERS}, basket AS (SELECT date, avg(ret) AS b FROM members GROUP BY 1),
per AS (SELECT symbol, corr(ret, b) AS corr FROM members JOIN basket USING (date) GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY corr, symbol) AS p, count(*) OVER () AS n FROM per)
SELECT m.symbol, m.date, round(ret, 8) AS ret, round(corr, 6) AS corr FROM members m JOIN placed USING (symbol) WHERE p > floor(n * 0.2) AND p <= n - floor(n * 0.2)""")
def correlated_members(spark, sf_dir):
    return rounded(rounded(synthetic.by_correlation(members(spark, sf_dir)), 8, "ret"), 6, "corr").select("symbol", "date", "ret", "corr")


INDEX = MEMBERS + ", basket AS (SELECT date, avg(ret) AS ret FROM members GROUP BY 1)"


def basket(spark, sf_dir):
    return members(spark, sf_dir).groupBy("date").agg(F.mean("ret").alias("ret"))


@query(f"""WITH {INDEX}
SELECT m.symbol AS universe, date, round(b.ret - (m.symbol + 1) / 400.0 * m.ret, 8) AS ret FROM members m JOIN basket b USING (date)""")
def without_member(spark, sf_dir):
    rows = members(spark, sf_dir)
    weights = rows.select("symbol").distinct().withColumn("weight", (F.col("symbol") + 1) / 400.0)
    return rounded(synthetic.without_member(basket(spark, sf_dir), rows, weights), 8, "ret")


@query(f"""WITH {MEMBERS} SELECT date, round(sum(ret * CASE WHEN symbol IN (1, 2, 3) THEN 2 ELSE 1 END) / sum(CASE WHEN symbol IN (1, 2, 3) THEN 2 ELSE 1 END), 8) AS ret FROM members GROUP BY 1""")
def tilted_basket(spark, sf_dir):
    return rounded(synthetic.tilted(members(spark, sf_dir), [1, 2, 3]), 8, "ret")


@query()
def sampled_members(spark, sf_dir):
    return rounded(synthetic.sampled_members(members(spark, sf_dir), 0.7, 42), 8, "ret")


@query(f"""WITH {INDEX}, universes AS (SELECT CAST(symbol AS VARCHAR) AS universe, date, ret FROM members WHERE symbol < 3),
real AS (SELECT date, ret, month(date) AS month FROM basket),
both_ AS (SELECT 'real' AS universe, date, ret, month, 1.0 AS weight FROM real UNION ALL SELECT u.universe, date, u.ret, month, 0.5 FROM real JOIN universes u USING (date))
SELECT universe, date, round(ret, 8) AS ret, month, weight, ret > 0.0025 AS target_up, ret < -0.0025 AS target_down, universe <> 'real' AS is_synthetic FROM both_""")
def augmented_rows(spark, sf_dir):
    universes = members(spark, sf_dir).filter("symbol < 3").withColumn("universe", F.col("symbol").cast("string"))
    real = basket(spark, sf_dir).withColumn("month", F.month("date").cast("long"))
    return rounded(synthetic.augmented(real, universes), 8, "ret")


@query(f"""
WITH {INDEX}, synth AS (SELECT date, ret FROM members WHERE symbol = 4)
SELECT date, round(b.ret, 8) AS ret, round(s.ret, 8) AS ret_synth FROM basket b JOIN synth s USING (date)""")
def real_and_synthetic(spark, sf_dir):
    """An inner join on the date whose clashing columns get a suffix."""
    other = members(spark, sf_dir).filter("symbol = 4").drop("symbol")
    named = other.select("date", *[F.col(c).alias(f"{c}_synth") for c in other.columns if c != "date"])
    return rounded(basket(spark, sf_dir).join(named, "date"), 8, "ret", "ret_synth")


_VALUE = "(f.equity * 0.1)"
_SLIP = f"(0.0001 * (1 + least(1, {_VALUE} / 100000)) * (1 + greatest(0, p.vol - 0.15) * 5))"
_ENTRY, _LEAVE = f"(p.open * (1 + p.way * {_SLIP}))", f"(p.leave * (1 - p.way * {_SLIP}))"
_PNL = f"((p.way * ({_LEAVE} - {_ENTRY}) - 0.01) * {_VALUE} / {_ENTRY})"


@query(f"""
WITH RECURSIVE {RETURNS}, marked AS (
  SELECT *, CASE WHEN volume > 2 THEN 'LONG' WHEN volume = 1 THEN 'SHORT' ELSE 'HOLD' END AS signal,
         CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(252) ELSE 0.15 END AS vol
  FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ways AS (SELECT *, CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END AS way, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM marked WHERE signal <> 'HOLD' AND year(date) = 1995),
ends AS MATERIALIZED (
  SELECT symbol, date, n, signal, way, vol, open,
         CASE WHEN (way > 0 AND low <= open * 0.99) OR (way < 0 AND high >= open * 1.01) THEN 'stop_loss'
              WHEN (way > 0 AND high >= open * 1.02) OR (way < 0 AND low <= open * 0.98) THEN 'take_profit' ELSE 'end_of_day' END AS why, close FROM ways),
prices AS MATERIALIZED (SELECT *, CASE why WHEN 'stop_loss' THEN open * (1 - way * 0.01) WHEN 'take_profit' THEN open * (1 + way * 0.02) ELSE close END AS leave FROM ends),
fold AS (
  SELECT symbol, CAST(0 AS BIGINT) AS n, 100000.0::DOUBLE AS equity, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS return_pct FROM (SELECT DISTINCT symbol FROM prices)
  UNION ALL
  SELECT p.symbol, p.n, f.equity + {_PNL}, {_PNL}, {_PNL} / {_VALUE} FROM fold f JOIN prices p ON p.symbol = f.symbol AND p.n = f.n + 1)
SELECT p.symbol, p.date, p.signal, p.why AS exit_reason, p.open AS entry_price, round(p.leave, 4) AS exit_price, round(pnl, 4) AS pnl, round(return_pct, 8) AS return_pct, round(equity, 3) AS equity
FROM prices p JOIN fold f ON f.symbol = p.symbol AND f.n = p.n""")
def stopped_trades(spark, sf_dir):
    volume = F.col("volume")
    signal = F.when((F.year("date") != 1995), "HOLD").when(volume > 2, "LONG").when(volume == 1, "SHORT").otherwise("HOLD")
    found = S.stopped_trades(returns(spark, sf_dir).withColumn("signal", signal))
    return rounded(rounded(rounded(found, 4, "exit_price", "pnl"), 8, "return_pct"), 3, "equity")


@query("""
WITH x AS (SELECT c_custkey AS id, (c_custkey % 100) / 100.0 AS p, 0.5 + (c_custkey % 7) / 2.0 AS b, 10 + c_custkey % 31 AS level FROM customer)
SELECT id, round(greatest(least(greatest(0, p - (1 - p) / b) * CASE WHEN level < 15 THEN 0.5 WHEN level < 25 THEN 0.35 WHEN level < 35 THEN 0.2 ELSE 0.1 END, 0.25), 0.01), 8) AS size FROM x""")
def stepped_kelly(spark, sf_dir):
    key = F.col("c_custkey")
    size = S.stepped_kelly(key % 100 / 100.0, 0.5 + key % 7 / 2.0, 10 + key % 31)
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.round(size, 8).alias("size"))


@query(f"""
WITH {DAILY}, run AS (SELECT symbol, date, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY date) AS dd FROM daily)
SELECT symbol, date, round(pow(1 - least(dd / 0.9, 1), 2), 8) AS size FROM run""")
def drawdown_sizes(spark, sf_dir):
    from tidemark.operators.risk import drawdown_size
    from tidemark.plans.catalog import drawdown_and_obv

    rows = daily_orders(spark, sf_dir).join(drawdown_and_obv(spark, sf_dir).select("symbol", "date", "peak"), ["symbol", "date"])
    size = drawdown_size(F.col("close") / F.col("peak") - 1, 1.0, 0.9, 2.0)
    return rows.select("symbol", "date", F.round(size, 8).alias("size"))


@query("SELECT p_partkey AS id, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 10")
def ranked_page(spark, sf_dir):
    """A page of a ranking: the limit is the feature."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return rows.orderBy(F.desc("score"), "id").offset(10).limit(25)


@query("""
WITH r AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax', 'l_linenumber']) AS feature,
  unnest([corr(l_quantity, l_discount), corr(l_extendedprice, l_discount), corr(l_tax, l_discount), corr(l_linenumber, l_discount)]) AS r FROM lineitem)
SELECT feature, round(r, 8) AS r FROM r ORDER BY abs(r) DESC, feature LIMIT 2""")
def strongest_correlations(spark, sf_dir):
    """The two columns that correlate most with the target: a top-k report."""
    names = ["l_quantity", "l_extendedprice", "l_tax", "l_linenumber"]
    one = table(spark, sf_dir, "lineitem").agg(*[F.corr(c, "l_discount").alias(c) for c in names])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in names])).alias("x")).select("x.*")
    return rounded(long.orderBy(F.desc(F.abs("r")), "feature").limit(2), 8, "r")
