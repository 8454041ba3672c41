"""Signals, fills with costs, and position sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W


def signal(swing: Column, timing: Column, threshold: float = 0.6) -> Column:
    """BUY on a high swing probability with good timing, SELL on a low one, else HOLD."""
    return F.when((swing >= threshold) & (timing >= 0.5), "BUY").when(swing <= 1 - threshold, "SELL").otherwise("HOLD")


def slippage(value: Column, volatility: Column, base: float = 0.0001) -> Column:
    """Slippage as a fraction: grows with the order, up to twofold, and with volatility above 15%."""
    return base * (1 + F.least(F.lit(1.0), value / 100_000)) * (1 + F.greatest(F.lit(0.0), volatility - 0.15) * 5)


def day_trades(signals: DataFrame, stake: float = 10_000.0, commission: float = 0.005, n: int = 20) -> DataFrame:
    """A trade for each BUY or SELL row, opened at the open and closed at the day's close.

    ``signals`` has daily bars with ``ret`` and ``signal``. Each trade stakes the same amount, so days
    do not depend on each other; volatility is annualized over the ``n`` rows before the day, 15% until
    they are there.
    """
    before = W.ordered().rowsBetween(-n, -1)
    vol = F.when(F.count("ret").over(before) >= n, F.stddev_samp("ret").over(before) * 252**0.5).otherwise(0.15)
    way = F.when(F.col("signal") == "BUY", 1).otherwise(-1)
    rows = signals.withColumn("volatility", vol).filter(F.col("signal") != "HOLD").withColumn("slip", slippage(F.lit(stake), F.col("volatility")))
    rows = rows.withColumns({"entry": F.col("open") * (1 + way * F.col("slip")), "exit": F.col("close") * (1 - way * F.col("slip"))})
    shares = F.try_divide(F.lit(stake), F.col("entry"))
    rows = rows.withColumn("pnl", way * (F.col("exit") - F.col("entry")) * shares - 2 * commission * shares)
    return rows.withColumn("return_pct", F.col("pnl") / stake).select("symbol", "date", "signal", "volatility", "entry", "exit", "pnl", "return_pct")


def kelly(win_rate: Column, ratio: Column, scale: float = 0.5, most: float = 0.25) -> Column:
    """Kelly fraction of a win rate and a ratio of mean win to mean loss, scaled and bounded; 0 without a ratio."""
    edge = F.when(ratio > 0, F.greatest(F.lit(0.0), win_rate - (1 - win_rate) / ratio)).otherwise(0.0)
    return F.least(scale * edge, F.lit(most))


def horizon_signals(daily: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Adds returns, directions and mean moves over several horizons, their agreement and strength; 0 where undefined."""
    rows = daily.withColumns({f"mh_return_{h}d": W.pct_change(F.col("close"), h) for h in horizons})
    rows = rows.withColumns({f"mh_momentum_{h}d": W.rolling(F.mean, F.abs(f"mh_return_{h}d"), 2 * h) for h in horizons})
    mean = lambda xs: F.aggregate(F.filter(F.array(*xs), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x) / F.greatest(
        F.size(F.filter(F.array(*xs), lambda x: x.isNotNull())), F.lit(1)
    )
    rows = rows.withColumns(
        {
            "mh_agreement": mean([F.signum(f"mh_return_{h}d") for h in horizons]),
            "mh_strength": mean([F.col(f"mh_momentum_{h}d") for h in horizons]),
        }
    )
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in rows.columns if c.startswith("mh_")})


def stopped_trades(signals: DataFrame, stake: float = 0.10, stop: float = 0.01, take: float = 0.02, capital: float = 100_000.0, commission: float = 0.005, n: int = 20) -> DataFrame:
    """A compounding portfolio per symbol: each signal's trade opens at the open and ends the same day.

    ``signals`` has daily bars with ``ret`` and ``signal`` (LONG, SHORT or HOLD). A trade ends at its
    stop if the day's range touches it, else at its target, else at the close. It stakes the share
    ``stake`` of the equity before it. What a trade earns per unit staked does not depend on the
    equity up to the order-size part of the slippage, so equity is folded over the day's results in
    date order; days of one symbol are few. A price of 0 or a missing one earns nothing.
    """
    before = W.ordered().rowsBetween(-n, -1)
    vol = F.when(F.count("ret").over(before) >= n, F.stddev_samp("ret").over(before) * 252**0.5).otherwise(0.15)
    way = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    rows = signals.withColumn("volatility", vol).filter("signal != 'HOLD'").withColumn("way", way)
    low, high, open_ = F.col("low"), F.col("high"), F.col("open")
    stop_at, take_at = open_ * (1 - F.col("way") * stop), open_ * (1 + F.col("way") * take)
    long = F.col("way") > 0
    stopped = F.when(long, low <= stop_at).otherwise(high >= stop_at)
    taken = F.when(long, high >= take_at).otherwise(low <= take_at)
    rows = rows.withColumns(
        {
            "exit_reason": F.when(stopped, "stop_loss").when(taken, "take_profit").otherwise("end_of_day"),
            "exit_price": F.when(stopped, stop_at).when(taken, take_at).otherwise(F.col("close")),
        }
    )
    day = F.struct("date", "open", "exit_price", "way", "volatility", "exit_reason")
    ordered = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(day)).alias("days"))
    empty = F.expr("CAST(array() AS array<struct<date: date, pnl: double, return_pct: double, equity: double>>)")

    def step(state: Column, d: Column) -> Column:
        equity = state.getField("equity")
        value = equity * stake
        slip = slippage(value, d.getField("volatility"))
        entry = d.getField("open") * (1 + d.getField("way") * slip)
        leave = d.getField("exit_price") * (1 - d.getField("way") * slip)
        shares = F.try_divide(value, entry)
        pnl = F.coalesce(d.getField("way") * (leave - entry) * shares - 2 * commission * shares, F.lit(0.0))
        done = F.struct(d.getField("date").alias("date"), pnl.alias("pnl"), F.try_divide(pnl, value).alias("return_pct"), (equity + pnl).alias("equity"))
        return F.struct((equity + pnl).alias("equity"), F.concat(state.getField("done"), F.array(done)).alias("done"))

    folded = ordered.withColumn("out", F.aggregate("days", F.struct(F.lit(capital).alias("equity"), empty.alias("done")), step, lambda s: s.getField("done")))
    found = folded.select("symbol", F.explode("out").alias("o")).select("symbol", "o.*")
    return rows.select("symbol", "date", "signal", "exit_reason", F.col("open").alias("entry_price"), "exit_price").join(found, ["symbol", "date"])


# Volatility index levels and the share of the Kelly fraction below each; the last holds above all.
VOLATILITY_STEPS = ((15.0, 0.50), (25.0, 0.35), (35.0, 0.20))
ABOVE = 0.10


def stepped_kelly(win_rate: Column, ratio: Column, level: Column, least: float = 0.01, most: float = 0.25) -> Column:
    """Kelly fraction scaled down in steps of a volatility index, within ``least`` to ``most``."""
    scale = F.lit(ABOVE)
    for limit, share in reversed(VOLATILITY_STEPS):
        scale = F.when(level < limit, share).otherwise(scale)
    return F.greatest(F.least(kelly(win_rate, ratio, 1.0, 1.0) * scale, F.lit(most)), F.lit(least))
