"""Feature families of a daily frame (``symbol, date, open, high, low, close, volume, ret``), each adding its columns.

Families that read another series take it as columns joined by date beforehand (``joined``) and fall
back to what the bars themselves tell where those columns are missing from the frame: which of the
two is used is decided when the plan is built, from the columns, never from the rows. Undefined
values become 0 at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.cleaning import normal_cdf

YEAR = math.sqrt(252)
col = F.col


def mean(x: Column | str, n: int, least: int | None = None) -> Column:
    return W.rolling(F.mean, col(x) if isinstance(x, str) else x, n, least)


def total(x: Column | str, n: int, least: int | None = None) -> Column:
    return W.rolling(F.sum, col(x) if isinstance(x, str) else x, n, least)


def std(x: Column | str, n: int, least: int | None = None) -> Column:
    # A deviation needs two values, whatever else is asked.
    return W.rolling(F.stddev_samp, col(x) if isinstance(x, str) else x, n, max(2, n if least is None else least))


def diff(x: str, k: int = 1) -> Column:
    return col(x) - F.lag(x, k).over(W.ordered())


def change(x: str, k: int = 1) -> Column:
    return F.try_divide(col(x), F.lag(x, k).over(W.ordered())) - 1


def zscore(x: str, n: int = 60, least: int | None = None, limit: float | None = 4.0, epsilon: float = 1e-10) -> Column:
    z = (col(x) - mean(x, n, least)) / (std(x, n, least) + epsilon)
    return z if limit is None else W.clip(z, -limit, limit)


def three_ways(z: Column | str, limit: float) -> Column:
    z = col(z) if isinstance(z, str) else z
    return F.when(z > limit, 1.0).when(z < -limit, -1.0).otherwise(0.0)


def true(test: Column) -> Column:
    """1 where ``test`` holds, 0 where it does not or is unknown."""
    return F.when(test, 1.0).otherwise(0.0)


def joined(rows: DataFrame, series: DataFrame, columns: list[str], most_days: int | None = None) -> DataFrame:
    """``rows`` with the ``columns`` of ``series`` of the same date, carried forward over at most ``most_days`` rows."""
    found = rows.join(series.select("date", *columns), "date", "left")
    if most_days is None:
        frame = W.ordered().rowsBetween(Window.unboundedPreceding, 0)
    else:
        frame = W.ordered().rowsBetween(-most_days, 0)
    return found.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})


def _done(rows: DataFrame, names: list[str]) -> DataFrame:
    x = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return rows.select("symbol", "date", *[x(col(c)).alias(c) for c in names])


def amihud(rows: DataFrame) -> DataFrame:
    """Illiquidity: absolute return for a million of traded value, capped at the symbol's 99th percentile."""
    raw = F.abs("ret") / (col("close") * col("volume") + 1e-10) * 1e6
    rows = rows.withColumn("raw", raw)
    cap = rows.groupBy("symbol").agg(F.percentile("raw", 0.99).alias("cap"))
    rows = rows.join(cap, "symbol").withColumn("liq_amihud_raw", F.when(col("raw").isNotNull(), F.least("raw", "cap")))
    rows = rows.withColumns({"liq_amihud_20d": mean("liq_amihud_raw", 20, 5), "liq_amihud_z": zscore("liq_amihud_raw", 60, 20)})
    names = ["liq_amihud_raw", "liq_amihud_20d", "liq_amihud_z", "liq_amihud_regime"]
    return _done(rows.withColumn("liq_amihud_regime", three_ways("liq_amihud_z", 1.5)), names)


def vpin(rows: DataFrame, window: int = 50) -> DataFrame:
    """Volume-synchronised probability of informed trading from bulk-classified volume."""
    span = F.abs(F.log(col("high") / (col("low") + 1e-10))) / (2 * math.sqrt(math.log(2)))
    usual = rows.groupBy("symbol").agg(F.stddev_samp("ret").alias("usual"))
    usual = usual.select("symbol", F.when(col("usual") >= 1e-10, col("usual")).otherwise(0.01).alias("usual"))
    rows = rows.withColumn("span", span).join(usual, "symbol")
    sigma = F.greatest(F.coalesce(mean("span", 20, 5), "usual"), F.lit(1e-10))
    rows = rows.withColumn("bought", normal_cdf(F.coalesce(col("ret") / sigma, F.lit(0.0))))
    rows = rows.withColumn("gap", F.abs(col("volume") * (2 * col("bought") - 1)))
    least = max(5, window // 5)
    value = W.clip(total("gap", window, least) / (total("volume", window, least) + 1e-10), 0.0, 1.0)
    # Rounded, or a constant value would have z-scores of its rounding errors.
    rows = rows.withColumn("vpin_value", F.round(value, 9))
    rows = rows.withColumns({"vpin_change_5d": diff("vpin_value", 5), "vpin_z": zscore("vpin_value", 60, 20)})
    return _done(rows.withColumn("vpin_regime", three_ways("vpin_z", 1.0)), ["vpin_value", "vpin_z", "vpin_regime", "vpin_change_5d"])


def range_volatilities(rows: DataFrame) -> DataFrame:
    """Garman-Klass, Rogers-Satchell and Yang-Zhang volatilities, their ratio to close-to-close, and range surprise."""
    e = 1e-10
    log = lambda a, b: F.log(a / (b + e) + e)
    o, h, l, c = (col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    rows = rows.withColumns(
        {
            "rs": F.greatest(log(h, c) * log(h, o) + log(l, c) * log(l, o), F.lit(0.0)),
            "gk": F.greatest(0.5 * F.pow(log(h, l), 2) - (2 * math.log(2) - 1) * F.pow(log(c, o), 2), F.lit(0.0)),
            "night": log(o, F.lag("close").over(W.ordered())),
            "body": log(c, o),
            "span": (h - l) / (c + e),
        }
    )
    k = 0.34 / (1.34 + 2 / 5)
    root = lambda x: F.when(x.isNotNull(), F.sqrt(252 * F.greatest(x, F.lit(0.0))))
    found = {}
    for n in (5, 20):
        least = max(3, n // 2)
        rs, var = mean("rs", n, least), lambda x: W.rolling(F.var_samp, col(x), n, least)  # noqa: B023, E731
        found |= {f"rvol_gk_{n}d": root(mean("gk", n, least)), f"rvol_rs_{n}d": root(rs), f"rvol_yz_{n}d": root(var("night") + k * rs + (1 - k) * var("body"))}
    rows = rows.withColumns(found)
    close = root(W.rolling(F.var_samp, col("ret"), 20, 5))
    rows = rows.withColumns(
        {
            "rvol_ratio_gk_cc": W.clip(col("rvol_gk_20d") / (close + e), 0.0, 5.0),
            "rvol_vol_surprise": W.clip(col("span") / (mean("span", 20, 5) + e), 0.0, 5.0),
        }
    )
    return _done(rows, [*found, "rvol_ratio_gk_cc", "rvol_vol_surprise"])


def skew_kurtosis(rows: DataFrame) -> DataFrame:
    """Population skewness and excess kurtosis, and how many more returns lie beyond two deviations above than below."""
    n = F.row_number().over(W.ordered()) - 1
    rows = rows.withColumn("at", n)

    def moment(aggregate, window: int, fewest: int) -> Column:
        frame = W.trailing(window)
        some = (F.count("ret").over(frame) >= fewest) & (col("at") >= max(fewest, window // 2))
        flat = F.var_pop("ret").over(frame) < 1e-20
        return F.when(some, F.when(flat, 0.0).otherwise(aggregate("ret").over(frame)))

    rows = rows.withColumns({f"skku_skew_{w}d": moment(F.skewness, w, 3) for w in (5, 20, 60)} | {"skku_kurtosis_20d": moment(F.kurtosis, 20, 4)})
    frame = W.trailing(60)
    past = F.collect_list("ret").over(frame)
    rows = rows.withColumns({"past": past, "deviation": F.stddev_samp("ret").over(frame), "middle": F.mean("ret").over(frame)})
    beyond = lambda sign: F.size(F.filter("past", lambda x: sign * (x - col("middle")) > 2 * col("deviation")))
    some = (F.size("past") >= 10) & (col("at") >= 30)
    asymmetry = F.when(some, F.when(col("deviation") < 1e-15, 0.0).otherwise((beyond(1) - beyond(-1)) / F.size("past")))
    rows = rows.withColumns({"skku_tail_asymmetry": asymmetry, "skku_skew_z": zscore("skku_skew_20d", 60, 20)})
    return _done(rows, ["skku_skew_5d", "skku_skew_20d", "skku_skew_60d", "skku_kurtosis_20d", "skku_tail_asymmetry", "skku_skew_z"])


def news(rows: DataFrame) -> DataFrame:
    """News sentiment: from ``sentiment, confidence, article_count, negative_pct, positive_pct``, or from five-day momentum."""
    zero = lambda c: F.coalesce(col(c), F.lit(0.0))
    if "sentiment" in rows.columns:
        rows = rows.withColumns({f"anews_{c}": zero(c) for c in ("sentiment", "confidence", "negative_pct", "positive_pct")} | {"articles": zero("article_count")})
        spread = F.nullif(std("articles", 20, 5), F.lit(0.0))
        rows = rows.withColumn("anews_article_count", (col("articles") - mean("articles", 20, 5)) / spread)
        regime = three_ways("anews_sentiment", 0.3)
    else:
        rows = rows.withColumn("filled", F.coalesce("ret", F.lit(0.0)))
        rows = rows.withColumn("anews_sentiment", W.clip(mean("filled", 5, 1) * 100, -1.0, 1.0))
        rows = rows.withColumn("anews_confidence", F.abs("anews_sentiment") * 0.5)
        rows = rows.withColumns({f"anews_{c}": F.lit(0.0) for c in ("article_count", "negative_pct", "positive_pct")})
        regime = F.lit(0.0)
    rows = rows.withColumns({"anews_sentiment_5d_ma": mean("anews_sentiment", 5, 1), "anews_momentum": diff("anews_sentiment", 5), "anews_regime": regime})
    return _done(rows, [f"anews_{c}" for c in ("sentiment", "confidence", "article_count", "negative_pct", "positive_pct", "sentiment_5d_ma", "momentum", "regime")])


def analyst_ratings(rows: DataFrame) -> DataFrame:
    """Analyst consensus: from ``buy_pct, sell_pct, strong_buy_pct``, or from the share of rising days."""
    if "buy_pct" in rows.columns:
        filled = {"buy_pct": 0.5, "sell_pct": 0.1, "strong_buy_pct": 0.2}
        rows = rows.withColumns({f"anlst_{c}": F.coalesce(col(c), F.lit(v)) for c, v in filled.items()})
        rows = rows.withColumn("moved", diff("anlst_buy_pct"))
    else:
        top = rows.groupBy("symbol").agg(F.percentile("ret", 0.8).alias("top"))
        rows = rows.join(top, "symbol").withColumns({"up": true(col("ret") > 0), "strong": true(col("ret") > col("top"))})
        rows = rows.withColumns({"anlst_buy_pct": mean("up", 20), "anlst_strong_buy_pct": mean("strong", 20), "moved": col("ret")})
        rows = rows.withColumn("anlst_sell_pct", 1 - col("anlst_buy_pct"))
    rows = rows.withColumns({"rises": true(col("moved") > 0), "falls": true(col("moved") < 0)})
    rows = rows.withColumns({"anlst_consensus_drift": diff("anlst_buy_pct", 20), "anlst_upgrade_count": total("rises", 20), "anlst_downgrade_count": total("falls", 20)})
    rows = rows.withColumns(
        {"anlst_net_revisions": col("anlst_upgrade_count") - col("anlst_downgrade_count"), "anlst_consensus_z": zscore("anlst_consensus_drift", 60, None, None, 1e-8)}
    )
    return _done(rows, [f"anlst_{c}" for c in ("buy_pct", "sell_pct", "strong_buy_pct", "consensus_drift", "upgrade_count", "downgrade_count", "net_revisions", "consensus_z")])


def exchange_put_call(rows: DataFrame) -> DataFrame:
    """Exchange put-call ratio: from ``pcr``, or mapped from realised volatility."""
    if "pcr" in rows.columns:
        rows = rows.withColumn("cboe_equity_pcr", F.coalesce("pcr", F.lit(0.85)))
    else:
        rows = rows.withColumn("filled", F.coalesce("ret", F.lit(0.0)))
        rows = rows.withColumn("cboe_equity_pcr", 0.5 + F.coalesce(std("filled", 20, 5) * YEAR, F.lit(0.15)) * 3.0)
    x = "cboe_equity_pcr"
    z = (col(x) - mean(x, 60, 10)) / F.nullif(std(x, 60, 10), F.lit(0.0))
    rows = rows.withColumns(
        {"cboe_total_pcr": col(x), "cboe_pcr_5d_ma": mean(x, 5, 1), "cboe_pcr_20d_ma": mean(x, 20, 1), "cboe_pcr_zscore": F.coalesce(z, F.lit(0.0)), "cboe_pcr_trend": diff(x, 5)}
    )
    real = "pcr" in rows.columns
    extreme = F.when(col(x) > 1.2, 1.0).when(col(x) < 0.5, -1.0).otherwise(0.0) if real else F.lit(0.0)
    rows = rows.withColumns({"cboe_extreme_signal": extreme, "cboe_regime": three_ways("cboe_pcr_zscore", 1.0) if real else F.lit(0.0)})
    return _done(rows, [x, "cboe_total_pcr", *[f"cboe_{c}" for c in ("pcr_5d_ma", "pcr_20d_ma", "pcr_zscore", "pcr_trend", "extreme_signal", "regime")]])


def crypto_sentiment(rows: DataFrame) -> DataFrame:
    """Crypto fear and greed from ``crypto_score``, 0 to 100; rows without one have zeros."""
    score = col("crypto_score")
    level = F.when(score < 20, 0).when(score < 40, 1).when(score <= 60, 2).when(score <= 80, 3).when(score.isNotNull(), 4)
    rows = rows.withColumns(
        {
            "crypto_fg_index": score,
            "crypto_fg_zscore": zscore("crypto_score", 60, 10, None),
            "crypto_fg_chg_5d": diff("crypto_score", 5),
            "crypto_fg_regime": level.cast("double"),
            "crypto_risk_proxy": true(score > 50),
        }
    )
    return _done(rows, ["crypto_fg_index", "crypto_fg_zscore", "crypto_fg_chg_5d", "crypto_fg_regime", "crypto_risk_proxy"])


def dark_pool(rows: DataFrame) -> DataFrame:
    """Short volume share estimated from moves and volume, ten days late; only days that have one."""
    busy = F.try_divide(col("volume"), mean("volume", 20))
    share = W.clip(0.45 - W.clip(col("ret"), -0.05, 0.05) * 2.0 + W.clip(busy - 1.0, -0.5, 0.5) * 0.10, 0.25, 0.70)
    rows = rows.withColumn("share", share).withColumn("dp_short_volume_ratio", F.lag("share", 10).over(W.ordered())).filter("dp_short_volume_ratio IS NOT NULL")
    x = "dp_short_volume_ratio"
    ends = rows.groupBy("symbol").agg(F.percentile(x, 0.9).alias("p90"), F.percentile(x, 0.1).alias("p10"))
    spread = std(x, 60, 20)
    rows = rows.join(ends, "symbol").withColumns(
        {
            "dp_short_ratio_zscore": W.clip(F.when(spread > 0.001, (col(x) - mean(x, 60, 20)) / spread).otherwise(0.0), -3.0, 3.0),
            "dp_short_ratio_chg_5d": diff(x, 5),
            "dp_short_ratio_extreme": true((col(x) > col("p90")) | (col(x) < col("p10"))),
        }
    )
    return _done(rows, [x, "dp_short_ratio_zscore", "dp_short_ratio_chg_5d", "dp_short_ratio_extreme"])


def congressional(rows: DataFrame, window: int = 30, busy: float = 1.5) -> DataFrame:
    """Smart-money days: rising or falling days of unusual volume over a window."""
    heavy = col("volume") > busy * mean("volume", 20, 1)
    rows = rows.withColumns({"buy": true(heavy & (col("ret") > 0)), "sell": true(heavy & (col("ret") < 0))})
    rows = rows.withColumns({"buys": total("buy", window, 1), "sells": total("sell", window, 1)})
    rows = rows.withColumn("congress_net_buys_30d", (col("buys") - col("sells")) / window)
    both = col("buys") + col("sells")
    rows = rows.withColumns(
        {"congress_volume_z": zscore("congress_net_buys_30d", 60, 10, None), "congress_buy_ratio": F.when(both > 0, col("buys") / (both + 1e-10)).otherwise(0.0)}
    )
    mood = W.clip(0.5 * col("congress_net_buys_30d") + 0.5 * (col("congress_buy_ratio") * 2 - 1), -1.0, 1.0)
    return _done(rows.withColumn("congress_sentiment", mood), ["congress_net_buys_30d", "congress_volume_z", "congress_buy_ratio", "congress_sentiment"])


def credit_spread(rows: DataFrame) -> DataFrame:
    """High-yield against investment-grade returns: from ``hy_ret, ig_ret``, or from return volatility."""
    if "hy_ret" in rows.columns:
        zero = {"hy": F.coalesce("hy_ret", F.lit(0.0)), "ig": F.coalesce("ig_ret", F.lit(0.0)), "cred_hy_ig_spread": F.coalesce(col("hy_ret") - col("ig_ret"), F.lit(0.0))}
    else:
        zero = {"hy": F.coalesce("ret", F.lit(0.0)), "ig": F.lit(0.0), "cred_hy_ig_spread": F.coalesce(std("ret", 20, 5), F.lit(0.0))}
    rows = rows.withColumns(zero)
    rows = rows.withColumn("cred_spread_20d", F.coalesce(mean("cred_hy_ig_spread", 20, 5), F.lit(0.0)))
    rows = rows.withColumns({"cred_spread_z": zscore("cred_spread_20d", 60, 10), "cred_spread_momentum": diff("cred_spread_20d", 5)})
    rows = rows.withColumns(
        {"cred_spread_accel": diff("cred_spread_momentum", 5), "cred_hy_return_20d": total("hy", 20, 5), "cred_ig_return_20d": total("ig", 20, 5), "cred_spread_regime": three_ways("cred_spread_z", 1.5)}
    )
    return _done(rows, [f"cred_{c}" for c in ("hy_ig_spread", "spread_20d", "spread_z", "spread_momentum", "spread_accel", "hy_return_20d", "ig_return_20d", "spread_regime")])


def dollar_index(rows: DataFrame) -> DataFrame:
    """Dollar index: from ``dxy_close``, or the inverse of the symbol's own returns."""
    names = [f"dxy_{c}" for c in ("level", "return", "momentum_20d", "vol_20d", "z_score", "spy_corr", "roc_5d", "regime")]
    if "dxy_close" not in rows.columns:
        own = {
            "dxy_level": F.lit(0.0),
            "dxy_return": -col("ret"),
            "dxy_momentum_20d": -total("ret", 20),
            "dxy_vol_20d": std("ret", 20) * YEAR,
            "dxy_z_score": F.lit(0.0),
            "dxy_spy_corr": F.lit(-0.5),
            "dxy_roc_5d": -total("ret", 5),
            "dxy_regime": F.lit(0.0),
        }
        return _done(rows.withColumns(own), names)
    usual = rows.groupBy("symbol").agg(F.mean("dxy_close").alias("usual"))
    rows = rows.join(usual, "symbol").withColumn("dxy", F.coalesce("dxy_close", "usual"))
    rows = rows.withColumn("dxy_return", change("dxy"))
    frame = W.trailing(20)
    both = F.count(F.when(col("ret").isNotNull() & col("dxy_return").isNotNull(), 1)).over(frame)
    rows = rows.withColumns(
        {
            "dxy_level": zscore("dxy", 60, None, None, 1e-8),
            "dxy_momentum_20d": change("dxy", 20),
            "dxy_vol_20d": std("dxy_return", 20) * YEAR,
            "dxy_z_score": zscore("dxy", 60, None, None, 1e-8),
            "dxy_spy_corr": F.when(both >= 20, W.correlation(col("ret"), col("dxy_return"), frame)),
            "dxy_roc_5d": change("dxy", 5),
        }
    )
    return _done(rows.withColumn("dxy_regime", three_ways("dxy_z_score", 1.0)), names)


def yield_curve(rows: DataFrame) -> DataFrame:
    """Yield curve: from ``tnx, fvx, irx``, or from ratios of moving averages."""
    if "tnx" in rows.columns:
        rows = rows.withColumns({c: F.coalesce(col(c), F.lit(0.0)) for c in ("tnx", "fvx", "irx")})
    else:
        rows = rows.withColumns({f"ma{n}": mean("close", n, 1) for n in (5, 20, 60)})
        ratio = lambda a, b: (col(a) / (col(b) + 1e-10) - 1) * 100
        rows = rows.withColumns({"tnx": ratio("ma20", "ma60"), "fvx": ratio("ma5", "ma20"), "irx": ratio("close", "ma5")})
    tnx, fvx, irx = (col(c) for c in ("tnx", "fvx", "irx"))
    rows = rows.withColumns({"yc_2s10s_slope": tnx - fvx, "yc_3m10y_slope": tnx - irx, "yc_curvature": tnx + irx - 2 * fvx})
    slope = col("yc_3m10y_slope")
    rows = rows.withColumns(
        {
            "yc_slope_momentum_5d": diff("yc_3m10y_slope", 5),
            "yc_slope_momentum_20d": diff("yc_3m10y_slope", 20),
            "yc_slope_z": zscore("yc_3m10y_slope", 60, 10),
            "yc_real_yield_proxy": zscore("tnx", 60, 10),
            "yc_inversion_flag": true(slope < 0),
            "yc_steepening_speed": diff("yc_curvature", 20),
            "yc_regime": F.when(slope > 1.5, 2.0).when(slope >= 0.5, 1.0).when(slope >= 0, 0.0).when(slope < 0, -1.0).otherwise(0.0),
        }
    )
    names = "2s10s_slope 3m10y_slope curvature slope_momentum_5d slope_momentum_20d slope_z real_yield_proxy inversion_flag steepening_speed regime"
    return _done(rows, [f"yc_{c}" for c in names.split()])


def volatility_terms(rows: DataFrame) -> DataFrame:
    """Volatility term structure: from ``vix, vix3m``, or from realised volatility over 20 and 60 days."""
    if "vix" not in rows.columns:
        level = lambda n, least: F.coalesce(std("ret", n, least) * YEAR * 100, F.lit(20.0))
        rows = rows.withColumns({"vix": level(20, 5), "vix3m": level(60, 10)})
    rows = rows.withColumns({"vts_vix_vix3m_ratio": col("vix") / (col("vix3m") + 1e-10), "vts_term_slope": col("vix3m") - col("vix")})
    ratio = col("vts_vix_vix3m_ratio")
    rows = rows.withColumns(
        {
            "vts_contango": F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), 1 - ratio)),
            "vts_backwardation": F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), ratio - 1)),
            "vts_term_slope_z": zscore("vts_term_slope", 60, 10),
            "vts_roll_yield_proxy": diff("vts_vix_vix3m_ratio", 5),
            "vts_ratio_momentum_5d": diff("vts_vix_vix3m_ratio", 5),
            "vts_regime": F.when(ratio < 0.9, 1.0).when(ratio > 1.05, -1.0).otherwise(0.0),
        }
    )
    return _done(rows, [f"vts_{c}" for c in "vix_vix3m_ratio contango backwardation term_slope term_slope_z roll_yield_proxy ratio_momentum_5d regime".split()])


def put_call(rows: DataFrame) -> DataFrame:
    """Put-call ratio: from ``pcr``, or mapped from realised volatility."""
    if "pcr" in rows.columns:
        rows = rows.withColumn("x", col("pcr"))
    else:
        rows = rows.withColumn("filled", F.coalesce("ret", F.lit(0.0)))
        rows = rows.withColumn("x", F.coalesce(W.clip(0.5 + (std("filled", 20) * YEAR * 100 - 20.0) * 0.02, 0.2, 2.0), F.lit(0.7)))
    x = col("x")
    rows = rows.withColumns(
        {
            "pcr_equity_ratio": x,
            "pcr_equity_ratio_5d_ma": mean("x", 5),
            "pcr_equity_ratio_20d_ma": mean("x", 20),
            "pcr_ratio_zscore": (x - mean("x", 60)) / F.nullif(std("x", 60), F.lit(0.0)),
            "pcr_extreme_puts": true(x > 1.2),
            "pcr_extreme_calls": true(x < 0.5),
            "pcr_trend": diff("x", 5),
            "pcr_regime": F.when(x > 1.0, 1.0).when(x < 0.5, -1.0).otherwise(0.0),
        }
    )
    return _done(rows, [f"pcr_{c}" for c in "equity_ratio equity_ratio_5d_ma equity_ratio_20d_ma ratio_zscore extreme_puts extreme_calls trend regime".split()])


def short_interest(rows: DataFrame) -> DataFrame:
    """Short interest: from ``si_ratio_raw``, or from busy falling days."""
    real = "si_ratio_raw" in rows.columns
    if real:
        rows = rows.withColumns({"x": F.coalesce("si_ratio_raw", F.lit(0.0)), "rise": change("close", 5)})
    else:
        busy = col("volume") / (mean("volume", 20) + 1e-8)
        # A missing return is no fall, but volume without a full mean has no ratio.
        rows = rows.withColumn("fell", busy * true(col("ret") < 0))
        rows = rows.withColumns({"x": mean("fell", 10), "rise": total("ret", 5)})
    rows = rows.withColumn("step", diff("x"))
    rows = rows.withColumns(
        {
            "si_ratio": col("x"),
            "si_change": col("step"),
            "si_days_to_cover": col("x") * (1.0 if real else 3.0),
            "si_velocity": mean("step", 5),
            "si_z_score": zscore("x", 60, None, None, 1e-8),
            "si_pct_float": col("x") / (W.rolling(F.max, col("x"), 252) + 1e-8),
            "si_change_5d": diff("x", 5),
        }
    )
    rows = rows.withColumn("si_squeeze_signal", true(col("rise") > 0.01) * true(col("si_z_score") > 1.0))
    return _done(rows, [f"si_{c}" for c in "ratio change days_to_cover velocity z_score pct_float change_5d squeeze_signal".split()])


def fund_flow(rows: DataFrame, window: int = 20, long: int = 60) -> DataFrame:
    """Fund flows estimated from volume changes without matching moves."""
    size, least, few = F.abs("ret"), max(1, window // 2), max(1, long // 4)
    rows = rows.withColumn("flow", (change("volume") - size) / (size + 0.001))
    busy = true((col("volume") > 1.5 * mean("volume", window, least)) & (size < 0.003))
    sold = true((col("ret") < -0.005) & (col("volume") > mean("volume", window, least)))
    rows = rows.withColumns({"basket": busy, "sold": sold})
    spread = std("flow", long, few)
    rows = rows.withColumns(
        {
            "etf_flow_spy_20d": mean("flow", window, least),
            "etf_flow_spy_z": F.when(spread > 1e-8, (col("flow") - mean("flow", long, few)) / spread).otherwise(0.0),
            "etf_flow_creation_redemption": mean("basket", window, least),
            "etf_flow_short_interest_ratio": mean("sold", window, least),
        }
    )
    return _done(rows, ["etf_flow_spy_20d", "etf_flow_spy_z", "etf_flow_creation_redemption", "etf_flow_short_interest_ratio"])


def volatility_of_volatility(rows: DataFrame) -> DataFrame:
    """Volatility of volatility: from ``vvix_close`` (carried forward), or from realised volatility's own deviation."""
    names = [f"vvix_{c}" for c in "level_z vix_ratio momentum_5d momentum_20d percentile vix_divergence acceleration regime".split()]
    rows = rows.withColumn("filled", F.coalesce("ret", F.lit(0.0))).withColumn("realised", std("filled", 20, 5) * YEAR)
    z = lambda x: W.clip((col(x) - mean(x, 60, 20)) / F.when(std(x, 60, 20) == 0, 1.0).otherwise(std(x, 60, 20)), -4.0, 4.0)
    if "vvix_close" in rows.columns:
        # A leading gap takes the first value there is.
        first = F.first("vvix_close", ignorenulls=True).over(W.ordered().rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumn("x", F.coalesce("vvix_close", first))
        level = F.coalesce(F.nullif(col("realised") * 100, F.lit(0.0)), F.lit(20.0))
        place = F.when(F.count("x").over(W.trailing(252)) >= 60, _rank_share("x", 252))
        rows = rows.withColumns({"vvix_vix_ratio": F.coalesce(col("x") / level, F.lit(1.0)), "vvix_percentile": F.coalesce(place, F.lit(0.5))})
        divergence = z("vvix_vix_ratio")
    else:
        rows = rows.withColumn("x", std("realised", 20, 5) * YEAR)
        level = F.coalesce(F.nullif("realised", F.lit(0.0)), F.lit(0.15))
        rows = rows.withColumns({"vvix_vix_ratio": F.coalesce(col("x") / level, F.lit(1.0)), "vvix_percentile": F.lit(0.5)})
        divergence = F.lit(0.0)
    rows = rows.withColumns({"vvix_level_z": z("x"), "vvix_vix_divergence": divergence, "vvix_momentum_5d": F.coalesce(change("x", 5), F.lit(0.0)), "vvix_momentum_20d": change("x", 20)})
    # The proxy's first known acceleration compares with an unknown move, which stays unknown there.
    moved = "vvix_momentum_5d"
    if "vvix_close" not in rows.columns:
        rows, moved = rows.withColumn("moved", change("x", 5)), "moved"
    return _done(rows.withColumns({"vvix_acceleration": diff(moved, 5), "vvix_regime": three_ways(F.coalesce("vvix_level_z", F.lit(0.0)), 1.0)}), names)


def _rank_share(x: str, n: int) -> Column:
    """The average rank of the row's value among the last ``n``, as a share of them."""
    frame = W.trailing(n)
    past = F.collect_list(x).over(frame)
    below = F.size(F.filter(past, lambda v: v < col(x)))
    equal = F.size(F.filter(past, lambda v: v == col(x)))
    return (below + (equal + 1) / 2.0) / F.size(past)


def rotation_of_sectors(rows: DataFrame, cyclical: list[str], defensive: list[str], n: int = 20) -> DataFrame:
    """One row per date over the symbols as sectors: how fast their ranks change, leaders, laggards and concentration."""
    rows = rows.withColumn("moved", F.coalesce(change("close", n), F.lit(0.0)))
    day = Window.partitionBy("date")
    ties = F.count(F.lit(1)).over(Window.partitionBy("date", "moved"))
    rows = rows.withColumn("rank", F.rank().over(day.orderBy(F.desc("moved"))) + (ties - 1) / 2.0)
    rows = rows.withColumn("shift", F.abs(diff("rank", 5)))
    top, bottom = F.sort_array(F.collect_list("moved"), asc=False), F.sort_array(F.collect_list("moved"))
    average = lambda xs: F.aggregate(F.slice(xs, 1, 3), F.lit(0.0), lambda a, v: a + v) / F.size(F.slice(xs, 1, 3))
    of = lambda names: F.mean(F.when(col("symbol").isin(names), col("moved")))
    days = rows.groupBy("date").agg(
        F.coalesce(F.mean("shift"), F.lit(0.0)).alias("secrot_rotation_speed"),
        average(top).alias("secrot_leader_momentum"),
        average(bottom).alias("secrot_laggard_momentum"),
        F.coalesce(F.stddev_samp("moved"), F.lit(0.0)).alias("secrot_momentum_dispersion"),
        F.sum(F.abs("moved")).alias("size"),
        F.coalesce(of(cyclical) - of(defensive), F.lit(0.0)).alias("secrot_cyclical_vs_defensive"),
    )
    leader = col("secrot_leader_momentum")
    # One row per date is ordered here.
    days = days.withColumn("symbol", F.lit("all")).withColumns(
        {"secrot_leader_laggard_spread": leader - col("secrot_laggard_momentum"), "secrot_top3_concentration": F.abs(leader) * 3 / F.when(col("size") == 0, 1.0).otherwise(col("size"))}
    )
    x = "secrot_rotation_speed"
    spread = std(x, 60, 20)
    z = (col(x) - mean(x, 60, 20)) / F.when(spread == 0, 1.0).otherwise(spread)
    names = "rotation_speed leader_momentum laggard_momentum leader_laggard_spread momentum_dispersion top3_concentration cyclical_vs_defensive regime".split()
    return _done(days.withColumn("secrot_regime", three_ways(F.coalesce(z, F.lit(0.0)), 1.0)), [f"secrot_{c}" for c in names]).drop("symbol")


def rotation_from_bars(rows: DataFrame) -> DataFrame:
    """The rotation columns where there are no sectors: from the symbol's own mean and deviation."""
    rows = rows.withColumn("filled", F.coalesce("ret", F.lit(0.0)))
    rows = rows.withColumns({"m": mean("filled", 20, 5), "s": std("filled", 20, 5)})
    found = {
        "secrot_rotation_speed": col("s") * 10,
        "secrot_leader_momentum": col("m") + col("s"),
        "secrot_laggard_momentum": col("m") - col("s"),
        "secrot_leader_laggard_spread": col("s") * 2,
        "secrot_momentum_dispersion": col("s"),
        "secrot_top3_concentration": F.lit(0.5),
        "secrot_cyclical_vs_defensive": F.lit(0.0),
        "secrot_regime": F.lit(0.0),
    }
    return _done(rows.withColumns(found), list(found))


def filled_both_ways(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values take the last one before, or else the first one after."""
    back, ahead = W.ordered().rowsBetween(Window.unboundedPreceding, 0), W.ordered().rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in columns})


def _mean_of(xs: list[Column]) -> Column:
    some = F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some))


def _corr(a: str, b: str, n: int, least: int) -> Column:
    frame = W.trailing(n)
    both = F.count(F.when(col(a).isNotNull() & col(b).isNotNull(), 1)).over(frame)
    return F.when(both >= least, W.correlation(col(a), col(b), frame))


def global_equity(rows: DataFrame) -> DataFrame:
    """Foreign equity: from closes ``efa, vwo, fxi, ewj`` (developed, emerging, China, Japan), or from the symbol's momentum."""
    names = [f"gleq_{c}" for c in "dm_us_spread em_dm_spread china_momentum japan_momentum global_breadth global_us_divergence contagion_risk regime".split()]
    rows = rows.withColumn("own", F.coalesce("ret", F.lit(0.0))).withColumn("own20", total("own", 20, 5))
    if "efa" not in rows.columns:
        zero, half = F.lit(0.0), F.lit(0.5)
        found = dict(zip(names, [zero, zero, col("own20") * 0.8, col("own20") * 0.9, half, zero, half, zero], strict=True))
        return _done(rows.withColumns(found), names)
    markets = ["efa", "vwo", "fxi", "ewj"]
    rows = filled_both_ways(rows, markets)
    rows = rows.withColumns({f"{m}20": F.coalesce(change(m, 20), F.lit(0.0)) for m in markets} | {f"{m}1": F.coalesce(change(m), F.lit(0.0)) for m in markets})
    rows = rows.withColumns(
        {
            "gleq_dm_us_spread": col("efa20") - col("own20"),
            "gleq_em_dm_spread": col("vwo20") - col("efa20"),
            "gleq_china_momentum": col("fxi20"),
            "gleq_japan_momentum": col("ewj20"),
            "gleq_global_breadth": sum((true(col(f"{m}20") > 0) for m in markets), F.lit(0.0)) / len(markets),
            "gleq_global_us_divergence": _mean_of([col(f"{m}20") for m in markets]) - col("own20"),
            "gleq_contagion_risk": F.coalesce(_mean_of([_corr("own", f"{m}1", 60, 20) for m in markets]), F.lit(0.5)),
        }
    )
    breadth = col("gleq_global_breadth")
    return _done(rows.withColumn("gleq_regime", F.when(breadth > 0.7, 1.0).when(breadth < 0.3, -1.0).otherwise(0.0)), names)


def currency_carry(rows: DataFrame) -> DataFrame:
    """Currencies: from ``eur_usd, usd_jpy, gbp_usd, aud_usd``, or from the symbol's momentum."""
    names = [f"fxc_{c}" for c in "eur_momentum jpy_carry_signal gbp_momentum aud_risk_signal dispersion equity_corr dollar_composite regime".split()]
    rows = rows.withColumn("own", F.coalesce("ret", F.lit(0.0)))
    if "eur_usd" not in rows.columns:
        s20, zero = total("own", 20, 5), F.lit(0.0)
        found = [-s20 * 0.5, s20 * 0.3, -s20 * 0.4, total("own", 10, 5) * 0.5, std("own", 20, 5) * 0.5, zero, s20 * 0.3, zero]
        return _done(rows.withColumns(dict(zip(names, found, strict=True))), names)
    pairs = ["eur_usd", "usd_jpy", "gbp_usd", "aud_usd"]
    rows = filled_both_ways(rows, pairs)
    rows = rows.withColumns({f"{p}_{k}": F.coalesce(change(p, k), F.lit(0.0)) for p in pairs for k in (1, 10, 20)})
    dollar = ["eur_usd", "gbp_usd", "aud_usd"]
    rows = rows.withColumns(
        {
            "fxc_eur_momentum": col("eur_usd_20"),
            "fxc_jpy_carry_signal": col("usd_jpy_20"),
            "fxc_gbp_momentum": col("gbp_usd_20"),
            "fxc_aud_risk_signal": col("aud_usd_10"),
            "fxc_dispersion": _mean_of([std(f"{p}_1", 20, 5) for p in dollar]),
            "fxc_equity_corr": _corr("own", "eur_usd_1", 20, 10),
            "fxc_dollar_composite": -_mean_of([col(f"{p}_20") for p in dollar]),
            "carry": (col("aud_usd_20") + col("usd_jpy_20")) / 2,
        }
    )
    spread = std("carry", 60, 20)
    z = (col("carry") - mean("carry", 60, 20)) / F.when(spread == 0, 1.0).otherwise(spread)
    return _done(rows.withColumn("fxc_regime", three_ways(F.coalesce(z, F.lit(0.0)), 1.0)), names)


def streak_breadth(members: DataFrame, weights: DataFrame, most: int = 10, other_weight: float = 0.01) -> DataFrame:
    """One row per date over the members: the shares (plain and weighted) that rise or fall for ``n`` days in a row.

    A member's streak is the number of its rising days in a row, negative for falling ones, 0 for a
    day without a move; days without a return count for nothing. ``weights`` has ``symbol, weight``.
    """
    rows = members.filter("ret IS NOT NULL").withColumns({"way": F.signum("ret"), "n": F.row_number().over(W.ordered())})
    island = col("n") - F.row_number().over(Window.partitionBy("symbol", "way").orderBy("date"))
    rows = rows.withColumn("island", island)
    length = F.row_number().over(Window.partitionBy("symbol", "way", "island").orderBy("date"))
    rows = rows.withColumn("streak", (col("way") * length).cast("double")).join(weights, "symbol", "left").withColumn("weight", F.coalesce("weight", F.lit(other_weight)))
    share = lambda test, by: F.try_divide(F.sum(F.when(test, by).otherwise(0.0)), F.sum(by))
    found = {}
    for n in range(2, most + 1):
        green, red = col("streak") >= n, col("streak") <= -n
        found |= {
            f"pct_green_{n}d": share(green, F.lit(1.0)),
            f"pct_red_{n}d": share(red, F.lit(1.0)),
            f"wtd_pct_green_{n}d": share(green, col("weight")),
            f"wtd_pct_red_{n}d": share(red, col("weight")),
        }
    found |= {
        "avg_streak_length": F.mean("streak"),
        "max_green_streak": F.max("streak"),
        "max_red_streak": F.min("streak"),
        "streak_dispersion": F.coalesce(F.stddev_samp("streak"), F.lit(0.0)),
        "day_return": F.mean("ret"),
    }
    days = rows.groupBy("date").agg(*[x.alias(name) for name, x in found.items()]).withColumn("symbol", F.lit("all"))
    for n in (2, 3, 5):
        days = days.withColumns({f"{k}net_green_{n}d": col(f"{k}pct_green_{n}d") - col(f"{k}pct_red_{n}d") for k in ("", "wtd_")})
    # One row per date is ordered from here on.
    watched = ("pct_green_3d", "pct_red_3d", "wtd_net_green_3d")
    days = days.withColumns({f"{c}_lag1": F.lag(c).over(W.ordered()) for c in watched} | {f"{c}_change": diff(c) for c in watched} | {"step": diff("net_green_3d")})
    days = days.withColumn("breadth_divergence", total("day_return", 3) * total("step", 3))
    return days.drop("symbol", "day_return", "step")


WAVELET = [f"wav_{c}" for c in "trend_5d trend_3d detail_1d detail_2d energy_ratio trend_momentum noise_level denoised_return regime cross_scale".split()]


def wavelets(rows: DataFrame) -> DataFrame:
    """A causal Haar-like decomposition: trends over five and three days, details, and how their energies compare.

    Symbols of fewer than 21 days are all 0.
    """
    close = col("close")
    away = lambda n: (close - mean("close", n, 1)) / (F.abs(close) + 1e-10)
    rows = rows.withColumns({"wav_trend_5d": away(5), "wav_trend_3d": away(3), "wav_detail_1d": change("close"), "wav_detail_2d": change("close", 2)})
    rows = W.exponential(rows, "wav_detail_1d", {"wav_denoised_return": 10})
    detail, trend = F.col("wav_detail_1d"), F.col("wav_trend_5d")
    both = F.count(F.when(trend.isNotNull(), detail)).over(W.trailing(20)) >= 5
    rows = rows.withColumns(
        {
            "wav_energy_ratio": std("wav_detail_1d", 10, 3) / (std("wav_trend_5d", 10, 3) + 1e-10),
            "wav_trend_momentum": diff("wav_trend_5d", 20) / 20,
            "wav_noise_level": std("wav_detail_1d", 20, 5),
            "wav_cross_scale": F.when(both, W.correlation(detail, trend, W.trailing(20))),
            "days": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
        }
    )
    rows = rows.withColumn("wav_regime", F.when(col("wav_energy_ratio") > 1.5, 1.0).when(col("wav_energy_ratio") < 0.7, -1.0).otherwise(0.0))
    bounded = {c: F.when(col("days") >= 21, W.clip(col(c), *((0.0, 20.0) if c == "wav_energy_ratio" else (-10.0, 10.0)))) for c in WAVELET}
    return _done(rows.withColumns(bounded), WAVELET)
