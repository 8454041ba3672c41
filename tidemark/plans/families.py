"""Queries of the feature families, with their SQL as chains of named steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import families as M
from tidemark.plans.catalog import RETURNS, query, returns, rounded
from tidemark.plans.cleaning import PHI
from tidemark.sources.market import table

#: Other series by date, with gaps.
SERIES = """series AS (
  SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount - 0.05) * 20, 12) AS sentiment, round(avg(l_discount) * 1.013729183, 12) AS confidence, CAST(count(*) AS DOUBLE) AS article_count,
         round(avg(CASE WHEN l_discount < 0.03 THEN 1.0 ELSE 0.0 END), 12) AS negative_pct, round(avg(CASE WHEN l_discount > 0.07 THEN 1.0 ELSE 0.0 END), 12) AS positive_pct,
         round(avg(l_quantity) / 25.1371, 12) AS ratio, round(avg(l_quantity) * 2, 12) AS score, round(avg(l_extendedprice), 9) AS price, round(avg(l_discount) * 100, 12) AS d,
         round(avg(l_tax) * 100, 12) AS t, round(stddev_pop(l_discount) * 500, 12) AS v
  FROM lineitem WHERE day(l_shipdate) % 5 <> 0 GROUP BY 1)"""


def series(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.day("l_shipdate") % 5 != 0)
    share = lambda test: F.mean(test.cast("double"))
    found = {
        "sentiment": F.mean(F.col("l_discount") - 0.05) * 20,
        "confidence": F.mean("l_discount") * 1.013729183,
        "article_count": F.count(F.lit(1)).cast("double"),
        "negative_pct": share(F.col("l_discount") < 0.03),
        "positive_pct": share(F.col("l_discount") > 0.07),
        "ratio": F.mean("l_quantity") / 25.1371,
        "score": F.mean("l_quantity") * 2,
        "price": F.mean("l_extendedprice"),
        "d": F.mean("l_discount") * 100,
        "t": F.mean("l_tax") * 100,
        "v": F.stddev_pop("l_discount") * 500,
    }
    # Means depend on the order of their values in the last digits.
    rounded_ = [F.round(x, 9 if name == "price" else 12).alias(name) for name, x in found.items()]
    return rows.groupBy(F.to_date("l_shipdate").alias("date")).agg(*rounded_)


def w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r(agg: str, x: str, n: int, least: int | None = None) -> str:
    """A rolling aggregate that waits for ``least`` values."""
    return f"CASE WHEN count({x}) OVER {w(n)} >= {n if least is None else least} THEN {agg}({x}) OVER {w(n)} END"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY date)"


def z(x: str, n: int = 60, least: int | None = None, limit: float | None = 4, epsilon: float = 1e-10) -> str:
    e = f"(({x} - ({r('avg', x, n, least)})) / (({r('stddev_samp', x, n, max(2, n if least is None else least))}) + {epsilon}))"
    return e if limit is None else f"CASE WHEN {e} IS NOT NULL THEN least(greatest({e}, -{limit}), {limit}) END"


def ways(x: str, limit: float) -> str:
    return f"CASE WHEN {x} > {limit} THEN 1 WHEN {x} < -{limit} THEN -1 ELSE 0 END"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def sql(*steps: dict, names: list[str], digits: int = 5, sources: dict | None = None, days: int | None = None, where: str = "") -> str:
    """Returns of the symbols, with the ``sources`` (name: column of the series) carried forward, through all steps."""
    base = "start AS (SELECT * FROM returns)"
    if sources:
        low = "UNBOUNDED" if days is None else str(days)
        frame = f"(PARTITION BY symbol ORDER BY r.date ROWS BETWEEN {low} PRECEDING AND CURRENT ROW)"
        carried = ", ".join(f"last_value({x} IGNORE NULLS) OVER {frame} AS {name}" for name, x in sources.items())
        base = f"{SERIES}, start AS (SELECT r.*, {carried} FROM returns r LEFT JOIN series s ON s.date = r.date)"
    ctes, last = [], "start"
    for i, step in enumerate(steps):
        ctes.append(f"step{i} AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in step.items())} FROM {last}{where if where and i == len(steps) - 1 else ''})")
        last = f"step{i}"
    shown = ", ".join(f"round(coalesce({c}, 0), {digits}) + 0.0 AS {c}" for c in names)
    return f"WITH {RETURNS}, {base}, {', '.join(ctes)} SELECT symbol, date, {shown} FROM {last}"


def shown(found, digits: int = 5):
    names = found.columns[2:]
    return rounded(found, digits, *names).withColumns({c: F.col(c) + F.lit(0.0) for c in names})


def sourced(spark, sf_dir, sources: dict, days: int | None = None):
    given = series(spark, sf_dir).select("date", *[F.col(x).alias(name) for name, x in sources.items()])
    return M.joined(returns(spark, sf_dir), given, list(sources), days)


@query(
    sql(
        {"raw": "abs(ret) / (close * volume + 1e-10) * 1e6"},
        {"liq_amihud_raw": "least(raw, quantile_cont(raw, 0.99) OVER (PARTITION BY symbol))"},
        {"liq_amihud_20d": r("avg", "liq_amihud_raw", 20, 5), "liq_amihud_z": z("liq_amihud_raw", 60, 20)},
        {"liq_amihud_regime": ways("liq_amihud_z", 1.5)},
        names=["liq_amihud_raw", "liq_amihud_20d", "liq_amihud_z", "liq_amihud_regime"],
    ).replace("least(raw,", "CASE WHEN raw IS NOT NULL THEN least(raw,").replace("OVER (PARTITION BY symbol)) AS liq", "OVER (PARTITION BY symbol)) END AS liq")
)
def amihud_features(spark, sf_dir):
    return shown(M.amihud(returns(spark, sf_dir)))


@query(
    sql(
        {"span": "abs(ln(high / (low + 1e-10))) / (2 * sqrt(ln(2)))", "spread": "stddev_samp(ret) OVER (PARTITION BY symbol)"},
        {"sigma": f"greatest(coalesce({r('avg', 'span', 20, 5)}, CASE WHEN spread >= 1e-10 THEN spread ELSE 0.01 END), 1e-10)"},
        {"x": "least(greatest(coalesce(ret / sigma, 0), -7), 7)"},
        {"phi": PHI.format(x="x")},
        {"gap": "abs(volume * (2 * phi - 1))"},
        {"vpin_value": "round(" + clip(f"({r('sum', 'gap', 50, 10)}) / (({r('sum', 'volume', 50, 10)}) + 1e-10)", 0, 1) + ", 9)"},
        {"vpin_change_5d": f"vpin_value - {lag('vpin_value', 5)}", "vpin_z": z("vpin_value", 60, 20)},
        {"vpin_regime": ways("vpin_z", 1.0)},
        names=["vpin_value", "vpin_z", "vpin_regime", "vpin_change_5d"],
        digits=4,
    )
)
def vpin_features(spark, sf_dir):
    return shown(M.vpin(returns(spark, sf_dir)), 4)


def _range_sql() -> str:
    log = lambda a, b: f"ln({a} / ({b} + 1e-10) + 1e-10)"
    k = "(0.34 / (1.34 + 2.0 / 5))"
    root = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN sqrt(252 * greatest({x}, 0)) END"
    found = {}
    for n in (5, 20):
        least = max(3, n // 2)
        rs = r("avg", "rs", n, least)
        found |= {
            f"rvol_gk_{n}d": root(r("avg", "gk", n, least)),
            f"rvol_rs_{n}d": root(rs),
            f"rvol_yz_{n}d": root(f"({r('var_samp', 'night', n, least)}) + {k} * ({rs}) + (1 - {k}) * ({r('var_samp', 'body', n, least)})"),
        }
    return sql(
        {
            "rs": f"greatest({log('high', 'close')} * {log('high', 'open')} + {log('low', 'close')} * {log('low', 'open')}, 0)",
            "gk": f"greatest(0.5 * pow({log('high', 'low')}, 2) - (2 * ln(2) - 1) * pow({log('close', 'open')}, 2), 0)",
            "night": f"ln(open / ({lag('close', 1)} + 1e-10) + 1e-10)",
            "body": log("close", "open"),
            "span": "(high - low) / (close + 1e-10)",
        },
        found,
        {
            "rvol_ratio_gk_cc": clip(f"rvol_gk_20d / (({root(r('var_samp', 'ret', 20, 5))}) + 1e-10)", 0, 5),
            "rvol_vol_surprise": clip(f"span / (({r('avg', 'span', 20, 5)}) + 1e-10)", 0, 5),
        },
        names=[*found, "rvol_ratio_gk_cc", "rvol_vol_surprise"],
    )


@query(_range_sql())
def range_volatility_features(spark, sf_dir):
    return shown(M.range_volatilities(returns(spark, sf_dir)))


def _moment(power: int, n: int, fewest: int) -> str:
    values = f"list_filter(list(ret) OVER {w(n)}, lambda x: x IS NOT NULL)"
    return (
        f"CASE WHEN count(ret) OVER {w(n)} >= {fewest} AND spot >= {max(fewest, n // 2)} THEN CASE WHEN var_pop(ret) OVER {w(n)} < 1e-20 THEN 0 ELSE "
        f"list_avg(list_transform(list_zip({values}, list_transform({values}, lambda x: avg_{n})), lambda p: pow(p[1] - p[2], {power}))) / pow(var_pop(ret) OVER {w(n)}, {power / 2}) - {3 if power == 4 else 0} END END"
    )


@query(
    sql(
        {"spot": "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1", **{f"avg_{n}": f"avg(ret) OVER {w(n)}" for n in (5, 20, 60)}, "past": f"list_filter(list(ret) OVER {w(60)}, lambda x: x IS NOT NULL)", "deviation": f"stddev_samp(ret) OVER {w(60)}"},
        {
            "skku_skew_5d": _moment(3, 5, 3),
            "skku_skew_20d": _moment(3, 20, 3),
            "skku_skew_60d": _moment(3, 60, 3),
            "skku_kurtosis_20d": _moment(4, 20, 4),
            "skku_tail_asymmetry": "CASE WHEN len(past) >= 10 AND spot >= 30 THEN CASE WHEN deviation < 1e-15 THEN 0 ELSE (len(list_filter(past, lambda x: x > avg_60 + 2 * deviation)) - len(list_filter(past, lambda x: x < avg_60 - 2 * deviation))) / len(past) END END",
        },
        {"skku_skew_z": z("skku_skew_20d", 60, 20)},
        names=["skku_skew_5d", "skku_skew_20d", "skku_skew_60d", "skku_kurtosis_20d", "skku_tail_asymmetry", "skku_skew_z"],
    )
)
def skew_kurtosis_features(spark, sf_dir):
    return shown(M.skew_kurtosis(returns(spark, sf_dir)))


NEWS = [f"anews_{c}" for c in ("sentiment", "confidence", "article_count", "negative_pct", "positive_pct", "sentiment_5d_ma", "momentum", "regime")]
NEWS_SOURCES = {c: c for c in ("sentiment", "confidence", "article_count", "negative_pct", "positive_pct")}
_SMOOTH = {"anews_sentiment_5d_ma": r("avg", "anews_sentiment", 5, 1), "anews_momentum": f"anews_sentiment - {lag('anews_sentiment', 5)}"}


@query(
    sql(
        {f"anews_{c}": f"coalesce({c}, 0)" for c in ("sentiment", "confidence", "negative_pct", "positive_pct")} | {"articles": "coalesce(article_count, 0)"},
        {"anews_article_count": f"(articles - ({r('avg', 'articles', 20, 5)})) / nullif({r('stddev_samp', 'articles', 20, 5)}, 0)", **_SMOOTH, "anews_regime": ways("anews_sentiment", 0.3)},
        names=NEWS,
        sources=NEWS_SOURCES,
    )
)
def news_features(spark, sf_dir):
    return shown(M.news(sourced(spark, sf_dir, NEWS_SOURCES)))


@query(
    sql(
        {"filled": "coalesce(ret, 0)"},
        {"anews_sentiment": clip(f"({r('avg', 'filled', 5, 1)}) * 100", -1, 1), "anews_article_count": "0", "anews_negative_pct": "0", "anews_positive_pct": "0", "anews_regime": "0"},
        {"anews_confidence": "abs(anews_sentiment) * 0.5", **_SMOOTH},
        names=NEWS,
    )
)
def news_features_from_bars(spark, sf_dir):
    return shown(M.news(returns(spark, sf_dir)))


ANALYSTS = [f"anlst_{c}" for c in ("buy_pct", "sell_pct", "strong_buy_pct", "consensus_drift", "upgrade_count", "downgrade_count", "net_revisions", "consensus_z")]
_REVISED = (
    {"rises": "CASE WHEN moved > 0 THEN 1 ELSE 0 END", "falls": "CASE WHEN moved < 0 THEN 1 ELSE 0 END"},
    {"anlst_consensus_drift": f"anlst_buy_pct - {lag('anlst_buy_pct', 20)}", "anlst_upgrade_count": r("sum", "rises", 20), "anlst_downgrade_count": r("sum", "falls", 20)},
    {"anlst_net_revisions": "anlst_upgrade_count - anlst_downgrade_count", "anlst_consensus_z": z("anlst_consensus_drift", 60, None, None, 1e-8)},
)
ANALYST_SOURCES = {"buy_pct": "positive_pct", "sell_pct": "negative_pct", "strong_buy_pct": "confidence"}


@query(
    sql(
        {"anlst_buy_pct": "coalesce(buy_pct, 0.5)", "anlst_sell_pct": "coalesce(sell_pct, 0.1)", "anlst_strong_buy_pct": "coalesce(strong_buy_pct, 0.2)"},
        {"moved": f"anlst_buy_pct - {lag('anlst_buy_pct', 1)}"},
        *_REVISED,
        names=ANALYSTS,
        sources=ANALYST_SOURCES,
    )
)
def analyst_features(spark, sf_dir):
    return shown(M.analyst_ratings(sourced(spark, sf_dir, ANALYST_SOURCES)))


@query(
    sql(
        {"moved": "ret", "up": "CASE WHEN ret > 0 THEN 1 ELSE 0 END", "strong": "CASE WHEN ret > quantile_cont(ret, 0.8) OVER (PARTITION BY symbol) THEN 1 ELSE 0 END"},
        {"anlst_buy_pct": r("avg", "up", 20), "anlst_strong_buy_pct": r("avg", "strong", 20)},
        {"anlst_sell_pct": "1 - anlst_buy_pct"},
        *_REVISED,
        names=ANALYSTS,
    )
)
def analyst_features_from_bars(spark, sf_dir):
    return shown(M.analyst_ratings(returns(spark, sf_dir)))


CBOE = [f"cboe_{c}" for c in ("equity_pcr", "total_pcr", "pcr_5d_ma", "pcr_20d_ma", "pcr_zscore", "pcr_trend", "extreme_signal", "regime")]
_X = "cboe_equity_pcr"
_CBOE = {
    "cboe_total_pcr": _X,
    "cboe_pcr_5d_ma": r("avg", _X, 5, 1),
    "cboe_pcr_20d_ma": r("avg", _X, 20, 1),
    "cboe_pcr_zscore": f"coalesce(({_X} - ({r('avg', _X, 60, 10)})) / nullif({r('stddev_samp', _X, 60, 10)}, 0), 0)",
    "cboe_pcr_trend": f"{_X} - {lag(_X, 5)}",
}


@query(
    sql(
        {_X: "coalesce(pcr, 0.85)"},
        _CBOE | {"cboe_extreme_signal": f"CASE WHEN {_X} > 1.2 THEN 1 WHEN {_X} < 0.5 THEN -1 ELSE 0 END"},
        {"cboe_regime": ways("cboe_pcr_zscore", 1)},
        names=CBOE,
        sources={"pcr": "ratio"},
    )
)
def exchange_put_call_features(spark, sf_dir):
    return shown(M.exchange_put_call(sourced(spark, sf_dir, {"pcr": "ratio"})))


@query(
    sql(
        {"filled": "coalesce(ret, 0)"},
        {_X: f"0.5 + coalesce(({r('stddev_samp', 'filled', 20, 5)}) * sqrt(252), 0.15) * 3"},
        _CBOE | {"cboe_extreme_signal": "0", "cboe_regime": "0"},
        names=CBOE,
        digits=4,
    )
)
def exchange_put_call_features_from_bars(spark, sf_dir):
    return shown(M.exchange_put_call(returns(spark, sf_dir)), 4)


@query(
    sql(
        {
            "crypto_fg_index": "crypto_score",
            "crypto_fg_zscore": z("crypto_score", 60, 10, None),
            "crypto_fg_chg_5d": f"crypto_score - {lag('crypto_score', 5)}",
            "crypto_fg_regime": "CASE WHEN crypto_score < 20 THEN 0 WHEN crypto_score < 40 THEN 1 WHEN crypto_score <= 60 THEN 2 WHEN crypto_score <= 80 THEN 3 WHEN crypto_score IS NOT NULL THEN 4 END",
            "crypto_risk_proxy": "CASE WHEN crypto_score > 50 THEN 1 ELSE 0 END",
        },
        names=["crypto_fg_index", "crypto_fg_zscore", "crypto_fg_chg_5d", "crypto_fg_regime", "crypto_risk_proxy"],
        sources={"crypto_score": "score"},
    )
)
def crypto_sentiment_features(spark, sf_dir):
    return shown(M.crypto_sentiment(sourced(spark, sf_dir, {"crypto_score": "score"})))


@query(
    sql(
        {"busy": f"volume / ({r('avg', 'volume', 20)})"},
        {"share": clip(f"0.45 - ({clip('ret', -0.05, 0.05)}) * 2 + ({clip('busy - 1', -0.5, 0.5)}) * 0.1", 0.25, 0.7)},
        {"dp_short_volume_ratio": lag("share", 10)},
        {"zero": "0"},
        names=["dp_short_volume_ratio", "dp_short_ratio_zscore", "dp_short_ratio_chg_5d", "dp_short_ratio_extreme"],
        where=" WHERE dp_short_volume_ratio IS NOT NULL",
    ).replace(
        " SELECT symbol, date, round(coalesce(dp_short_volume_ratio",
        f""", step4 AS (SELECT *, CASE WHEN ({r('stddev_samp', 'dp_short_volume_ratio', 60, 20)}) > 0.001 THEN least(greatest((dp_short_volume_ratio - ({r('avg', 'dp_short_volume_ratio', 60, 20)}))
  / ({r('stddev_samp', 'dp_short_volume_ratio', 60, 20)}), -3), 3) ELSE 0 END AS dp_short_ratio_zscore, dp_short_volume_ratio - {lag('dp_short_volume_ratio', 5)} AS dp_short_ratio_chg_5d,
  CASE WHEN dp_short_volume_ratio > quantile_cont(dp_short_volume_ratio, 0.9) OVER (PARTITION BY symbol) OR dp_short_volume_ratio < quantile_cont(dp_short_volume_ratio, 0.1) OVER (PARTITION BY symbol)
  THEN 1 ELSE 0 END AS dp_short_ratio_extreme FROM step3) SELECT symbol, date, round(coalesce(dp_short_volume_ratio""",
    ).replace("FROM step3", "FROM step4", 2).replace("FROM step4) SELECT", "FROM step3) SELECT")
)
def dark_pool_features(spark, sf_dir):
    return shown(M.dark_pool(returns(spark, sf_dir)))


@query(
    sql(
        {"heavy": f"volume > 1.5 * ({r('avg', 'volume', 20, 1)})"},
        {"buy": "CASE WHEN heavy AND ret > 0 THEN 1 ELSE 0 END", "sell": "CASE WHEN heavy AND ret < 0 THEN 1 ELSE 0 END"},
        {"buys": f"sum(buy) OVER {w(30)}", "sells": f"sum(sell) OVER {w(30)}"},
        {"congress_net_buys_30d": "(buys - sells) / 30", "congress_buy_ratio": "CASE WHEN buys + sells > 0 THEN buys / (buys + sells + 1e-10) ELSE 0 END"},
        {"congress_volume_z": z("congress_net_buys_30d", 60, 10, None), "congress_sentiment": "least(greatest(0.5 * congress_net_buys_30d + 0.5 * (congress_buy_ratio * 2 - 1), -1), 1)"},
        names=["congress_net_buys_30d", "congress_volume_z", "congress_buy_ratio", "congress_sentiment"],
        digits=4,
    )
)
def congressional_features(spark, sf_dir):
    return shown(M.congressional(returns(spark, sf_dir)), 4)


CREDIT = [f"cred_{c}" for c in ("hy_ig_spread", "spread_20d", "spread_z", "spread_momentum", "spread_accel", "hy_return_20d", "ig_return_20d", "spread_regime")]
_CREDIT = (
    {"cred_spread_20d": f"coalesce({r('avg', 'cred_hy_ig_spread', 20, 5)}, 0)"},
    {"cred_spread_z": z("cred_spread_20d", 60, 10), "cred_spread_momentum": f"cred_spread_20d - {lag('cred_spread_20d', 5)}"},
    {"cred_spread_accel": f"cred_spread_momentum - {lag('cred_spread_momentum', 5)}", "cred_hy_return_20d": r("sum", "hy", 20, 5), "cred_ig_return_20d": r("sum", "ig", 20, 5), "cred_spread_regime": ways("cred_spread_z", 1.5)},
)
CREDIT_SOURCES = {"hy_ret": "sentiment", "ig_ret": "confidence"}


@query(
    sql(
        {"hy": "coalesce(hy_ret, 0)", "ig": "coalesce(ig_ret, 0)", "cred_hy_ig_spread": "coalesce(hy_ret - ig_ret, 0)"}, *_CREDIT, names=CREDIT, sources=CREDIT_SOURCES, days=3, digits=5
    )
)
def credit_spread_features(spark, sf_dir):
    return shown(M.credit_spread(sourced(spark, sf_dir, CREDIT_SOURCES, 3)), 5)


@query(sql({"hy": "coalesce(ret, 0)", "ig": "0", "cred_hy_ig_spread": f"coalesce({r('stddev_samp', 'ret', 20, 5)}, 0)"}, *_CREDIT, names=CREDIT, digits=4))
def credit_spread_features_from_bars(spark, sf_dir):
    return shown(M.credit_spread(returns(spark, sf_dir)), 4)


DOLLAR = [f"dxy_{c}" for c in ("level", "return", "momentum_20d", "vol_20d", "z_score", "spy_corr", "roc_5d", "regime")]


@query(
    sql(
        {"dxy": "coalesce(dxy_close, avg(dxy_close) OVER (PARTITION BY symbol))"},
        {"dxy_return": f"dxy / {lag('dxy', 1)} - 1"},
        {
            "dxy_level": z("dxy", 60, None, None, 1e-8),
            "dxy_z_score": z("dxy", 60, None, None, 1e-8),
            "dxy_momentum_20d": f"dxy / {lag('dxy', 20)} - 1",
            "dxy_vol_20d": f"({r('stddev_samp', 'dxy_return', 20)}) * sqrt(252)",
            "dxy_spy_corr": f"CASE WHEN count(ret * dxy_return) OVER {w(20)} >= 20 THEN corr(ret, dxy_return) OVER {w(20)} END",
            "dxy_roc_5d": f"dxy / {lag('dxy', 5)} - 1",
        },
        {"dxy_regime": ways("dxy_z_score", 1)},
        names=DOLLAR,
        sources={"dxy_close": "price"},
        days=3,
        digits=4,
    )
)
def dollar_index_features(spark, sf_dir):
    return shown(M.dollar_index(sourced(spark, sf_dir, {"dxy_close": "price"}, 3)), 4)


@query(
    sql(
        {
            "dxy_level": "0",
            "dxy_return": "-ret",
            "dxy_momentum_20d": f"-({r('sum', 'ret', 20)})",
            "dxy_vol_20d": f"({r('stddev_samp', 'ret', 20)}) * sqrt(252)",
            "dxy_z_score": "0",
            "dxy_spy_corr": "-0.5",
            "dxy_roc_5d": f"-({r('sum', 'ret', 5)})",
            "dxy_regime": "0",
        },
        names=DOLLAR,
        digits=4,
    )
)
def dollar_index_features_from_bars(spark, sf_dir):
    return shown(M.dollar_index(returns(spark, sf_dir)), 4)


YIELD = [f"yc_{c}" for c in "2s10s_slope 3m10y_slope curvature slope_momentum_5d slope_momentum_20d slope_z real_yield_proxy inversion_flag steepening_speed regime".split()]
_S = "yc_3m10y_slope"
_YIELD = (
    {"yc_2s10s_slope": "tnx - fvx", _S: "tnx - irx", "yc_curvature": "tnx + irx - 2 * fvx"},
    {
        "yc_slope_momentum_5d": f"{_S} - {lag(_S, 5)}",
        "yc_slope_momentum_20d": f"{_S} - {lag(_S, 20)}",
        "yc_slope_z": z(_S, 60, 10),
        "yc_real_yield_proxy": z("tnx", 60, 10),
        "yc_inversion_flag": f"CASE WHEN {_S} < 0 THEN 1 ELSE 0 END",
        "yc_steepening_speed": f"yc_curvature - {lag('yc_curvature', 20)}",
        "yc_regime": f"CASE WHEN {_S} > 1.5 THEN 2 WHEN {_S} >= 0.5 THEN 1 WHEN {_S} >= 0 THEN 0 WHEN {_S} < 0 THEN -1 ELSE 0 END",
    },
)


@query(sql({"tnx": "coalesce(x, 0)", "fvx": "coalesce(y, 0)", "irx": "coalesce(v, 0)"}, *_YIELD, names=YIELD, sources={"x": "d", "y": "t", "v": "v"}, days=3))
def yield_curve_features(spark, sf_dir):
    return shown(M.yield_curve(sourced(spark, sf_dir, {"tnx": "d", "fvx": "t", "irx": "v"}, 3)))


@query(
    sql(
        {f"ma{n}": r("avg", "close", n, 1) for n in (5, 20, 60)},
        {"tnx": "(ma20 / (ma60 + 1e-10) - 1) * 100", "fvx": "(ma5 / (ma20 + 1e-10) - 1) * 100", "irx": "(close / (ma5 + 1e-10) - 1) * 100"},
        *_YIELD,
        names=YIELD,
        digits=4,
    )
)
def yield_curve_features_from_bars(spark, sf_dir):
    return shown(M.yield_curve(returns(spark, sf_dir)), 4)


TERMS = [f"vts_{c}" for c in "vix_vix3m_ratio contango backwardation term_slope term_slope_z roll_yield_proxy ratio_momentum_5d regime".split()]
_T = "vts_vix_vix3m_ratio"
_TERMS = (
    {_T: "vix / (vix3m + 1e-10)", "vts_term_slope": "vix3m - vix"},
    {
        "vts_contango": f"CASE WHEN {_T} IS NOT NULL THEN greatest(0, 1 - {_T}) END",
        "vts_backwardation": f"CASE WHEN {_T} IS NOT NULL THEN greatest(0, {_T} - 1) END",
        "vts_term_slope_z": z("vts_term_slope", 60, 10),
        "vts_roll_yield_proxy": f"{_T} - {lag(_T, 5)}",
        "vts_ratio_momentum_5d": f"{_T} - {lag(_T, 5)}",
        "vts_regime": f"CASE WHEN {_T} < 0.9 THEN 1 WHEN {_T} > 1.05 THEN -1 ELSE 0 END",
    },
)


@query(sql(*_TERMS, names=TERMS, sources={"vix": "v", "vix3m": "score"}, days=3))
def volatility_term_features(spark, sf_dir):
    return shown(M.volatility_terms(sourced(spark, sf_dir, {"vix": "v", "vix3m": "score"}, 3)))


@query(sql({"vix": f"coalesce(({r('stddev_samp', 'ret', 20, 5)}) * sqrt(252) * 100, 20)", "vix3m": f"coalesce(({r('stddev_samp', 'ret', 60, 10)}) * sqrt(252) * 100, 20)"}, *_TERMS, names=TERMS, digits=3))
def volatility_term_features_from_bars(spark, sf_dir):
    return shown(M.volatility_terms(returns(spark, sf_dir)), 3)


PUTS = [f"pcr_{c}" for c in "equity_ratio equity_ratio_5d_ma equity_ratio_20d_ma ratio_zscore extreme_puts extreme_calls trend regime".split()]
_PUTS = {
    "pcr_equity_ratio": "x",
    "pcr_equity_ratio_5d_ma": r("avg", "x", 5),
    "pcr_equity_ratio_20d_ma": r("avg", "x", 20),
    "pcr_ratio_zscore": f"(x - ({r('avg', 'x', 60)})) / nullif({r('stddev_samp', 'x', 60)}, 0)",
    "pcr_extreme_puts": "CASE WHEN x > 1.2 THEN 1 ELSE 0 END",
    "pcr_extreme_calls": "CASE WHEN x < 0.5 THEN 1 ELSE 0 END",
    "pcr_trend": f"x - {lag('x', 5)}",
    "pcr_regime": "CASE WHEN x > 1 THEN 1 WHEN x < 0.5 THEN -1 ELSE 0 END",
}


@query(sql({"x": "pcr"}, _PUTS, names=PUTS, sources={"pcr": "ratio"}))
def put_call_features(spark, sf_dir):
    return shown(M.put_call(sourced(spark, sf_dir, {"pcr": "ratio"})))


@query(sql({"filled": "coalesce(ret, 0)"}, {"x": f"coalesce({clip('0.5 + ((' + r('stddev_samp', 'filled', 20) + ') * sqrt(252) * 100 - 20) * 0.02', 0.2, 2)}, 0.7)"}, _PUTS, names=PUTS, digits=4))
def put_call_features_from_bars(spark, sf_dir):
    return shown(M.put_call(returns(spark, sf_dir)), 4)


SHORTS = [f"si_{c}" for c in "ratio change days_to_cover velocity z_score pct_float change_5d squeeze_signal".split()]


def _shorts(cover: str) -> tuple[dict, ...]:
    return (
        {"step": f"x - {lag('x', 1)}"},
        {
            "si_ratio": "x",
            "si_change": "step",
            "si_days_to_cover": f"x * {cover}",
            "si_velocity": r("avg", "step", 5),
            "si_z_score": z("x", 60, None, None, 1e-8),
            "si_pct_float": f"x / (({r('max', 'x', 252)}) + 1e-8)",
            "si_change_5d": f"x - {lag('x', 5)}",
        },
        {"si_squeeze_signal": "CASE WHEN rise > 0.01 AND si_z_score > 1 THEN 1 ELSE 0 END"},
    )


@query(sql({"x": "coalesce(raw, 0)", "rise": f"close / {lag('close', 5)} - 1"}, *_shorts("1"), names=SHORTS, sources={"raw": "ratio"}, digits=4))
def short_interest_features(spark, sf_dir):
    return shown(M.short_interest(sourced(spark, sf_dir, {"si_ratio_raw": "ratio"})), 4)


@query(
    sql(
        {"fell": f"volume / (({r('avg', 'volume', 20)}) + 1e-8) * CASE WHEN ret < 0 THEN 1 ELSE 0 END"},
        {"x": r("avg", "fell", 10), "rise": r("sum", "ret", 5)},
        *_shorts("3"),
        names=SHORTS,
        digits=4,
    )
)
def short_interest_features_from_bars(spark, sf_dir):
    return shown(M.short_interest(returns(spark, sf_dir)), 4)


@query(
    sql(
        {"flow": f"(volume / {lag('volume', 1)} - 1 - abs(ret)) / (abs(ret) + 0.001)", "usual": r("avg", "volume", 20, 10)},
        {"basket": "CASE WHEN volume > 1.5 * usual AND abs(ret) < 0.003 THEN 1 ELSE 0 END", "sold": "CASE WHEN ret < -0.005 AND volume > usual THEN 1 ELSE 0 END"},
        {
            "etf_flow_spy_20d": r("avg", "flow", 20, 10),
            "etf_flow_spy_z": f"CASE WHEN ({r('stddev_samp', 'flow', 60, 15)}) > 1e-8 THEN (flow - ({r('avg', 'flow', 60, 15)})) / ({r('stddev_samp', 'flow', 60, 15)}) ELSE 0 END",
            "etf_flow_creation_redemption": r("avg", "basket", 20, 10),
            "etf_flow_short_interest_ratio": r("avg", "sold", 20, 10),
        },
        names=["etf_flow_spy_20d", "etf_flow_spy_z", "etf_flow_creation_redemption", "etf_flow_short_interest_ratio"],
        digits=4,
    )
)
def fund_flow_features(spark, sf_dir):
    return shown(M.fund_flow(returns(spark, sf_dir)), 4)


VVIX = [f"vvix_{c}" for c in "level_z vix_ratio momentum_5d momentum_20d percentile vix_divergence acceleration regime".split()]


def _bounded(x: str) -> str:
    s = r("stddev_samp", x, 60, 20)
    return clip(f"({x} - ({r('avg', x, 60, 20)})) / CASE WHEN ({s}) = 0 THEN 1 ELSE ({s}) END", -4, 4)


@query(
    sql(
        {"filled": "coalesce(ret, 0)", "x": "coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"},
        {"realised": f"({r('stddev_samp', 'filled', 20, 5)}) * sqrt(252)", "past": f"list(x) OVER {w(252)}"},
        {
            "vvix_vix_ratio": "coalesce(x / coalesce(nullif(realised * 100, 0), 20), 1)",
            "vvix_percentile": "CASE WHEN len(past) >= 60 THEN (len(list_filter(past, lambda p: p < x)) + (len(list_filter(past, lambda p: p = x)) + 1) / 2.0) / len(past) ELSE 0.5 END",
            "vvix_level_z": _bounded("x"),
            "vvix_momentum_5d": f"coalesce(x / {lag('x', 5)} - 1, 0)",
            "vvix_momentum_20d": f"x / {lag('x', 20)} - 1",
        },
        {"vvix_vix_divergence": _bounded("vvix_vix_ratio"), "vvix_acceleration": f"vvix_momentum_5d - {lag('vvix_momentum_5d', 5)}", "vvix_regime": ways("coalesce(vvix_level_z, 0)", 1)},
        names=VVIX,
        sources={"v": "score"},
        digits=4,
    )
)
def volatility_of_volatility_features(spark, sf_dir):
    return shown(M.volatility_of_volatility(sourced(spark, sf_dir, {"vvix_close": "score"})), 4)


@query(
    sql(
        {"filled": "coalesce(ret, 0)"},
        {"realised": f"({r('stddev_samp', 'filled', 20, 5)}) * sqrt(252)"},
        {"x": f"({r('stddev_samp', 'realised', 20, 5)}) * sqrt(252)"},
        {
            "vvix_vix_ratio": "coalesce(x / coalesce(nullif(realised, 0), 0.15), 1)",
            "vvix_percentile": "0.5",
            "vvix_vix_divergence": "0",
            "vvix_level_z": _bounded("x"),
            "vvix_momentum_5d": f"x / {lag('x', 5)} - 1",
            "vvix_momentum_20d": f"x / {lag('x', 20)} - 1",
        },
        {"vvix_acceleration": f"vvix_momentum_5d - {lag('vvix_momentum_5d', 5)}", "vvix_regime": ways("coalesce(vvix_level_z, 0)", 1)},
        names=VVIX,
        digits=3,
    )
)
def volatility_of_volatility_features_from_bars(spark, sf_dir):
    return shown(M.volatility_of_volatility(returns(spark, sf_dir)), 3)


@query(f"""
WITH {RETURNS}, moved AS (SELECT symbol, date, coalesce(close / {lag('close', 20)} - 1, 0) AS m FROM returns),
ranked AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY m DESC) + (count(*) OVER (PARTITION BY date, m) - 1) / 2.0 AS k FROM moved),
shifted AS (SELECT *, abs(k - {lag('k', 5)}) AS shift FROM ranked),
days AS (
  SELECT 'all' AS symbol, date, coalesce(avg(shift), 0) AS speed, list_avg(list_reverse_sort(list(m))[1:3]) AS lead_, list_avg(list_sort(list(m))[1:3]) AS lag_, coalesce(stddev_samp(m), 0) AS disp,
         sum(abs(m)) AS size, coalesce(avg(m) FILTER (symbol IN ('1-URGENT', '2-HIGH')) - avg(m) FILTER (symbol IN ('4-NOT SPECIFIED', '5-LOW')), 0) AS cyc FROM shifted GROUP BY 2),
z AS (SELECT *, (speed - ({r('avg', 'speed', 60, 20)})) / CASE WHEN ({r('stddev_samp', 'speed', 60, 20)}) = 0 THEN 1 ELSE ({r('stddev_samp', 'speed', 60, 20)}) END AS z FROM days)
SELECT date, round(speed, 5) AS secrot_rotation_speed, round(lead_, 5) + 0.0 AS secrot_leader_momentum, round(lag_, 5) + 0.0 AS secrot_laggard_momentum, round(lead_ - lag_, 5) + 0.0 AS secrot_leader_laggard_spread,
       round(disp, 5) AS secrot_momentum_dispersion, round(abs(lead_) * 3 / CASE WHEN size = 0 THEN 1 ELSE size END, 5) AS secrot_top3_concentration, round(cyc, 5) + 0.0 AS secrot_cyclical_vs_defensive,
       CASE WHEN coalesce(z, 0) > 1 THEN 1.0 WHEN coalesce(z, 0) < -1 THEN -1.0 ELSE 0.0 END AS secrot_regime FROM z""")
def sector_rotation_features(spark, sf_dir):
    found = M.rotation_of_sectors(returns(spark, sf_dir), ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"])
    names = found.columns[1:]
    return rounded(found, 5, *names).withColumns({c: F.col(c) + F.lit(0.0) for c in names})


@query(
    sql(
        {"filled": "coalesce(ret, 0)"},
        {"m": r("avg", "filled", 20, 5), "s": r("stddev_samp", "filled", 20, 5)},
        {
            "secrot_rotation_speed": "s * 10",
            "secrot_leader_momentum": "m + s",
            "secrot_laggard_momentum": "m - s",
            "secrot_leader_laggard_spread": "s * 2",
            "secrot_momentum_dispersion": "s",
            "secrot_top3_concentration": "0.5",
            "secrot_cyclical_vs_defensive": "0",
            "secrot_regime": "0",
        },
        names=[f"secrot_{c}" for c in "rotation_speed leader_momentum laggard_momentum leader_laggard_spread momentum_dispersion top3_concentration cyclical_vs_defensive regime".split()],
        digits=4,
    )
)
def sector_rotation_features_from_bars(spark, sf_dir):
    return shown(M.rotation_from_bars(returns(spark, sf_dir)), 4)


GLOBAL = [f"gleq_{c}" for c in "dm_us_spread em_dm_spread china_momentum japan_momentum global_breadth global_us_divergence contagion_risk regime".split()]
MARKETS = {"efa": "price", "vwo": "score", "fxi": "ratio", "ewj": "v"}


def _both_ways(c: str) -> str:
    return f"coalesce({c}, first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def _corr(a: str, b: str, n: int, least: int) -> str:
    return f"CASE WHEN count({a} * {b}) OVER {w(n)} >= {least} AND NOT isnan(corr({a}, {b}) OVER {w(n)}) THEN corr({a}, {b}) OVER {w(n)} END"


@query(
    sql(
        {"own": "coalesce(ret, 0)", **{f"{m}_f": _both_ways(m) for m in MARKETS}},
        {"own20": r("sum", "own", 20, 5), **{f"{m}20": f"coalesce({m}_f / nullif({lag(m + '_f', 20)}, 0) - 1, 0)" for m in MARKETS}, **{f"{m}1": f"coalesce({m}_f / nullif({lag(m + '_f', 1)}, 0) - 1, 0)" for m in MARKETS}},
        {
            "gleq_dm_us_spread": "efa20 - own20",
            "gleq_em_dm_spread": "vwo20 - efa20",
            "gleq_china_momentum": "fxi20",
            "gleq_japan_momentum": "ewj20",
            "gleq_global_breadth": "(" + " + ".join(f"CASE WHEN {m}20 > 0 THEN 1 ELSE 0 END" for m in MARKETS) + ") / 4",
            "gleq_global_us_divergence": "(" + " + ".join(f"{m}20" for m in MARKETS) + ") / 4 - own20",
            "gleq_contagion_risk": "coalesce(list_avg(list_filter([" + ", ".join(_corr("own", f"{m}1", 60, 20) for m in MARKETS) + "], lambda c: c IS NOT NULL)), 0.5)",
        },
        {"gleq_regime": "CASE WHEN gleq_global_breadth > 0.7 THEN 1 WHEN gleq_global_breadth < 0.3 THEN -1 ELSE 0 END"},
        names=GLOBAL,
        sources=MARKETS,
        digits=4,
    )
)
def global_equity_features(spark, sf_dir):
    return shown(M.global_equity(sourced(spark, sf_dir, MARKETS)), 4)


@query(
    sql(
        {"own": "coalesce(ret, 0)"},
        {"own20": r("sum", "own", 20, 5)},
        dict(zip(GLOBAL, ["0", "0", "own20 * 0.8", "own20 * 0.9", "0.5", "0", "0.5", "0"], strict=True)),
        names=GLOBAL,
        digits=4,
    )
)
def global_equity_features_from_bars(spark, sf_dir):
    return shown(M.global_equity(returns(spark, sf_dir)), 4)


CARRY = [f"fxc_{c}" for c in "eur_momentum jpy_carry_signal gbp_momentum aud_risk_signal dispersion equity_corr dollar_composite regime".split()]
PAIRS = {"eur_usd": "price", "usd_jpy": "score", "gbp_usd": "ratio", "aud_usd": "v"}
_DOLLAR = ("eur_usd", "gbp_usd", "aud_usd")


@query(
    sql(
        {"own": "coalesce(ret, 0)", **{f"{p}_f": _both_ways(p) for p in PAIRS}},
        {f"{p}_{k}": f"coalesce({p}_f / nullif({lag(p + '_f', k)}, 0) - 1, 0)" for p in PAIRS for k in (1, 10, 20)},
        {
            "fxc_eur_momentum": "eur_usd_20",
            "fxc_jpy_carry_signal": "usd_jpy_20",
            "fxc_gbp_momentum": "gbp_usd_20",
            "fxc_aud_risk_signal": "aud_usd_10",
            "fxc_dispersion": "list_avg(list_filter([" + ", ".join(r("stddev_samp", f"{p}_1", 20, 5) for p in _DOLLAR) + "], lambda c: c IS NOT NULL))",
            "fxc_equity_corr": _corr("own", "eur_usd_1", 20, 10),
            "fxc_dollar_composite": "-(" + " + ".join(f"{p}_20" for p in _DOLLAR) + ") / 3",
            "carry": "(aud_usd_20 + usd_jpy_20) / 2",
        },
        {"fxc_regime": ways(f"coalesce((carry - ({r('avg', 'carry', 60, 20)})) / CASE WHEN ({r('stddev_samp', 'carry', 60, 20)}) = 0 THEN 1 ELSE ({r('stddev_samp', 'carry', 60, 20)}) END, 0)", 1)},
        names=CARRY,
        sources=PAIRS,
        digits=4,
    )
)
def currency_carry_features(spark, sf_dir):
    return shown(M.currency_carry(sourced(spark, sf_dir, PAIRS)), 4)


@query(
    sql(
        {"own": "coalesce(ret, 0)"},
        {"s20": r("sum", "own", 20, 5), "s10": r("sum", "own", 10, 5), "d20": r("stddev_samp", "own", 20, 5)},
        dict(zip(CARRY, ["-s20 * 0.5", "s20 * 0.3", "-s20 * 0.4", "s10 * 0.5", "d20 * 0.5", "0", "s20 * 0.3", "0"], strict=True)),
        names=CARRY,
        digits=4,
    )
)
def currency_carry_features_from_bars(spark, sf_dir):
    return shown(M.currency_carry(returns(spark, sf_dir)), 4)


def _streak_sql() -> str:
    shares, shown_ = [], []
    for n in range(2, 11):
        for name, test in (("green", f"streak >= {n}"), ("red", f"streak <= -{n}")):
            shares += [f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) AS pct_{name}_{n}d", f"sum(CASE WHEN {test} THEN weight ELSE 0 END) / sum(weight) AS wtd_pct_{name}_{n}d"]
            shown_ += [f"pct_{name}_{n}d", f"wtd_pct_{name}_{n}d"]
    nets = [f"{k}pct_green_{n}d - {k}pct_red_{n}d AS {k}net_green_{n}d" for n in (2, 3, 5) for k in ("", "wtd_")]
    shown_ += [f"{k}net_green_{n}d" for n in (2, 3, 5) for k in ("", "wtd_")] + ["avg_streak_length", "max_green_streak", "max_red_streak", "streak_dispersion"]
    lags = [x for c in ("pct_green_3d", "pct_red_3d", "wtd_net_green_3d") for x in (f"lag({c}) OVER o AS {c}_lag1", f"{c} - lag({c}) OVER o AS {c}_change")]
    shown_ += [f"{c}_{x}" for c in ("pct_green_3d", "pct_red_3d", "wtd_net_green_3d") for x in ("lag1", "change")]
    three = "OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"""WITH {RETURNS}, moved AS (SELECT symbol, date, ret, sign(ret) AS way, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM returns WHERE ret IS NOT NULL),
islands AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, way ORDER BY date) AS island FROM moved),
streaks AS (SELECT *, way * row_number() OVER (PARTITION BY symbol, way, island ORDER BY date) AS streak, CASE symbol WHEN '1-URGENT' THEN 0.07 WHEN '2-HIGH' THEN 0.03 ELSE 0.01 END AS weight FROM islands),
days AS (SELECT date, {", ".join(shares)}, avg(streak) AS avg_streak_length, max(streak) AS max_green_streak, min(streak) AS max_red_streak, coalesce(stddev_samp(streak), 0) AS streak_dispersion, avg(ret) AS day_return
         FROM streaks GROUP BY 1),
nets AS (SELECT *, {", ".join(nets)} FROM days),
lagged AS (SELECT *, {", ".join(lags)}, net_green_3d - lag(net_green_3d) OVER o AS step FROM nets WINDOW o AS (ORDER BY date))
SELECT date, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in shown_)},
       round(CASE WHEN count(day_return) {three} >= 3 AND count(step) {three} >= 3 THEN sum(day_return) {three} * sum(step) {three} END, 5) + 0.0 AS breadth_divergence FROM lagged"""


@query(_streak_sql())
def streak_breadth_features(spark, sf_dir):
    rows = returns(spark, sf_dir)
    weights = spark.sql("SELECT * FROM VALUES ('1-URGENT', 0.07D), ('2-HIGH', 0.03D) AS given(symbol, weight)")
    found = M.streak_breadth(rows.select("symbol", "date", "ret"), weights)
    names = [c for c in found.columns if c not in ("date", "breadth_divergence")]
    found = rounded(rounded(found, 6, *names), 5, "breadth_divergence")
    return found.withColumns({c: F.col(c) + F.lit(0.0) for c in [*names, "breadth_divergence"]})
