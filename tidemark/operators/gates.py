"""Trading gates: rules on slow series that boost, reduce or block a signal at extremes.

Each gate's first rule that holds decides; without one, or without its value, it passes. Multipliers
compose, and any block turns the signal into HOLD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

col = F.col


def _contrarian(x: str, caution: float, block: float, reduce: float) -> list[tuple]:
    """A crowd on one side: against it is boosted, with it reduced and, far out, blocked."""
    along = lambda limit: f"{x} > {limit} AND signal = 'BUY' OR {x} < -{limit} AND signal = 'SELL'"
    return [(along(block), "BLOCK", 0.0, 0.0), (along(caution), "REDUCE", reduce, 1.0), (f"abs({x}) > {caution}", "BOOST", 1 / reduce, 1.0)]


# Each gate's rules in order (condition, action, confidence and size multiplier) and the hours its value stays fresh.
RULES: dict[str, list[tuple]] = {
    "fear_greed": [
        ("fear_greed < 20 AND signal = 'BUY' OR fear_greed > 80 AND signal = 'SELL'", "BOOST", 1.15, 1.0),
        ("fear_greed < 20 AND signal = 'SELL' OR fear_greed > 80 AND signal = 'BUY'", "REDUCE", 0.80, 1.0),
    ],
    "cot": _contrarian("cot", 2.0, 3.0, 0.70),
    "aaii": _contrarian("aaii", 30.0, 40.0, 0.85),
    "gex": [("gex = 'positive_gex'", "BOOST", 1.10, 1.0), ("gex = 'negative_gex'", "REDUCE", 0.85, 1.0)],
    "insider": [("insider >= 0.90D AND signal = 'SELL' OR insider <= 0.10D AND signal = 'BUY'", "REDUCE", 1.0, 0.50)],
    "macro_calendar": [
        ("macro_calendar IN ('fomc', 'nfp', 'cpi')", "BLOCK", 0.0, 0.0),
        ("macro_calendar = 'before_fomc'", "REDUCE", 0.7, 0.5),
        ("macro_calendar IN ('before_nfp', 'before_cpi')", "REDUCE", 0.8, 0.6),
    ],
    "vol_regime": [
        ("vol_regime > 35", "BLOCK", 0.0, 0.0),
        ("vol_regime > 28 AND signal = 'BUY'", "REDUCE", 0.6, 0.5),
        ("vol_regime > 28 AND signal = 'SELL'", "BOOST", 1.15, 1.0),
        ("vol_regime <= 28 AND backwardation", "REDUCE", 0.7, 0.8),
    ],
}
FRESH_HOURS = {"fear_greed": 48, "cot": 168, "aaii": 168, "gex": 24, "insider": 168}
CONFIDENCE, SIZE = (0.3, 1.5), (0.2, 1.5)


def trading_gates(signals: DataFrame, gates: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """Adds each gate's ``<gate>_action``, the bounded ``confidence_mult`` and ``position_mult``, ``blocked_by`` and ``gated_signal``.

    ``signals`` has ``signal`` (BUY, SELL or HOLD) and, for each of ``gates``, a column of its name with the latest
    value: scores, z-scores, spreads, a regime, a percentile, the day's event (``fomc``, ``before_nfp``, ...), a volatility level (with a boolean
    ``backwardation``). Where ``<gate>_age`` (hours) exists and is past the gate's limit, the gate is ``STALE`` and has no say. HOLD passes all gates.
    """
    rows = signals
    confidence, size = F.lit(1.0), F.lit(1.0)
    blocking = []
    for gate in gates:
        action, conf, pos = F.lit("PASS"), F.lit(1.0), F.lit(1.0)
        for test, name, c, p in reversed(RULES[gate]):
            # A test on a missing value is null and does not hold.
            action, conf, pos = (F.when(F.expr(test), value).otherwise(rest) for value, rest in ((name, action), (c, conf), (p, pos)))
        stale = F.lit(False)
        if gate in FRESH_HOURS and f"{gate}_age" in signals.columns:
            stale = F.coalesce(col(f"{gate}_age") > FRESH_HOURS[gate], F.lit(False))
        idle = stale | (col("signal") == "HOLD") | col("signal").isNull()
        rows = rows.withColumn(f"{gate}_action", F.when(stale, "STALE").when(idle, "PASS").otherwise(action))
        confidence, size = confidence * F.when(idle, 1.0).otherwise(conf), size * F.when(idle, 1.0).otherwise(pos)
        blocking.append(F.when(col(f"{gate}_action") == "BLOCK", gate))
    bounded = lambda x, limits: F.least(F.greatest(x, F.lit(limits[0])), F.lit(limits[1]))
    rows = rows.withColumns({"confidence_mult": bounded(confidence, CONFIDENCE), "position_mult": bounded(size, SIZE), "blocked_by": F.concat_ws(",", *blocking)})
    return rows.withColumn("gated_signal", F.when(col("blocked_by") != "", "HOLD").otherwise(col("signal")))


def average_true_range_stops(levels: DataFrame, stop: float = 1.5, take: float = 2.5, least: float = 0.001, most: float = 0.05) -> DataFrame:
    """Adds the volatility ``regime`` and the stop and target of ``close`` for its ``direction`` from ``atr``, scaled by the level ``vix``.

    A missing ``atr`` is a hundredth of the price. Shares of a price of 0 are null.
    """
    level, price = col("vix"), col("close")
    regime, scale = F.lit("EXTREME"), F.lit(2.0)
    for name, limit, factor in reversed((("LOW_VOL", 15, 0.8), ("NORMAL", 25, 1.0), ("HIGH_VOL", 35, 1.5))):
        regime, scale = F.when(level < limit, name).otherwise(regime), F.when(level < limit, factor).otherwise(scale)
    range_ = F.coalesce("atr", price * 0.01)
    way = F.when(F.upper("direction") == "LONG", 1.0).otherwise(-1.0)
    share = F.try_divide(range_ * stop * scale, price)
    rows = levels.withColumns({"regime": regime, "vix_scale": scale, "stop_pct": F.when(share.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), share)))})
    return rows.withColumns(
        {
            "tp_pct": F.try_divide(range_ * take * scale, price),
            "stop_loss": price - way * price * col("stop_pct"),
            "take_profit": price + way * range_ * take * scale,
        }
    )
