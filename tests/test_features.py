"""Feature operators on hand-made tables: resets, gaps, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import features, folds, splits, strategy, synthetic

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]


def returns(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, d, r) for d, r in zip(DAYS, values, strict=False)], "symbol string, date date, ret double")


def test_cusum_legs_restart_by_themselves(spark):
    rows = returns(spark, [0.6, None, 0.6, -0.5, -0.6, 0.1, 1.2]).unionByName(returns(spark, [0.6, 0.3], "B"))
    found = {(r["symbol"], r["date"]): (r["up"], r["down"]) for r in folds.cusum_events(rows, 1.0).collect()}
    assert found == {("A", DAYS[2]): (True, False), ("A", DAYS[4]): (False, True), ("A", DAYS[6]): (True, False)}


def test_amount_bars_do_not_carry_the_overshoot(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(hours=12 * i), 1.0, 2.0, 0.5, 1.5, v) for i, v in enumerate([4, 5, 9, 1, 8, 1])]
    bars = spark.createDataFrame(rows, "symbol string, at timestamp, open double, high double, low double, close double, volume long")
    found = folds.amount_bars(bars, F.col("volume"), "at", ["at"]).orderBy("bar").collect()
    # 28 in 3 days: bars close at 9 1/3.
    assert [(r["volume"], r["n_rows"]) for r in found] == [(18, 3), (10, 3)]


def test_empty_tables(spark):
    none = returns(spark, [0.1]).limit(0)
    assert folds.cusum_events(none, 1.0).count() == 0
    bars = none.select("symbol", "date", *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")], "ret")
    for found in (
        features.order_flow(bars), features.seasonality(bars), features.moments(bars), features.range_structure(bars), features.rotation(bars),
        features.circuit_breaker(bars), features.l_moments(bars), features.entropies(bars), splits.combinatorial_folds(bars),
        splits.walk_forward(bars, 5, 2, 2), strategy.horizon_signals(bars), synthetic.without_extremes(bars, 0.2),
    ):
        assert found.count() == 0


def test_few_rows_and_flat_prices(spark):
    bars = returns(spark, [None, 0.0, 0.0]).select("*", *[F.lit(5.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    assert {r["imbalance"] for r in features.order_flow(bars).collect()} == {0.0}
    assert {(r["shannon"], r["permutation"]) for r in features.entropies(bars).collect()} == {(0.0, 0.0)}
    assert splits.combinatorial_folds(bars).count() == 0


def test_walk_forward_windows(spark):
    found = splits.walk_forward(returns(spark, [0.0] * 12), train=3, test=2, step=2).collect()
    sizes = {}
    for r in found:
        sizes.setdefault((r["window"], r["role"]), []).append(r["date"])
    want = {}
    for k in range(3):
        start = 2 * k
        want[(k, "train")], want[(k, "test")] = DAYS[start : start + 4], DAYS[start + 4 : start + 7]
    assert {k: sorted(v) for k, v in sizes.items()} == want
    anchored = splits.walk_forward(returns(spark, [0.0] * 12), train=3, test=2, step=2, anchored=True)
    assert anchored.filter("window = 2 AND role = 'train'").count() == 8


def test_signal_of_missing_probabilities_is_hold(spark):
    rows = spark.createDataFrame([(0.9, 0.9), (0.9, 0.1), (0.1, None), (None, 0.9)], "swing double, timing double")
    assert [r[0] for r in rows.select(strategy.signal(F.col("swing"), F.col("timing"))).collect()] == ["BUY", "HOLD", "SELL", "HOLD"]
