"""Calibration, conformal sizes, bandits and gates against plain recomputation and on edge cases."""

import math
import random

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import gates as G
from tidemark.plans import catalog

SCORED = "symbol string, score double, label int, extra string"


def best_rising(points):
    """Levels of the least-squares rising fit by the closed form: the highest of the lowest means around each point."""
    xs = sorted(points)
    sums = [(sum(points[x]), len(points[x])) for x in xs]
    mean = lambda j, k: sum(s for s, _ in sums[j : k + 1]) / sum(w for _, w in sums[j : k + 1])
    n = len(xs)
    return xs, [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_isotonic_against_closed_form(spark, buckets):
    draw = random.Random(buckets)
    rows = [(s, round(draw.random(), draw.choice([1, 2])), int(draw.random() < 0.5), "x") for s in ("a", "b") for _ in range(60)]
    rows += [("one", 0.5, 1, "x"), ("a", None, 1, "x"), ("a", 0.5, None, "x"), ("flat", 0.1, 1, "x"), ("flat", 0.9, 0, "x")]
    table = spark.createDataFrame(rows, SCORED).repartition(4)
    steps = C.isotonic_fit(table, buckets=buckets)
    found = {}
    for r in steps.collect():
        found.setdefault(r.symbol, []).append((r.low, r.high, r.level))
    for symbol in {r[0] for r in rows}:
        points = {}
        for s, x, y, _ in rows:
            if s == symbol and x is not None and y is not None:
                points.setdefault(x, []).append(y)
        xs, levels = best_rising(points)
        blocks = sorted(found[symbol])
        assert all(a[2] < b[2] and a[1] < b[0] for a, b in zip(blocks, blocks[1:]))
        for x, level in zip(xs, levels):
            assert [abs(b[2] - level) < 1e-9 for b in blocks if b[0] <= x <= b[1]] == [True]
    asked = [(s, x, 1, f"{i}") for i, (s, x) in enumerate([(s, round(draw.uniform(-0.2, 1.2), 3)) for s in ("a", "b", "one", "flat") for _ in range(50)] + [("a", None), ("unknown", 0.3)])]
    got = {r.extra: r.calibrated for r in C.isotonic_apply(spark.createDataFrame(asked, SCORED).repartition(3), steps).collect()}
    assert len(got) == len(asked)
    for symbol, x, _, name in asked:
        if x is None or symbol == "unknown":
            assert got[name] is None
            continue
        blocks = sorted(found[symbol])
        want = np.interp(x, [v for b in blocks for v in b[:2]], [b[2] for b in blocks for _ in range(2)])
        assert abs(got[name] - min(max(want, 0.01), 0.99)) < 1e-9


def test_pooling_is_associative():
    draw = np.random.default_rng(3)
    x, y, w = np.arange(200.0), draw.random(200), draw.integers(1, 5, 200).astype(float)
    whole = C.pooled(x, x, y * w, w)
    parts = [block for at in range(0, 200, 37) for block in C.pooled(x[at : at + 37], x[at : at + 37], (y * w)[at : at + 37], w[at : at + 37])]
    again = C.pooled(*(np.array(c) for c in zip(*parts)))
    assert np.allclose(whole, again)


def test_calibration_error_by_hand(spark):
    rows = [("a", 0.05, 0, "x"), ("a", 0.08, 1, "x"), ("a", 1.0, 1, "x"), ("a", 0.95, 0, "x"), ("a", None, 1, "x")]
    found = C.calibration_error(spark.createDataFrame(rows, SCORED), ["symbol"], "score", "label").first()
    assert abs(found.ece - (abs(0.13 - 1) + abs(1.95 - 1)) / 4) < 1e-12


def test_conformal_thresholds_and_sizes(spark):
    draw = random.Random(9)
    rows = [("a", round(draw.random(), 2), draw.randrange(2), "x") for _ in range(83)] + [("few", 0.3, 1, "x"), ("a", None, 1, "x"), ("a", 0.4, None, "x")]
    for alpha in (0.05, 0.1, 0.5):
        found = {r.symbol: r for r in C.conformal_threshold(spark.createDataFrame(rows, SCORED), alpha=alpha, buckets=5).collect()}
        wrong = sorted(1 - x if y else x for s, x, y, _ in rows if s == "a" and x is not None and y is not None)
        assert found["a"].n == 83 and abs(found["a"].threshold - wrong[math.ceil(84 * (1 - alpha) - 1e-9) - 1]) < 1e-12
    assert C.conformal_threshold(spark.createDataFrame(rows, SCORED), alpha=0.1).filter("symbol = 'few'").first().threshold is None
    thresholds = spark.createDataFrame([("a", 5, 0.4), ("few", 1, None)], "symbol string, n long, threshold double")
    asked = spark.createDataFrame([("a", 0.9, 1, "one"), ("a", 0.5, 1, "none"), ("few", 0.5, 1, "two"), ("new", 0.5, 1, "two")], SCORED)
    got = {(r.symbol, r.extra): (r.set_width, r["size"]) for r in C.conformal_sizes(asked, thresholds).collect()}
    assert got == {("a", "one"): (1, 0.1), ("a", "none"): (0, 0.05), ("few", "two"): (2, 0.025), ("new", "two"): (2, 0.025)}


def test_adaptive_alpha_step_by_step(spark):
    draw = random.Random(2)
    wrong = [None, *[draw.choice([0, 1, None]) for _ in range(60)]]
    rows = spark.createDataFrame([("a", i, w) for i, w in enumerate(wrong)], "symbol string, d int, wrong int").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    got = [(r.alpha, r.error_rate) for r in C.adaptive_alpha(rows, window=10, gamma=0.05).orderBy("date").collect()]
    alpha, rate, seen = 0.1, 0.0, []
    for i, w in enumerate(wrong):
        if w is not None:
            seen = [*seen, w][-10:]
            weights = [0.95 ** (len(seen) - 1 - j) for j in range(len(seen))]
            rate = sum(a * b for a, b in zip(weights, seen)) / sum(weights)
            alpha = min(0.3, max(0.01, alpha + 0.05 * (rate - 0.1)))
        assert abs(got[i][0] - alpha) < 1e-12 and abs(got[i][1] - rate) < 1e-12
    assert C.adaptive_alpha(rows.limit(0)).count() == 0


def test_thompson_fold_and_choices(spark):
    draw = random.Random(4)
    rows = [(draw.choice("xyz"), d, i, round(draw.random(), 3)) for d in range(5) for i in range(30)] + [("x", 9, 0, None), ("x", 9, 1, 1.5)]
    posteriors = C.thompson_posteriors(spark.createDataFrame(rows, "model string, day int, n int, reward double").repartition(4), ["day", "n"], decay=0.98)
    got = {r.model: r for r in posteriors.collect()}
    alpha, beta = dict.fromkeys("xyz", 1.0), dict.fromkeys("xyz", 1.0)
    for model, _, _, reward in sorted(rows[:-2], key=lambda r: r[1:3]):
        for m in "xyz":
            alpha[m], beta[m] = alpha[m] * 0.98, beta[m] * 0.98
        alpha[model], beta[model] = alpha[model] + reward, beta[model] + 1 - reward
    for m in "xyz":
        assert abs(got[m].alpha - alpha[m]) < 1e-9 and abs(got[m].beta - beta[m]) < 1e-9
    assert abs(sum(r.weight for r in got.values()) - 1) < 1e-12
    arms = spark.createDataFrame([("bad", 2.0, 20.0), ("good", 20.0, 2.0), ("odd", 1.0, 1.0)], "model string, alpha double, beta double")
    draws = spark.range(400).withColumnRenamed("id", "draw")
    chosen = {r.draw: r.choice for r in C.thompson_choices(arms, draws.repartition(7)).collect()}
    assert chosen == {r.draw: r.choice for r in C.thompson_choices(arms, draws).collect()} and len(chosen) == 400
    share = lambda m: sum(c == m for c in chosen.values()) / 400
    assert share("good") > 0.7 and share("bad") < 0.02 and 0.03 < share("odd") < 0.3
    with pytest.raises(ValueError):
        C.thompson_choices(arms, draws, most_arms=2)


def test_thompson_query_counts_every_event(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else f"2024-01-0{1 + i % 3} 10:00:00", "ab"[i % 2], None if i % 7 == 0 else 40.0 * i) for i in range(30)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["thompson_posteriors"](spark, str(tmp_path)).toPandas()
    sql = catalog.ORACLES["thompson_posteriors"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert oracle.normal(got) == oracle.normal(duckdb.sql(sql).df())


def test_true_ranges(spark):
    rows = [("a", i, 10.0 + i % 3, 9.0 - i % 2, 9.5 + i % 5) for i in range(20)]
    bars = spark.createDataFrame(rows, "symbol string, d int, high double, low double, close double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    got = [r.atr for r in C.average_true_range(bars).orderBy("date").collect()]
    ranges = [rows[0][2] - rows[0][3]] + [max(r[2] - r[3], abs(r[2] - p[4]), abs(r[3] - p[4])) for p, r in zip(rows, rows[1:])]
    level = None
    for i in range(20):
        level = sum(ranges[: i + 1]) / (i + 1) if i < 14 else 2 / 15 * ranges[i] + 13 / 15 * level
        assert abs(got[i] - level) < 1e-12


def test_gates_at_their_edges(spark):
    schema = "signal string, fear_greed double, fear_greed_age double, cot double, aaii double, gex string, insider double, macro_calendar string, vol_regime double, backwardation boolean"
    quiet = {"fear_greed": 50.0, "fear_greed_age": 1.0, "cot": 0.0, "aaii": 0.0, "gex": "neutral", "insider": 0.5, "macro_calendar": None, "vol_regime": 20.0, "backwardation": False}

    def decide(signal, **changes):
        values = quiet | changes
        row = spark.createDataFrame([(signal, *values.values())], schema)
        r = G.trading_gates(row).first()
        return round(r.confidence_mult, 6), round(r.position_mult, 6), r.blocked_by, r.gated_signal

    assert decide("BUY") == (1.0, 1.0, "", "BUY")
    assert decide("BUY", fear_greed=19.9) == (1.15, 1.0, "", "BUY") and decide("SELL", fear_greed=19.9)[0] == 0.8 and decide("BUY", fear_greed=20.0)[0] == 1.0
    assert decide("BUY", fear_greed=90.0, fear_greed_age=49.0) == (1.0, 1.0, "", "BUY")
    assert decide("BUY", cot=3.5) == (0.3, 0.2, "cot", "HOLD") and decide("SELL", cot=3.5) == (round(1 / 0.7, 6), 1.0, "", "SELL") and decide("BUY", cot=2.5)[0] == 0.7
    assert decide("SELL", aaii=-41.0, vol_regime=36.0) == (0.3, 0.2, "aaii,vol_regime", "HOLD") and decide("HOLD", vol_regime=99.0) == (1.0, 1.0, "", "HOLD")
    assert decide("BUY", gex="negative_gex", insider=0.05) == (0.85, 0.5, "", "BUY") and decide("SELL", insider=0.95)[1] == 0.5
    assert decide("BUY", macro_calendar="before_fomc", backwardation=True) == (0.49, 0.4, "", "BUY") and decide("SELL", macro_calendar="cpi")[2] == "macro_calendar"
    nothing = spark.createDataFrame([("BUY", *[None] * 9), (None, *[None] * 9)], schema)
    assert [tuple(r) for r in G.trading_gates(nothing).select("confidence_mult", "position_mult", "gated_signal").collect()] == [(1.0, 1.0, "BUY"), (1.0, 1.0, None)]


def test_stops_of_a_zero_price(spark):
    rows = spark.createDataFrame([(0.0, 1.0, "LONG", 40.0), (100.0, None, "short", 14.0), (100.0, 9.0, "LONG", 20.0)], "close double, atr double, direction string, vix double")
    zero, short, wide = G.average_true_range_stops(rows).collect()
    assert zero.stop_pct is None and zero.tp_pct is None and zero.regime == "EXTREME"
    assert abs(short.stop_loss - 101.2) < 1e-9 and abs(short.take_profit - 98.0) < 1e-9 and short.vix_scale == 0.8
    assert wide.stop_pct == 0.05 and abs(wide.stop_loss - 95) < 1e-9 and abs(wide.take_profit - 122.5) < 1e-9
