"""Operators without SQL, and the cases that the tables do not hold."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, cleaning, features, labels, monitoring, resample, risk, strategy, synthetic, targets
from tidemark.operators import validation as V
from tidemark.operators.quantiles import amounts_below, exact_quantiles, ordinal_ranks


def test_resolutions():
    assert [resample.minutes_of(r) for r in ("1min", "1h", "10", "7m", "45min")] == [1, 60, 10, 7, 45]
    for wrong in ("", "x", "1d", "h", "0", "0min", "m", "m5", "5 5", "-5", "1.5min"):
        with pytest.raises(ValueError):
            resample.minutes_of(wrong)


def test_resampling_of_empty_and_single_bars(spark):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, trade_count long, vwap double, date date, session string"
    one = spark.sql("SELECT 'a' AS symbol, TIMESTAMP '2024-01-02 09:47:00' AS ts, 1D AS open, 2D AS high, 0.5D AS low, 1.5D AS close, 0D AS volume, 3L AS trade_count, 9D AS vwap, DATE '2024-01-02' AS date, 'regular' AS session")
    alone = resample.resample(one, 15).first()
    assert alone.ts.minute == 47 and alone.vwap == 9
    both = one.union(one.withColumn("ts", F.expr("TIMESTAMP '2024-01-02 09:52:00'")))
    assert [(r.ts.minute, r.trade_count, r.vwap) for r in resample.resample(both, 15).collect()] == [(45, 6, None)]
    assert resample.resample(spark.createDataFrame([], schema), 15, "none").count() == 0


def test_column_checks(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0.5, 1.0, 3.0)], "Open double, HIGH double, low double, Close double, VOLUME double")
    assert cleaning.normal_columns(rows).columns == ["open", "high", "low", "close", "volume"]
    with pytest.raises(ValueError):
        cleaning.normal_columns(rows.drop("low"))


def test_normal_distribution_function(spark):
    xs = [-40.0, -8.0, -3.6, -3.4, -1.0, 0.0, 0.5, 3.49, 3.51, 6.0, 39.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(cleaning.normal_cdf(F.col("x"))).collect()
    for x, (p,) in zip(xs, got, strict=True):
        assert abs(p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-13, x


def test_bootstrap_of_equal_returns(spark):
    trades = spark.createDataFrame([("a", i, 0.01) for i in range(30)] + [("b", 1, -0.6)], "symbol string, n int, ret double")
    found = {r.symbol: r for r in V.bootstrap(trades, ["symbol"], ["n"], simulations=20).collect()}
    assert abs(found["a"].median_equity - 100_000 * 1.01**30) < 1e-4 and found["a"].median_max_dd == 0 and found["a"].prob_profit == 1
    assert abs(found["b"].mean_equity - 40_000) < 1e-6 and found["b"].prob_lose_50pct == 1 and abs(found["b"].dd_ci_upper - 0.6) < 1e-9


def test_bootstrap_varies_and_repeats(spark):
    trades = spark.createDataFrame([("a", i, (i % 7 - 3) / 100) for i in range(40)], "symbol string, n int, ret double")
    a, b = (V.bootstrap(trades.repartition(p), ["symbol"], ["n"], simulations=60).first() for p in (1, 5))
    assert a == b and a.equity_ci_lower < a.median_equity < a.equity_ci_upper and 0 < a.prob_profit < 1


def test_sampled_members_repeat(spark):
    rows = spark.createDataFrame([(f"s{i}", d, 0.1) for i in range(20) for d in range(3)], "symbol string, date int, ret double")
    picked = lambda seed: {r.symbol for r in synthetic.sampled_members(rows, 0.7, seed).collect()}
    assert picked(1) == picked(1) and len(picked(1)) == 14 and picked(1) != picked(2)


def test_drift_of_constant_and_missing_features(spark):
    train = spark.createDataFrame([("same", 1.0), ("moved", 1.0), ("gone", 1.0), ("gone", 2.0)] * 5, "feature string, value double")
    live = spark.createDataFrame([("same", 1.0), ("moved", 2.0), ("gone", None)], "feature string, value double")
    found = {r.feature: r for r in V.drift_monitor(train, live).collect()}
    assert found["same"].psi == 0 and math.isinf(found["moved"].psi) and math.isinf(found["gone"].psi)
    assert found["same"].severity == "significant" and abs(found["same"].drift_fraction - 2 / 3) < 1e-9


def test_guarded_events_fall_back(spark):
    rows = spark.sql("SELECT 'a' AS symbol, date_add(DATE '2024-01-01', CAST(id AS INT)) AS date, CASE WHEN id % 10 = 0 THEN 0.05 ELSE 0D END AS ret FROM range(100)")
    kept = lambda *args, **options: targets.guarded_events(rows, *args, **options)
    assert kept(0.0).count() == 100 and kept(10.0, least_events=1).count() == 100
    assert {(r.halvings) for r in kept(0.05, least_events=5, most_filtered=0.95).collect()} == {0}
    assert kept(0.08, least_events=1, most_filtered=0.91).agg(F.max("halvings"), F.count("*")).first()[:] == (1, 10)


def test_pareto_front_against_pairs(spark):
    rows = [("a", (i * 37) % 11, (i * 53) % 13) for i in range(60)]
    got = {tuple(r) for r in V.pareto_front(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], "x", "y").collect()}
    better = lambda p, q: p[1] >= q[1] and p[2] >= q[2] and p != q
    assert got == {q for q in rows if not any(better(p, q) for p in rows)}


def test_bars_without_volume(spark):
    ticks = spark.sql("SELECT 'a' AS symbol, TIMESTAMP '2024-01-02 09:47:00' AS ts, 1L AS event_id, 5D AS price")
    assert "vwap" not in bars.time_bars(ticks, 60).columns
    assert bars.time_bars(ticks.withColumn("volume", F.lit(0.0)), 60).first().vwap is None


def test_exact_quantiles(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    groups = {"spread": draw.normal(size=3000), "few": draw.integers(0, 4, 5000).astype(float), "hot": np.append(np.full(4000, 7.0), draw.normal(size=300)), "one": np.array([2.5])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("few", None), ("none", None)]
    shares = [0.0, 0.013, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = {r.k: r.quantiles for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert np.allclose(got[k], np.quantile(values, shares), atol=1e-12), k


def _prices(spark, closes, symbol="a"):
    rows = [(symbol, i, c, c, c, c, 0.0) for i, c in enumerate(closes)]
    found = spark.createDataFrame(rows, "symbol string, d int, open double, high double, low double, close double, volume double")
    return found.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).drop("d")


def test_zero_prices_and_single_rows(spark):
    zeros = _prices(spark, [1.0, 0.0, 2.0, 0.0, 0.0, 3.0]).unionByName(_prices(spark, [5.0], "alone"))
    found = {r.date.day: r for r in targets.barrier_labels(zeros.select("symbol", "date", "close"), horizon=2).collect()}
    assert (found[2].touch_type, found[2].return_at_touch, found[1].touch_type) == ("expiry", None, "sl")
    found = {r.date.day: r for r in labels.triple_barrier(zeros, horizon=2).collect()}
    assert (found[2].touch_type, found[2].return_at_touch) == ("time", None)
    assert features.range_structure(zeros).filter("range IS NULL").count() == 3
    assert risk.range_volatility(zeros, 2).count() == 7
    single = spark.createDataFrame([("a", 1, 0.01), ("b", 1, -1.0), ("b", 2, 0.5)], "symbol string, date int, ret double")
    found = {r.symbol: r for r in monitoring.performance(single).collect()}
    assert found["a"].sharpe is None and abs(found["a"].total_return - 0.01) < 1e-12
    signals = zeros.withColumns({"ret": F.lit(0.0), "signal": F.lit("BUY")})
    assert strategy.day_trades(signals).filter("pnl IS NULL").count() == 3
    held = strategy.stopped_trades(signals.withColumn("signal", F.lit("LONG"))).filter("date > '2024-01-05'").first()
    assert held.equity is not None


def test_timing_targets_of_a_day(spark):
    closes = {0: 10.0, 5: 9.0, 10: 9.5, 60: 8.0, 119: 9.0, 150: 7.0, 190: 11.0, 300: 12.0, 380: 12.0, 389: 10.0}
    rows = spark.createDataFrame([(m, c) for m, c in closes.items()], "m int, c double").select(
        F.lit("a").alias("symbol"), F.lit("2024-01-02").cast("date").alias("date"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-02 09:30:00")) + F.col("m") * 60).alias("ts"),
        *[F.col("c").alias(n) for n in ("open", "high", "low", "close")],
    )
    t = targets.timing_targets(rows).first()
    assert (t.entry_price, t.entry_minute, t.exit_price, t.exit_minute) == (8.0, 60.0, 12.0, 300.0)
    assert abs(t.best_return - 0.5) < 1e-12 and abs(t.max_adverse - 0.125) < 1e-12 and t.stop_pct == 0.05 and t.take_profit_pct == 0.05
    moves = [b / a - 1 for a, b in zip(list(closes.values()), list(closes.values())[1:])]
    mean = sum(moves) / 9
    vol = math.sqrt(sum((x - mean) ** 2 for x in moves) / 8) * math.sqrt(10)
    assert abs(t.day_volatility - vol) < 1e-12 and t.batches == 4 and t.should_batch and abs(t.position_pct - 0.1 * 0.5 * 2) < 1e-12
    assert abs(t.max_possible_return - 5 / 7) < 1e-12 and abs(t.capture_efficiency - 0.7) < 1e-12
    short = targets.timing_targets(rows, long=False).first()
    assert (short.entry_price, short.exit_price) == (10.0, 11.0) and abs(short.best_return + 0.1) < 1e-12 and abs(short.max_adverse - 0.1) < 1e-12
    empty = targets.timing_targets(rows.withColumns({n: F.lit(0.0) for n in ("open", "high", "low", "close")})).first()
    assert empty.best_return is None and empty.stop_pct is None and empty.open_to_close is None


def test_ranks_and_amounts_by_ranges(spark):
    import random

    draw = random.Random(6)
    rows = [(k, draw.choice([draw.random(), 0.5, None]), float(draw.randrange(9)), i) for k in "ab" for i in range(400)]
    table = spark.createDataFrame(rows, "k string, x double, y double, t int").repartition(5)
    found = ordinal_ranks(table.filter("x IS NOT NULL"), ["k"], ["t"], {"x": "rx", "y": "ry"}).collect()
    for k in "ab":
        mine = [r for r in rows if r[0] == k and r[1] is not None]
        by_x, by_y = ({r[3]: i + 1 for i, r in enumerate(sorted(mine, key=lambda r: (r[c], r[3])))} for c in (1, 2))
        got = [r for r in found if r.k == k]
        assert len(got) == len(mine) and all((r.rx, r.ry) == (by_x[r.t], by_y[r.t]) for r in got)
    counts = table.filter("x IS NOT NULL").groupBy("k", "x").agg(F.count("*").alias("n"))
    for r in amounts_below(counts, ["k"], "x", "n", "below").collect():
        assert r.below == sum(1 for o in rows if o[0] == r.k and o[1] is not None and o[1] < r.x)


def _ranked_rows():
    import random

    draw = random.Random(8)
    value = lambda: draw.choice([draw.gauss(0, 1), draw.gauss(0, 1), 0.5, -0.0, 0.0, float("nan"), None])
    rows = [(k, draw.choice([draw.randrange(40), None]), f"{i:04}", value(), float(draw.randrange(3)), draw.choice([float(draw.randrange(4)), draw.random(), None])) for k in "ab" for i in range(500)]
    rows += [("c", i, "", float(i), 1.0, float(-i)) for i in range(2)] + [("d", i, "", None, float(i), float(i)) for i in range(5)]
    return rows, "k string, t int, u string, x double, z double, y double"


@pytest.mark.parametrize("few", [500_000, 0])
def test_rank_correlations_by_parts_of_the_ties(spark, monkeypatch, few):
    monkeypatch.setattr(V, "PARTS", 8)
    monkeypatch.setattr(V, "SMALL_ROWS", few)
    rows, schema = _ranked_rows()
    found = V.ordinal_rank_correlations(spark.createDataFrame(rows, schema).repartition(5), ["x", "z"], "y", ["k"], ["t", "u"]).collect()
    got = {(r.k, r.feature): (r.n, r.r) for r in found}
    assert len(got) == len(found) and set(got) == {(k, f) for k in "abcd" for f in "xz"} - {("d", "x")}
    for (k, f), (n, r) in got.items():
        mine = [(row[3 if f == "x" else 4], row[5], (row[1] is None, row[1] or 0, row[2])) for row in rows if row[0] == k and row[5] is not None]
        mine = [row for row in mine if row[0] is not None]
        ranks = [0] * len(mine), [0] * len(mine)
        for c in (0, 1):
            for place, i in enumerate(sorted(range(len(mine)), key=lambda i: (mine[i][c] != mine[i][c], 0.0 if mine[i][c] != mine[i][c] else mine[i][c], mine[i][2]))):
                ranks[c][i] = place
        middle = (len(mine) - 1) / 2
        wanted = sum((a - middle) * (b - middle) for a, b in zip(*ranks, strict=True)) / sum((a - middle) ** 2 for a in ranks[0]) if len(mine) > 2 else 0.0
        assert n == len(mine) and abs(r - wanted) < 1e-12


def test_concept_drift_deals_whole_rows_once(spark, capsys):
    from tidemark.plans import validation

    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, ("-1", "false")):
            spark.conf.set(name, value)
        validation.concept_drift(spark, "/root/testdata/sf0.001").explain("formatted")
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    # Once for each half.
    assert len(dealt) > 2 and sum("l_suppkey" in columns or "_tie3" in columns for columns in dealt) == 2


def test_bootstrap_over_spans(spark, monkeypatch):
    trades = spark.createDataFrame([("a", i // 7, i, ((i * 37) % 11 - 5) / 50) for i in range(50)], "symbol string, day int, n int, ret double")
    whole = V.bootstrap(trades, ["symbol"], ["day", "n"], simulations=40).first()
    monkeypatch.setattr(V, "SPAN", 7)
    spans = V.bootstrap(trades.repartition(4), ["symbol"], ["day", "n"], simulations=40).first()
    assert all(abs(a - b) < 1e-9 * abs(a) + 1e-12 for a, b in zip(whole[1:], spans[1:], strict=True))
    lost = V.bootstrap(spark.createDataFrame([("a", 1, 1, -1.0), ("a", 1, 2, -2.0)], trades.schema), ["symbol"], ["day", "n"], simulations=5).first()
    assert lost.mean_equity == 0 and lost.median_max_dd == 1


def test_edges_and_cuts_travel_to_the_rows(spark, capsys):
    from tidemark.operators import calibration

    key = (F.col("id") % 3).cast("string")
    rows = spark.range(100).select(key.alias("symbol"), key.alias("feature"), (F.col("id") / 7).alias("value"), (F.col("id") % 2).alias("label"))
    edges = spark.range(3).select(F.col("id").cast("string").alias("feature"), F.array(F.lit(0.0), F.lit(5.0), F.lit(15.0)).alias("edges"))
    cuts = rows.groupBy("symbol").agg(F.percentile_approx("value", F.array(F.lit(0.5))).alias("_cuts"))
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, ("-1", "false")):
            spark.conf.set(name, value)
        for found in (V._binned(rows, edges), calibration._bucketed(rows, cuts, "symbol", "value")):
            found.explain()
            plan = capsys.readouterr().out
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
