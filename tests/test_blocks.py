"""Block structure, path signatures and timing features against plain loops, without looking ahead, and over zero prices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks


def frame(spark, closes, volumes=None):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(closes))]
    volumes = volumes or [10 + i * 7 % 13 for i in range(len(closes))]
    rows = [("a", d, c, c, c, c, v) for d, c, v in zip(days, closes, volumes, strict=True)]
    found = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")
    before = F.expr("lag(close) OVER (PARTITION BY symbol ORDER BY date)")
    return found.withColumn("ret", F.try_divide("close", before) - 1).repartition(3)


def values(found):
    return [r.asDict() for r in found.orderBy("date").collect()]


def drawn(n, seed=3):
    random = np.random.default_rng(seed)
    return [float(c) for c in 100 * np.exp(np.cumsum(random.normal(0, 0.02, size=n)))]


def test_blocks_against_plain_loops(spark):
    closes = drawn(90)
    got = values(blocks.block_structure(frame(spark, closes)))
    signs = {n: [0] * n + [np.sign(closes[i] / closes[i - n] - 1) for i in range(n, len(closes))] for n in (3, 5)}
    for n in (3, 5):
        streaks = [1.0] * len(closes)
        for i in range(2 * n, len(closes)):
            if signs[n][i] == signs[n][i - n] != 0:
                streaks[i] = streaks[i - n] + 1
        assert [r[f"blk_boundary_{n}d_streak"] for r in got] == streaks
        for i in range(n - 1, len(closes)):
            block, fall, won, top = closes[i - n + 1 : i + 1], 0.0, 1.0, 0.0
            for x in block:
                top = max(top, x)
                if (x - top) / top < fall:
                    fall, peak, low = (x - top) / top, top, x
            if fall:
                won = min(1.0, (block[-1] - low) / (peak - low))
            assert got[i][f"blk_{n}d_max_drawdown"] == pytest.approx(-fall, abs=1e-8)
            assert got[i][f"blk_{n}d_recovery_ratio"] == pytest.approx(won, abs=1e-6)
    assert max(r["blk_boundary_3d_streak"] for r in got) > 2
    assert {r["blk_cascade_full"] for r in got} == {-1.0, 0.0, 1.0}


def area(x, y):
    return sum(x[j] * y[i] for j in range(len(x)) for i in range(j))


def test_signatures_against_double_sums(spark):
    closes = drawn(100, 5)
    rows = frame(spark, closes)
    volumes = [r["volume"] for r in values(rows)]
    got = values(blocks.path_signatures(rows))
    x = [0.0] + [b / a - 1 for a, b in zip(closes, closes[1:])]
    v = [volumes[i] / np.mean(volumes[i - 19 : i + 1]) if i >= 19 else 1.0 for i in range(len(closes))]
    y = [0.0] + [b - a for a, b in zip(v, v[1:])]
    for i, row in enumerate(got):
        for n in (5, 10, 20):
            w = slice(i - n + 1, i + 1)
            want = (0.0, 0.0) if i < n - 1 else (area(x[w], y[w]), area(x[w], y[w]) - area(y[w], x[w]))
            assert (row[f"psig_sig2_{n}d"], row[f"psig_sig2_anti_{n}d"]) == pytest.approx(want, abs=1e-12)
    # Without volume steps there is no area at all, not a rounding error of one.
    assert {r["psig_sig_ratio"] for r in values(blocks.path_signatures(frame(spark, closes, [7] * 100)))} == {0.0}


@pytest.mark.parametrize("family", [blocks.block_structure, blocks.path_signatures, blocks.timing_features])
def test_nothing_looks_ahead_and_zero_prices_pass(spark, family):
    closes = drawn(80, 8)
    assert values(family(frame(spark, closes)))[:50] == values(family(frame(spark, closes[:50])))
    broken = values(family(frame(spark, [0.0, None, 3.0, 0.0, *closes[:30]], [0] * 34)))
    assert len(broken) == 34 and all(np.isfinite(x) for r in broken for k, x in r.items() if k not in ("symbol", "date"))
    assert values(family(frame(spark, closes).limit(0))) == []


def test_premarket_is_joined_where_it_is_known(spark):
    day = dt.date(2020, 1, 3)
    minutes = spark.createDataFrame(
        [("a", day, 500, 10.0, 12.0, 9.0, 11.0, 5), ("a", day, 560, 11.0, 11.5, 10.0, 10.0, 5), ("a", day, 600, 10.0, 30.0, 1.0, 20.0, 30), ("a", day + dt.timedelta(1), 700, 1.0, 1.0, 1.0, 1.0, 0)],
        "symbol string, date date, minute int, open double, high double, low double, close double, volume long",
    )
    shape = blocks.premarket_shape(minutes)
    got = {r["date"]: tuple(r[c] for c in blocks.PREMARKET) for r in shape.collect()}
    assert got[day] == pytest.approx((0.3, 0.0, 0.25, 10 / 11 - 1))
    assert got[day + dt.timedelta(1)] == (None,) * 4
    joined = values(blocks.timing_features(frame(spark, drawn(5)), shape))
    assert [r["pm_volume_pct"] for r in joined] == [0.0, 0.0, 0.25, 0.0, 0.0]
