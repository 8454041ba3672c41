"""Distances of windows of returns by moving sorted mass, and local clock times over the changes of daylight saving."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest

from tidemark.operators.bars import local_parts
from tidemark.operators.risk import WASSERSTEIN, wasserstein_regime


def moved(a, b):
    """Both samples repeated to one size, then compared in order."""
    return np.mean(np.abs(np.sort(np.repeat(a, len(b))) - np.sort(np.repeat(b, len(a)))))


def test_regimes_against_plain_windows(spark):
    random = np.random.default_rng(2)
    values = [None, *random.normal(0, 0.01, size=60), None, *random.normal(0.02, 0.03, size=90)]
    rows = [("a", date(2020, 1, 1) + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, date date, ret double").repartition(3)
    got = [r.asDict() for r in wasserstein_regime(frame(rows)).orderBy("date").collect()]
    known = lambda low, high: [v for v in values[low:high] if v is not None]
    distances, changes = [], []
    for t, r in enumerate(got):
        for n in (20, 60):
            want = pytest.approx(moved(known(t - n, t), known(t - 2 * n, t - n)), abs=1e-12) if t >= 2 * n else None
            assert r[f"wreg_distance_{n}d"] == want
        if t < 40:
            assert all(r[c] is None for c in WASSERSTEIN)
            continue
        distances.append(r["wreg_distance_20d"])
        assert r["wreg_mean_shift"] == pytest.approx(np.mean(known(t - 20, t)) - np.mean(known(t - 40, t - 20)), abs=1e-12)
        assert r["wreg_vol_shift"] == pytest.approx(np.std(known(t - 20, t), ddof=1) - np.std(known(t - 40, t - 20), ddof=1), abs=1e-12)
        past = distances[-120:]
        z = (past[-1] - np.mean(past)) / np.std(past, ddof=1) if len(past) >= 10 else None
        assert r["wreg_distance_z"] == (None if z is None else pytest.approx(z, abs=1e-9))
        changes += [t] if z is not None and z > 2 else []
        assert r["wreg_regime_duration"] == (t - changes[-1] if changes else None)
    assert len(changes) > 3
    assert [r.asDict() for r in wasserstein_regime(frame(rows[:100])).orderBy("date").collect()] == got[:100]
    assert wasserstein_regime(frame([])).count() == 0
    assert wasserstein_regime(frame([("a", d, 0.0) for _, d, _ in rows])).filter("wreg_distance_z <> 0 OR wreg_stability <> 1").count() == 0


def test_local_times_follow_daylight_saving(spark):
    given = [datetime(2024, 3, 10, 6, 59, 59), datetime(2024, 3, 10, 7, 0), datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 3, 6, 30), datetime(2024, 1, 1, 2, 0), None]
    want = [("01:59:59", 10), ("03:00:00", 10), ("01:30:00", 3), ("01:30:00", 3), ("21:00:00", 31), (None, None)]
    for kind in ("timestamp", "timestamp_ntz"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], f"i int, ts {kind}")
        got = local_parts(rows, "ts", "America/New_York").orderBy("i").collect()
        assert [(r["time"], r["date"] and r["date"].day) for r in got] == want
        assert [(r["hour"], r["minute"]) for r in got][:2] == [(1, 59), (3, 0)]
