"""The window kernels against plain loops over one window at a time, and against looking ahead."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as K


def draw(n, seed=1):
    random = np.random.default_rng(seed)
    return random.normal(size=n)


def days(spark, **columns):
    """One symbol's days with the given columns; nan stands for a missing value."""
    n = len(next(iter(columns.values())))
    rows = [("a", i, *[None if math.isnan(v[i]) else float(v[i]) for v in columns.values()]) for i in range(n)]
    found = spark.createDataFrame(rows, "symbol string, d int, " + ", ".join(f"{c} double" for c in columns))
    return found.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).repartition(3)


def values(found):
    return [tuple(r)[2:] for r in found.orderBy("date").collect()]


def beta_by_summing(x, a, b, steps=400_000):
    """The integral with t = u**2 near 0 and t = 1 - u**2 near 1, where half-integer powers have no kinks."""
    u = (np.arange(steps) + 0.5) / steps
    low = u * math.sqrt(min(x, 0.5))
    total = (2 * low * low ** (2 * a - 2) * (1 - low**2) ** (b - 1)).mean() * math.sqrt(min(x, 0.5))
    if x > 0.5:
        start, stop = math.sqrt(1 - x), math.sqrt(0.5)
        high = start + u * (stop - start)
        total += (2 * high * high ** (2 * b - 2) * (1 - high**2) ** (a - 1)).mean() * (stop - start)
    return total / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


@pytest.mark.parametrize(("a", "b"), [(0.5, 0.5), (1.0, 2.5), (120.5, 0.5), (118.0, 2.5), (5.0, 5.0), (0.5, 60.0)])
def test_regularised_beta(a, b):
    xs = np.array([1e-9, 0.01, 0.3, 0.5, 0.77, 0.95, 0.999])
    got = K.regularised_beta(xs, a, b)
    for x, value in zip(xs, got, strict=True):
        assert abs(value - beta_by_summing(x, a, b)) < 1e-9, (x, a, b)
    assert K.regularised_beta(np.array([0.0, 1.0]), a, b).tolist() == [0.0, 1.0]


def test_tail_of_f_where_it_is_known():
    # With two numerator degrees the tail is (1 + 2 f / d)**(-d / 2); with one and one an arc tangent.
    f = np.array([0.0, 0.1, 1.0, 3.3, 40.0])
    assert np.allclose(K.f_tail(f, 2, 37), (1 + 2 * f / 37) ** (-37 / 2), rtol=1e-10, atol=1e-14)
    assert np.allclose(K.f_tail(f, 1, 1), 1 - 2 / math.pi * np.arctan(np.sqrt(f)), atol=1e-12)


def granger_by_hand(cause, effect, lag):
    def rss(columns, y):
        design = np.array([[1.0, *row] for row in zip(*columns)])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        return sum((yi - row @ beta) ** 2 for yi, row in zip(y, design))

    n = len(effect)
    y = effect[lag:]
    own = [[effect[t - k] for t in range(lag, n)] for k in range(1, lag + 1)]
    more = [[cause[t - k] for t in range(lag, n)] for k in range(1, lag + 1)]
    without, whole = rss(own, y), rss(own + more, y)
    spare = n - lag - 2 * lag - 1
    f = (without - whole) / lag / (whole / spare)
    return beta_by_summing(spare / (spare + lag * f), spare / 2, lag / 2)


def test_granger_tests_against_plain_least_squares():
    effect = draw(80)
    causes = np.array([np.roll(effect, -2) + draw(80, 2), draw(80, 3), np.roll(effect, -1) * 0.2 + draw(80, 4)])
    for lag in (1, 2, 5):
        got = K.granger_p(causes, effect, lag)
        for cause, p in zip(causes, got, strict=True):
            assert abs(p - granger_by_hand(cause, effect, lag)) < 1e-9
    assert K.granger_p(causes, effect, 2)[0] < 1e-6
    constant = K.granger_p(np.array([np.ones(80), effect]), effect, 3)
    assert (constant >= 0.99).all() and K.granger_p(causes[:, :8], effect[:8], 3).tolist() == [1, 1, 1]


def test_causal_features(spark):
    n = 90
    x, z, ret = draw(n, 5), draw(n, 6), draw(n, 7)
    ret[2:] += 1.5 * x[:-2]
    z[1:] += 0.7 * x[:-1]
    x[3], ret[0] = math.nan, math.nan
    sparse = np.where(np.arange(n) % 5, math.nan, 1.0)
    got = np.array(values(K.causal(days(spark, ret=ret, x=x, z=z, sparse=sparse), ["x", "z", "sparse"], window=40)))
    filled = lambda v: np.nan_to_num(v)
    want = np.zeros((n, 6))
    for end in range(40, n):
        start = end - (end - 40) % 4
        inside = slice(start - 40, start)
        want[end] = K.causal_window(np.array([filled(x)[inside], filled(z)[inside]]), filled(ret)[inside])
    assert np.allclose(got, want, atol=1e-9) and got[60:, 0].min() >= 1 and got[60:, 3].max() > 0
    short = values(K.causal(days(spark, ret=ret[:20], x=x[:20]), ["x"], window=40))
    assert short == [(0.0,) * 6] * 20


def test_causal_window_by_hand():
    x, y = draw(120, 8), draw(120, 9)
    y[1:] += x[:-1]
    found = K.causal_window(np.array([x]), y, lags=2)
    p = [granger_by_hand(x, y, lag) for lag in (1, 2)]
    strength = [-math.log10(max(v, 1e-15)) for v in p if v < 0.05]
    assert found[0] == len(strength) == 2 and abs(found[1] - np.mean(strength)) < 1e-6 and abs(found[4] - strength[0]) < 1e-6 and abs(found[5] - strength[1]) < 1e-6


def test_transfer_entropy_against_counting():
    source, target = draw(90, 10), draw(90, 11)
    target[1:] += 2 * source[:-1]
    got = K.transfer_entropy_of(source, target, 20)
    state = lambda v: [0 if a < v.mean() - v.std() else 2 if a > v.mean() + v.std() else 1 for a in v]
    s, t = state(source), state(target)
    for i in range(90):
        te = 0.0
        if i >= 20:
            seen = [(s[j - 1], t[j - 1], t[j]) for j in range(i - 19, i + 1)]
            for x, y, now in set(seen):
                joint = seen.count((x, y, now))
                both, past, after = (sum(1 for q in seen if test(q)) for test in (lambda q: q[:2] == (x, y), lambda q: q[1] == y, lambda q: q[1:] == (y, now)))
                te += joint / 20 * math.log(joint / both * past / after)
        assert abs(got[i] - max(te, 0)) < 1e-12
    assert not K.transfer_entropy_of(np.zeros(60), target[:60], 20).any() and not K.transfer_entropy_of(source[:5], target[:5], 20).any()


def test_absorption_against_one_window():
    series = np.column_stack([draw(80, s) for s in range(4)] + [np.zeros(80)])
    series[:, 1] += series[:, 0]
    series[7, 2] = math.nan
    got = K.absorption_of(series)
    assert np.isnan(got[:29]).all() and np.isnan(got[29]) and not np.isnan(got[30])
    for i in (30, 59, 79):
        inside = series[max(0, i - 59) : i + 1, :4]
        inside = inside[~np.isnan(inside).any(axis=1)]
        values = sorted(np.linalg.eigvals(np.corrcoef(inside.T)).real, reverse=True)
        assert abs(got[i] - sum(values[:3]) / sum(values)) < 1e-9


def test_network_against_one_window():
    series = np.column_stack([draw(90, s) for s in range(5)])
    series[:, 1] += 2 * series[:, 0]
    series[:, 4] -= 2 * series[:, 3]
    series[:40, 2] = math.nan
    got = K.network_of(series, 30)
    assert np.isnan(got[:9]).all() and got[20, 2] == 0.5 and got[80, 2] == pytest.approx(2 / 3)
    assert got[20, 0] == pytest.approx(2 / 6) and got[80, 0] == pytest.approx(2 / 10) and got[80, 3] == 1
    chain = np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
    assert K.components_of(chain) == 2 and K.components_of(np.zeros((3, 3), bool)) == 3


def hurst_by_hand(window):
    n = len(window)
    points = []
    for size in (n // 4, n // 3, n // 2):
        ratios = []
        for at in range(0, n // size * size if size >= 10 else 0, size):
            part = window[at : at + size]
            mean = sum(part) / size
            path, total = [], 0.0
            for v in part:
                total += v - mean
                path.append(total)
            spread = math.sqrt(sum((v - mean) ** 2 for v in part) / (size - 1))
            if spread > 0:
                ratios.append((max(path) - min(path)) / spread)
        if ratios:
            points.append((math.log(size), math.log(sum(ratios) / len(ratios))))
    if n < 20 or len(points) < 2:
        return 0.5
    x, y = zip(*points)
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return min(1.0, max(0.0, sum((a - mx) * (b - my) for a, b in points) / sum((a - mx) ** 2 for a in x)))


def test_hurst_against_one_window():
    moves = np.concatenate([draw(60, 3), np.zeros(30), np.cumsum(draw(60, 4))])
    moves[[0, 20, 21]] = math.nan
    for window in (50, 100):
        got = K.hurst_of(moves, window)
        for i in range(len(moves)):
            inside = [v for v in moves[max(0, i - window + 1) : i + 1] if not math.isnan(v)]
            want = hurst_by_hand(inside) if i >= window - 1 and len(inside) >= 20 else 0.5
            assert abs(got[i] - want) < 1e-9, (window, i)


def har_by_hand(close):
    n = len(close)
    ret = [0.0] + [(close[i] - close[i - 1]) / close[i - 1] for i in range(1, n)]
    day = [r * r for r in ret]
    mean = lambda i, k, m: sum(day[max(0, i - k + 1) : i + 1]) / min(k, i + 1) if i + 1 >= m else math.nan
    inputs = [[1.0, day[i], mean(i, 5, 3), mean(i, 22, 10)] for i in range(n)]
    beta, predicted = np.array([0.0, 0.3, 0.3, 0.3]), [0.0] * n
    for i in range(60, n):
        predicted[i] = max(float(np.dot(inputs[i - 1], beta)), 0.0)
        if (i - 60) % 20 == 0:
            at = range(max(i - 252, 22), i)
            design, y = np.array([inputs[t - 1] for t in at]), np.array([day[t] for t in at])
            beta = np.clip(np.linalg.solve(design.T @ design + 1e-8 * np.eye(4), design.T @ y), -1, 2) if len(at) >= 30 else np.array([0.0, 0.3, 0.3, 0.3])
    return day, predicted


def test_har_against_day_by_day(spark):
    for n in (61, 62, 120, 121, 333):
        close = 100 * np.exp(np.cumsum(draw(n, n) * 0.02))
        got = np.array(values(K.heterogeneous_variance(days(spark, close=close))))
        day, predicted = har_by_hand(close)
        assert np.allclose(got[:, 0], predicted, atol=1e-12) and np.allclose(got[60:, 1], np.array(day[60:]) - predicted[60:], atol=1e-12)
    assert values(K.heterogeneous_variance(days(spark, close=close[:29]))) == [(0.0,) * 4] * 29


@pytest.mark.parametrize("family", [K.heterogeneous_variance, K.hurst, K.changepoints, K.absorption, K.multifractal, K.quantile_states])
def test_no_look_ahead(spark, family):
    close = 100 * np.exp(np.cumsum(draw(260, 2) * 0.02))
    whole, part = values(family(days(spark, close=close))), values(family(days(spark, close=close[:200])))
    assert np.allclose(whole[:200], part, atol=1e-10) and len(whole) == 260


def test_changepoint_after_calm_days(spark):
    close = [100.0 + 0.01 * (i % 2) for i in range(30)] + [150.0 * 1.5**i for i in range(3)] + [500.0] * 20
    found = values(K.changepoints(days(spark, close=np.array(close))))
    assert found[29][2] == 0 and found[30] == (1.0, 1.0, 1.0) and found[-1][2] == 1 and values(K.changepoints(days(spark, close=np.array(close[:9])))) == [(0.0,) * 3] * 9


def dfa_by_hand(x, q):
    n = len(x)
    profile = np.cumsum(x - np.mean(x))
    points = []
    for size in (8, 16, 32):
        rough = []
        for at in range(0, n // size * size, size):
            part = profile[at : at + size]
            slope, start = np.polyfit(range(size), part, 1)
            rough.append(math.sqrt(sum((v - slope * i - start) ** 2 for i, v in enumerate(part)) / size))
        mean = math.exp(sum(map(math.log, rough)) / len(rough)) if q == 0 else (sum(r**q for r in rough) / len(rough)) ** (1 / q)
        points.append((math.log(size), math.log(mean)))
    return min(1.5, max(0.0, np.polyfit(*zip(*points), 1)[0]))


def test_detrended_exponents_against_one_window():
    windows = np.array([draw(100, s) for s in range(4)] + [np.cumsum(draw(100, 5))])
    got = K.detrended_exponents(windows)
    for j, q in enumerate((2.0, 0.0, -2.0)):
        assert np.allclose(got[j], [dfa_by_hand(w, q) for w in windows], atol=1e-9)
    assert (K.detrended_exponents(windows[:, :63]) == 0.5).all() and (K.detrended_exponents(np.zeros((1, 100))) == 0.5).all()


def test_quantile_states_day_by_day(spark):
    close = 100 * np.exp(np.cumsum(draw(190, 6) * 0.02 + np.repeat([0.01, -0.01], 95)))
    got = values(K.quantile_states(days(spark, close=close)))
    moves = [0.0, *(close[1:] / close[:-1] - 1)]
    before, run = None, 1
    for i in range(190):
        if i < 120:
            assert got[i] == (1.0, 0.33, 0.33, 0.0, 1.0)
            continue
        past, now = np.array(moves[i - 120 : i]), np.mean(moves[i - 20 : i])
        low, high = np.percentile(past, 33), np.percentile(past, 67)
        state = 2 if now > high else 0 if now < low else 1
        near = [1 / abs(now - part.mean()) for part in (past[past <= low], past[(past > low) & (past <= high)], past[past > high])]
        run = run + 1 if state == before else 1
        want = (state, near[2] / sum(near), near[0] / sum(near), float(before is not None and state != before), run)
        assert np.allclose(got[i], want, atol=1e-9), i
        before = state


def test_tails_by_counting():
    a = draw(60, 3)
    assert K.tails_of(a, a) == (1.0, pytest.approx(6 / 6)) and K.tails_of(a, -a) == (0.0, 0.0)
    b = np.where(a > np.sort(a)[-7], a, draw(60, 4) - 5)
    assert K.tails_of(a, b)[0] == 1.0 and K.tails_of(np.ones(20), np.ones(20))[0] == 1.0
