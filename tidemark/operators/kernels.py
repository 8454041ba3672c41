"""Feature families whose windows need more than running sums: causality, correlation matrices, long memory, regimes.

Each takes a daily frame (``symbol, date, close, ret`` and other series as columns) and returns
``symbol, date`` and its features. A symbol's days go through one Arrow batch in date order; they are few
(decades are thousands), and symbols spread over the cluster. Within a symbol all windows are computed at
once on stacked arrays. Undefined values are 0 unless stated otherwise. Nothing looks ahead but where stated.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_symbol(rows: DataFrame, inputs: list[str], outputs: list[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """``symbol, date`` and the ``outputs`` that ``kernel`` makes of the ``inputs``, each an array of doubles in date order."""
    chosen = rows.select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in inputs])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", ignore_index=True)
        found = kernel({c: frame[c].to_numpy(float) for c in inputs})
        plain = {c: np.nan_to_num(np.asarray(found[c], float), nan=0.0, posinf=0.0, neginf=0.0) for c in outputs}
        return frame[["symbol", "date"]].assign(**plain)

    return chosen.groupBy("symbol").applyInPandas(run, ", ".join(["symbol string", "date date", *[f"{c} double" for c in outputs]]))


def _rolled(x: np.ndarray, n: int, least: int):
    return pd.Series(x).rolling(n, min_periods=least)


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


# Distributions


def regularised_beta(x: np.ndarray, a: float, b: float, terms: int = 300) -> np.ndarray:
    """I_x(a, b), from its continued fraction taken from the last term back; arrays of x at once."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    z = np.where(swap, 1 - x, x)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    fraction = np.ones_like(z)
    for m in range(terms, 0, -1):
        k = m // 2
        if m % 2:
            step = -(p + k) * (p + q + k) / ((p + 2 * k) * (p + 2 * k + 1))
        else:
            step = k * (q - k) / ((p + 2 * k - 1) * (p + 2 * k))
        fraction = 1 + step * z / fraction
    with np.errstate(divide="ignore"):
        log = p * np.log(z) + q * np.log1p(-z)
    front = np.exp(log - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / p
    tail = front / fraction
    return np.clip(np.where(swap, 1 - tail, tail), 0.0, 1.0)


def f_tail(f: np.ndarray, d1: int, d2: int) -> np.ndarray:
    """P(F > f) with ``d1`` and ``d2`` degrees of freedom."""
    f = np.maximum(f, 0.0)
    return regularised_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


# Causality


def _residuals(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What least squares on each of a stack of designs leaves of ``y``; designs without full rank included."""
    rcond = np.finfo(float).eps * max(design.shape[-2:])
    beta = np.linalg.pinv(design, rcond=rcond) @ y[..., None]
    return y - (design @ beta)[..., 0]


def granger_p(causes: np.ndarray, effect: np.ndarray, lag: int) -> np.ndarray:
    """P-values of the F tests that ``lag`` past values of each row of ``causes`` add to those of ``effect``."""
    n = len(effect) - lag
    spare = n - 2 * lag - 1
    if len(effect) <= 2 * lag + 2 or spare <= 0:
        return np.ones(len(causes))
    past = lambda v: np.stack([v[..., lag - k : len(effect) - k] for k in range(1, lag + 1)], axis=-1)
    own = np.column_stack([np.ones(n), past(effect)])
    whole = np.concatenate([np.broadcast_to(own, (len(causes), *own.shape)), past(causes)], axis=-1)
    y = effect[lag:]
    without = float((_residuals(own, y) ** 2).sum())
    left = (_residuals(whole, np.broadcast_to(y, (len(causes), n))) ** 2).sum(axis=1)
    usable = (left > 0) & (without >= left)
    f = (without - left) / lag / np.where(usable, left / spare, 1.0)
    return np.where(usable & (f > 0), f_tail(f, lag, spare), 1.0)


def partial_p(x: np.ndarray, y: np.ndarray, given: np.ndarray, lag: int) -> float:
    """Two-sided p-value of the correlation of ``x`` with ``y`` ``lag`` rows later, without what ``given`` explains of both."""
    n = len(y) - lag
    spare = n - len(given) - 2
    if len(y) <= lag + len(given) + 2 or spare <= 0:
        return 1.0
    design = np.column_stack([np.ones(n), *(g[:n] for g in given)])
    a, b = _residuals(design, x[:n]), _residuals(design, y[lag:])
    if a.std() * b.std() < 1e-15:
        return 1.0
    r = np.corrcoef(a, b)[0, 1]
    square = r * r * spare / (1 - r * r + 1e-15)
    return float(min(1.0, regularised_beta(np.array([spare / (spare + square)]), spare / 2, 0.5)[0]))


CAUSAL = [f"causal_{c}" for c in ("n_causes", "avg_strength", "max_strength", "net_direction", "lag1_strength", "lag5_strength")]
#: At most this many of the other passed series are held fixed in the second stage.
MOST_GIVEN = 5


def causal_window(causes: np.ndarray, effect: np.ndarray, lags: int = 5, level: float = 0.05) -> np.ndarray:
    """The six figures of one window: what passes the F test, then a partial correlation given the other series that passed."""
    p = np.array([granger_p(causes, effect, lag) for lag in range(1, lags + 1)])
    passed = [(c, lag) for c in range(len(causes)) for lag in range(1, lags + 1) if p[lag - 1, c] < level]
    series = sorted({c for c, _ in passed})
    found = []
    for c, lag in passed:
        given = [o for o in series if o != c][:MOST_GIVEN]
        value = partial_p(causes[c], effect, causes[given], lag) if given else p[lag - 1, c]
        if value < level:
            n = len(effect) - lag
            moves = causes[c][:n].std() * effect[lag:].std() > 0
            way = np.sign(np.corrcoef(causes[c][:n], effect[lag:])[0, 1]) if moves and n > 2 else 0.0
            strength = -math.log10(max(value, 1e-15))
            found.append((lag, strength, strength * (way or 1.0)))
    if not found:
        return np.zeros(6)
    lag, strength, signed = (np.array(x) for x in zip(*found, strict=True))
    of = lambda at: strength[lag == at].mean() if (lag == at).any() else 0.0
    return np.array([len(found), strength.mean(), strength.max(), signed.sum(), of(1), of(lags)])


def causal(rows: DataFrame, causes: list[str], window: int = 252, lags: int = 5, level: float = 0.05, most: int = 20) -> DataFrame:
    """Granger causes of ``ret`` among ``causes`` over the ``window`` days before each, anew every tenth of a window.

    Of more than ``most`` series those that correlate most with the returns over all of a symbol's days are tested, which looks
    ahead; give fewer to avoid it. Series missing on half a window's days or more are left out.
    """

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(x["ret"])
        out = np.zeros((n, 6))
        usable = [c for c in causes if (~np.isnan(x[c])).sum() > window * 0.5]
        if n >= window and usable:
            if len(usable) > most:
                strength = [abs(pd.Series(x[c]).corr(pd.Series(x["ret"]))) for c in usable]
                usable = [usable[i] for i in np.argsort([-(0.0 if np.isnan(s) else s) for s in strength], kind="stable")[:most]]
            series, effect = np.array([_finite(x[c]) for c in usable]), _finite(x["ret"])
            step = max(1, window // 10)
            for end in range(window, n, step):
                out[end : end + step] = causal_window(series[:, end - window : end], effect[end - window : end], lags, level)
        return dict(zip(CAUSAL, out.T, strict=True))

    return by_symbol(rows, ["ret", *causes], CAUSAL, kernel)


def transfer_entropy_of(source: np.ndarray, target: np.ndarray, window: int = 50) -> np.ndarray:
    """Information (nats) that yesterday's state of ``source`` adds on today's of ``target``, over ``window`` transitions up to each day.

    States are below, within or above one deviation around the mean of the whole series, which looks ahead.
    """

    def states(x: np.ndarray) -> np.ndarray:
        spread = x.std()
        return np.ones(len(x), int) if spread < 1e-15 else 1 + (x > x.mean() + spread) - (x < x.mean() - spread)

    n = len(target)
    out = np.zeros(n)
    if n <= window:
        return out
    s, t = states(source), states(target)
    code = s[:-1] * 9 + t[:-1] * 3 + t[1:]
    running = np.vstack([np.zeros((1, 27)), np.cumsum(np.eye(27)[code], axis=0)])
    p = ((running[window:] - running[:-window]) / window).reshape(-1, 3, 3, 3)
    # Sums over today's state, over the source's, and over both.
    pair, own = p.sum(axis=3, keepdims=True), p.sum(axis=1, keepdims=True)
    before = own.sum(axis=3, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log(p * before / (pair * own)), 0.0)
    out[window:] = np.maximum(terms.sum(axis=(1, 2, 3)), 0.0)
    return out


def transfer_entropy(rows: DataFrame, sources: dict[str, str], window: int = 50) -> DataFrame:
    """``te_<name>_to_spy`` of each ``sources`` (name to column), their maximum and their mean; missing returns count as 0."""
    names = {f"te_{name}_to_spy": column for name, column in sources.items()}

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ret = _finite(x["ret"])
        found = {name: transfer_entropy_of(_finite(x[column]), ret, window) for name, column in names.items()}
        all_of = np.array(list(found.values()))
        return found | {"te_max_inflow": all_of.max(axis=0), "te_net_flow": all_of.mean(axis=0)}

    return by_symbol(rows, ["ret", *names.values()], [*names, "te_max_inflow", "te_net_flow"], kernel)


# Correlation matrices


def _multi_scale(close: np.ndarray) -> np.ndarray:
    """Seven series that a price alone gives: returns over four spans, two volatilities and the distance from its mean."""
    price = pd.Series(close)
    day = price.pct_change(fill_method=None)
    spans = [price.pct_change(k, fill_method=None) for k in (5, 10, 20, 50)]
    spread = [day.rolling(n, min_periods=least).std() for n, least in ((5, 3), (20, 10))]
    return np.column_stack([*spans, *spread, price / price.rolling(20, min_periods=10).mean() - 1])


ABSORPTION = ["ar_ratio", "ar_change_20d", "ar_z"]


def absorption_of(series: np.ndarray, window: int = 60, least: int = 30, top: int = 3) -> np.ndarray:
    """Share of the variance of standardised series (columns) that the ``top`` components hold, over the days with all of them; nan where unknown."""
    out = np.full(len(series), np.nan)
    whole = np.isfinite(series).all(axis=1)
    for end in range(least, len(series) + 1):
        inside = series[max(0, end - window) : end][whole[max(0, end - window) : end]]
        if len(inside) < least:
            continue
        spread = inside.std(axis=0, ddof=1)
        moving = spread > 1e-10
        if moving.sum() < 3:
            continue
        z = (inside[:, moving] - inside[:, moving].mean(axis=0)) / (spread[moving] + 1e-10)
        values = np.linalg.eigvalsh(z.T @ z)[::-1]
        out[end - 1] = values[:top].sum() / values.sum()
    return out


def absorption(rows: DataFrame, series: list[str] | None = None) -> DataFrame:
    """The absorption ratio of ``series`` (three at least) or of the price at several scales, its change and z-score."""

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        matrix = np.column_stack([x[c] for c in series]) if series and len(series) >= 3 else _multi_scale(x["close"])
        ratio = absorption_of(matrix)
        change = pd.Series(ratio).diff(20).to_numpy()
        usual = _rolled(ratio, 100, 40)
        z = ((ratio - usual.mean()) / (usual.std() + 1e-10)).clip(-4, 4).to_numpy()
        return dict(zip(ABSORPTION, (ratio, change, z), strict=True))

    return by_symbol(rows, list(dict.fromkeys(["close", *(series or [])])), ABSORPTION, kernel)


NETWORK = [f"netw_{c}" for c in ("density", "avg_centrality", "centrality_z", "modularity", "hub_disconnect")]


def components_of(adjacent: np.ndarray) -> int:
    """Connected parts of a graph: the distinct rows of what each node reaches."""
    reach = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        further = (reach.astype(int) @ reach.astype(int)) > 0
        if (further == reach).all():
            return len(np.unique(further, axis=0))
        reach = further


def network_of(series: np.ndarray, window: int = 60, limit: float = 0.5) -> np.ndarray:
    """Density, mean centrality, modularity and highest degree of the graph of correlations beyond ``limit``; nan where unknown.

    A correlation is over the days that have both series.
    """
    out = np.full((len(series), 4), np.nan)
    least = max(2, window // 3)
    for end in range(1, len(series) + 1):
        inside = series[max(0, end - window) : end]
        known = ~np.isnan(inside)
        inside = inside[known.any(axis=1)][:, known.any(axis=0)]
        n = inside.shape[1]
        if len(inside) < least or n < 2:
            continue
        links = np.abs(_finite(pd.DataFrame(inside).corr().to_numpy())) > limit
        np.fill_diagonal(links, False)
        degree = links.sum(axis=1)
        out[end - 1] = degree.sum() / (n * (n - 1)), (degree / (n - 1)).mean(), 1 - 1 / components_of(links), degree.max()
    return out


def network(rows: DataFrame, series: list[str], window: int = 60, limit: float = 0.5) -> DataFrame:
    """The correlation graph of the returns of a symbol and of ``series``; below two series all is 0."""

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        found = network_of(np.column_stack([x["ret"], *(x[c] for c in series)]), window, limit)
        usual = _rolled(found[:, 0], window, max(2, window // 3))
        z = (found[:, 0] - usual.mean()) / (usual.std() + 1e-10)
        hub = pd.Series(found[:, 3]).diff(5) / len(series)
        return dict(zip(NETWORK, (found[:, 0], found[:, 1], z, found[:, 2], hub), strict=True))

    return by_symbol(rows, ["ret", *series], NETWORK, kernel)


# Long memory


HAR = ["harv_predicted", "harv_residual", "harv_residual_z", "harv_component_ratio"]
#: Intercept and weights of day, week and month before the first fit, and the bounds of all later ones.
HAR_START, HAR_BOUNDS = np.array([0.0, 0.3, 0.3, 0.3]), (-1.0, 2.0)


def heterogeneous_variance(rows: DataFrame, least: int = 60, refit: int = 20, history: int = 252) -> DataFrame:
    """Tomorrow's squared return from those of a day, a week and a month (Corsi 2009), fitted anew every ``refit`` days on a year.

    A day is predicted with the fit of earlier days only. Symbols of fewer than 30 days are all 0.
    """

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        close = x["close"]
        n = len(close)
        if n < 30:
            return {c: np.zeros(n) for c in HAR}
        ret = np.concatenate([[0.0], np.diff(close) / np.maximum(close[:-1], 1e-10)])
        day = ret * ret
        week, month = (_rolled(day, k, m).mean().to_numpy() for k, m in ((5, 3), (22, 10)))
        inputs = np.column_stack([np.ones(n), day, week, month])
        known = np.isfinite(inputs).all(axis=1)
        predicted, residual = np.zeros(n), np.zeros(n)
        beta = HAR_START
        # The fit at a block's first day holds from the day after.
        for begin in [least - 1, *range(least, n, refit)]:
            stop = min(least + 1 if begin < least else begin + refit + 1, n)
            at = np.arange(max(begin - history, 22), begin)
            at = at[known[at - 1]]
            if begin >= least:
                beta = HAR_START
            if begin >= least and len(at) >= 30:
                design, y = inputs[at - 1], day[at]
                beta = np.clip(np.linalg.solve(design.T @ design + np.eye(4) * 1e-8, design.T @ y), *HAR_BOUNDS)
            days = np.arange(begin + 1, stop)
            days = days[known[days - 1]]
            predicted[days] = np.maximum(inputs[days - 1] @ beta, 0.0)
            residual[days] = day[days] - predicted[days]
        usual = _rolled(residual, 60, 30)
        z = ((residual - usual.mean()) / usual.std().replace(0.0, 1e-10)).clip(-5, 5)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.clip(np.where(month > 1e-15, day / month, 1.0), 0.0, 10.0)
        return dict(zip(HAR, (predicted, residual, z, ratio), strict=True))

    return by_symbol(rows, ["close"], HAR, kernel)


HURST = ["hurst_50d", "hurst_100d", "hurst_z", "hurst_regime"]


def rescaled_range(windows: np.ndarray) -> np.ndarray:
    """Hurst exponents of a stack of equally long windows, from rescaled ranges of their halves, thirds and quarters; 0.5 where undefined.

    Each part's range of accumulated deviations is divided by its deviation; the exponent is the slope of the
    logarithm of their mean against that of the length, within 0 to 1.
    """
    count, n = windows.shape
    lengths = [size for size in (n // 4, n // 3, n // 2) if size >= 10]
    if n < 20 or len(lengths) < 2:
        return np.full(count, 0.5)
    logs = np.full((count, len(lengths)), np.nan)
    for i, size in enumerate(lengths):
        parts = windows[:, : n // size * size].reshape(count, n // size, size)
        path = np.cumsum(parts - parts.mean(axis=2, keepdims=True), axis=2)
        spread = parts.std(axis=2, ddof=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(spread > 0, (path.max(axis=2) - path.min(axis=2)) / spread, np.nan)
            some = (spread > 0).any(axis=1)
            logs[some, i] = np.log(np.nanmean(ratio[some], axis=1))
    x = np.where(np.isnan(logs), np.nan, np.log(np.array(lengths, float)))
    enough = (~np.isnan(logs)).sum(axis=1) >= 2
    slope = np.full(count, 0.5)
    dx = x[enough] - np.nanmean(x[enough], axis=1, keepdims=True)
    dy = logs[enough] - np.nanmean(logs[enough], axis=1, keepdims=True)
    slope[enough] = np.clip(np.nansum(dx * dy, axis=1) / np.nansum(dx * dx, axis=1), 0.0, 1.0)
    return slope


def hurst_of(returns: np.ndarray, window: int) -> np.ndarray:
    """Exponents of the last ``window`` log returns of each day, those that are missing left out; 0.5 before."""
    out = np.full(len(returns), 0.5)
    if len(returns) < window:
        return out
    views = sliding_window_view(returns, window)
    missing = np.isnan(views).sum(axis=1)
    for m in np.unique(missing):
        at = np.flatnonzero(missing == m)
        if window - m >= 20:
            kept = views[at]
            out[at + window - 1] = rescaled_range(kept[~np.isnan(kept)].reshape(len(at), window - m))
    return out


def hurst(rows: DataFrame) -> DataFrame:
    """Exponents over 50 and 100 days, a z-score, and the regime: 0 reverts, 1 walks at random, 2 trends."""

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            moves = np.diff(np.log(x["close"]), prepend=np.nan)
        moves[~np.isfinite(moves)] = np.nan
        short, long = hurst_of(moves, 50), hurst_of(moves, 100)
        usual = _rolled(short, 100, 20)
        z = ((short - usual.mean()) / (usual.std() + 1e-10)).clip(-4, 4)
        return dict(zip(HURST, (short, long, z, 1.0 + (short > 0.6) - (short < 0.4)), strict=True))

    return by_symbol(rows, ["close"], HURST, kernel)


# Regimes


CHANGEPOINT = ["cpd_run_length", "cpd_prob_change", "cpd_regime_id"]


def changepoints(rows: DataFrame, hazard: float = 1 / 250, jump: float = 0.5, settled: int = 10) -> DataFrame:
    """Run length, probability of a change and regime number, in one pass of three numbers of state.

    A day more than two deviations from its run's mean makes a change more probable; beyond ``jump``, in a run of more than
    ``settled`` days, a new run begins with that day. Symbols of fewer than ten days are all 0.
    """

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        close = x["close"]
        n = len(close)
        length, probability, regime = np.zeros(n), np.zeros(n), np.zeros(n)
        if n >= 10:
            moves = np.concatenate([[0.0], np.diff(close) / (np.abs(close[:-1]) + 1e-10)])
            count, total, squares, number = 0, 0.0, 0.0, 0
            for i, move in enumerate(moves):
                count, total, squares = count + 1, total + move, squares + move * move
                mean = total / count
                spread = math.sqrt(max(squares / count - mean * mean, 1e-10)) + 1e-10
                probability[i] = min(1.0, hazard + 0.3 * max(0.0, abs(move - mean) / spread - 2)) if count > 1 else hazard
                if probability[i] > jump and count > settled:
                    number, count, total, squares = (number + 1) % 10, 1, move, move * move
                length[i], regime[i] = min(count, 252), number
        return dict(zip(CHANGEPOINT, (length, probability, regime), strict=True))

    return by_symbol(rows, ["close"], CHANGEPOINT, kernel)


HMM = [f"hmm_{c}" for c in ("state", "bull_prob", "bear_prob", "transition_prob", "regime_duration")]


def quantile_states(rows: DataFrame, window: int = 120, recent: int = 20, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """Bear (0), neutral (1) or bull (2) by where the mean of the ``recent`` returns lies among the quantiles of ``window``.

    All windows end the day before. Probabilities are inverse distances to the means of the three parts of the window. The
    first ``window`` days are neutral with probabilities 0.33.
    """

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        close = x["close"]
        n = len(close)
        state, bull, bear = np.ones(n), np.full(n, 0.33), np.full(n, 0.33)
        change, duration = np.zeros(n), np.ones(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            moves = _finite(np.concatenate([[0.0], close[1:] / close[:-1] - 1])) if n else close
        if n > window:
            past = sliding_window_view(moves, window)[:-1]
            now = past[:, -recent:].mean(axis=1)
            least, most = np.percentile(past, [100 * low, 100 * high], axis=1)
            state[window:] = 1.0 + (now > most) - (now < least)
            below, above = past <= least[:, None], past > most[:, None]
            parts = (below, ~below & ~above, above)
            usual = (least, (least + most) / 2, most)
            counts = [part.sum(axis=1) for part in parts]
            centres = [np.where(k > 0, np.where(part, past, 0.0).sum(axis=1) / np.maximum(k, 1), u) for part, k, u in zip(parts, counts, usual, strict=True)]
            near = np.array([1 / np.maximum(np.abs(now - c), 1e-10) for c in centres])
            bear[window:], bull[window:] = near[0] / near.sum(axis=0), near[2] / near.sum(axis=0)
            moved = np.diff(state[window:], prepend=state[window]) != 0
            change[window:] = moved
            at = np.arange(len(moved))
            begun = np.maximum.accumulate(np.where(moved, at, 0))
            duration[window:] = at - begun + 1
        return dict(zip(HMM, (state, bull, bear, change, duration), strict=True))

    return by_symbol(rows, ["close"], HMM, kernel)


# Tails


COPULA = [f"copula_{c}" for c in ("upper_tail", "lower_tail", "tail_asymmetry", "tail_z")]


def tails_of(a: np.ndarray, b: np.ndarray, share: float = 0.10) -> tuple[float, float]:
    """How often both series are among their highest, and lowest, ``share`` of ranks, relative to that share, within 0 to 1; equal values rank by place."""
    n = len(a)
    rank = lambda v: (np.argsort(np.argsort(v, kind="stable"), kind="stable") + 1) / (n + 1)
    x, y = rank(a), rank(b)
    upper, lower = ((x > 1 - share) & (y > 1 - share)).sum(), ((x < share) & (y < share)).sum()
    return min(1.0, upper / (n * share)), min(1.0, lower / (n * share))


def tail_dependence(rows: DataFrame, benchmark: str | None = None, window: int = 60, share: float = 0.10) -> DataFrame:
    """Empirical tail dependence of the returns on ``benchmark``, or on themselves a day before, over ``window`` days."""

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ret = x["ret"]
        other = x[benchmark] if benchmark else np.concatenate([[np.nan], ret[:-1]])
        upper, lower = np.full(len(ret), np.nan), np.full(len(ret), np.nan)
        known = ~(np.isnan(ret) | np.isnan(other))
        for end in range(window, len(ret) + 1):
            inside = slice(end - window, end)
            both = known[inside]
            if both.sum() >= max(10, window // 4):
                upper[end - 1], lower[end - 1] = tails_of(ret[inside][both], other[inside][both], share)
        usual = _rolled(lower, window, window // 2)
        z = (lower - usual.mean()) / (usual.std() + 1e-10)
        return dict(zip(COPULA, (upper, lower, upper - lower, z), strict=True))

    return by_symbol(rows, ["ret", *([benchmark] if benchmark else [])], COPULA, kernel)


# Multifractals


MFDFA = ["mfdfa_alpha", "mfdfa_width", "mfdfa_asymmetry", "mfdfa_z"]
MFDFA_SCALES = (8, 16, 32)


def detrended_exponents(windows: np.ndarray, q: tuple[float, ...] = (2.0, 0.0, -2.0), scales: tuple[int, ...] = MFDFA_SCALES) -> np.ndarray:
    """Scaling exponents of a stack of equally long windows for each moment ``q``, within 0 to 1.5; 0.5 where undefined.

    The accumulated deviations are cut into segments of each scale, a line is taken out of each, and the exponent
    is the slope of the logarithm of the q-mean of what is left against that of the scale.
    """
    count, n = windows.shape
    out = np.full((len(q), count), 0.5)
    if n < 2 * max(scales):
        return out
    profile = np.cumsum(windows - windows.mean(axis=1, keepdims=True), axis=1)
    logs = np.full((len(q), count, len(scales)), np.nan)
    for i, size in enumerate(scales):
        parts = profile[:, : n // size * size].reshape(count, n // size, size)
        line, _ = np.linalg.qr(np.column_stack([np.ones(size), np.arange(size)]))
        left = parts - (parts @ line) @ line.T
        rough = np.sqrt((left * left).mean(axis=2))
        rough = np.where(rough > 0, rough, np.nan)
        some = ~np.isnan(rough).all(axis=1)
        for j, power in enumerate(q):
            if power == 0:
                logs[j, some, i] = np.nanmean(np.log(rough[some]), axis=1)
            else:
                logs[j, some, i] = np.log(np.nanmean(rough[some] ** power, axis=1)) / power
    x = np.log(np.array(scales, float))
    for j in range(len(q)):
        y = np.where(np.isfinite(logs[j]), logs[j], np.nan)
        at = np.flatnonzero((~np.isnan(y)).sum(axis=1) >= 2)
        used = np.where(np.isnan(y[at]), np.nan, x)
        dx, dy = used - np.nanmean(used, axis=1, keepdims=True), y[at] - np.nanmean(y[at], axis=1, keepdims=True)
        out[j, at] = np.clip(np.nansum(dx * dy, axis=1) / np.nansum(dx * dx, axis=1), 0.0, 1.5)
    return out


def multifractal(rows: DataFrame, window: int = 100, z_window: int = 60) -> DataFrame:
    """Exponent, width and asymmetry of the multifractal spectrum of the last ``window`` log returns, and the width's z-score."""

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(x["close"])
        with np.errstate(divide="ignore", invalid="ignore"):
            moves = np.log(np.concatenate([[np.nan], x["close"][1:] / x["close"][:-1]])) if n else x["close"]
        moves[~np.isfinite(moves)] = np.nan
        alpha, width, bend = np.full(n, 0.5), np.zeros(n), np.zeros(n)
        if n >= window:
            views = sliding_window_view(moves, window)
            missing = np.isnan(views).sum(axis=1)
            for m in np.unique(missing):
                at = np.flatnonzero(missing == m)
                if window - m >= 2 * max(MFDFA_SCALES):
                    two, zero, minus = detrended_exponents(views[at][~np.isnan(views[at])].reshape(len(at), window - m))
                    alpha[at + window - 1], width[at + window - 1], bend[at + window - 1] = two, np.abs(two - minus), minus - 2 * zero + two
        usual = _rolled(width, z_window, max(10, z_window // 4))
        z = ((width - usual.mean()) / (usual.std() + 1e-10)).clip(-4, 4)
        return dict(zip(MFDFA, (alpha, width, bend.clip(-2, 2), z), strict=True))

    return by_symbol(rows, ["close"], MFDFA, kernel)
