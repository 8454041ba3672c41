"""Multi-scale universes on small series: every draw followed by hand, quotas, contiguous blocks, reruns, keys without the kinds."""

import hashlib
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import multiscale

START = date(2020, 1, 1)


def series(spark, **keys):
    rows = [(k, START + timedelta(days=i), None if v is None else float(v)) for k, values in keys.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, ret double").repartition(3)


def draw(seed, what, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, what, *parts))).encode()).hexdigest()[:8], 16)


def by_hand(key, n, seed, pools):
    """The kind and place that each of ``n`` days takes, from pools of (start, length) blocks and quotas by kind."""
    drawn = []
    for kind, (blocks, quota) in pools.items():
        filled, k = 0, 1
        while filled < quota:
            start, length = blocks[draw(seed, "pick", key, kind, k) % len(blocks)]
            drawn.append((draw(seed, "place", key, kind, k), kind, k, start, length))
            filled, k = filled + length, k + 1
    days = [(kind, start + j) for _, kind, _, start, length in sorted(drawn) for j in range(length)][:n]
    return days + [(None, draw(seed, "rest", key, i + 1) % n) for i in range(len(days), n)]


def taken(found):
    return [(r["kind"], (r["taken_from"] - START).days) for r in found.orderBy("date").collect()]


def chosen(name):
    return {name: multiscale.UNIVERSES[name]}


def week_kind(block):
    return "bull" if sum(x > 0.0025 for x in block) >= 3 else "bear" if sum(x < -0.0025 for x in block) >= 3 else "choppy"


def test_weeks_by_hand(spark):
    x = np.random.default_rng(2).normal(0, 0.005, size=203)
    got = taken(multiscale.universes(series(spark, a=x), ["symbol"], chosen("multiscale_weekly_bear")))
    pools = {k: ([], 0) for k in ("bull", "bear", "choppy")}
    for i in range(40):
        pools[week_kind(x[5 * i : 5 * i + 5])][0].append((5 * i, 5))
    want = by_hand("a", 203, 3002, {k: (pools[k][0], q * 5) for k, q in (("bull", 12), ("bear", 20), ("choppy", 8))})
    assert got == want and [k for k, _ in got[200:]] == [None] * 3


@pytest.mark.parametrize(("rallies", "flats"), [(3, 3), (1, 4), (4, 1), (1, 1), (0, 0)])
def test_months_and_what_stands_in_for_missing_kinds(spark, rallies, flats):
    sums = [-0.05] * 6 + [0.05] * rallies + [0.0] * flats
    x = [s / 21 for s in sums for _ in range(21)]
    starts = [(21 * i, 21) for i in range(len(sums))]
    down, up, flat = starts[:6], starts[6 : 6 + rallies], starts[6 + rallies :]
    if rallies < 2:
        up = flat[: len(flat) // 2] if flats >= 2 else down[:1]
    if flats < 2:
        flat = up[: len(up) // 2] if rallies >= 2 else down[:1]
    n = len(sums)
    a, b = max(1, int(n * 0.4)), max(1, int(n * 0.3))
    want = by_hand("a", len(x), 3010, {"drawdown": (down, a * 21), "rally": (up, b * 21), "flat": (flat, (n - a - b) * 21)})
    assert taken(multiscale.universes(series(spark, a=x), ["symbol"], chosen("multiscale_monthly_drawdown"))) == want


def test_spells_of_volatility_by_hand(spark):
    random = np.random.default_rng(4)
    x = np.concatenate([random.normal(0, s, size=60) for s in (0.003, 0.01, 0.03, 0.01, 0.003, 0.02)])
    spread = [np.std(x[i - 9 : i + 1], ddof=1) * 252**0.5 if i >= 9 else 0.2 for i in range(len(x))]
    kinds = ["low" if s < 0.12 else "high" if s > 0.22 else "med" for s in spread]
    pools, i = {k: [] for k in ("low", "med", "high")}, 0
    while i < len(x):
        stop = i
        while stop < len(x) and kinds[stop] == kinds[i]:
            stop += 1
        if stop - i >= 3:
            pools[kinds[i]].append((i, stop - i))
        i = stop
    found = multiscale.universes(series(spark, a=x), ["symbol"], chosen("multiscale_vol_regime"))
    assert taken(found) == by_hand("a", len(x), 3030, {k: (b, len(x) // 3) for k, b in pools.items()})


def test_single_days_meet_their_quotas_and_reruns_agree(spark):
    x = np.random.default_rng(6).normal(0, 0.008, size=300)
    rows = series(spark, a=x, b=x[::-1], few=x[:12], calm=[0.0] * 100, none=[None] * 50)
    names = ("multiscale_swing_large", "multiscale_swing_flat", "multiscale_cascade")
    found = multiscale.universes(rows, ["symbol"], {n: multiscale.UNIVERSES[n] for n in names}).cache()
    counts = {(u, s): Counter() for u in names for s in "ab"}
    for r in found.collect():
        counts[r["universe"], r["symbol"]][r["kind"]] += 1
        assert r["synthetic_return"] == (x if r["symbol"] == "a" else x[::-1])[(r["taken_from"] - START).days]
    for (universe, _), kinds in counts.items():
        assert sum(kinds.values()) == 300
        if universe == "multiscale_cascade":
            assert len({n for k, n in kinds.items() if k != "rest"}) == 1 and len(kinds) > 5
        else:
            assert kinds["large" if universe.endswith("large") else "flat"] == 120
    again = multiscale.universes(rows.repartition(5), ["symbol"], {n: multiscale.UNIVERSES[n] for n in names})
    assert sorted(again.collect()) == sorted(found.collect())
    assert multiscale.universes(rows.limit(0), ["symbol"]).count() == 0
