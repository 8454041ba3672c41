"""Bear universes on small series whose draws are followed by hand."""

import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bear


def series(spark, **keys):
    rows = [(k, date(2020, 1, 1) + timedelta(days=i), None if v is None else float(v)) for k, values in keys.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, ret double").repartition(3)


def draw(seed, what, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, what, *parts))).encode()).hexdigest()[:8], 16)


def by_hand(key, values, seed):
    """The places that a block bootstrap takes, one list for each block."""
    n = len(values)
    fell = [i >= 9 and sum(values[i - 9 : i + 1]) < -0.02 for i in range(n)]
    spell = [any(fell[max(0, i - 5) : i + 1]) for i in range(n)]
    runs, i = [], 0
    while i < n:
        stop = i
        while stop < n and spell[stop]:
            stop += 1
        if stop - i >= 3:
            runs.append((i, stop - i))
        i = max(stop, i + 1)
    blocks, filled, number = [], 0, 1
    while filled < n:
        start, length = runs[draw(seed, "run", key, number) % len(runs)]
        take = min(5 + draw(seed, "length", key, number) % 16, length)
        start += draw(seed, "start", key, number) % (length - take + 1)
        take = min(take, n - filled)
        blocks.append(list(range(start, start + take)))
        filled, number = filled + take, number + 1
    return blocks


def test_blocks_are_contiguous_days_of_decline_and_agree_on_reruns(spark):
    random = np.random.default_rng(3)
    falls = [float(x) for x in random.normal(0, 0.01, size=240)]
    index = series(spark, a=falls, rising=[0.001] * 200, short=[-0.01] * 20, empty=[None] * 50)
    got = bear.block_bootstrap(index, ["symbol"], 7).orderBy("symbol", "date").collect()
    assert {r.symbol for r in got} == {"a"} and len(got) == 240
    wanted = by_hand("a", falls, 7)
    assert [(r.block, (r.taken_from - date(2020, 1, 1)).days) for r in got] == [(i, p) for i, places in enumerate(wanted, 1) for p in places]
    assert all(r.synthetic_return == falls[(r.taken_from - date(2020, 1, 1)).days] for r in got)
    again = bear.block_bootstrap(index.repartition(7), ["symbol"], 7).orderBy("symbol", "date").collect()
    assert again == got
    assert bear.block_bootstrap(index, ["symbol"], 8).orderBy("symbol", "date").collect() != got
    assert bear.block_bootstrap(index.limit(0), ["symbol"], 7).count() == 0


@pytest.mark.parametrize("flat", [0, 7])
def test_balanced_shares_are_exact_and_every_return_is_a_real_one(spark, flat):
    values = [0.01 + i / 1e4 for i in range(70)] + [-0.01 - i / 1e4 for i in range(14)] + [0.001] * flat
    index = series(spark, a=values, few=[0.01] * 50 + [-0.01] * 9)
    got = bear.regime_balanced(index, ["symbol"], 0.35, 0.55, 1).collect()
    n = len(values)
    assert {r.symbol for r in got} == {"a"} and len({r.date for r in got}) == n
    assert {r.synthetic_return for r in got} <= set(values)
    rising, falling = math.floor(n * 0.35), math.floor(n * 0.55)
    spare = 0 if flat else n - rising - falling
    assert sum(r.synthetic_return > 0.0025 for r in got) == rising + spare - spare // 2
    assert sum(r.synthetic_return < -0.0025 for r in got) == falling + spare // 2
    assert sorted(got) == sorted(bear.regime_balanced(index.repartition(5), ["symbol"], 0.35, 0.55, 1).collect())


def test_shift_and_amplification_stop_at_the_limit(spark):
    index = series(spark, a=[0.2, 0.01, 0.0, -0.02, -0.09, None, math.nan])
    assert [r.synthetic_return for r in bear.mean_shift(index, ["symbol"], 10).orderBy("date").collect()] == pytest.approx([0.1, 0.009, -0.001, -0.021, -0.091])
    assert [r.synthetic_return for r in bear.amplified(index, ["symbol"]).orderBy("date").collect()] == pytest.approx([0.1, 0.007, 0.0, -0.03, -0.1])


def test_rotation_falls_on_average_with_the_deviation_of_the_index(spark):
    random = np.random.default_rng(5)
    names = {f"s{i}": random.normal(0.002, 0.01, size=120).tolist() for i in range(6)}
    members = series(spark, **names)
    real = random.normal(0.001, 0.008, size=130)
    index = series(spark, index=real.tolist()).drop("symbol")
    got = [r.synthetic_return for r in bear.defensive_rotation(members, index, ["s0", "s1", "s2"], ["s3", "s4", "s5"]).orderBy("date").collect()]
    columns = np.array(list(names.values()))
    raw = 0.54 * columns[:3].mean(axis=0) + 0.56 * columns[3:].mean(axis=0)
    raw *= real[:120].std(ddof=1) / (raw.std(ddof=1) + 1e-10)
    assert raw.mean() > 0
    assert got == pytest.approx([*np.clip(raw - raw.mean() - 0.0003, -0.1, 0.1), *(real[120:] - 0.0005)])
    assert bear.defensive_rotation(members.filter(F.col("symbol") != "s0"), index, ["s0", "s1", "s2"], ["s3", "s4", "s5"]).count() == 0
    assert bear.defensive_rotation(members, index, ["s0", "s1", "s2"], ["s3", "s4", "s5"], least_dates=121).count() == 0
