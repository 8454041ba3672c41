"""Selection inside folds against plain counting, and proof that no test row reaches what a fold has fitted."""

import math
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection as S

FEATURES = ["signal", "same", "noise", "still", "coarse"]


def frame(spark, n=300, seed=5, change=None):
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        target = int(random.random() < 0.5)
        signal, noise = target + random.normal(0, 0.8), random.normal()
        row = [signal, 3 * signal + 1, noise, 7.0, float(int(2 * noise))]
        if change is not None and i in change:
            target, row = 1 - target, [1e3 * i, -1.0 * i, 5e2 * target, 1.0 * i, 9.0]
        rows.append((date(2020, 1, 1) + timedelta(days=i), target, *[float(x) for x in row]))
    return spark.createDataFrame(rows, "date date, target int, " + ", ".join(f"{f} double" for f in FEATURES)).repartition(3)


def told_by_hand(values, targets, bins=10):
    n, below = len(values), {v: sum(w < v for w in values) for v in set(values)}
    both = Counter((below[v] * bins // n, t) for v, t in zip(values, targets))
    one, two = Counter(b for b, _ in both.elements()), Counter(targets)
    return sum(c / n * math.log(c * n / (one[b] * two[t])) for (b, t), c in both.items())


def judged(rows, folds):
    train = rows.join(folds.filter("role = 'train'"), "date")
    found = S.select_features(train, FEATURES, ["fold"], 2)
    return {(r["fold"], r["feature"]): (r["varies"], r["distinct"], r["selected"], r["mi"]) for r in found.collect()}


def test_folds_against_plain_places(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(23)]
    rows = spark.createDataFrame([(d,) for d in days for _ in range(2)], "date date")
    got = {(r["fold"], r["date"]): r["role"] for r in S.dated_folds(rows, 5, 3, 2).collect()}
    for fold in range(5):
        low, high = 4 * fold, 23 if fold == 4 else 4 * fold + 4
        for i, d in enumerate(days):
            want = "test" if low <= i < high else "purged" if low - 3 <= i < high + 2 else "train"
            assert got[fold, d] == want
    assert S.dated_folds(rows.limit(0)).count() == 0


def test_selection_by_counting_and_without_a_leak(spark):
    rows, folds = frame(spark), S.dated_folds(frame(spark), 3)
    got = judged(rows, folds)
    plain = {r["date"]: r for r in rows.collect()}
    trains = {k: [plain[r["date"]] for r in folds.collect() if (r["fold"], r["role"]) == (k, "train")] for k in range(3)}
    for k, train in trains.items():
        assert got[k, "still"] == (False, False, False, None)
        assert got[k, "same"] == (True, False, False, None)
        mi = {f: told_by_hand([r[f] for r in train], [r["target"] for r in train]) for f in ("signal", "noise", "coarse")}
        for f in ("signal", "noise"):
            assert got[k, f][3] == pytest.approx(mi[f], abs=1e-9)
        assert got[k, "signal"][2] and sum(x[2] for (fold, _), x in got.items() if fold == k) == 2
    # Whatever the first fold's test and purged days hold, what it has fitted stays as it is.
    away = {(d - date(2020, 1, 1)).days for d in (r["date"] for r in folds.filter("fold = 0 AND role <> 'train'").collect())}
    changed = judged(frame(spark, change=away), folds)
    assert [changed[0, f] for f in FEATURES] == [got[0, f] for f in FEATURES]
    assert any(changed[1, f] != got[1, f] for f in FEATURES)


def test_information_with_ties_nulls_and_one_class(spark):
    values = [1.0] * 40 + [2.0] * 5 + [float("nan")] * 3 + [float(i) for i in range(10)]
    targets = [i % 3 % 2 for i in range(len(values))]
    rows = spark.createDataFrame([(x, t) for x, t in zip(values, targets)] + [(5.0, None)], "x double, target int").withColumn("none", F.lit(None).cast("double"))
    got = {r["feature"]: r["mi"] for r in S.mutual_information(S.unpivoted(rows, [], ["x", "none"]), ["feature"]).collect()}
    assert got["x"] == pytest.approx(told_by_hand([0.0 if x != x else x for x in values], targets), abs=1e-9)
    assert got["none"] == 0.0
    single = S.unpivoted(rows.withColumn("target", F.lit(1)), [], ["x"])
    assert [r["mi"] for r in S.mutual_information(single, ["feature"]).collect()] == [0.0]


def test_interactions_are_found_and_added(spark):
    random = np.random.default_rng(3)
    points = [(float(a), float(b), int(a * b > 0)) for a, b in random.normal(size=(400, 2))]
    rows = spark.createDataFrame(points, "a double, b double, target int")
    found = S.interactions(rows, ["a", "b"]).collect()
    assert {r["name"] for r in found} == {"ix_a_product_b", "ix_a_ratio_b"}
    assert [r["mi"] for r in found] == sorted((r["mi"] for r in found), reverse=True) and found[0]["mi"] > 0.6
    added = S.with_interactions(rows.union(spark.createDataFrame([(1.0, 0.0, 1)], rows.schema)), [("a", "b", "product"), ("a", "b", "ratio"), ("a", "lost", "ratio")])
    assert added.columns == ["a", "b", "target", "ix_a_product_b", "ix_a_ratio_b"]
    assert all(r["ix_a_product_b"] == r["a"] * r["b"] and r["ix_a_ratio_b"] == (r["a"] / r["b"] if r["b"] else 1e10) for r in added.collect())
    assert S.interactions(rows, ["a"]).count() == 0


def test_groups_and_budgets():
    groups = S.grouped(["pm_a", "pm_b", "vol_c", "x", "pm_d"], {"early": ["pm_"], "volume": ["vol_", "pm_d"], "none": ["q_"]})
    assert groups == {"early": ["pm_a", "pm_b", "pm_d"], "volume": ["vol_c"], "other": ["x"]}
    assert S.budgets(groups, 10) == {"early": 6, "volume": 2, "other": 2}
    assert S.budgets(groups, 10, mode="equal") == {"early": 3, "volume": 3, "other": 3}
    assert S.budgets(groups, 1, least=2) == {"early": 2, "volume": 2, "other": 2}
    with pytest.raises(ValueError):
        S.budgets(groups, 1, mode="random")


def test_area_under_by_pairs(spark):
    random = np.random.default_rng(8)
    rows = [("k", float(round(random.normal() + t, 1)), t) for t in (0, 1) for _ in range(60)] + [("one", 0.5, 1)]
    got = {r["key"]: r["auc"] for r in S.area_under(spark.createDataFrame(rows, "key string, score double, target int"), ["key"]).collect()}
    ones, zeros = ([s for k, s, t in rows if k == "k" and t == c] for c in (1, 0))
    assert got == {"k": pytest.approx(np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones])), "one": 0.5}


def test_validation_finds_the_signal_and_nothing_in_noise(spark):
    rows = frame(spark, 240)
    got = S.cross_validate(rows, FEATURES, S.dated_folds(rows, 2), most=2, components=2).orderBy("fold").collect()
    assert [(r["fold"], r["n_test"], r["n_selected"], r["n_components"]) for r in got] == [(0, 120, 2, 2), (1, 120, 2, 2)]
    assert all(0.7 < r["test_auc"] < 0.95 and 0.7 < r["train_auc"] < 0.95 for r in got)
    none = S.cross_validate(rows, ["still"], S.dated_folds(rows, 2)).collect()
    assert all((r["n_selected"], r["train_auc"], r["test_auc"]) == (0, 0.5, 0.5) for r in none)
