"""Symbol words against a plain reading of one window at a time."""

import math
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators.words import symbol_words


def by_hand(closes):
    moves = [0.0] + [math.log(b / a) for a, b in zip(closes, closes[1:])]
    found, shares = [], []
    for i in range(len(closes)):
        window, word = np.array(moves[max(0, i - 19) : i + 1]), None
        if len(window) == 20:
            parts = window.reshape(5, 4).mean(axis=1)
            spread = window.std()
            letters = [2] * 5 if spread < 1e-10 else [sum((m - window.mean()) / spread >= b for b in (-0.6745, 0, 0.6745)) for m in parts]
            word = "".join("abcd"[p] for p in letters)
        shares.append([0.0] * 4 if word is None else [word.count(c) / 5 for c in "abcd"])
        novelty = 0.0
        if i >= 49:
            p, q = (np.maximum(x, 1e-12) for x in (np.array(shares[i]), np.mean(shares[i - 49 : i + 1], axis=0)))
            p, q = p / p.sum(), q / q.sum()
            novelty = max(0.0, float((p * np.log(p / q)).sum()))
        match = 0.0 if word is None else 1.0 if word[-2:] in ("cd", "dd") else -1.0 if word[-2:] in ("aa", "ab") else 0.0
        number = 0.0 if word is None else float(int("".join(str("abcd".index(c)) for c in word), 4))
        found.append((word, number, match, pytest.approx(novelty, abs=1e-9)))
    return found


def rows(spark, closes):
    found = [("a", date(2020, 1, 1) + timedelta(days=i), c) for i, c in enumerate(closes)]
    return spark.createDataFrame(found, "symbol string, date date, close double").repartition(3)


def words(spark, closes):
    return [tuple(r)[2:] for r in symbol_words(rows(spark, closes)).orderBy("date").collect()]


def test_words_against_a_plain_reading_and_without_looking_ahead(spark):
    random = np.random.default_rng(11)
    closes = [float(c) for c in 100 * np.exp(np.cumsum(random.normal(0, 0.02, size=130)))]
    got = words(spark, closes)
    assert got == by_hand(closes)
    assert {m for _, _, m, _ in got} == {-1.0, 0.0, 1.0}
    assert words(spark, closes[:80]) == got[:80]


def test_windows_without_spread_zero_prices_and_no_rows(spark):
    assert words(spark, [5.0] * 25)[-1] == ("ccccc", float(int("22222", 4)), 0.0, 0.0)
    assert words(spark, [0.0] * 25)[-1][0] == "ccccc"
    gap = words(spark, [100.0 + i % 7 for i in range(20)] + [None] * 6 + [100.0 + i % 5 for i in range(20)])
    assert gap[24][0][-1] == "d" and len(gap) == 46
    assert words(spark, []) == []
