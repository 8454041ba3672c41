"""Folds with a reset: what a row gets depends on every row of its symbol before it.

A symbol's rows are sorted on disk if need be and streamed through a few numbers of state, so memory
stays bounded; symbols are the unit of parallel work, as a fold with a reset cannot be cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import information_threshold


def fold(rows: DataFrame, order: list[str], inputs: list[str], start: Callable, out: dict[str, str]) -> DataFrame:
    """Adds the columns ``out`` (name to type), one value each from calls of ``start()`` in ``order``.

    ``start`` begins a symbol: it returns the function that takes a row's ``inputs`` in turn.
    """
    names = list(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, step = None, None
        for frame in frames:
            found = []
            for at, *values in zip(frame["symbol"], *(frame[c] for c in inputs), strict=True):
                if step is None or at != symbol:
                    symbol, step = at, start()
                found.append(step(*values))
            yield frame.assign(**{name: [row[i] for row in found] for i, name in enumerate(names)})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{k}` {v}" for k, v in out.items()])
    return rows.repartition("symbol").sortWithinPartitions("symbol", *order).mapInPandas(run, schema)


def cusum_events(returns: DataFrame, threshold: float) -> DataFrame:
    """Rows at which the sum of gains or of losses since the last event reaches ``threshold``.

    Each sum restarts by itself, so both may fire on one row. A missing return counts as 0.
    """

    def start():
        up = down = 0.0

        def step(r):
            nonlocal up, down
            up, down = max(0.0, up + r), min(0.0, down + r)
            fired = up >= threshold, down <= -threshold
            up, down = (0.0 if fired[0] else up), (0.0 if fired[1] else down)
            return fired

        return step

    rows = returns.select("symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("_r"))
    return fold(rows, ["date"], ["_r"], start, {"up": "boolean", "down": "boolean"}).filter("up OR down").drop("_r")


def amount_bars(rows: DataFrame, amount: Column, at: str, order: list[str]) -> DataFrame:
    """Bars that close once their ``amount`` reaches the symbol's mean amount of a day.

    An overshoot is not carried over; the last bar may be short. ``rows`` have open, high, low,
    close and volume. With the traded value as amount these are dollar bars, with the volume volume bars.
    """

    def start():
        bar, total = 0, 0.0

        def step(x, threshold):
            nonlocal bar, total
            mine, total = bar, total + x
            if total >= threshold:
                bar, total = bar + 1, 0.0
            return (mine,)

        return step

    sized = rows.withColumn("_amount", amount.cast("double")).join(information_threshold(rows, amount, at), "symbol")
    numbered = fold(sized, order, ["_amount", "threshold"], start, {"bar": "long"})
    place = F.struct(*order)
    return numbered.groupBy("symbol", "bar").agg(
        F.min(at).alias("began"),
        F.min_by("open", place).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", place).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n_rows"),
    )
