"""Live risk and execution checks with state: a circuit breaker, fills met by their expectations, drift of what arrives."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.validation import drift_against

#: transformWithState keeps its state in this store; set it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

BREAKER_STATE = "day date, daily double, equity double, peak double, losses long, tripped string"
BREAKER_ROWS = (
    "symbol string, kind string, day date, event_id long, direction string, size double, reason string, daily_pnl double, drawdown double, losses long, tripped string"
)


class CircuitBreaker(StatefulProcessor):
    """One account's limits, over its trades and signals in the order they come.

    A trade moves the day's profit, the equity, its peak and the run of losses. A signal other than HOLD
    is checked: a day's loss or a drawdown at its limit trips the breaker and turns this and later
    signals into HOLD, the first until the day ends, the second for good; after ``losses`` losing trades
    in a row a signal's size is halved. A day ends when the account's next day begins or, by a timer,
    when the watermark passes its midnight; either way its figures are emitted once.
    """

    def __init__(self, daily_loss: float, drawdown: float, losses: int, equity: float):
        self.daily_loss, self.drawdown, self.losses, self.equity = daily_loss, drawdown, losses, equity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", BREAKER_STATE)

    def _fallen(self, equity: float, peak: float) -> float:
        return (peak - equity) / peak if peak > 0 else 0.0

    def _day_row(self, symbol: str, s: list) -> tuple:
        day, daily, equity, peak, losses, tripped = s
        return (symbol, "day", day, None, None, None, None, daily, self._fallen(equity, peak), losses, tripped)

    def _closed(self, s: list) -> list:
        day, _, equity, peak, losses, tripped = s
        return [None, 0.0, equity, peak, losses, None if tripped == "daily_loss" else tripped]

    def _timer(self, day: datetime.date) -> int:
        after = datetime.datetime.combine(day + datetime.timedelta(days=1), datetime.time(), datetime.UTC)
        return int(after.timestamp() * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = list(self.account.get()) if self.account.exists() else [None, 0.0, self.equity, self.equity, 0, None]
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        columns = ["event_id", "day", "kind", "pnl", "direction", "size"]
        for event_id, day, kind, pnl, direction, size in frame[columns].itertuples(index=False, name=None):
            if s[0] is not None and day > s[0]:
                self.handle.deleteTimer(self._timer(s[0]))
                out.append(self._day_row(key[0], s))
                s = self._closed(s)
            if s[0] is None:
                # A row that comes after its day was closed counts for the next one to close.
                s[0] = day
                self.handle.registerTimer(self._timer(day))
            _, daily, equity, peak, losses, tripped = s
            if kind == "trade":
                daily += pnl
                equity += pnl * equity if equity > 0 else pnl
                s = [s[0], daily, equity, max(peak, equity), losses + 1 if pnl < 0 else 0, tripped]
                continue
            reason = None
            if direction != "HOLD":
                fallen = self._fallen(equity, peak)
                if tripped is None and peak > 0 and -daily / peak >= self.daily_loss:
                    tripped = "daily_loss"
                elif tripped is None and fallen >= self.drawdown:
                    tripped = "drawdown"
                reason, s[5] = tripped, tripped
                if reason is not None:
                    direction = "HOLD"
                elif losses >= self.losses:
                    size = size * 0.5
            out.append((key[0], "signal", day, event_id, direction, size, reason, daily, self._fallen(equity, peak), losses, tripped))
        self.account.update(tuple(s))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = list(self.account.get()) if self.account.exists() else [None]
        out = []
        if s[0] is not None and self._timer(s[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._day_row(key[0], s))
            self.account.update(tuple(self._closed(s)))
        yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        names = [field.split()[0] for field in BREAKER_ROWS.split(", ")]
        found = pd.DataFrame(out, columns=names, dtype=object)
        return found.astype({"event_id": "Int64", "losses": "Int64", "size": "float64", "daily_pnl": "float64", "drawdown": "float64"})

    def close(self) -> None:
        pass


def circuit_breaker(
    events: DataFrame, daily_loss: float = 0.02, drawdown: float = 0.10, losses: int = 5, equity: float = 1.0, late: str = "1 hour"
) -> DataFrame:
    """Checked signals and closed days of each ``symbol`` (an account) of a stream.

    ``events`` has ``symbol, event_id, ts, kind`` (``trade`` or ``signal``), ``pnl`` (a share of the
    equity), ``direction`` and ``size``. State is one row for each account. An account's rows of one micro-batch are
    ordered in memory, so bound the batch by the source's trigger options. Days are those of UTC.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("day", F.to_date("ts"))
    processor = CircuitBreaker(daily_loss, drawdown, losses, equity)
    return rows.groupBy("symbol").transformWithStateInPandas(processor, BREAKER_ROWS, "append", "EventTime")


def met_expectations(expected: DataFrame, fills: DataFrame, wait: str = "10 days", late: str = "1 day") -> DataFrame:
    """Each expected order with its fill, or with none once it can no longer come; a stream-stream outer join.

    ``expected`` has ``order_id, direction, expected, ordered_at``; ``fills`` has ``order_id, actual, filled_at``.
    A fill counts from the order on for ``wait``. Fills delivered again are dropped. Both sides' state is
    bounded by the watermarks. A long fill is favourable at or below the expected price, a short one at or above it.
    """
    asked = expected.withColumn("ordered_at", F.col("ordered_at").cast("timestamp")).withWatermark("ordered_at", late)
    once = fills.withColumn("filled_at", F.col("filled_at").cast("timestamp")).withWatermark("filled_at", late).dropDuplicatesWithinWatermark(["order_id"])
    once = once.withColumnRenamed("order_id", "fill_id")
    inside = F.expr(f"fill_id = order_id AND filled_at >= ordered_at AND filled_at <= ordered_at + INTERVAL {wait}")
    slip = F.when(F.col("actual").isNull(), None).when(F.col("expected") == 0, 0.0).otherwise((F.col("actual") - F.col("expected")) / F.col("expected") * 10000)
    good = F.when(F.upper("direction") == "LONG", F.col("slip") <= 0).otherwise(F.col("slip") >= 0)
    return asked.join(once, inside, "left_outer").withColumn("slip", slip).select(
        "order_id", F.upper("direction").alias("direction"), "expected", "actual", F.round("slip", 2).alias("slippage_bps"), good.alias("favorable"), "ordered_at", "filled_at"
    )


def watch_drift(live: DataFrame, baseline: DataFrame, path: str, label: str, threshold: float = 0.2):
    """Starts a stream that judges every micro-batch of ``feature, value`` rows against ``baseline`` (of ``drift_baseline``).

    Each batch gives one row for each feature, with the batch's smallest ``label``, in ``path/log/batch=<id>``. A batch that
    is run again after a failure writes the same folder again, so the log holds it once.
    """

    def judge(batch: DataFrame, number: int) -> None:
        first = batch.agg(F.min(label).alias(label)).scalar()
        drift_against(baseline, batch, threshold).withColumn(label, first).write.mode("overwrite").parquet(f"{path}/log/batch={number}")

    return live.writeStream.foreachBatch(judge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
