"""Drift, ranking quality and performance summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import amounts_below, exact_quantiles


def performance(returns: DataFrame, risk_free: float = 0.04, days: int = 252) -> DataFrame:
    """Total return, Sharpe ratio (population deviation), worst drawdown and win rate by symbol.

    ``returns`` has ``symbol, date, ret``; null returns are left out. The Sharpe ratio is null where the
    returns do not vary, as with a single one.
    """
    valid = returns.filter("ret IS NOT NULL")
    growth = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = valid.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(growth)))
    curve = curve.withColumn("peak", F.greatest(F.max("equity").over(growth), F.lit(1.0)))
    excess = F.col("ret") - risk_free / days
    return curve.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total_return"),
        F.try_divide(F.sqrt(F.lit(float(days))) * F.mean(excess), F.stddev_pop("ret")).alias("sharpe"),
        F.min(F.try_divide(F.col("equity"), F.col("peak")) - 1).alias("max_drawdown"),
        F.mean((F.col("ret") > 0).cast("double")).alias("win_rate"),
    )


def auc(scored: DataFrame, score: str, label: str, keys: tuple = ("symbol",)) -> DataFrame:
    """Area under the ROC curve by ``keys``; ties count half.

    Rows are counted by distinct score first; only those counts are ordered, by ranges of scores.
    """
    counts = scored.groupBy(*keys, score).agg(F.sum(label).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg"))
    below = amounts_below(counts, list(keys), score, "_neg", "_below")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return below.groupBy(*keys).agg(F.try_divide(wins, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"), F.sum("_pos").alias("n_pos"))


def recent_auc(predictions: DataFrame, order: list[str], baselines: DataFrame, last: int = 500, degrading: float = 0.03, critical: float = 0.05) -> DataFrame:
    """AUC of each symbol's ``last`` predictions (``score, label``) against its baseline, with an alert.

    Fewer than ten predictions, or a single class, give no AUC and no decay.
    """
    recent = Window.partitionBy("symbol").orderBy(*[F.desc(c) for c in order])
    kept = predictions.withColumn("_place", F.row_number().over(recent)).filter(F.col("_place") <= last)
    sizes = predictions.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_predictions"))
    found = sizes.join(auc(kept, "score", "label"), "symbol", "left").join(baselines, "symbol", "left")
    enough = F.col("n_predictions") >= 10
    value = F.when(enough, F.col("auc"))
    decay = F.coalesce(F.when(value.isNotNull(), F.col("baseline_auc") - value), F.lit(0.0))
    alert = (
        F.when(~enough, "INSUFFICIENT_DATA")
        .when(value.isNull(), "SINGLE_CLASS")
        .when(F.col("decay") >= critical, "CRITICAL")
        .when(F.col("decay") >= degrading, "DEGRADING")
        .otherwise("NONE")
    )
    return found.withColumn("decay", decay).select(
        "symbol", F.round(value, 4).alias("rolling_auc"), "baseline_auc", F.round("decay", 4).alias("decay"), "n_predictions", alert.alias("alert"), (alert == "CRITICAL").alias("should_retrain")
    )


def stability_index(train: DataFrame, test: DataFrame, column: str, bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """Population stability index of ``column`` by ``symbol`` against quantile bins of ``train``.

    Bin edges are a few numbers per symbol; both sides are only counted against them.
    """
    shares = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(train.withColumn("_x", F.col(column)), ["symbol"], "_x", shares, "_edges")
    # Interpolated edges that fall on a value may miss it by a rounding error.
    edges = edges.select("symbol", F.transform("_edges", lambda e: F.round(e, 9)).alias("edges"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        binned = rows.join(edges, "symbol").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.round(column, 9))))
        return binned.groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias(name))

    total = lambda c: F.sum(c).over(Window.partitionBy("symbol"))
    grid = edges.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    both = grid.join(counted(train, "e"), ["symbol", "bin"], "left").join(counted(test, "a"), ["symbol", "bin"], "left").fillna(0)
    expected, actual = F.greatest(F.col("e") / total("e"), F.lit(epsilon)), F.greatest(F.col("a") / total("a"), F.lit(epsilon))
    return both.withColumn("_part", (actual - expected) * F.log(actual / expected)).groupBy("symbol").agg(F.sum("_part").alias("psi"))


def purged_folds(rows: DataFrame, folds: int = 5, purge: int = 5, embargo: int = 2) -> DataFrame:
    """``symbol, date, fold, role``: each contiguous fold as test, the rest as train without its neighbours.

    Folds have ``n // folds`` rows, the last one takes the remainder. The ``purge`` rows before a
    test and the ``embargo`` rows after it train nothing, nor does anything after the last test.
    Folds without any training row are left out.
    """
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1).withColumn(
        "_of", F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    )
    split = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    width, final, n = F.floor(F.col("_of") / folds), F.col("fold") == folds - 1, F.col("_n")
    low = F.col("fold") * width
    high = F.when(final, F.col("_of")).otherwise((F.col("fold") + 1) * width)
    role = F.when((n >= low) & (n < high), "test").when((n < low - purge) | (~final & (n >= high + embargo)), "train").otherwise("purged")
    trains = (low - purge > 0) | (~final & (high + embargo < F.col("_of")))
    return split.filter(trains & (width > 0)).select("symbol", "date", "fold", role.alias("role"))


def trade_metrics(trades: DataFrame, keys: list[str], days: int = 252, risk_free: float = 0.04) -> DataFrame:
    """Win rate, mean win and loss, profit factor and Sortino ratio of closed trades (``pnl``, ``ret``).

    A trade without profit is a loss; the profit factor's divisor is 1 at least. Sortino divides by
    the population deviation of the negative returns.
    """
    won, lost = F.col("pnl") > 0, F.col("pnl") <= 0
    excess = F.mean("ret") - risk_free / days
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.mean(won.cast("double")).alias("win_rate"),
        F.coalesce(F.mean(F.when(won, F.col("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.mean(F.when(lost, -F.col("pnl"))), F.lit(0.0)).alias("avg_loss"),
        (F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)) / F.greatest(F.abs(F.coalesce(F.sum(F.when(lost, F.col("pnl"))), F.lit(0.0))), F.lit(1.0))).alias("profit_factor"),
        F.try_divide(days**0.5 * excess, F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret")))).alias("sortino"),
    )
