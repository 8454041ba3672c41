"""Model validation and backtest summaries: overfitting, tiers, scores, drift, attribution, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.quantiles import computed, cuts_of, exact_quantiles, range_of


def overfitting(splits: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the out-of-sample results (``score``) of each strategy's splits that lie below their median; 0 for one split."""
    median = splits.groupBy(*keys).agg(F.median("score").alias("_median"), F.count(F.lit(1)).alias("n_splits"))
    below = F.mean((F.col("score") < F.col("_median")).cast("double"))
    found = splits.join(median, keys).groupBy(*keys, "n_splits").agg(below.alias("pbo"))
    return found.withColumn("pbo", F.when(F.col("n_splits") > 1, F.col("pbo")).otherwise(0.0))


def walk_forward_splits(rows: DataFrame, splits: int = 5, train: int = 252, test: int = 21, purge: int = 5, embargo: int = 2) -> DataFrame:
    """``symbol, date, split, role``: tests from the newest dates back, each with the training dates before it.

    Split ``s`` tests ``test`` dates that end ``s * (test + embargo)`` dates before the last, and
    trains on the ``train + 20 * s`` dates that end ``purge`` dates before the test. With too few
    dates there are fewer splits, two at least; a split with fewer than ``train`` training rows is left out.
    """
    whole = Window.partitionBy("symbol")
    placed = rows.select("symbol", "date", (F.dense_rank().over(W.ordered()) - 1).alias("at")).withColumn("n", F.max("at").over(whole) + 1)
    room = F.col("n") - splits * test - splits * (purge + embargo)
    fewer = F.greatest(F.lit(2), F.floor((F.col("n") - train) / (test + purge + embargo)))
    count = F.when(room < train, fewer).otherwise(splits)
    dealt = placed.withColumn("split", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    test_from = F.col("n") - F.col("split") * (test + embargo) - test
    train_to = test_from - purge
    train_from = F.greatest(F.lit(0), train_to - (train + F.col("split") * 20))
    at = F.col("at")
    role = F.when((at >= test_from) & (at < test_from + test), "test").when((at >= train_from) & (at < train_to), "train")
    found = dealt.filter(train_to > train_from).withColumn("role", role).filter("role IS NOT NULL")
    each = Window.partitionBy("symbol", "split")
    n_train, n_test = F.count_if(F.col("role") == "train").over(each), F.count_if(F.col("role") == "test").over(each)
    return (
        found.withColumns({"n_train": n_train, "n_test": n_test})
        .filter((F.col("n_train") >= train) & (F.col("n_test") > 0))
        .select("symbol", "date", F.col("split").cast("long").alias("split"), "role")
    )


def tier(stability: Column, fragility: Column, auc: Column, suite: Column | None = None, least_suite: float = 0.5) -> Column:
    """1, 2 from a stability of 0.60 on, 3 if also fragility is below 0.40, the AUC 0.57 at least and the suite passes."""
    solid = (fragility < 0.40) & (auc >= 0.57)
    solid = solid if suite is None else solid & (suite.isNull() | (suite >= least_suite))
    return F.when(~F.coalesce(stability >= 0.60, F.lit(False)), 1).when(F.coalesce(solid, F.lit(False)), 3).otherwise(2).cast("long")


# Weights of the composite score.
SCORE_WEIGHTS = {"win_rate": 0.25, "robustness": 0.20, "profit_potential": 0.15, "noise_tolerance": 0.15, "plateau_stability": 0.15, "complexity_penalty": 0.10}


def composite_score(trades: DataFrame, folds: DataFrame, models: DataFrame) -> DataFrame:
    """The weighted evaluation score of each ``model`` with its components.

    ``trades`` has ``model, bought, ret``, ``folds`` ``model, score, noisy`` (null where not tested),
    ``models`` ``model, n_features, sensitivity``.
    """
    bought = trades.filter("bought").groupBy("model").agg(
        F.mean((F.col("ret") > 0).cast("double")).alias("wins"),
        F.coalesce(F.mean(F.when(F.col("ret") > 0, F.col("ret"))), F.lit(0.0)).alias("win"),
        F.coalesce(F.abs(F.mean(F.when(F.col("ret") < 0, F.col("ret")))), F.lit(0.001)).alias("loss"),
        F.mean("ret").alias("mean"),
        F.stddev_pop("ret").alias("std"),
    )
    cv = folds.groupBy("model").agg(F.mean("score").alias("cv"), F.stddev_pop("score").alias("cv_std"), F.mean("noisy").alias("noisy"))
    rows = models.join(bought, "model", "left").join(cv, "model")
    col = F.col
    factor = F.when(col("loss") > 0, col("win") / col("loss")).otherwise(1.0)
    sharpe = W.clip(col("mean") / (col("std") + 1e-6), -3.0, 3.0)
    parts = {
        "win_rate": F.coalesce(F.least("wins", F.lit(0.75)) / 0.75 + F.lit(0.0) * col("wins"), F.lit(0.5)),
        "robustness": col("cv") * (1 - F.least(col("cv_std") / (col("cv") + 1e-6), F.lit(0.5))),
        "profit_potential": F.coalesce(W.clip(factor * 0.3 + sharpe * 0.7, 0.0, 1.0), F.lit(0.0)),
        "noise_tolerance": F.when(col("noisy").isNull(), 0.5).otherwise(F.greatest(1 - (col("cv") - col("noisy")) / (col("cv") + 1e-6), F.lit(0.0))),
        "plateau_stability": 1 - F.least("sensitivity", F.lit(1.0)),
        "complexity_penalty": F.when(col("n_features") <= 30, 1.0).otherwise(F.greatest(1 - (col("n_features") - 30) / 100, F.lit(0.5))),
    }
    total = sum((weight * F.col(name) for name, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    return rows.withColumns(parts).withColumn("wmes", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).select("model", *parts, "wmes")


#: Parts that the order of the ties is cut into, and the sample that places the cuts.
PARTS, SAMPLE = 1024, 10_000
#: Rows of a table that may travel to all tasks.
SMALL_ROWS = 500_000


def _sums_before(counts: DataFrame, keys: list[str], order: list[str], amounts: list[str]) -> DataFrame:
    """Replaces each of ``amounts`` by its sum over the rows of a key that come earlier by ``_range`` and, inside it, by ``order``."""
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "_range").agg(*[F.sum(a).alias(a) for a in amounts])
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_start{a}") for a in amounts])
    own = counts.withColumns({a: F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts}).join(F.broadcast(starts), [*keys, "_range"])
    return own.withColumns({a: F.col(a) + F.col(f"_start{a}") for a in amounts}).drop(*[f"_start{a}" for a in amounts])


def ordinal_rank_correlations(rows: DataFrame, features: list[str], target: str, keys: list[str], ties: list[str]) -> DataFrame:
    """Spearman's correlation of each of ``features`` (as doubles) with ``target`` from ordinal ranks: ``keys, feature, n, r``; 0 for fewer than three rows.

    Equal values rank by ``ties`` (nulls last), then by the features and the target; ``keys`` have few values. The first of ``ties``
    is a number that cuts the rows into parts of about equal size. Rows are dealt once, by part; twice where the target has many
    values. A row's rank is the number of rows with smaller values, of those with its value in earlier parts, and of those up to it in
    its own part; the first two are the same for a part's rows of one value. So the products of the ranks are summed by part and
    value, and only these sums are dealt by ranges of the value and put in order.
    """
    places = range(len(features))
    given = rows.select(*keys, *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)], F.col(target).alias("_y"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(features)])
    given = given.filter(F.col("_y").isNotNull())
    sizes = F.array(*[F.count(f"_x{i}") for i in places])
    # Of a key, one row or one for each range is broadcast; the offsets below only where they are few.
    about = computed(
        given.groupBy(*keys).agg(
            cuts_of("_tie0", PARTS, SAMPLE).alias("_parts"),
            sizes.alias("_sizes"),
            F.approx_count_distinct("_y").alias("_kinds"),
            cuts_of("_y").alias("_y_cuts"),
            F.array(*[cuts_of(f"_x{i}") for i in places]).alias("_x_cuts"),
        )
    )
    placed = given.join(F.broadcast(about.select(*keys, "_parts")), keys).withColumn("_part", range_of("_tie0", "_parts", PARTS, nulls_last=True)).drop("_parts")

    # The target's rank among the rows that have the feature, for each feature.
    below = [f"_b{i}" for i in places]
    counts = placed.groupBy(*keys, "_part", "_y").agg(*[F.count(f"_x{i}").alias(b) for i, b in enumerate(below)])
    ranged = counts.join(F.broadcast(about.select(*keys, "_y_cuts")), keys).withColumn("_range", range_of("_y", "_y_cuts")).drop("_y_cuts")
    offsets = _sums_before(ranged, keys, ["_y", "_part"], below).drop("_range")
    cell = [*keys, "_part"]
    # By number, as tasks put together to the usual size would not hold the rows of all features in memory.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if (about.agg(F.sum("_kinds")).first()[0] or 0) * PARTS <= SMALL_ROWS:
        joined = placed.repartition(tasks, *cell).join(F.broadcast(offsets), [*cell, "_y"])
    else:
        joined = placed.join(offsets, [*cell, "_y"]).repartition(tasks, *cell)
    # Rows that agree in all of these are interchangeable, so reruns agree.
    order = [*[F.asc_nulls_last(f"_tie{i}") for i in range(len(ties))], *[f"_x{i}" for i in places], "_y"]
    numbered = joined.withColumn("_at", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).drop(*[f"_tie{i}" for i in range(len(ties))])
    so_far = Window.partitionBy(*cell, "_y").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = numbered.withColumns({b: F.col(b) + F.count(f"_x{i}").over(so_far) for i, b in enumerate(below)})

    # From here on one row for each row and feature, in the tasks where the rows are; ranks of the target count from their mean.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"_x{i}").cast("double").alias("_x"), F.col(b).alias("_b")) for i, b in enumerate(below)])).alias("_e")
    long = ranked.select(*cell, "_at", each).select("*", "_e.*").drop("_e").filter(F.col("_x").isNotNull())
    long = long.join(F.broadcast(about.select(*keys, "_sizes")), keys).withColumn("_b", F.col("_b") - (F.get("_sizes", F.col("_f")) + 1) / 2).drop("_sizes")
    long = long.withColumn("_own", F.row_number().over(Window.partitionBy(*cell, "_f", "_x").orderBy("_at")))
    summed = long.groupBy(*cell, "_f", "_x").agg(F.count(F.lit(1)).alias("_c"), F.sum("_b").alias("_s"), F.sum(F.col("_own") * F.col("_b")).alias("_p"))
    summed = summed.join(F.broadcast(about.select(*keys, "_x_cuts")), keys).withColumn("_cuts", F.get("_x_cuts", F.col("_f"))).withColumn("_range", range_of("_x", "_cuts")).drop("_x_cuts", "_cuts")
    inside = Window.partitionBy(*keys, "_f", "_range").orderBy("_x", "_part").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_c").over(inside), F.lit(0))
    by_range = summed.withColumn("_p", F.col("_p") + within * F.col("_s")).groupBy(*keys, "_f", "_range").agg(*[F.sum(c).alias(c) for c in ("_c", "_s", "_p")])
    before = Window.partitionBy(*keys, "_f").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.withColumn("_p", F.col("_p") + F.coalesce(F.sum("_c").over(before), F.lit(0)) * F.col("_s"))
    found = by_range.groupBy(*keys, "_f").agg(F.sum("_c").alias("n"), F.sum("_s").alias("_s"), F.sum("_p").alias("_p"))
    n = F.col("n").cast("double")
    r = F.when(n >= 3, (F.col("_p") - (n + 1) / 2 * F.col("_s")) / (n * (n * n - 1) / 12)).otherwise(0.0)
    return found.select(*keys, F.get(F.array(*map(F.lit, features)), F.col("_f")).alias("feature"), "n", r.alias("r"))


def concept_drift(baseline: DataFrame, current: DataFrame, feature: str = "feature") -> DataFrame:
    """Fisher's z test of each feature's rank correlation with the target (``n, r``) now against the baseline, with severity over all features."""
    bound = lambda r: F.greatest(F.lit(-0.999), F.least(F.lit(0.999), r))
    a = baseline.select(feature, F.col("n").alias("n_base"), F.col("r").alias("baseline"))
    b = current.select(feature, F.col("n").alias("n_new"), F.col("r").alias("current"))
    spread = F.sqrt(1 / F.greatest(F.col("n_base") - 3, F.lit(1)) + 1 / F.greatest(F.col("n_new") - 3, F.lit(1)))
    z = (F.atanh(bound(F.col("baseline"))) - F.atanh(bound(F.col("current")))) / spread
    rows = a.join(b, feature).withColumn("z", z).withColumn("significant", F.abs("z") > 1.96)
    # One row for each feature; a window without a key over them.
    share = F.mean(F.col("significant").cast("double")).over(Window.partitionBy(F.lit(0)))
    severity = F.when(F.col("drift_score") < 0.05, "NONE").when(F.col("drift_score") < 0.20, "MILD").when(F.col("drift_score") < 0.40, "MODERATE").otherwise("SEVERE")
    return rows.withColumn("drift_score", share).select(
        feature, "baseline", "current", (F.col("current") - F.col("baseline")).alias("change"), "z", "significant", "drift_score", severity.alias("severity")
    )


def _binned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``feature``, the number of its rows in each bin, and its lowest and highest value; one aggregation by bin, then one by feature.

    The edges, one row for each feature, travel to the rows.
    """
    value = F.round("value", 9)
    place = F.greatest(F.least(F.size(F.filter("edges", lambda e: e <= value)), F.size("edges") - 1), F.lit(1))
    inside = (value >= F.element_at("edges", 1)) & (value <= F.element_at("edges", -1))
    placed = rows.filter("value IS NOT NULL").join(F.broadcast(edges.select("feature", "edges")), "feature").withColumn("bin", F.when(inside, place))
    counted = placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    each = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("bins")
    return counted.groupBy("feature").agg(each, F.min("low").alias("low"), F.max("high").alias("high"))


def drift_baseline(train: DataFrame, bins: int = 10) -> DataFrame:
    """``feature, edges, bins`` of training rows (``feature, value``): quantile edges, equal ones once, and the rows in each bin; one row for each feature."""
    shares = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(train, ["feature"], "value", shares, "edges").withColumn("edges", F.array_distinct(F.transform("edges", lambda e: F.round(e, 9))))
    return edges.join(_binned(train, edges).select("feature", "bins"), "feature")


def drift_against(baseline: DataFrame, live: DataFrame, threshold: float = 0.2, epsilon: float = 1e-6) -> DataFrame:
    """PSI of each ``feature``'s live ``value`` in the baseline's bins, with the share of drifted features and its severity.

    Values outside the training range are left out of both shares. A
    feature that was constant has PSI 0 while it stays so, and infinity otherwise or without live rows.
    """
    found = _binned(live, baseline).withColumnRenamed("bins", "live_bins")

    def part(i: Column) -> Column:
        def share(counts: str) -> Column:
            here, total = F.try_element_at(counts, i), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda s, n: s + n)
            return F.greatest(F.coalesce(F.try_divide(here, total), F.lit(0.0)), F.lit(epsilon))

        e, a = share("bins"), share("live_bins")
        return (a - e) * F.log(a / e)

    varied = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("edges") - 1), part), F.lit(0.0), lambda s, x: s + x)
    constant, infinite = F.element_at("edges", 1), F.lit(float("inf"))
    psi = (
        F.when(F.col("low").isNull(), F.when(F.size("edges") > 1, infinite).otherwise(0.0))
        .when(F.size("edges") > 1, varied)
        .when((F.col("low") == constant) & (F.col("high") == constant), 0.0)
        .otherwise(infinite)
    )
    judged = baseline.join(found, "feature", "left").select("feature", psi.alias("psi")).withColumn("drifted", F.col("psi") > threshold)
    # One row for each feature; a window without a key over them.
    fraction = F.mean(F.col("drifted").cast("double")).over(Window.partitionBy(F.lit(0)))
    severity = F.when(F.col("drift_fraction") > 0.2, "significant").when(F.col("drift_fraction") > 0.1, "moderate").otherwise("none")
    return judged.withColumn("drift_fraction", fraction).withColumn("severity", severity)


def drift_monitor(train: DataFrame, live: DataFrame, bins: int = 10, threshold: float = 0.2, epsilon: float = 1e-6) -> DataFrame:
    """Live rows against the baseline of training rows."""
    return drift_against(drift_baseline(train, bins), live, threshold, epsilon)


def regime_of_trades(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``regime``: BULL or BEAR where the mean of the last 20 trade returns exceeds their deviation, else SIDEWAYS."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-19, 0)
    enough = F.count("ret").over(frame) >= 5
    rows = trades.withColumns({"_mean": F.when(enough, F.mean("ret").over(frame)), "_std": F.when(enough, F.stddev_samp("ret").over(frame))})
    regime = F.when(F.col("_mean") > F.col("_std"), "BULL").when(F.col("_mean") < -F.col("_std"), "BEAR").otherwise("SIDEWAYS")
    return rows.withColumn("regime", regime).drop("_mean", "_std")


def regime_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Count, win rate, mean return, profit and Sharpe ratio (population deviation) of the trades of each regime."""
    return trades.groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.mean((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.mean("ret").alias("avg_return"),
        F.sum("pnl").alias("total_pnl"),
        (F.mean("ret") / (F.stddev_pop("ret") + 1e-8) * 252**0.5).alias("sharpe"),
    )


#: Drawn trades that one step of the bootstrap puts in order.
SPAN = 4096


def _numbered(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Trades with their number ``_i`` (from 1) in each key: by counts of the first column of ``order``, then by place within it."""
    group = [*keys, order[0]]
    before = Window.partitionBy(*keys).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    starts = trades.groupBy(*group).agg(F.count(F.lit(1)).alias("_in")).withColumn("_start", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*(order[1:] or [order[0]])))
    return trades.withColumn("_i", place).join(starts, group).withColumn("_i", F.col("_i") + F.col("_start")).drop("_start")


def bootstrap(trades: DataFrame, keys: list[str], order: list[str], simulations: int = 200, capital: float = 100_000.0, seed: int = 7) -> DataFrame:
    """Percentiles of the final equity and worst drawdown of resampled trade sequences.

    Place ``i`` of simulation ``s`` takes the trade whose number is a hash of both, so reruns agree.
    Each simulation's places are cut into spans of ``SPAN``; a drawn place is joined with its trade by number, a span is
    summed up by its total, highest and deepest point of the running logarithms, and the few spans of a simulation are put together. No task
    holds a key's trades. A trade that loses everything ends its sequence at 0.
    """
    numbered = _numbered(trades, keys, order)
    sizes = numbered.groupBy(*keys).agg(F.max("_i").alias("_n"))
    spans = F.floor((F.col("_n") + SPAN - 1) / SPAN)
    dealt = sizes.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(simulations)))).withColumn("_span", F.explode(F.sequence(F.lit(0).cast("long"), spans - 1)))
    first = F.col("_span") * SPAN + 1
    places = dealt.repartition(*keys, "sim", "_span").withColumn("_at", F.explode(F.sequence(first, F.least(first + SPAN - 1, F.col("_n")))))
    drawn = places.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), F.col("sim"), F.col("_at").cast("int")), F.col("_n")) + 1)
    found = drawn.join(numbered.select(*keys, "_i", F.greatest(F.coalesce("ret", F.lit(0.0)), F.lit(-1.0)).alias("ret")), [*keys, "_i"])
    # The logarithm of losing everything is taken as one that no gain undoes.
    step = F.when(F.col("ret") <= -1, -1e6).otherwise(F.log1p("ret"))
    inside = Window.partitionBy(*keys, "sim", "_span").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    path = found.withColumn("_path", F.sum(step).over(inside)).withColumn("_fall", F.col("_path") - F.greatest(F.max("_path").over(inside), F.lit(0.0)))
    spanned = path.groupBy(*keys, "sim", "_span").agg(F.max_by("_path", "_at").alias("_total"), F.max("_path").alias("_high"), F.min("_path").alias("_low"), F.min("_fall").alias("_fall"))
    earlier = Window.partitionBy(*keys, "sim").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    begun = spanned.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    begun = begun.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_start") + F.col("_high")).over(earlier), F.lit(0.0)), F.lit(0.0)))
    worst = F.least(F.col("_fall"), F.col("_start") + F.col("_low") - F.col("_peak"))
    ended = begun.groupBy(*keys, "sim").agg((F.exp(F.sum("_total")) * capital).alias("equity"), (1 - F.exp(F.min(worst))).alias("worst"))
    q = lambda c, p: F.percentile(c, p)
    return ended.groupBy(*keys).agg(
        q("equity", 0.5).alias("median_equity"),
        F.mean("equity").alias("mean_equity"),
        q("equity", 0.025).alias("equity_ci_lower"),
        q("equity", 0.975).alias("equity_ci_upper"),
        q("equity", 0.05).alias("worst_case_equity"),
        q("equity", 0.95).alias("best_case_equity"),
        q("worst", 0.5).alias("median_max_dd"),
        q("worst", 0.95).alias("dd_ci_upper"),
        F.mean((F.col("equity") > capital).cast("double")).alias("prob_profit"),
        F.mean((F.col("equity") > 2 * capital).cast("double")).alias("prob_double"),
        F.mean((F.col("equity") < capital / 2).cast("double")).alias("prob_lose_50pct"),
    )


def walk_forward_summary(windows: DataFrame, days: DataFrame) -> DataFrame:
    """One row over all windows (``total_return_pct, sharpe, win_rate, n_trades``) and their daily returns."""
    over = days.agg((252**0.5 * F.mean("ret") / (F.stddev_pop("ret") + 1e-8)).alias("x")).scalar()
    found = windows.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("total_return_pct").alias("total_return_pct"),
        F.mean("total_return_pct").alias("avg_window_return_pct"),
        F.mean("sharpe").alias("avg_sharpe"),
        F.stddev_pop("sharpe").alias("std_sharpe"),
        F.min("total_return_pct").alias("worst_window_return"),
        F.max("total_return_pct").alias("best_window_return"),
        F.mean(F.when(F.col("n_trades") > 0, F.col("win_rate"))).alias("avg_win_rate"),
        F.sum("n_trades").alias("total_trades"),
    )
    return found.withColumn("overall_sharpe", F.coalesce(over, F.lit(0.0)))


def attribution(trades: DataFrame, order: list[str], last: int = 50) -> DataFrame:
    """Win rate and mean profit of the ``last`` trades, over all (``regime`` null) and by regime."""
    recent = trades.orderBy(*[F.desc(c) for c in order]).limit(last)
    return recent.cube("regime").agg(
        F.grouping("regime").cast("boolean").alias("overall"),
        F.count(F.lit(1)).alias("n_trades"),
        F.mean((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.mean("pnl").alias("avg_pnl"),
    )


def matched_fills(expected: DataFrame, fills: DataFrame) -> DataFrame:
    """The first fill of each expected order with its slippage in basis points; later fills find nothing left.

    A long fill is favourable at or below the expected price, a short one at or above it.
    """
    best = lambda c: F.min_by(c, F.struct("filled_at", "actual")).alias(c)
    first = fills.groupBy("order_id").agg(best("actual"), F.min("filled_at").alias("filled_at"))
    slip = F.when(F.col("expected") == 0, 0.0).otherwise((F.col("actual") - F.col("expected")) / F.col("expected") * 10000)
    good = F.when(F.col("direction") == "LONG", F.col("slip") <= 0).otherwise(F.col("slip") >= 0)
    return expected.withColumn("direction", F.upper("direction")).join(first, "order_id").withColumn("slip", slip).select(
        "order_id", "direction", "expected", "actual", F.round("slip", 2).alias("slippage_bps"), good.alias("favorable"), "filled_at"
    )


def last_per_key(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The newest ``n`` rows of each key, as a bounded log keeps them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def pareto_front(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The rows of each key that no other beats in one of ``x, y`` without losing in the other (more is better).

    In falling order of ``x`` a row is on the front if its ``y`` is that group's best and above all
    before it; a running maximum over distinct ``x`` decides, so no pairs are formed.
    """
    best = rows.groupBy(*keys, x).agg(F.max(y).alias("_best"))
    before = Window.partitionBy(*keys).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    edge = best.withColumn("_above", F.max("_best").over(before)).filter("_above IS NULL OR _best > _above").select(*keys, x, F.col("_best").alias(y))
    return rows.join(edge, [*keys, x, y], "left_semi")
