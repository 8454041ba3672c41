"""Selection of features inside folds, interactions, group budgets, and a cross-validation that fits nothing on what it tests.

``rows`` has ``date``, the feature columns (missing and infinite values count as 0) and a ``target`` of 0 and 1. Features are columns, so there are tens
or hundreds of them; rows may be many. Every statistic of every fold comes from one grouped aggregation.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import amounts_below

col = F.col


def plain(x: str | Column) -> Column:
    """The value, 0 where it is missing or not finite."""
    x = (col(x) if isinstance(x, str) else x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def dated_folds(rows: DataFrame, folds: int = 5, purge: int = 5, embargo: int = 2) -> DataFrame:
    """``date, fold, role`` for each date and fold: contiguous tests, neither the ``purge`` dates before one nor the ``embargo`` after it in its training.

    All rows of a date share its role. The last fold takes the remainder; folds without a date to train on, or to test, are left out. Only distinct dates are put in order.
    """
    days = rows.select("date").distinct()
    days = days.withColumns({"_n": F.row_number().over(Window.orderBy("date")) - 1, "_of": F.count(F.lit(1)).over(Window.partitionBy())})
    split = days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    width, n = F.floor(col("_of") / folds), col("_n")
    low = col("fold") * width
    high = F.when(col("fold") == folds - 1, col("_of")).otherwise(low + width)
    role = F.when((n >= low) & (n < high), "test").when((n >= low - purge) & (n < high + embargo), "purged").otherwise("train")
    return split.filter((high > low) & ((low - purge > 0) | (high + embargo < col("_of")))).select("date", "fold", role.alias("role"))


def unpivoted(rows: DataFrame, keys: list[str], features: list[str], target: str = "target") -> DataFrame:
    """``keys, target, feature, position, value``, a row for each feature of a row."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), plain(f).alias("value")) for i, f in enumerate(features)])
    return rows.filter(col(target).isNotNull()).select(*keys, col(target).cast("int").alias("target"), F.inline(each))


def mutual_information(long: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``keys, mi``: what ``value``, in ``bins`` of equally many rows, tells of the ``target``, in nats.

    Equal values share a bin, that of the first of them. Values are counted first, and ranks come from ranges of values, so no task
    orders all rows of a feature; a value that a third of the rows have is one row by then.
    """
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_all"), F.sum("target").alias("_ones"))
    totals = counts.groupBy(*keys).agg(F.sum("_all").alias("_n"), F.sum("_ones").alias("_n1"))
    placed = amounts_below(counts, keys, "value", "_all", "_below").join(totals, keys)
    binned = placed.groupBy(*keys, "_n", "_n1", F.floor(col("_below") * bins / col("_n")).alias("_bin")).agg(F.sum("_all").alias("_b"), F.sum("_ones").alias("_b1"))

    def term(both: Column, side: Column) -> Column:
        return F.when(both > 0, both / col("_n") * F.log(both * col("_n") / (col("_b") * side))).otherwise(0.0)

    part = term(col("_b1"), col("_n1")) + term(col("_b") - col("_b1"), col("_n") - col("_n1"))
    return binned.groupBy(*keys).agg(F.greatest(F.sum(part), F.lit(0.0)).alias("mi"))


def select_features(rows: DataFrame, features: list[str], keys: list[str], most: int = 30, variance: float = 0.01, correlation: float = 0.95, bins: int = 10) -> DataFrame:
    """``keys, feature, position, variance, varies, distinct, mi, selected`` for each group of training rows (``keys``, such as the fold).

    A feature must vary by more than ``variance``, correlate with no earlier feature that stays by more than ``correlation``, and be among the ``most`` with
    the most mutual information (ties: the earlier). ``mi`` is null for those that fell before.
    """
    usable = rows.filter(col("target").isNotNull())
    value = [plain(f) for f in features]
    pairs = list(combinations(range(len(features)), 2))
    moments = usable.groupBy(*keys).agg(
        *[F.var_pop(x).alias(f"_v{i}") for i, x in enumerate(value)], *[F.covar_pop(value[i], value[j]).alias(f"_c{i}_{j}") for i, j in pairs]
    )
    for j in range(len(features)):
        like = F.lit(False)
        for i in range(j):
            like = like | (col(f"_k{i}") & (F.abs(col(f"_c{i}_{j}")) > correlation * F.sqrt(col(f"_v{i}") * col(f"_v{j}"))))
        moments = moments.withColumn(f"_k{j}", (col(f"_v{j}") > variance) & ~like)
    each = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), col(f"_v{i}").alias("variance"), (col(f"_v{i}") > variance).alias("varies"), col(f"_k{i}").alias("distinct")) for i, f in enumerate(features)]
    judged = moments.select(*keys, F.inline(F.array(*each)))
    stay = judged.filter("distinct").select(*keys, "feature")
    told = mutual_information(unpivoted(usable, keys, features).join(stay, [*keys, "feature"]), [*keys, "feature"], bins)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("mi"), "position"))
    return judged.join(told, [*keys, "feature"], "left").withColumn("selected", col("distinct") & (place <= most))


def combined(a: str, b: str, operation: str) -> Column:
    """Two features as a ``product`` or a ``ratio``; a divisor closer to 0 than 1e-10 is 1e-10."""
    x, y = plain(a), plain(b)
    if operation == "product":
        return plain(x * y)
    if operation == "ratio":
        return plain(x / F.when(F.abs(y) > 1e-10, y).otherwise(1e-10))
    raise ValueError(f"unknown operation {operation!r}")


def named(a: str, b: str, operation: str) -> str:
    return f"ix_{a[:30]}_{operation}_{b[:30]}"


def interactions(rows: DataFrame, features: list[str], top: int = 15, factor: float = 1.5, most: int = 20, operations: tuple[str, ...] = ("product", "ratio"), bins: int = 10, digits: int = 9) -> DataFrame:
    """``name, first, second, operation, mi, alone``: combinations of two of the ``top`` features that tell more than ``factor`` times what either tells alone.

    The ``most`` of them that tell most; ties go by name. All features are taken if there are five or fewer. Which features are on top is a table of at most ``top``
    names, read before the combinations are planned. Values are compared at ``digits`` decimals.
    """
    rounded = rows.select("target", *[F.round(plain(f), digits).alias(f) for f in features])
    own = mutual_information(unpivoted(rounded, [], features), ["feature"], bins)
    best = own.orderBy(F.desc("mi"), "feature").limit(len(features) if len(features) <= 5 else top)
    chosen = sorted(r["feature"] for r in best.select("feature").collect())
    tried = [(a, b, o) for a, b in combinations(chosen, 2) for o in operations]
    schema = "name string, first string, second string, operation string, mi double, alone double"
    if not tried:
        return rows.sparkSession.createDataFrame([], schema)
    each = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(o).alias("operation"), F.round(combined(a, b, o), digits).alias("value")) for a, b, o in tried])
    long = rounded.filter("target IS NOT NULL").select(col("target").cast("int").alias("target"), F.inline(each))
    told = mutual_information(long, ["first", "second", "operation"], bins)
    for side in ("first", "second"):
        told = told.join(own.select(col("feature").alias(side), col("mi").alias(f"_{side}")), side)
    name = F.concat(F.lit("ix_"), F.substring("first", 1, 30), F.lit("_"), "operation", F.lit("_"), F.substring("second", 1, 30))
    found = told.withColumns({"name": name, "alone": F.greatest("_first", "_second")}).filter(col("mi") > factor * col("alone"))
    return found.orderBy(F.desc("mi"), "name").limit(most).select("name", "first", "second", "operation", "mi", "alone")


def with_interactions(rows: DataFrame, found: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` with a column for each (first, second, operation) whose two columns are there."""
    return rows.withColumns({named(a, b, o): combined(a, b, o) for a, b, o in found if a in rows.columns and b in rows.columns})


def grouped(features: list[str], prefixes: dict[str, list[str]]) -> dict[str, list[str]]:
    """The features of each group, the first one with a prefix of theirs; those without are ``other``. Empty groups are left out."""
    found: dict[str, list[str]] = {}
    for feature in features:
        group = next((g for g, starts in prefixes.items() if feature.startswith(tuple(starts))), "other")
        found.setdefault(group, []).append(feature)
    return found


def budgets(groups: dict[str, list[str]], total: int, least: int = 1, mode: str = "proportional") -> dict[str, int]:
    """How many features each group may keep of ``total``: by its size, or ``equal``, and never fewer than ``least``."""
    if mode not in ("proportional", "equal"):
        raise ValueError(f"unknown mode {mode!r}")
    count = sum(map(len, groups.values()))
    share = lambda members: total // len(groups) if mode == "equal" else round(total * len(members) / count)
    return {group: max(least, share(members)) for group, members in groups.items()}


def select_by_group(judged: DataFrame, keys: list[str], groups: dict[str, list[str]], allowed: dict[str, int], protected: tuple[str, ...] = ()) -> DataFrame:
    """``judged`` (of ``select_features``) with ``group``, and ``selected`` anew: all that vary of ``protected`` groups, of others the best within their budget.

    The groups of the features, a row for each column, are part of the plan.
    """
    of = F.create_map(*[F.lit(x) for g, members in groups.items() for f in members for x in (f, g)])
    limit = F.create_map(*[F.lit(x) for g, n in allowed.items() for x in (g, n)])
    rows = judged.withColumn("group", F.element_at(of, col("feature")))
    place = F.row_number().over(Window.partitionBy(*keys, "group").orderBy(F.desc_nulls_last("mi"), "position"))
    kept = F.when(col("group").isin(*protected), col("varies")).otherwise(col("distinct") & (place <= F.element_at(limit, col("group"))))
    return rows.withColumn("selected", kept)


def cross_validate(rows: DataFrame, features: list[str], folds: DataFrame, most: int = 30, components: int = 20, strength: float = 1.0) -> DataFrame:
    """``fold, n_train, n_test, n_selected, n_components, train_auc, test_auc``: selection, scaling, principal components and a logistic regression, all fitted on training rows only.

    ``folds`` is ``date, fold, role``. ``strength`` is the inverse of the ridge penalty. Selection of all folds is one job, then each fold's model is fitted in turn on the cluster.
    A fold without two classes or without a feature to use has AUC 0.5. Scores are compared by their ranks, ties count half.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    usable = rows.filter(col("target").isNotNull()).select("date", col("target").cast("double").alias("target"), *[plain(f).alias(f) for f in features])
    # Every fold reads these rows several times; blocks that do not fit in memory go to disk, lost ones are computed again.
    dealt = usable.join(folds.filter("role <> 'purged'"), "date").persist()
    judged = select_features(dealt.filter("role = 'train'"), features, ["fold"], most)
    # One row for each fold and feature.
    chosen: dict[int, list[tuple[int, str]]] = {}
    for r in judged.filter("selected").select("fold", "position", "feature").collect():
        chosen.setdefault(r["fold"], []).append((r["position"], r["feature"]))
    sizes = dealt.groupBy("fold").agg(
        *[F.count_if(col("role") == r).alias(f"n_{r}") for r in ("train", "test")], *[F.count_distinct(F.when(col("role") == r, col("target"))).alias(f"_{r}") for r in ("train", "test")]
    ).orderBy("fold").collect()
    scored, summary = None, []
    for size in sizes:
        inputs = [f for _, f in sorted(chosen.get(size["fold"], []))]
        k = min(components, len(inputs))
        summary.append((size["fold"], size["n_train"], size["n_test"], len(inputs), k))
        if not inputs or size["_train"] < 2:
            continue
        train = dealt.filter((col("fold") == size["fold"]) & (col("role") == "train"))
        stages = [
            VectorAssembler(inputCols=inputs, outputCol="_x"),
            StandardScaler(inputCol="_x", outputCol="_s", withMean=True),
            PCA(k=k, inputCol="_s", outputCol="_p"),
            StandardScaler(inputCol="_p", outputCol="_z", withMean=True),
            LogisticRegression(featuresCol="_z", labelCol="target", regParam=1 / (strength * size["n_train"]), standardization=False, probabilityCol="_probability"),
        ]
        model = Pipeline(stages=stages).fit(train)
        found = model.transform(dealt.filter(col("fold") == size["fold"])).select("fold", "role", col("target").cast("int").alias("target"), vector_to_array("_probability")[1].alias("score"))
        scored = found if scored is None else scored.unionByName(found)
    out = rows.sparkSession.createDataFrame(summary, "fold int, n_train long, n_test long, n_selected int, n_components int")
    if scored is None:
        return out.withColumns({"train_auc": F.lit(0.5), "test_auc": F.lit(0.5)})
    areas = area_under(scored, ["fold", "role"]).groupBy("fold").agg(*[F.max(F.when(col("role") == r, col("auc"))).alias(f"{r}_auc") for r in ("train", "test")])
    return out.join(areas, "fold", "left").fillna(0.5, ["train_auc", "test_auc"])


def area_under(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, auc``: how often a row of ``target`` 1 has the higher ``score`` than one of 0, ties counting half; 0.5 with one class."""
    counts = scored.groupBy(*keys, "score").agg(F.sum("target").alias("_ones"), F.sum(1 - col("target")).alias("_zeros"))
    below = amounts_below(counts, keys, "score", "_zeros", "_below")
    found = below.groupBy(*keys).agg(F.sum(col("_ones") * (col("_below") + col("_zeros") / 2)).alias("_won"), (F.sum("_ones") * F.sum("_zeros")).alias("_pairs"))
    return found.select(*keys, F.coalesce(F.try_divide(col("_won"), col("_pairs")), F.lit(0.5)).alias("auc"))
