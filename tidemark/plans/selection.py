"""Queries of selection inside folds, interactions, group budgets and cross-validation over daily features, with SQL where no model is fitted."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import selection as S
from tidemark.plans.catalog import RETURNS, query, returns, rounded

FEATURES = ["ret", "ret_3d", "ret_5d", "day_range", "day_body", "doubled", "constant", "vol_today", "vol_change", "gap_open"]
GROUPS = S.grouped(FEATURES, {"returns": ["ret"], "shape": ["day_", "gap_"], "volume": ["vol_"]})
ALLOWED = S.budgets(GROUPS, 5)
_LAG = lambda x, k: f"lag({x}, {k}) OVER w"
DAYS = f"""{RETURNS}, days AS (
  SELECT symbol, date, CAST(lead(close) OVER w > close AS INTEGER) AS target, coalesce(round(ret, 9), 0) AS ret, coalesce(round(close / {_LAG("close", 3)} - 1, 9), 0) AS ret_3d,
         coalesce(round(close / {_LAG("close", 5)} - 1, 9), 0) AS ret_5d, round((high - low) / open, 9) AS day_range, round((close - open) / open, 9) AS day_body,
         2 * round((close - open) / open, 9) AS doubled, 1.0::DOUBLE AS constant, CAST(volume AS DOUBLE) AS vol_today, coalesce(round(volume / {_LAG("volume", 1)} - 1, 9), 0) AS vol_change,
         coalesce(round(open / {_LAG("close", 1)} - 1, 9), 0) AS gap_open
  FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def days(spark, sf_dir):
    lag = lambda x, k: F.lag(x, k).over(W.ordered())
    body = F.round(F.try_divide(F.col("close") - F.col("open"), F.col("open")), 9)
    return returns(spark, sf_dir).select(
        "symbol",
        "date",
        (F.lead("close").over(W.ordered()) > F.col("close")).cast("int").alias("target"),
        F.round("ret", 9).alias("ret"),
        *[F.round(F.try_divide(F.col("close"), lag("close", k)) - 1, 9).alias(f"ret_{k}d") for k in (3, 5)],
        F.round(F.try_divide(F.col("high") - F.col("low"), F.col("open")), 9).alias("day_range"),
        body.alias("day_body"),
        (2 * body).alias("doubled"),
        F.lit(1.0).alias("constant"),
        F.col("volume").cast("double").alias("vol_today"),
        F.round(F.try_divide(F.col("volume"), lag("volume", 1)) - 1, 9).alias("vol_change"),
        F.round(F.try_divide(F.col("open"), lag("close", 1)) - 1, 9).alias("gap_open"),
    )


_FOLDS = """dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT date FROM days)),
bounds AS (SELECT *, fold * (total // 5) AS low, CASE WHEN fold = 4 THEN total ELSE (fold + 1) * (total // 5) END AS high FROM dates, (SELECT unnest(range(5)) AS fold)),
folds AS (SELECT date, fold, CASE WHEN n >= low AND n < high THEN 'test' WHEN n >= low - 5 AND n < high + 2 THEN 'purged' ELSE 'train' END AS role FROM bounds)"""


@query(f"WITH {RETURNS}, days AS (SELECT date FROM returns), {_FOLDS} SELECT date, fold, role FROM folds")
def leak_proof_folds(spark, sf_dir):
    return S.dated_folds(returns(spark, sf_dir)).withColumn("fold", F.col("fold").cast("long"))


def _told(rows: str, keys: str) -> str:
    """The mutual information of ``value`` and ``target`` by ``keys``."""
    return f"""(SELECT {keys}, greatest(sum(CASE WHEN b1 > 0 THEN b1 / n * ln(b1 * n / (b * n1)) ELSE 0 END + CASE WHEN b > b1 THEN (b - b1) / n * ln((b - b1) * n / (b * (n - n1))) ELSE 0 END), 0) AS mi
  FROM (SELECT {keys}, bin, n, n1, count(*) AS b, CAST(sum(target) AS DOUBLE) AS b1 FROM (
    SELECT *, (rank() OVER (PARTITION BY {keys} ORDER BY value) - 1) * 10 // count(*) OVER w AS bin, CAST(count(*) OVER w AS DOUBLE) AS n, CAST(sum(target) OVER w AS DOUBLE) AS n1
    FROM {rows} WHERE target IS NOT NULL WINDOW w AS (PARTITION BY {keys})) GROUP BY ALL) GROUP BY {keys})"""


def _selected_sql() -> str:
    p = range(len(FEATURES))
    moments = ", ".join([*[f"var_pop({f}) AS v{i}" for i, f in enumerate(FEATURES)], *[f"covar_pop({FEATURES[i]}, {FEATURES[j]}) AS c{i}_{j}" for i, j in combinations(p, 2)]])
    levels, last = [], "moments"
    for j in p:
        like = " OR ".join(f"(k{i} AND abs(c{i}_{j}) > 0.95 * sqrt(v{i} * v{j}))" for i in range(j)) or "false"
        levels.append(f"level{j} AS (SELECT *, v{j} > 0.01 AND NOT ({like}) AS k{j} FROM {last})")
        last = f"level{j}"
    judged = " UNION ALL ".join(f"SELECT fold, '{f}' AS feature, {i} AS position, v{i} AS variance, v{i} > 0.01 AS varies, k{i} AS \"distinct\" FROM {last}" for i, f in enumerate(FEATURES))
    return f"""
WITH {DAYS}, {_FOLDS}, train AS (SELECT d.*, f.fold FROM days d JOIN folds f USING (date) WHERE role = 'train' AND target IS NOT NULL),
moments AS (SELECT fold, {moments} FROM train GROUP BY 1), {", ".join(levels)}, judged AS ({judged}),
long AS (SELECT fold, target, unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest([{", ".join(FEATURES)}]) AS value FROM train),
told AS {_told("long", "fold, feature")},
found AS (SELECT j.*, CASE WHEN "distinct" THEN mi END AS mi FROM judged j LEFT JOIN told USING (fold, feature))"""


_SHOWN = 'fold, feature, CAST(position AS BIGINT) AS position, round(variance, 6) AS variance, varies, "distinct", round(mi, 8) AS mi'


def _shown(found):
    return rounded(rounded(found, 6, "variance"), 8, "mi").withColumns({c: F.col(c).cast("long") for c in ("fold", "position")})


def judged(spark, sf_dir):
    rows = days(spark, sf_dir)
    train = rows.join(S.dated_folds(rows).filter("role = 'train'"), "date")
    return S.select_features(train, FEATURES, ["fold"], 5)


@query(_selected_sql() + f"""
SELECT {_SHOWN}, "distinct" AND row_number() OVER (PARTITION BY fold ORDER BY mi DESC NULLS LAST, position) <= 5 AS selected FROM found""")
def selected_in_folds(spark, sf_dir):
    return _shown(judged(spark, sf_dir))


@query(_selected_sql() + f""", placed AS (
  SELECT *, CASE {" ".join(f"WHEN feature IN ({', '.join(repr(f) for f in members)}) THEN '{g}'" for g, members in GROUPS.items())} END AS "group" FROM found)
SELECT {_SHOWN}, "group", CASE WHEN "group" = 'volume' THEN varies ELSE "distinct" AND row_number() OVER (PARTITION BY fold, "group" ORDER BY mi DESC NULLS LAST, position)
  <= CASE "group" {" ".join(f"WHEN '{g}' THEN {n}" for g, n in ALLOWED.items())} END END AS selected FROM placed""")
def selected_by_group(spark, sf_dir):
    return _shown(S.select_by_group(judged(spark, sf_dir), ["fold"], GROUPS, ALLOWED, ("volume",)))


_USED = ["ret", "day_range", "day_body", "vol_today", "gap_open"]


@query(f"""
WITH {DAYS}, single AS (SELECT target, unnest([{", ".join(f"'{f}'" for f in _USED)}]) AS feature, unnest([{", ".join(_USED)}]) AS value FROM days), own AS {_told("single", "feature")},
pairs AS (
  SELECT target, x.first, x.second, x.operation, round(CASE WHEN x.operation = 'product' THEN x.a * x.b ELSE x.a / CASE WHEN abs(x.b) > 1e-10 THEN x.b ELSE 1e-10 END END, 9) AS value
  FROM (SELECT target, unnest([{", ".join(f"{{'first': '{a}', 'second': '{b}', 'operation': '{o}', 'a': {a}, 'b': {b}}}" for a, b in combinations(sorted(_USED), 2) for o in ("product", "ratio"))}]) AS x FROM days)),
told AS {_told("pairs", "first, second, operation")}
SELECT 'ix_' || first || '_' || operation || '_' || second AS name, first, second, operation, round(t.mi, 8) AS mi, round(greatest(a.mi, b.mi), 8) AS alone
FROM told t JOIN own a ON a.feature = first JOIN own b ON b.feature = second WHERE t.mi > 1.05 * greatest(a.mi, b.mi) ORDER BY t.mi DESC, name LIMIT 20""")
def discovered_interactions(spark, sf_dir):
    return rounded(S.interactions(days(spark, sf_dir), _USED, factor=1.05), 8, "mi", "alone")


@query()
def leak_proof_validation(spark, sf_dir):
    rows = days(spark, sf_dir)
    return rounded(S.cross_validate(rows, FEATURES, S.dated_folds(rows), most=5, components=3), 6, "train_auc", "test_auc")
