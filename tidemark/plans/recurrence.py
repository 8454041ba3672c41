"""Queries of recurrence and topology; their windows are compared with plain loops in the tests, SQL would form all pairs of points of all windows."""

from __future__ import annotations

from tidemark.operators import recurrence
from tidemark.plans.catalog import query, returns
from tidemark.plans.kernels import shown


@query()
def rqa_features(spark, sf_dir):
    return shown(recurrence.recurrence(returns(spark, sf_dir)), 6)


@query()
def tda_features(spark, sf_dir):
    return shown(recurrence.topology(returns(spark, sf_dir)), 6)
