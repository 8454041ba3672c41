"""Centroid clustering against a plain Lloyd of Python integers, and against its SQL."""

import hashlib
import math
import random

import oracle
from conftest import SMALL

from tidemark.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, cluster string, key int"


def by_hand(rows, components, clusters, rounds, scale=256, seed=2):
    kept = []
    for vec_id, vector, *_ in rows:
        if vector is not None and len(vector) == components and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector]))
    draws = sorted((vec_id is None, hashlib.sha256(f"{seed}:{vec_id}".encode()).hexdigest(), centroids.packed(centroids.np.array([v]))[0], v) for vec_id, v in kept)
    found = [d[-1] for d in draws[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(found))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        found = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(found)]
    last = [(vec_id, *nearest(v)) for vec_id, v in kept]
    inertia = {}
    for _, d, j in last:
        inertia[j] = inertia.get(j, 0) + d
    whole = sum(inertia.values())
    fits = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return sorted(((i, j, fits(d), fits(inertia[j]), fits(whole), digest[j]) for i, d, j in last), key=str)


def check(spark, rows, components, clusters, rounds):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = centroids.cluster(vectors, components=components, clusters=clusters, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, components, clusters, rounds)


def test_against_plain_lloyd(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(i % 4, 0.3) for _ in range(3)], "x", 1) for i in range(200)]
    # A third of all rows share one vector, others repeat, and some ids repeat or are null.
    rows += [(1000 + i, [0.5, -0.25, 0.125], None, None) for i in range(120)]
    rows += [(i, rows[i][1], "y", 2) for i in range(30)] + [(None, [float(i), 0.0, -1.0], "z", 3) for i in range(3)]
    rows += [(5000, None, "x", 1), (5001, [1.0, None, 2.0], "x", 1), (5002, [1.0, float("nan"), 2.0], "x", 1), (5003, [float("inf"), 0.0, 0.0], "x", 1), (5004, [1.0], "x", 1), (5005, [], "x", 1)]
    check(spark, rows, 3, 7, 4)
    check(spark, rows, 3, 500, 2)
    check(spark, rows, 1, 2, 1)


def test_ties_and_empty_clusters(spark):
    # Equal vectors under many ids start several equal centroids; only the first of them fills.
    rows = [(i, [1.0, 1.0], None, None) for i in range(50)] + [(100 + i, [float(i % 2 * 2), 1.0], None, None) for i in range(10)]
    check(spark, rows, 2, 20, 3)


def test_integers_beyond_doubles(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) * 10 ** draw.choice([0, 3, 7, 9, 12, 15]) for _ in range(4)], None, None) for i in range(80)]
    rows += rows[:20] * 3
    check(spark, rows, 4, 6, 3)
    far = spark.createDataFrame([(1, [1e17, 0.0], None, None), (2, [1e300, 0.0], None, None), (3, [1.0, 0.0], None, None)], SCHEMA)
    assert [r.vec_id for r in centroids.cluster(far, components=2).collect()] == [3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, None, None)], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_matches_sql(spark):
    got = queries.QUERIES["op11_centroid_clustering"](spark, SMALL).toPandas()
    want = oracle.by_sql(queries.ORACLES["op11_centroid_clustering"], SMALL)
    assert oracle.normal(got) == oracle.normal(want) and len(got) == 500
