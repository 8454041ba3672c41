"""Centroid clustering of quantised vectors by weighted deduplication.

Components become integers, floor(scale * x). Identical integer vectors are grouped first, by their
exact bytes, into distinct ones with multiplicities; Lloyd's rounds then run on distinct vectors
only, each weighing what it stands for. A task sums its rows into one integer vector for each
centroid; the tasks' sums are added by Spark, and ``clusters`` rows of them come to the driver. At
the end the distinct vectors' assignments are joined back to the ids: vectors that stand for more
than a thousandth of all rows (fewer than a thousand of them) by broadcast, so that a vector which
a third of all rows share is never one task's, the others by shuffle.

All arithmetic is on integers: 64-bit or double matrices where every intermediate value fits them
exactly, Python integers otherwise. Centroids start at the rows with the smallest
SHA-256 of ``<seed>:<id>``, move to the floor of their vectors' mean, and stay where they are empty.

Defined cases: vectors that are null, have another number of components, or hold a null or
non-finite one take no part; nor do those with a component whose integer passes 2**62 in size. Rows
with a null id are assigned like others and start a centroid only if all rows with ids already do;
repeated rows count each, and rows with equal ids start centroids in the order of their packed bytes.
With fewer rows than clusters each row starts one. Ties go to the smaller number. A
distance or inertia beyond 63 bits is null. An empty table gives an empty result. Only
the id and vector columns are read; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: A vector that more than one row in this many shares is joined by broadcast.
HOT_SHARE = 1000
MOST = 1 << 62
WIDTHS = ("<i2", "<i4", "<i8")


def quantised(vectors: pa.Array, components: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and their integers as one row each."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), components), False).to_numpy(zero_copy_only=False))
    values = pc.cast(vectors.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), components)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(values * scale)
    inside = (np.abs(values) < MOST).all(axis=1)
    return at[inside], values[inside].astype(np.int64)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row's bytes in the narrowest integers that hold all of it, so equal rows have equal bytes."""
    most = np.maximum(rows, ~rows).max(axis=1, initial=0)
    width = (most >= 1 << 15).astype(int) + (most >= 1 << 31)
    out: list[bytes] = [b""] * len(rows)
    for w, kind in enumerate(WIDTHS):
        for i, row in zip(np.flatnonzero(width == w), rows[width == w].astype(kind), strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(keys: list[bytes], components: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and integers of the rows, those of one width at a time."""
    sizes = np.array([len(k) for k in keys])
    for kind in WIDTHS:
        at = np.flatnonzero(sizes == components * int(kind[-1]))
        if len(at):
            yield at, np.frombuffer(b"".join([keys[i] for i in at]), kind).reshape(len(at), components).astype(np.int64)


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; the smaller number on ties."""
    reach = int(np.abs(rows).max(initial=0)) + max(abs(x) for c in centroids for x in c)
    if rows.shape[1] * reach * reach < 1 << 53:
        a, c = rows.astype(float), np.array(centroids, float)
        squares = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
        label = squares.argmin(axis=1)
        return label, squares[np.arange(len(rows)), label].astype(np.int64)
    exact = rows.astype(object)
    label, best = np.zeros(len(rows), int), None
    for number, c in enumerate(centroids):
        squares = ((exact - np.array(c, object)) ** 2).sum(axis=1)
        if best is None:
            best = squares
        closer = np.array(squares < best, bool)
        label[closer], best = number, np.where(closer, squares, best)
    return label, best


def _pack(components: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = quantised(batch.column(1), components, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(packed(rows), pa.binary())], ["vec_id", "key"])

    return run


def _sums(centroids: list[list[int]], components: int):
    """A task's sums: one row for each centroid and component, and with component -1 the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            keys, weights = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at, rows in unpacked(keys, components):
                label, _ = nearest(rows, centroids)
                for c in np.unique(label):
                    chosen, weight = rows[label == c], weights[at[label == c]]
                    if (int(np.abs(chosen).max()) + 1) * int(weight.sum()) >= MOST:
                        chosen, weight = chosen.astype(object), weight.astype(object)
                    found = [weight.sum(), *(chosen * weight[:, None]).sum(axis=0)]
                    total[int(c)] = [int(a) + b for a, b in zip(found, total.get(int(c), [0] * len(found)), strict=True)]
        rows = [(c, i - 1, Decimal(x)) for c, found in total.items() for i, x in enumerate(found)]
        cluster, place, amount = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(amount, pa.decimal128(38, 0))], ["cluster", "place", "amount"]
        )

    return run


def _assign(centroids: list[list[int]], components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            cluster, distance = np.zeros(len(keys), np.int32), np.zeros(len(keys), object)
            for at, rows in unpacked(keys, components):
                cluster[at], distance[at] = nearest(rows, centroids)
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(fits, pa.int64())], ["key", "weight", "cluster", "distance"])

    return run


def _moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    found = {(r["cluster"], r["place"]): int(r["amount"]) for r in sums}
    return [[found[c, i] // found[c, -1] for i in range(len(old))] if (c, -1) in found else old for c, old in enumerate(centroids)]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 64,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = scratch.save(
        vectors.select(F.col(id_col).alias("vec_id"), vector_col).mapInArrow(_pack(components, scale), f"vec_id {kind}, key binary"), "vectors"
    )
    distinct = scratch.save(kept.groupBy("key").agg(F.count(F.lit(1)).alias("weight")), "distinct")

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(drawn.alias("draw"), "vec_id", "key").orderBy(F.asc_nulls_last("draw"), "vec_id", "key").limit(clusters).collect()
    centroids = [next(unpacked([bytes(r["key"])], components))[1][0].tolist() for r in first]

    result = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], result.format(kind))
    for _ in range(rounds):
        partial = distinct.mapInArrow(_sums(centroids, components), "cluster int, place int, amount decimal(38,0)")
        centroids = _moved(centroids, partial.groupBy("cluster", "place").agg(F.sum("amount").alias("amount")).collect())

    assigned = scratch.save(distinct.mapInArrow(_assign(centroids, components), "key binary, weight long, cluster int, distance long"), "assigned")
    summary = assigned.groupBy("cluster").agg(
        F.sum("weight").alias("rows"),
        F.sum(F.col("weight").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("inertia"),
        F.count_if(F.col("distance").isNull()).alias("beyond"),
    ).collect()
    rows = sum(r["rows"] for r in summary)
    inertia = {r["cluster"]: None if r["beyond"] else int(r["inertia"]) for r in summary}
    whole = None if None in inertia.values() else sum(inertia.values())

    def fitting(x: int | None) -> int | None:
        return x if x is not None and x < 1 << 63 else None

    # At most ``clusters`` rows.
    about = spark.createDataFrame(
        [(c, fitting(x), fitting(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    hot = F.col("weight") * HOT_SHARE > rows
    # Fewer than HOT_SHARE vectors can each stand for more than that share of the rows.
    by_broadcast = kept.join(F.broadcast(assigned.filter(hot).drop("weight")), "key")
    by_shuffle = kept.join(F.broadcast(assigned.filter(hot).select("key")), "key", "left_anti").join(assigned.filter(~hot).drop("weight"), "key")
    return (
        by_broadcast.unionByName(by_shuffle)
        .join(F.broadcast(about), "cluster")
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )
