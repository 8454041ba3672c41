"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are quantised to integers and dealt into shards of similar ones: cells around centroids
that are fitted on a bounded sample (they only decide what lies together, never a result), split
where a cell has too many rows. A shard's rows are cut into blocks that are narrow in each
component. A query's upper bound for a shard or block is the sum over its terms (components) of
term times the maximum there, or the minimum for negative terms.

First each query visits the shard with its highest bound; that gives it a k-th score. Then only
queries, not rows, travel: each goes to the shards whose bound reaches its k-th score so far. In a
shard it visits blocks by falling bound, scores all rows of a block through the block's forward
index, and stops once the next bound is below its k-th score. A shard's rows are read once for each
``query_rows`` queries that reach it. Nothing is broadcast but the centroids, at most
``MOST_CELLS`` of them, and no group's size depends on the data.

How much is pruned depends on the vectors: clustered ones leave most shards out, while for
independent random components in many dimensions the bounds of all blocks exceed the k-th score
and every row is scored.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
vectors with a null id. A query never finds rows with its own id. Vectors of unequal length are
padded with zeros. Ties go to the smaller id; rows with the same id are each a candidate. A query
with fewer candidates than k gets them all. Scores are exact while they fit 63 bits. An empty table
gives an empty result. Only the id and vector columns are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 64
QUERY_ROWS = 2048
SHARD_ROWS = 4096
BLOCK_ROWS = 64
#: Vectors that the centroids are fitted on, and the most centroids.
SAMPLE_ROWS = 4096
MOST_CELLS = 256
#: Shard summaries that one task bounds a group of queries by.
CHUNK_SHARDS = 8192


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles while all sums of products stay below 2**53, else as 64-bit integers."""
    most = max(a.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return (a, b) if most < 2.0**53 else (a.astype(np.int64), b.astype(np.int64))


def blocks_of(rows: np.ndarray, block_rows: int = BLOCK_ROWS) -> list[np.ndarray]:
    """Positions of the rows in blocks: halved at the median of the widest component until small enough."""
    done, open_ = [], [np.arange(len(rows))]
    while open_:
        part = open_.pop()
        if len(part) <= block_rows:
            done.append(part)
            continue
        values = rows[part]
        widest = int(np.argmax(values.max(axis=0) - values.min(axis=0))) if rows.shape[1] else 0
        order = part[np.argsort(values[:, widest], kind="stable")] if rows.shape[1] else part
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def bounds(queries: np.ndarray, highest: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ highest.T + np.minimum(queries, 0) @ lowest.T


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block_rows: int = BLOCK_ROWS, least: np.ndarray | None = None):
    """The best ``k`` rows of a shard for each query: arrays of query position, row id and score, and the (query, block) pairs scored.

    Rows below ``least``, the k-th score a query has elsewhere, are left out.
    """
    queries, rows = _exact(queries, rows)
    parts = blocks_of(rows, block_rows)
    limits = bounds(queries, np.array([rows[p].max(axis=0) for p in parts]), np.array([rows[p].min(axis=0) for p in parts]))
    order = np.argsort(-limits, axis=1, kind="stable")
    n = len(queries)
    none = np.iinfo(np.int64).min
    best = np.full((n, k), none)
    best_ids = np.full((n, k), np.iinfo(np.int64).max)
    floor = np.full(n, none) if least is None else least
    active = np.arange(n)
    scored = 0
    for step in range(len(parts)):
        block = order[active, step]
        # A block whose bound equals the k-th score may still hold a smaller id.
        alive = limits[active, block] >= np.maximum(best[active, -1], floor[active])
        active, block = active[alive], block[alive]
        if not len(active):
            break
        scored += len(active)
        for b in np.unique(block):
            who = active[block == b]
            inside = parts[b]
            scores = (queries[who] @ rows[inside].T).astype(np.int64)
            scores[query_ids[who][:, None] == ids[inside][None, :]] = none
            # Most blocks hold nothing better for most queries; only the others are merged.
            better = (scores >= np.maximum(best[who, -1], floor[who])[:, None]).any(axis=1)
            who, scores = who[better], scores[better]
            if not len(who):
                continue
            all_scores = np.hstack([best[who], scores])
            all_ids = np.hstack([best_ids[who], np.broadcast_to(ids[inside], scores.shape)])
            top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            best[who], best_ids[who] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
    at, place = np.nonzero((best > none) & (best >= floor[:, None]))
    return at, best_ids[at, place], best[at, place], scored


def _centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows of the sample; no randomness."""
    found = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = np.argmin((found**2).sum(axis=1) - 2 * sample @ found.T, axis=1)
        found = np.array([sample[near == c].mean(axis=0) if (near == c).any() else found[c] for c in range(len(found))])
    return found


def top_k(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: int = SCALE,
    query_rows: int = QUERY_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, <id>, score`` for the rows of ``vectors`` for which ``is_query`` of the id holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    component = F.col(vector_col).cast("array<double>")
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), component.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
    )
    terms = scratch.save(valid.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")), "terms")
    total = terms.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n_rows, width = total["n"], total["width"] or 0
    cells = max(1, min(MOST_CELLS, n_rows // 512))
    # A bounded sample by hash; it only tells which rows lie together.
    luck = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)
    drawn = terms.filter(luck < 2 * SAMPLE_ROWS / max(1, n_rows)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect() if cells > 1 else []
    centroids = spark.sparkContext.broadcast(_centroids(_matrix([r["v"] for r in drawn], width), cells) if drawn else np.zeros((1, width)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                far = (centroids.value**2).sum(axis=1) - 2 * _matrix(part["v"], width) @ centroids.value.T
                yield part.assign(cell=np.argmin(far, axis=1))

    placed = scratch.save(terms.mapInPandas(assign, "id long, v array<double>, cell long"), "placed")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    split = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / shard_rows))
    # At most MOST_CELLS rows are broadcast.
    rows = scratch.save(placed.join(F.broadcast(sizes), "cell").select("id", "v", (F.shiftleft("cell", 40) + split).alias("shard")), "rows")

    def summary(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values = _matrix(part["v"], width)
        return pd.DataFrame({"shard": [key[0]], "highest": [values.max(axis=0)], "lowest": [values.min(axis=0)]})

    summaries = scratch.save(rows.groupBy("shard").applyInPandas(summary, "shard long, highest array<double>, lowest array<double>"), "summaries")
    asked = scratch.save(terms.filter(is_query(F.col("id"))).select("id", "v"), "queries")
    n_shards, n_queries = summaries.count(), asked.count()
    n_chunks, n_groups = max(1, -(-n_shards // CHUNK_SHARDS)), max(1, -(-n_queries // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grouped = asked.withColumn("query_group", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_groups)).cast("int"))
    by_group = summaries.withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(n_chunks)).cast("int")).withColumn("query_group", every(n_groups))

    def bounded(queries: DataFrame, only_best: bool) -> DataFrame:
        """``id, shard, bound``: each query's best shard of each chunk, or all that reach its ``least``."""

        def run(_, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(theirs):
                return pd.DataFrame({"id": [], "shard": [], "bound": []}).astype({"id": "int64", "shard": "int64"})
            limits = bounds(_matrix(mine["v"], width), _matrix(theirs["highest"], width), _matrix(theirs["lowest"], width))
            if only_best:
                at, shard = np.arange(len(mine)), np.argmax(limits, axis=1)
            else:
                # A hair below, as these bounds are rounded where they exceed 2**53.
                at, shard = np.nonzero(limits >= mine["least"].to_numpy()[:, None] * 1.0 - np.abs(limits) * 1e-12)
            return pd.DataFrame({"id": mine["id"].to_numpy()[at], "shard": theirs["shard"].to_numpy()[shard], "bound": limits[at, shard]})

        dealt = queries.withColumn("chunk", every(n_chunks))
        return dealt.groupBy("query_group", "chunk").cogroup(by_group.groupBy("query_group", "chunk")).applyInPandas(run, "id long, shard long, bound double")

    def probed(pairs: DataFrame) -> DataFrame:
        """``query_id, vec, score``: the best rows of each pair's shard. ``pairs`` has ``id, v, least, shard``."""
        reached = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("copies"))
        dealt = pairs.join(reached, "shard").withColumn("copy", F.pmod(F.xxhash64("id", F.lit(2)), F.col("copies"))).drop("copies")
        copied = rows.join(reached, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")

        def run(_, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(theirs):
                return pd.DataFrame({"query_id": [], "vec": [], "score": []}, dtype="int64")
            ids = mine["id"].to_numpy()
            at, found, score, _ = search_shard(ids, _matrix(mine["v"], width), theirs["id"].to_numpy(), _matrix(theirs["v"], width), k, least=mine["least"].to_numpy())
            return pd.DataFrame({"query_id": ids[at], "vec": found, "score": score})

        return dealt.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInPandas(run, "query_id long, vec long, score long")

    least = F.lit(np.iinfo(np.int64).min)
    first = bounded(grouped, True).groupBy("id").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    begun = scratch.save(asked.join(first, "id").withColumn("least", least).select("id", "v", "least", "shard"), "begun")
    near = scratch.save(probed(begun), "near")
    kth = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    known = begun.join(kth, F.col("id") == F.col("query_id"), "left").select(
        "id", "v", F.coalesce("kth", least).alias("least"), F.col("shard").alias("visited"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_groups)).cast("int").alias("query_group")
    )
    known = scratch.save(known, "known")
    rest = bounded(known, False).join(known.drop("query_group"), "id").filter(F.col("shard") != F.col("visited"))
    far = probed(scratch.save(rest.select("id", "v", "least", "shard"), "rest"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec")
    return (
        near.unionByName(far)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec").alias(id_col), "score")
    )
