"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

A document's set holds its distinct word shingles. Documents with the same set form a class
(copies), found by a digest with map-side combining; everything after works on one representative
of each class. A representative's sketch is its ``k`` smallest shingle hashes, or all of them.

Inverted lists of retained values generate the overlaps. Two sets with similarity of at least the
threshold share all but a few of their retained values, so a sketch only enters the lists of its
rarest ones: a value that many documents share (a licence line, a common passage) is listed only
for sketches made of little else. In each list the members are linked to the list's head instead
of to each other, and the pair of sketches is merged into a sketch of the union, whose estimate
drops hopeless pairs; exact Jaccard on full sets confirms the rest. A list whose other members are
still in several components is then compared in full, block against block of a bounded number of
sets and of shingles, and only links that join two components are emitted. So no link is lost,
while a group of n copies costs about n pairs.

A list of more than one block is first divided by size. Two sets can only be linked if their sizes
are within the threshold of each other; and if both sketches are whole sets, the values from the
list's own on (in the order of rarity) must make up the overlap that two such sizes need, or else
the pair shares an earlier value and is found in that one's list. Only members that pass both for
a pair of sizes are compared, so short texts that share a frequent template just below the
threshold are not compared at all.

The number of values to list follows from ``slack``: with similarity s, the values of the union
sketch that both retain are at least k*s - slack*sqrt(k*s*(1-s)), and six deviations miss fewer than
one pair in 10**8. Sets of at most k shingles are compared in full, without any such estimate.

Defined cases: without words or text a document has the empty set, is linked with nothing and is
its own component. With fewer words than a shingle the whole sequence is its one shingle. Rows
with the same id are copies of each other's component only if their sets are linked; null ids
take part and come out with their class's component. Texts whose words collide by chance (2**-64
for two words) would be linked. Of each component exactly one row is kept:
the one with the smallest id, null ids last, then the least hash of its text, then one arbitrary
row of several identical rows. An empty table gives an empty result. Only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, settled
from .components import components
from .shingles import shingle_set

WORDS = 5
SIMILARITY = (80, 100)
SKETCH = 64
SLACK = 7.0
#: Rows up to which a table of ids may be broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 1_000_000
#: Shingles and sets in one block of a list that is compared in full.
BLOCK_SHINGLES = 1 << 19
BLOCK_SETS = 1 << 12


def least_overlap(n: int, similarity: float, k: int, slack: float) -> int:
    """The retained values that a set of ``n`` shares with any set at least so similar."""
    if n <= k * similarity:
        return max(1, ceil(n * similarity - 1e-9))
    return max(1, int(k * similarity - slack * sqrt(k * similarity * (1 - similarity))))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few full sets are in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketches(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(text.as_py(), words) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "digest", "sketch"],
            )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return run


def _linked(counts: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    part, whole = similarity
    return whole * counts >= part * (sizes_a + sizes_b - counts)


def _confirm(similarity: tuple[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for a, b in zip(frame["set_a"], frame["set_b"], strict=True):
                x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(bool(_linked(np.int64(both), len(x), len(y), similarity)))
            yield frame.loc[keep, ["a", "b"]]

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 512) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one.

    Shingles that few sets share are counted pair by pair, the others by products of their
    membership columns.
    """
    n, m = len(left), len(right)
    owner = np.repeat(np.arange(n + m), [len(s) for s in left + right])
    _, column = np.unique(np.concatenate(left + right), return_inverse=True)
    on_left = owner < n
    columns = int(column.max()) + 1 if len(column) else 0
    times = [np.bincount(column[side], minlength=columns) for side in (on_left, ~on_left)]
    pairs = times[0] * times[1]
    out = np.zeros((n, m), np.float32)

    def entries(side: np.ndarray, wanted: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(side & wanted[column])
        at = at[np.argsort(column[at], kind="stable")]
        return owner[at] - first, column[at]

    few = (pairs > 0) & (pairs <= max(16, n * m // 256))
    (i, ci), (j, cj) = entries(on_left, few, 0), entries(~on_left, few, n)
    start, ends = np.searchsorted(cj, ci), np.cumsum(times[1][ci])
    done = 0
    while done < len(i):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 20), side="right")))
        reps = times[1][ci[done:upto]]
        inside = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        np.add.at(out.reshape(-1), np.repeat(i[done:upto], reps) * m + j[np.repeat(start[done:upto], reps) + inside], 1)
        done = upto

    many = (pairs > 0) & ~few
    number = np.cumsum(many) - 1
    (i, ci), (j, cj) = entries(on_left, many, 0), entries(~on_left, many, n)
    ci, cj = number[ci], number[cj]
    for first in range(0, int(many.sum()), width):
        size = min(width, int(many.sum()) - first)
        member = [np.zeros((rows, size), np.float32) for rows in (n, m)]
        for table, who, what in ((member[0], i, ci), (member[1], j, cj)):
            at = slice(np.searchsorted(what, first), np.searchsorted(what, first + size))
            table[who[at], what[at] - first] = 1
        out += member[0] @ member[1].T
    return out


def _compare_block(similarity: tuple[int, int]):
    """Links that join different components among the members of one block or between two blocks."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        _, size_a, size_b, low, high = key
        alone = size_a == size_b and low == high
        on_left = part["side"].to_numpy() == 0
        if part["label"].nunique() < 2 or not (alone or on_left.any() and not on_left.all()):
            return empty
        at_a = np.arange(len(part)) if alone else np.flatnonzero(on_left)
        at_b = at_a if alone else np.flatnonzero(~on_left)
        sets = [np.frombuffer(x, np.int64) for x in part["shingles"]]
        sizes = np.array([len(s) for s in sets])
        counts = overlaps([sets[i] for i in at_a], [sets[i] for i in at_b])
        labels = part["label"].to_numpy().copy()
        ids, links = part["cls"].to_numpy(), []
        for row, i in enumerate(at_a):
            linked = at_b[_linked(counts[row].astype(np.int64), sizes[i], sizes[at_b], similarity)]
            others = linked[labels[linked] != labels[i]]
            if len(others):
                joined, first = np.unique(labels[others], return_index=True)
                links += [(ids[i], ids[others[j]]) for j in first]
                labels[np.isin(labels, joined)] = labels[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64") if links else empty

    return run


def _n_blocks(n_sets: Column, n_shingles: Column) -> Column:
    return F.greatest(F.ceil(n_sets / BLOCK_SETS), F.ceil(n_shingles / BLOCK_SHINGLES)).cast("int")


def _by_sizes(members: DataFrame, similarity: tuple[int, int], k: int, scratch: Scratch) -> DataFrame:
    """The members of frequent lists, for each pair of size classes whose sets can be linked.

    Sizes of whole sketches, up to ``k``, are classes of their own; a larger set is in a class with
    those up to ``1 / similarity`` times its size, so that linked ones are in the same class or in
    neighbouring ones (the base is a little larger, against rounding).
    """
    part, whole = similarity
    step = log(whole / part * 1.0001)
    size = F.when(F.col("n") <= k, F.col("n")).otherwise(F.floor(F.log(F.col("n") / k) / step) + k + 1).cast("int")
    sized = members.withColumn("size", size)
    classes = scratch.save(sized.groupBy("value", "size").agg(F.max("rest").alias("most"), F.min("n").alias("from_n"), F.max("n").alias("to_n")), "sizes")
    a, b = (classes.select("value", *[F.col(c).alias(f"{c}_{x}") for c in ("size", "most", "from_n", "to_n")]) for x in "ab")
    exact = F.col("size_b") <= k
    need = F.when(exact, F.ceil((F.col("size_a") + F.col("size_b")) * part / (part + whole))).otherwise(0)
    pairs = scratch.save(
        a.join(b, "value")
        .filter("size_a <= size_b")
        .filter((F.col("to_n_a") * whole >= F.col("from_n_b") * part) & (exact | (F.col("size_a") <= k) | (F.col("size_b") - F.col("size_a") <= 1)))
        .withColumn("need", need)
        .filter("need <= least(most_a, most_b)")
        .select("value", "size_a", "size_b", "need"),
        "size-pairs",
    )
    left = sized.join(pairs.withColumnRenamed("size_a", "size").withColumn("size_a", F.col("size")), ["value", "size"]).withColumn("side", F.lit(0))
    right = (
        sized.join(pairs.filter("size_a < size_b").withColumnRenamed("size_b", "size").withColumn("size_b", F.col("size")), ["value", "size"])
        .withColumn("side", F.lit(1))
    )
    columns = ["value", "size_a", "size_b", "side", "cls", "n", "label"]
    return left.unionByName(right).filter("rest >= need").select(*columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``; see ``_decided`` for the options."""
    return _decisions(docs, id_col, text_col, **options).drop("text_key")


def _decisions(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    return settled(docs.sparkSession, "near-duplicates", lambda: _decided(docs, id_col, text_col, **options))


def _decided(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    words: int = WORDS,
    similarity: tuple[int, int] = SIMILARITY,
    k: int = SKETCH,
    slack: float = SLACK,
) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    share = similarity[0] / similarity[1]
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    sketched = scratch.save(
        keyed.mapInArrow(
            _sketches(words, k), f"doc_id {id_type}, text_key long, n_shingles long, digest binary, sketch array<long>"
        ).withColumn("row_id", F.monotonically_increasing_id()),
        "sketched",
    )
    rows = sketched.drop("sketch")
    # Classes of equal sets; a class is named by the row that stands for it.
    classes = scratch.save(
        rows.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "row_id")).alias("first"),
            F.max("n_shingles").alias("n"),
        )
        .select("digest", F.col("first.row_id").alias("cls"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "n"),
        "classes",
    )
    sketches = scratch.save(
        sketched.select("row_id", "sketch").join(classes.select(F.col("cls").alias("row_id"), "n"), "row_id").withColumnRenamed("row_id", "cls"),
        "sketches",
    )

    # Inverted lists of the rarest retained values.
    retained = sketches.select("cls", F.explode("sketch").alias("value"))
    repeated = retained.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    need = F.when(
        F.col("n") <= k * share, F.greatest(F.lit(1), F.ceil(F.col("n") * share - 1e-9))
    ).otherwise(least_overlap(k + 1, share, k, slack))
    listed = F.array_size("sketch") - need + 1 - (F.array_size("sketch") - F.array_size("found"))
    entries = scratch.save(
        retained.join(repeated, "value")
        .groupBy("cls")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("found"))
        .join(sketches, "cls")
        .withColumn("listed", listed.cast("int"))
        .filter("listed > 0")
        .select("cls", "n", F.array_size("found").alias("shared"), F.posexplode(F.slice("found", F.lit(1), F.col("listed"))).alias("place", "entry"))
        # ``rest``: the shared values from this one on.
        .select("cls", "n", F.col("entry.value").alias("value"), (F.col("shared") - F.col("place")).alias("rest")),
        "entries",
    )
    heads = scratch.save(
        entries.groupBy("value").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "heads"
    )
    members = scratch.save(entries.join(heads, "value").select("value", "cls", "n", "rest", "head"), "members")
    pairs = members.filter("cls != head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()

    # The k smallest values of the union of two sketches, and how many of them both retain.
    left = sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("sketch_b"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    both = F.array_size(F.array_intersect("union", F.array_intersect("sketch_a", "sketch_b")))
    least = share - slack * F.sqrt(F.lit(share * (1 - share)) / F.array_size("union"))
    hopeful = scratch.save(
        pairs.join(left, "a").join(right, "b").withColumn("union", union).filter(both / F.array_size("union") >= least).select("a", "b"),
        "pairs",
    )

    # Full sets of all members of lists.
    wanted = scratch.save(
        members.select("cls").distinct().join(classes, "cls").select("cls", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "wanted"
    )
    table = F.broadcast(wanted) if wanted.count() <= SMALL_ROWS else wanted
    sets = scratch.save(
        keyed.join(table, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("cls", "text")
        .mapInArrow(_full_sets(words), "cls long, shingles binary")
        .dropDuplicates(["cls"]),
        "sets",
    )
    confirmed = scratch.save(
        hopeful.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
        .join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a")
        .mapInPandas(_confirm(similarity), "a long, b long"),
        "confirmed",
    )
    first = components(confirmed, "a", "b", "near-duplicates-first")

    # Lists whose other members are still in several components are compared block by block.
    labelled = scratch.save(
        members.filter("cls != head")
        .join(first, F.col("cls") == F.col("node"), "left")
        .select("value", "cls", "n", "rest", F.coalesce("component", "cls").alias("label")),
        "labelled",
    )
    mixed = scratch.save(
        labelled.groupBy("value")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
        .filter("low < high")
        .select("value", _n_blocks(F.col("sets"), F.col("shingles")).alias("n_blocks")),
        "mixed",
    )
    single = labelled.join(mixed.filter("n_blocks = 1").select("value"), "value")
    zero = F.lit(0)
    blocks = single.select("value", *[zero.alias(c) for c in ("size_a", "size_b", "low", "high", "side")], "cls", "label")
    if mixed.filter("n_blocks > 1").limit(1).count():
        frequent = scratch.save(labelled.join(mixed.filter("n_blocks > 1").select("value"), "value"), "frequent")
        sized = scratch.save(_by_sizes(frequent, similarity, k, scratch), "sized")
        of_side = lambda side, what: F.sum(F.when(F.col("side") == side, what).otherwise(0))
        tasks = (
            sized.groupBy("value", "size_a", "size_b")
            .agg(
                F.min("label").alias("least_label"),
                F.max("label").alias("most_label"),
                *[of_side(side, what).alias(f"{name}_{side}") for side in (0, 1) for name, what in (("sets", 1), ("shingles", F.col("n")))],
            )
            .filter("least_label < most_label AND (size_a = size_b OR sets_0 > 0 AND sets_1 > 0)")
            .select("value", "size_a", "size_b", *[_n_blocks(F.col(f"sets_{x}"), F.col(f"shingles_{x}")).alias(f"blocks_{x}") for x in (0, 1)])
        )
        same = F.col("size_a") == F.col("size_b")
        mine = F.when(F.col("side") == 0, F.col("blocks_0")).otherwise(F.col("blocks_1"))
        theirs = F.when(same | (F.col("side") == 1), F.col("blocks_0")).otherwise(F.col("blocks_1"))
        dealt = (
            sized.join(tasks, ["value", "size_a", "size_b"])
            .withColumn("block", F.pmod(F.xxhash64("cls"), mine).cast("int"))
            .withColumn("with_block", F.explode(F.sequence(zero, theirs - 1)))
        )
        low = F.when(same, F.least("block", "with_block")).when(F.col("side") == 0, F.col("block")).otherwise(F.col("with_block"))
        high = F.when(same, F.greatest("block", "with_block")).when(F.col("side") == 0, F.col("with_block")).otherwise(F.col("block"))
        side = F.when(same, (F.col("block") > F.col("with_block")).cast("int")).otherwise(F.col("side"))
        blocks = blocks.unionByName(
            dealt.select("value", "size_a", "size_b", low.alias("low"), high.alias("high"), side.alias("side"), "cls", "label")
        )
    rest = scratch.save(
        blocks.join(sets, "cls").groupBy("value", "size_a", "size_b", "low", "high").applyInPandas(_compare_block(similarity), "a long, b long"), "rest"
    )
    found = components(confirmed.unionByName(rest), "a", "b", "near-duplicates-all")

    reachable = (
        classes.join(found, F.col("cls") == F.col("node"), "left")
        .select("digest", "cls", "doc_id", "text_key", F.coalesce("component", "cls").alias("component"))
    )
    best = reachable.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "cls")).alias("best")
    )
    named = reachable.join(best, "component").select(
        F.col("digest").alias("_digest"), F.col("best.doc_id").alias("component_id"), F.col("best.cls").alias("keep_row")
    )
    some = F.col("n_shingles") > 0
    return rows.join(named, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("row_id") == F.col("keep_row")).otherwise(True).alias("kept"),
    )


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; the columns stay as they are.

    Rows without words stay. Rows are told apart by id and text, so ids may be null or repeat;
    several rows with the id and text that stay are thinned to one.
    """
    columns = docs.columns
    scratch = Scratch(docs.sparkSession, "near-duplicates-kept")
    gone_id, gone_key, stays, rows = free_names(docs, "gone_id", "gone_key", "stays", "rows")
    decided = scratch.save(_decisions(docs, id_col, text_col, **options), "decided")
    touched = scratch.save(
        decided.filter("n_shingles > 0")
        .groupBy(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
        .agg(F.max("kept").alias(stays), F.count(F.lit(1)).alias(rows))
        .filter(~F.col(stays) | (F.col(rows) > 1))
        .drop(rows),
        "touched",
    )
    table = F.broadcast(touched) if touched.count() <= SMALL_ROWS else touched
    same = docs[id_col].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text_col]) == F.col(gone_key))
    if not touched.filter(F.col(stays)).limit(1).count():
        return docs.join(table, same, "left_anti")
    marked = docs.join(table, same, "left")
    once = marked.filter(F.col(stays)).dropDuplicates([gone_id, gone_key])
    return marked.filter(F.col(stays).isNull()).select(*columns).unionByName(once.select(*columns))
