"""Exact deduplication with a heavy-hitter split.

Every row is reduced to the SHA-256 of its text without ASCII white space. Misra-Gries summaries
of the partitions name the digests that may be frequent; their exact winners are computed with
map-side combining, at most ``counters`` of them, and broadcast, so that the rows of frequent
digests are decided where they lie. All other digests are shuffled by digest; each such group is
at most ``2 / counters`` of the rows.

Defined cases: null text counts as empty, and empty texts are one group; white-space-only texts
join it. Of equal texts the row with the most code points in its original text stays, then the
smallest id (null ids last), then one arbitrary row of several identical rows. An empty table
gives an empty result. Only the id and text columns are read; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, Scratch, free_names

COUNTERS = 1024
#: Rows up to which the table of dropped rows may be broadcast; a larger one is joined by a shuffle.
SMALL_ROWS = 1_000_000


def _summaries(counters: int):
    """Misra-Gries over one partition, a batch at a time: at most ``counters`` digests are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for entry in pc.value_counts(batch.column(0)).to_pylist():
                kept[entry["values"]] = kept.get(entry["values"], 0) + entry["counts"]
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {digest: n - cut for digest, n in kept.items() if n > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "at_least"]
        )

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them each that more than ``2 / counters`` of the rows have."""
    total = digests.count()
    return (
        digests.select("digest")
        .mapInArrow(_summaries(counters), "digest binary, at_least long")
        .groupBy("digest")
        .agg(F.sum("at_least").alias("at_least"))
        .filter(F.col("at_least") > F.lit(total / counters))
        .filter(F.col("at_least") > 1)
        .select("digest")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return _decided(docs, id_col, text_col, counters).drop("text_key")


def _decided(docs: DataFrame, id_col: str, text_col: str, counters: int) -> DataFrame:
    """The rows of ``exact_dedup`` with ``text_key``, a hash of the original text."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = scratch.save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(text, f"[{WHITE_SPACE}]+", ""), 256)).alias("digest"),
            F.char_length(text).alias("n_chars"),
            F.xxhash64(text).alias("text_key"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "digests",
    )
    heavy = scratch.save(frequent_digests(digests, counters), "heavy")
    preference = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id"))
    winners = (
        digests.join(F.broadcast(heavy), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(preference).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")
    )
    by_map = digests.join(F.broadcast(winners), "digest").withColumn("kept", F.col("row_id") == F.col("keep_row"))
    group = Window.partitionBy("digest")
    first = group.orderBy(*[preference.getField(i) for i in ("col1", "col2", "doc_id", "row_id")])
    by_shuffle = (
        digests.join(F.broadcast(heavy), "digest", "left_anti")
        .withColumn("keep_id", F.first("doc_id").over(first))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("kept", F.row_number().over(first) == 1)
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "text_key"]
    return by_map.select(*columns).unionByName(by_shuffle.select(*columns))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts; the columns stay as they are.

    The keys of the rows that go, not the texts, are what moves: rows are told apart by id and the
    hash of their original text, so ids may be null or repeat, and of several rows with the id and
    text that stay one stays. Extra columns may have any names. An empty table stays empty.
    """
    columns = docs.columns
    scratch = Scratch(docs.sparkSession, "exact-dedup-kept")
    gone_id, gone_key, stays, rows = free_names(docs, "gone_id", "gone_key", "stays", "rows")
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    touched = scratch.save(
        _decided(docs, id_col, text_col, counters)
        .groupBy(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
        .agg(F.max("kept").alias(stays), F.count(F.lit(1)).alias(rows))
        .filter(~F.col(stays) | (F.col(rows) > 1))
        .drop(rows),
        "touched",
    )
    table = F.broadcast(touched) if touched.count() <= SMALL_ROWS else touched
    same = docs[id_col].eqNullSafe(F.col(gone_id)) & (text_key == F.col(gone_key))
    if not touched.filter(F.col(stays)).limit(1).count():
        return docs.join(table, same, "left_anti")
    marked = docs.join(table, same, "left")
    once = marked.filter(F.col(stays)).dropDuplicates([gone_id, gone_key])
    return marked.filter(F.col(stays).isNull()).select(*columns).unionByName(once.select(*columns))
