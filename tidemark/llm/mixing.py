"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A document's size is its number of white-space separated words. Sources, by code point with null
last, get the weights 3, 1, 2, repeating, and share 150 % of all words; no target passes twice
its source's size, and what is cut off is shared among the others by weight. Each document draws
an exponential key, scaled by its quality weight. Complete epochs take every document of the
source; the rest of the target is filled in key order until the words taken come nearest to it.

The prefix sums run over about sqrt(n) buckets of the keys' own distribution for each source (a
mixture of exponential ones, a part for each power of two of the weights), so buckets are even
whatever the weights are, and no task holds a source. The table of sources (one row each) is the
only thing sorted in one task.

Quality follows four rules that Rae et al. (2021, Gopher) use for web text: each that a document
fails halves its weight.

Defined cases: null text has size 0; a null source is a source; a source without words has
target 0. Keys are hashes of the id, source, size and text, so reruns agree; identical rows are
interchangeable. An empty table gives an empty result. Only id, text and source are read; other
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, WORD, Scratch, free_names, running_total, unit_hash

SOURCE_WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2


# The limits of Rae et al. 2021, table A1.
WORDS_FROM, WORDS_TO = 50, 100_000
MEAN_WORD_FROM, MEAN_WORD_TO = 3, 10
MOST_SYMBOLS_PER_WORD = 0.1
LEAST_WORDS_WITH_LETTERS = 0.8


def quality_weight(text: Column, size: Column) -> Column:
    """1, halved for each rule on length, mean word length, symbols and words without letters that fails."""
    words = F.greatest(size, F.lit(1))
    lettered = F.regexp_count(text, F.lit(rf"(?<![^{WHITE_SPACE}])[^{WHITE_SPACE}\p{{L}}]*+\p{{L}}"))
    rules = [
        size.between(WORDS_FROM, WORDS_TO),
        (F.char_length(text) / words).between(MEAN_WORD_FROM, MEAN_WORD_TO + 1),
        F.regexp_count(text, F.lit(r"#|\u2026|\.\.\.")) / words <= MOST_SYMBOLS_PER_WORD,
        lettered / words >= LEAST_WORDS_WITH_LETTERS,
    ]
    weight = F.lit(1.0)
    for rule in rules:
        weight = weight * F.when(rule, 1.0).otherwise(0.5)
    return weight


def source_targets(sizes: DataFrame, weights: tuple = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``source, n_docs, source_size, target`` from rows of ``source, size``.

    With sources ordered by cap / weight, the capped ones come first; the first whose equal share
    by weight of what is left stays under its cap gives the water level for all that follow.
    """
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy(F.lit(0))
    named = (
        per_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights)) + 1))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("total", F.sum("source_size").over(everything) * float(share))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = named.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap")))
    return levelled.select("source", "n_docs", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = SOURCE_WEIGHTS,
    share: float = TOTAL_SHARE,
    most: float = MOST_EPOCHS,
    seed: int = 17,
    quality: Column | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, copies, mixed_source``."""
    return _decided(docs, id_col, text_col, source_col, weights, share, most, seed, quality).drop("text_key")


def _decided(docs, id_col, text_col, source_col, weights=SOURCE_WEIGHTS, share=TOTAL_SHARE, most=MOST_EPOCHS, seed=17, quality=None) -> DataFrame:
    """The rows of ``mix`` with ``text_key``, a hash of the text."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (quality if quality is not None else F.lit(None).cast("double")).alias("given"),
        text.alias("text"),
    )
    weight = F.coalesce(F.greatest("given", F.lit(1e-9)), quality_weight(F.col("text"), F.col("size")))
    keyed = scratch.save(
        sized.select("doc_id", "source", "size", F.xxhash64("text").alias("text_key"), weight.alias("weight")).withColumn(
            "key", -F.log(unit_hash(F.col("doc_id"), F.col("size"), F.col("source"), F.col("text_key"), seed=seed)) / F.col("weight")
        ),
        "keyed",
    )
    targets = source_targets(keyed, weights, share, most)
    power = F.pow(F.lit(2.0), F.round(F.log2("weight")))
    parts = (
        keyed.groupBy("source", power.alias("rate"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source")
        .agg(F.collect_list(F.struct("rate", "n")).alias("parts"))
        .withColumnRenamed("source", "parts_source")
    )
    named = scratch.save(targets.join(parts, F.col("source").eqNullSafe(F.col("parts_source"))).drop("parts_source").withColumnRenamed("source", "named_source"), "targets")
    n_buckets = F.ceil(F.sqrt(F.col("n_docs")))
    below = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p.getField("n") * (1 - F.exp(-F.col("key") * p.getField("rate"))))
    rows = (
        keyed.join(named, keyed["source"].eqNullSafe(named["named_source"]), "left")
        .withColumn("bucket", F.floor(below / F.col("n_docs") * n_buckets))
        .drop("named_source", "parts")
    )
    ranked = running_total(rows, "source", "bucket", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_key")], F.col("size"), "before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    extra = ((F.col("before") + F.col("size") / 2) < rest).cast("long")
    return ranked.withColumn("copies", (epochs + extra).cast("long")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        F.col("source").alias("mixed_source"),
        "text_key",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; the columns stay as they are.

    A row is known by its id, source and text. Rows that agree in these draw the same key; if they
    are taken unequally often, the order of all their columns tells which gets which number.
    """
    columns = docs.columns
    scratch = Scratch(docs.sparkSession, "mixed-documents")
    as_id, as_source, as_key, copies, place, at, again = free_names(docs, "as_id", "as_source", "as_key", "copies", "place", "at", "again")
    decided = scratch.save(
        _decided(docs, id_col, text_col, source_col, **options)
        .withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "mixed_source", "text_key").orderBy("copies")))
        .select(*[F.col(c).alias(name) for c, name in (("doc_id", as_id), ("mixed_source", as_source), ("text_key", as_key), ("copies", copies), ("place", place))]),
        "decided",
    )
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    source = docs[source_col].cast("string")
    on = docs[id_col].eqNullSafe(F.col(as_id)) & source.eqNullSafe(F.col(as_source)) & (key == F.col(as_key))
    marked = docs
    if decided.filter(F.col(place) > 1).limit(1).count():
        marked = docs.withColumn(at, F.row_number().over(Window.partitionBy(docs[id_col], source, key).orderBy(F.xxhash64(*columns))))
        on &= F.col(at) == F.col(place)
    return (
        marked.join(decided.filter(F.col(copies) > 0), on)
        .withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
        .select(*columns)
    )
