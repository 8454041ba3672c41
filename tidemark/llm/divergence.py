"""Source divergence audit: how the words of each source differ from other sources' of its language.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case. A language keeps the
terms that ``least_documents`` of its documents hold. A group is a (language, source). Each group,
and each language as a whole, gives a kept term with count c the share
p = 1 + floor(10**9 * (c + 5) / (N + 5 * V)), with N its count of all kept terms and V their number;
a term that a group does not hold has the group's baseline, the share of count 0.

Two parts come out. ``pair``: for each other source of the language the sum over all kept terms of the
difference of both shares, all of them ranked. ``term``: the group's terms with a higher share than the
language's, the ``terms`` highest differences ranked.

*Counting* happens where documents lie: a task counts its texts by group and hands on sums whenever it
has read ``FLUSH_BYTES``; Spark adds them by (language, source, term).

*Pairs* are sparse. Two groups that both lack a term differ by their baselines, so a pair's value is
V * |baseline difference| plus, over the terms that either holds, the difference of the shares less
that of the baselines. Terms are dealt into buckets of about ``TILE_TERMS``, a language's sources into blocks
of ``TILE_SOURCES``; a task gets a bucket's counts for two blocks, at most ``2 * TILE_SOURCES`` rows for a
term, and returns one row for each pair with a correction. Every pair is in the result, so the output
itself grows with the square of a language's sources; the rows that move grow with sources / TILE_SOURCES.

*Terms* are ranked by radix selection. From the highest bits down, a histogram of the next
``RADIX_BITS`` bits of the candidates tells, for each group, the digit in which its k-th value lies;
candidates above are chosen, those below drop out. What still ties at the k-th value is refined
by the UTF-8 bytes that follow the tied terms' common prefix, two at a time, until at
most ``few`` ties are left to sort in any group. Only histograms are ever brought together.

Defined cases: null text, language or source counts as empty. A group without kept terms
has N = 0 and is part of all pairs. With V = 0 all pair values are 0. Repeated rows count
each. Texts may hold any bytes. An empty table gives an empty result. Only text, language and source
are read; other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAST_DOCUMENTS = 30
TERMS = 50
#: A task hands on its counts after this many bytes of text, so they stay bounded.
FLUSH_BYTES = 16 << 20
TILE_TERMS = 2048
TILE_SOURCES = 256
RADIX_BITS = 10
#: Ties that a group may have left when its refinement by bytes ends.
FEW = 256

_LETTERS = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: Separators become spaces and A-Z lower case; bytes beyond ASCII stay.
_TO_TERMS = bytes(b if b >= 0x80 or b in _LETTERS[1] else _LETTERS[1][b - 0x41] if b in _LETTERS[0] else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch], flush_bytes: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """Sums by language, source and term; a row without a term counts the group's documents."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    names = ["lang", "source", "term", "occurrences", "documents"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in groups.items():
            columns = [[lang] * len(documents), [source] * len(documents), list(documents), [occurrences[t] for t in documents], list(documents.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        groups.clear()

    read = 0
    for batch in batches:
        texts = batch.column(2)
        for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            occurrences, documents = groups.setdefault(group, (Counter(), Counter()))
            text = texts[i].as_py()
            found = terms_of(text)
            occurrences.update(found)
            documents.update({*found, None})
            read += len(text)
            if read >= flush_bytes:
                yield from handed_on()
                read = 0
    yield from handed_on()


def share(count: Column | str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), exactly."""
    count = F.col(count) if isinstance(count, str) else count
    above = (count.cast("decimal(20,0)") + 5) * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = F.col(total).cast("decimal(20,0)") + F.col(kept).cast("decimal(15,0)") * 5
    return F.call_function("div", above, below) + 1


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Corrections of all pairs of a tile; the tile of the first bucket adds what the baselines give."""
    lang, left, right, bucket = (rows[name].iloc[0] for name in ("lang", "i", "j", "bucket"))
    heads = rows[rows["term"] < 0].sort_values("number")
    rows = rows[rows["term"] >= 0]
    numbers, base, block = (heads[name].to_numpy(np.int64) for name in ("number", "share", "block"))
    kept = int(heads["kept"].iloc[0])
    at = np.searchsorted(numbers, rows["number"].to_numpy(np.int64))
    names, term = np.unique(rows["term"].to_numpy(np.int64), return_inverse=True)
    shares = np.repeat(base[:, None], len(names), axis=1)
    shares[at, term] = rows["share"].to_numpy(np.int64)
    others = np.flatnonzero(block == right)
    found = []
    for a in np.flatnonzero(block == left):
        b = others[numbers[others] > numbers[a]]
        apart = np.abs(base[b] - base[a])
        value = np.abs(shares[b] - shares[a]).sum(axis=1) - len(names) * apart + (kept * apart if bucket == 0 else 0)
        told = np.ones(len(b), bool) if bucket == 0 else value != 0
        found.append(np.column_stack([np.full(told.sum(), numbers[a]), numbers[b[told]], value[told]]))
    return pd.DataFrame(np.concatenate(found), columns=["a", "b", "value"]).assign(lang=lang)[["lang", "a", "b", "value"]]


def pair_values(shares: DataFrame, groups: DataFrame, tile_terms: int, tile_sources: int) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources of a language.

    ``groups`` has ``lang, source, number, kept, base, sources``; ``shares`` has ``lang, number, term``
    (numbers) and ``share``.
    """
    blocks = F.ceil(F.col("sources") / tile_sources)
    buckets = F.greatest(F.ceil(F.col("kept") / tile_terms), F.lit(1))
    place = {"block": F.floor(F.col("number") / tile_sources), "blocks": blocks}
    per_lang = ["lang", "kept", "sources"]
    heads = groups.select(*per_lang, "number", F.explode(F.sequence(F.lit(0), (buckets - 1).cast("int"))).alias("bucket"), F.lit(-1).cast("long").alias("term"), F.col("base").alias("share"))
    body = shares.select(*per_lang, "number", F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket"), "term", "share")
    tiles = (
        heads.unionByName(body)
        .withColumns(place)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("lang", "i", "j", "bucket", "number", "block", "term", "share", "kept")
    )
    # A tile of one block with itself gets each row once; tiles of two blocks get one row from each side.
    found = tiles.groupBy("lang", "i", "j", "bucket").applyInPandas(_tile, "lang string, a long, b long, value long")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    name = groups.select("lang", "number", "source")
    ordered = sums.select("lang", both.alias("pair"), "value").select("lang", "pair.a", "pair.b", "value")
    return (
        ordered.join(name.withColumnRenamed("number", "a"), ["lang", "a"])
        .join(name.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .select("lang", "source", "item", "value")
    )


def radix_select(values: DataFrame, keys: list[str], value: str, name: str, k: int, scratch: Scratch, bits: int = RADIX_BITS, few: int = FEW) -> DataFrame:
    """The ``k`` rows of each group with the highest ``value`` (a non-negative long), ties to the smaller ``name`` in UTF-8.

    No task ever gets a group: each round counts digits by group with partial sums, and walks at most
    2**bits (for values) or 2**16 + 2**8 + 1 (for bytes) counts of a group. ``values`` is read once a round. Names differ
    within a group, except for rows that are interchangeable.
    """
    rows = values.withColumn("_raw", F.col(name).cast("binary"))
    top = rows.agg(F.max(value).alias("top")).first()["top"]
    if top is None:
        return values
    # State of each group: the digits of its k-th value so far, and how many rows are to be chosen among those that share them.
    state = scratch.save(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tied")).select(*keys, "tied", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need")), "state-0")
    above = Window.partitionBy(*keys).orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1)
    shift = -(-max(top.bit_length(), 1) // bits) * bits
    number = 0

    def next_state(digits: DataFrame, before: Column, extend: Column, order: Window) -> DataFrame:
        """From each group's candidates by digit: the digit that holds the k-th of them; the last one where there are fewer."""
        nonlocal number
        counts = digits.groupBy(*keys, "prefix", "need", "digit").agg(F.count(F.lit(1)).alias("tied"))
        walked = counts.withColumn("above", F.coalesce(F.sum("tied").over(order), F.lit(0)))
        last = Window.partitionBy(*keys).orderBy(before)
        number += 1
        return scratch.save(
            walked.filter(F.col("above") < F.col("need"))
            .withColumn("_place", F.row_number().over(last))
            .filter("_place = 1")
            .select(*keys, "tied", extend.alias("prefix"), (F.col("need") - F.col("above")).alias("need")),
            f"state-{number}",
        )

    while shift:
        candidates = rows.join(state, keys).filter(F.shiftright(value, shift) == F.col("prefix"))
        shift -= bits
        digit = F.shiftright(value, shift).bitwiseAND(F.lit((1 << bits) - 1))
        state = next_state(candidates.withColumn("digit", digit), F.asc("digit"), F.shiftleft(F.col("prefix"), bits) + F.col("digit"), above)

    threshold = scratch.save(state.select(*keys, F.col("prefix").alias("_least"), F.col("need").alias("_need"), F.col("tied").alias("_tied")), "threshold")
    marked = rows.join(threshold, keys)
    chosen = marked.filter((F.col(value) > F.col("_least")) | ((F.col(value) == F.col("_least")) & (F.col("_tied") <= F.col("_need"))))
    out = chosen.select(*values.columns)

    ties = scratch.save(marked.filter((F.col(value) == F.col("_least")) & (F.col("_tied") > F.col("_need"))).select(*keys, value, name, "_raw", F.col("_need").alias("need")), "ties-0")
    first = Window.partitionBy(*keys).orderBy(F.asc("digit")).rowsBetween(Window.unboundedPreceding, -1)
    step = 0
    while True:
        # Between the least and the greatest of the ties, all share their common prefix.
        spans = ties.groupBy(*keys).agg(F.min("_raw").alias("low"), F.max("_raw").alias("high"), F.count(F.lit(1)).alias("tied"), F.max("need").alias("need"))
        open_spans = spans.filter((F.col("tied") > F.greatest(F.lit(few), F.col("need"))) & (F.col("low") != F.col("high")))
        if open_spans.isEmpty():
            break
        step += 1
        shared = scratch.save(open_spans.select(*keys, common_prefix(F.col("low"), F.col("high")).alias("prefix")), f"spans-{step}")
        followed = ties.join(shared, keys).withColumn("digit", F.hex(F.substring("_raw", F.col("prefix") + 1, F.lit(2))))
        cut = next_state(followed.withColumn("prefix", F.col("prefix").cast("long")), F.desc("digit"), F.col("digit"), first)
        cut = cut.select(*keys, F.col("prefix").alias("_digit"), F.col("need").alias("_left"))
        sided = scratch.save(followed.join(cut, keys), f"sided-{step}")
        out = out.unionByName(sided.filter(F.col("digit") < F.col("_digit")).select(*values.columns))
        rest = ties.join(shared, keys, "left_anti")
        ties = scratch.save(rest.unionByName(sided.filter(F.col("digit") == F.col("_digit")).select(*keys, value, name, "_raw", F.col("_left").alias("need"))), f"ties-{step}")
    # At most ``few`` or ``need`` rows of a group, or rows with one name.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_raw"))
    return out.unionByName(ties.withColumn("_place", place).filter(F.col("_place") <= F.col("need")).select(*values.columns))


def common_prefix(a: Column, b: Column) -> Column:
    """How many bytes two binaries share at their start: found by halving, not byte by byte."""
    steps = F.sequence(F.lit(0), F.lit(31))

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high + 1) / 2)
        same = F.substring(a, F.lit(1), middle.cast("int")) == F.substring(b, F.lit(1), middle.cast("int"))
        done = low >= high
        return F.struct(
            F.when(done | ~same, low).otherwise(middle).alias("low"),
            F.when(done | same, high).otherwise(middle - 1).alias("high"),
        )

    start = F.struct(F.lit(0).cast("long").alias("low"), F.least(F.octet_length(a), F.octet_length(b)).cast("long").alias("high"))
    return F.aggregate(steps, start, halve)["low"].cast("int")


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    terms: int = TERMS,
    flush_bytes: int = FLUSH_BYTES,
    tile_terms: int = TILE_TERMS,
    tile_sources: int = TILE_SOURCES,
    bits: int = RADIX_BITS,
    few: int = FEW,
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` of both parts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(batches, flush_bytes)

    counted = (
        docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).cast("binary").alias("text"))
        .mapInArrow(count, "lang string, source string, term binary, occurrences long, documents long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    )
    counts = scratch.save(counted, "counts")

    # The terms of each language, with a number of their own.
    vocabulary = (
        counts.filter(F.col("term").isNotNull())
        .groupBy("lang", F.col("term").alias("kept_term"))
        .agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("lang_count"))
        .filter(F.col("documents") >= least_documents)
        .select(F.col("lang").alias("kept_lang"), "kept_term", "lang_count", F.monotonically_increasing_id().alias("number_of_term"))
    )
    vocabulary = scratch.save(vocabulary, "vocabulary")
    of_lang = vocabulary.groupBy(F.col("kept_lang").alias("lang")).agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_count").alias("lang_total"))
    postings = scratch.save(
        counts.join(vocabulary, (F.col("lang") == F.col("kept_lang")) & (F.col("term") == F.col("kept_term"))).select(
            "lang", "source", F.col("term").cast("string").alias("item"), F.col("number_of_term").alias("term"), "occurrences", "lang_count"
        ),
        "postings",
    )
    totals = postings.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = (
        counts.filter(F.col("term").isNull())
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .na.fill(0, ["total", "kept", "lang_total"])
        .withColumn("number", (F.row_number().over(by_source) - 1).cast("long"))
        .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        .withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), "total", "kept")).otherwise(F.lit(0).cast("long")))
    )
    groups = scratch.save(groups, "groups")
    shares = scratch.save(
        postings.join(groups, ["lang", "source"]).select(
            "lang", "source", "item", "term", "number", "kept", "sources", share("occurrences", "total", "kept").alias("share"), share("lang_count", "lang_total", "kept").alias("lang_share")
        ),
        "shares",
    )

    pairs = pair_values(shares, groups, tile_terms, tile_sources)
    higher = scratch.save(
        shares.filter(F.col("share") > F.col("lang_share")).select("lang", "source", "item", (F.col("share") - F.col("lang_share")).alias("value")), "higher"
    )
    best = radix_select(higher, ["lang", "source"], "value", "item", terms, scratch, bits, few)
    parts = pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return parts.select("lang", "source", "part", "item", "value", rank.alias("rank"))
