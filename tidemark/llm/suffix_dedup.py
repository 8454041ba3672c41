"""Suffix-array deduplication: removal of long strings that occurred before.

A byte is removed if it lies in a string of ``length`` bytes of its document that also starts
earlier: in a document with a smaller id, or earlier in the same one. Strings are judged on the
input texts, as UTF-8 bytes.

1. Every such string has an anchor, its least ``GRAM``-byte substring by hash; equal strings have
   equal anchors at the same offset. Each document's anchors, with the run of strings that each one
   stands for (its context), are shuffled by anchor. Anchors that occur once cannot hold a
   repeat and are dropped: an exact filter, which leaves the shared parts of the corpus.
   Misra-Gries summaries name the anchors and contexts that may be frequent; these are dealt over
   many tasks, and the firsts of their parts are compared once more.
2. Of equal contexts the later ones are removed whole.
3. The different contexts of an anchor meet in a shard of bounded size. Induced sorting orders
   all suffixes of the shard and carries the prefixes that neighbours share; neighbours with
   ``length`` bytes in common form a class, and all but its first member are removed. An anchor with too many contexts for one shard is salted; then each
   shard also reports the first of each of its classes, and a shuffle by the string's digest finds
   those that another shard saw earlier.
4. The removed strings of a document are joined to its text.

Defined cases: null text is empty. Documents shorter than ``length`` bytes are never touched.
Null ids come after all others. A row that repeats id and text counts as a later document: it is
removed whole, if long enough. Rows with the same id and different texts are ordered by their text
hashes. An empty table gives an empty result. Ids are integers. Only the id and text columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, settled
from .induced_sort import MEMORY, suffix_order

LENGTH = 100
GRAM = 32
SHARD_BYTES = 1 << 22
SMALL_ROWS = 1_000_000
#: Frequent anchors and contexts that are dealt over this many tasks each.
COUNTERS = 1024
SALTS = 64
#: Bytes of a text that are searched for anchors at a time.
PART = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_POSITION = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(PART + 4 * LENGTH, np.uint64(factor))
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _windows(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each window of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        values, done = join(values[:-done], values[done:]), 2 * done
    rest = width - done
    return join(values[:-rest], values[rest:]) if rest else values


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    values, power, done = raw.astype(np.uint64) + np.uint64(1), np.uint64(_BASE), 1
    while done < gram:
        values = values[:-done] * power + values[done:]
        power, done = power * power, 2 * done
    return _mixed(values)


def contexts(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, start and number of strings of each context of a text."""
    found: list[tuple[np.ndarray, ...]] = []
    up, down = _tables()
    # Wrapping of powers is meant.
    with np.errstate(over="ignore"):
        for at in range(0, len(raw) - length + 1, PART):
            part = np.frombuffer(raw, np.uint8, min(PART + length - 1, len(raw) - at), at)
            grams = _gram_hashes(part, gram)
            keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
            anchor = (_windows(keys, length - gram + 1, np.minimum) & _POSITION).astype(np.int64)
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            last = np.append(first[1:], len(anchor))
            anchor = anchor[first]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            whole = (sums[last + length - 1] - sums[first]) * down[first]
            whole = _mixed(whole + (anchor - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (last - first).astype(np.uint64))
            found.append((grams[anchor].view(np.int64), whole.view(np.int64), first + at, last - first))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _find_contexts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [contexts((t.as_py() or "").encode(), length, gram) for t in part.column(3)]
                sizes = [len(f[0]) for f in found]
                rows = pa.array(np.repeat(np.arange(len(found)), sizes))
                columns = [part.column(i).take(rows) for i in range(3)]
                columns += [pa.array(np.concatenate([f[i] for f in found])) for i in range(2)]
                columns += [pa.array(np.concatenate([f[i] for f in found]).astype(np.int32)) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "row_id", "anchor", "context", "start", "strings"])

    return run


def _frequent(counters: int):
    """Misra-Gries over one partition for anchors (kind 0) and for contexts of an anchor (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[dict, dict] = ({}, {})
        for batch in batches:
            pairs = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            for kind, changes in enumerate((pairs[1:, 0] != pairs[:-1, 0], (pairs[1:] != pairs[:-1]).any(axis=1))):
                heads = np.flatnonzero(np.append(True, changes)) if len(pairs) else np.zeros(0, int)
                counts = np.diff(np.append(heads, len(pairs)))
                held = kept[kind]
                if not len(held) and len(counts) > counters:
                    cut = np.partition(counts, -counters - 1)[-counters - 1]
                    heads, counts = heads[counts > cut], counts[counts > cut] - cut
                for (a, c), n in zip(pairs[heads].tolist(), counts.tolist(), strict=True):
                    key = (a, c if kind else 0)
                    held[key] = held.get(key, 0) + n
                if len(held) > counters:
                    cut = sorted(held.values(), reverse=True)[counters]
                    left = {key: n - cut for key, n in held.items() if n > cut}
                    held.clear()
                    held.update(left)
        rows = [(kind, a, c, n) for kind, held in enumerate(kept) for (a, c), n in held.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "anchor", "context", "at_least"])

    return run


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                wanted = part.column(2)
                flat = wanted.flatten()
                starts, strings = (flat.field(name).to_numpy() for name in ("start", "strings"))
                owner = np.repeat(np.arange(part.num_rows), [len(x) for x in wanted])
                raws = [(texts[start + i].as_py() or "").encode() for i in range(part.num_rows)]
                cut = [raws[o][s : s + n + length - 1] for o, s, n in zip(owner, starts, strings, strict=True)]
                names = ["anchor", "shard", "salted", "row_id", "start", "strings"]
                columns = [part.column(0).take(pa.array(owner))] + [flat.field(name) for name in names] + [pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "raw"])

    return run


def repeated_strings(shard: pd.DataFrame, length: int, memory: int = MEMORY) -> pd.DataFrame:
    """Runs of strings of a shard's contexts that repeat an earlier one, and its salted classes' firsts.

    Rows have ``digest`` null for runs (``strings`` from ``start`` on) and set for firsts. The
    contexts are put in the order of their documents, so the first of equal strings is the one with
    the least place in the shard's text; the sorted suffixes are read once, block by block.
    """
    by = np.lexsort((shard["start"], shard["row_id"], shard["doc_id"].fillna(0).to_numpy(np.int64), shard["doc_id"].isna()))
    shard = shard.iloc[by]
    raws = shard["raw"].tolist()
    sizes = np.array([len(r) for r in raws])
    offsets = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\xff".join(raws), np.uint8)  # 0xFF is in no UTF-8 text
    strings, salted = shard["strings"].to_numpy(), shard["salted"].to_numpy(bool)
    edges = np.zeros(len(text) + 1, np.int8)
    np.add.at(edges, offsets, 1)
    np.add.at(edges, offsets + strings, -1)
    begins_string = np.cumsum(edges[:-1], dtype=np.int8) > 0
    later = np.zeros(len(text), bool)
    number, open_class, open_first = 0, -1, -1
    for positions, shared in suffix_order(text, 256, length, memory):
        classes = np.cumsum(shared < length) + number
        number = int(classes[-1])
        some = begins_string[positions]
        positions, classes = positions[some], classes[some]
        if not len(positions):
            continue
        heads = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
        firsts = np.minimum.reduceat(positions, heads)
        if classes[0] == open_class:
            later[max(open_first, firsts[0])] = True
            firsts[0] = min(open_first, firsts[0])
        counts = np.diff(np.append(heads, len(positions)))
        later[positions[positions != np.repeat(firsts, counts)]] = True
        open_class, open_first = classes[-1], firsts[-1]
    # Between contexts lie positions that begin no string, so runs end with their context.
    edges = np.diff(np.concatenate([[0], later.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(offsets, begin, "right") - 1
    start = shard["start"].to_numpy()
    runs = pd.DataFrame({"at": owner, "start": start[owner] + begin - offsets[owner], "strings": end - begin, "digest": None})
    out = runs
    if salted.any():
        first = np.flatnonzero(begins_string & ~later)
        owner = np.searchsorted(offsets, first, "right") - 1
        first, owner = first[salted[owner]], owner[salted[owner]]
        digests = [xxhash.xxh3_128_digest(text[i : i + length].tobytes()) for i in first]
        out = pd.concat([runs, pd.DataFrame({"at": owner, "start": start[owner] + first - offsets[owner], "strings": 1, "digest": digests})], ignore_index=True)
    out["doc_id"], out["row_id"] = shard["doc_id"].to_numpy(object)[out["at"]], shard["row_id"].to_numpy()[out["at"]]
    return out[["doc_id", "row_id", "start", "strings", "digest"]]


def kept_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.append(True, starts[1:] > ends[:-1])
    begin, end = starts[head], ends[np.append(np.flatnonzero(head)[1:] - 1, len(ends) - 1)]
    view, left, at = memoryview(raw), [], 0
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        left.append(view[at:b])
        at = e
    left.append(view[at:])
    return int((end - begin).sum()), len(begin), b"".join(left)


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = (batch.column(2)[i].as_py() or "").encode()
                runs = batch.column(3)[i].values
                starts = runs.field("start").to_numpy().astype(np.int64)
                removed, spans, left = kept_bytes(raw, starts, starts + runs.field("strings").to_numpy() + length - 1)
                rows.append((removed, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                ["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    memory: int = MEMORY,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept_text``.

    ``kept_text`` leaves out bytes of characters that a removal has cut through.
    """
    return settled(docs.sparkSession, "suffix-dedup", lambda: _without_repeats(docs, id_col, text_col, length, gram, shard_bytes, memory, with_text))


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, shard_bytes: int, memory: int, with_text: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = scratch.save(
        keyed.groupBy("doc_id", "text_key").agg(
            F.count(F.lit(1)).alias("copies"),
            F.max(F.octet_length("text")).cast("long").alias("n_bytes"),
            F.max(F.sha2("text", 256)).alias("sha256"),
        ),
        "rows",
    )
    repeated = rows.filter("copies > 1").limit(1).count() > 0
    # Repeated rows are answered from their counts; the search sees each (id, text) once.
    searched = keyed.dropDuplicates(["doc_id", "text_key"]) if repeated else keyed
    found = searched.select("doc_id", "text_key", F.col("text_key").alias("row_id"), "text").mapInArrow(
        _find_contexts(length, gram), "doc_id long, text_key long, row_id long, anchor long, context long, start int, strings int"
    )
    # Frequent anchors are dealt by context, frequent contexts by row; the rest meet by anchor.
    frequent = scratch.save(
        found.select("anchor", "context").mapInArrow(_frequent(COUNTERS), "kind int, anchor long, context long, at_least long")
        .groupBy("kind", "anchor", "context")
        .agg(F.sum("at_least").alias("at_least"))
        .filter("at_least > 1")
        .withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("at_least"), "anchor", "context")))
        .filter(F.col("place") <= COUNTERS),
        "frequent",
    )
    hot_anchor = frequent.filter("kind = 0").select("anchor", F.lit(True).alias("hot_anchor"))
    hot_context = frequent.filter("kind = 1").select("anchor", "context", F.lit(True).alias("hot_context"))
    # Two tables of at most COUNTERS rows.
    salt = (
        F.when(F.col("hot_context"), F.pmod(F.xxhash64("row_id", "start"), F.lit(SALTS)) + SALTS)
        .when(F.col("hot_anchor"), F.pmod(F.xxhash64("context"), F.lit(SALTS)))
        .otherwise(-1)
    )
    dealt = found.join(F.broadcast(hot_anchor), "anchor", "left").join(F.broadcast(hot_context), ["anchor", "context"], "left").withColumn("salt", salt)
    together = Window.partitionBy("anchor", "salt")
    earlier = [F.col("doc_id").asc_nulls_last(), "row_id", "start"]
    several = F.count(F.lit(1)).over(together) > 1
    differ = F.min("context").over(together) != F.max("context").over(together)
    met = scratch.save(
        dealt.withColumn("copy", F.row_number().over(Window.partitionBy("anchor", "salt", "context").orderBy(*earlier)))
        .withColumn("hot", F.coalesce("hot_anchor", "hot_context", F.lit(False)))
        .withColumn("several", several)
        .withColumn("differ", differ)
        .filter("hot OR several AND (copy > 1 OR differ)")
        .select("doc_id", "text_key", "row_id", "anchor", "context", "start", "strings", "copy", F.coalesce("hot_context", F.lit(False)).alias("hot_context")),
        "met",
    )
    # Each salt of a frequent context has a first; one of those few is the first of all.
    first_of_all = F.row_number().over(Window.partitionBy("anchor", "context").orderBy(*earlier))
    columns = ["doc_id", "text_key", "row_id", "anchor", "start", "strings"]
    firsts = met.filter("hot_context AND copy = 1").select(*columns, (first_of_all > 1).alias("removed"))
    shared = met.filter("NOT (hot_context AND copy = 1)").select(*columns, (F.col("copy") > 1).alias("removed")).unionByName(firsts)
    candidates = shared.filter("NOT removed")
    per_anchor = scratch.save(
        candidates.groupBy("anchor").agg(F.sum(F.col("strings") + length).alias("bytes")), "anchors"
    )
    total = per_anchor.agg(F.sum("bytes")).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    large = per_anchor.filter(F.col("bytes") > shard_bytes / 2).select(
        F.col("anchor").alias("_anchor"), F.ceil(F.col("bytes") / (shard_bytes / 2)).cast("long").alias("_salts")
    )
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("row_id", "start"), F.coalesce("_salts", F.lit(1))) + 1).otherwise(0)
    dealt = candidates.join(large, F.col("anchor") == F.col("_anchor"), "left").select(
        "doc_id",
        "text_key",
        F.struct(
            "anchor",
            F.pmod(F.xxhash64("anchor", salt), F.lit(n_shards)).alias("shard"),
            F.col("_salts").isNotNull().alias("salted"),
            "row_id",
            "start",
            "strings",
        ).alias("context"),
    )
    by_doc = scratch.save(
        dealt.groupBy("doc_id", "text_key").agg(F.collect_list("context").alias("contexts")), "by-doc"
    )
    cut = _with_texts(keyed, by_doc, repeated).select("doc_id", "text", "contexts").mapInArrow(
        _cut_contexts(length), "doc_id long, anchor long, shard long, salted boolean, row_id long, start int, strings int, raw binary"
    )
    judged = scratch.save(
        cut.groupBy("shard").applyInPandas(
            lambda shard: repeated_strings(shard, length, memory), "doc_id long, row_id long, start int, strings int, digest binary"
        ),
        "judged",
    )
    same_string = Window.partitionBy("digest").orderBy(*earlier)
    seen_elsewhere = judged.filter("digest IS NOT NULL").withColumn("place", F.row_number().over(same_string)).filter("place > 1")
    columns = ["doc_id", "row_id", "start", "strings"]
    runs = (
        shared.filter("removed").select(*columns).unionByName(judged.filter("digest IS NULL").select(*columns)).unionByName(seen_elsewhere.select(*columns))
    )
    spans = scratch.save(
        runs.groupBy("doc_id", F.col("row_id").alias("text_key")).agg(F.collect_list(F.struct("start", "strings")).alias("runs")), "spans"
    )
    removed = scratch.save(
        _with_texts(keyed, spans, repeated)
        .select("doc_id", "text_key", "text", "runs")
        .mapInArrow(_remove(length), "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
        .drop(*([] if with_text else ["kept_text"])),
        "removed",
    )
    named = removed.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    out = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    first = out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        *(["text_key", "kept_text"] if with_text else []),
    )
    if with_text:
        texts = keyed.dropDuplicates(["doc_id", "text_key"]) if repeated else keyed
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
        first = (
            first.join(texts.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), on)
            .withColumn("kept_text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
            .drop("_id", "_key", "text", "text_key")
        )
    if repeated:
        long_enough = F.col("n_bytes") >= length
        more = rows.filter("copies > 1").withColumn("_again", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
        again = more.select(
            "doc_id",
            "n_bytes",
            F.when(long_enough, F.col("n_bytes")).otherwise(0).alias("n_removed"),
            long_enough.cast("long").alias("n_spans"),
            F.when(long_enough, F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")).alias("kept_sha256"),
            *([F.lit("").alias("kept_text")] if with_text else []),
        )
        first = first.unionByName(again)
    return first


def _with_texts(keyed: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """``wanted`` (by id and text key) with the texts. Only wanted texts are shuffled where their keys are few."""
    names = wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    if wanted.count() <= SMALL_ROWS:
        keyed = keyed.join(F.broadcast(names.select("_id", "_key")), on, "left_semi")
    if repeated:
        keyed = keyed.dropDuplicates(["doc_id", "text_key"])
    return keyed.join(names.hint("shuffle_merge"), on).drop("_id", "_key")
