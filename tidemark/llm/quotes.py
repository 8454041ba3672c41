"""Quotation linking: conversations in reply order, without the quotes.

Built-in functions only. Leading ``>`` marks give the level of each line; consecutive lines of one
level form a passage. Passages, and what the messages of the same conversation wrote themselves, are
normalised (lower case, single spaces) and divided into units in several ways: the whole text,
paragraphs, lines, and the sentences of either. A message covers a passage if in one of these ways
the passage's units are a run of its own. 64-bit hashes (of the SHA-256 of units) decide this: those of runs of 2, 4, 8, ... units
come from each other by doubling, and a run of any length is two of them that overlap. Messages are
only hashed for the run lengths that are quoted in their conversation. So a quote of any run of
whole paragraphs, lines or sentences is found, one cut within a sentence is not.

The latest earlier message that covers a first-level passage is the parent; deeper levels quote the
parent's own quotes and only count where the first level finds nothing. "Latest earlier" is a
running maximum over the turns of one hash, in buckets of a bounded number of rows, so a line that
all messages of a conversation quote costs no pairs and no large task.

The order comes from the tour around the reply trees (each message is entered, its replies are
visited, it is left): each event points to the one after it, and pointer doubling sums up what lies
behind. Every key is unique there, so n messages take log2(2n) joins without skew, however long
the chains are. Sorting a conversation by ``root_turn, position`` puts each reply after what it
answers.

Defined cases: null text counts as empty. A message whose passages are found nowhere, or that
quotes only itself or later messages, starts a tree of its own. Rows with the same conversation
and turn are one node of the tree and each keep their row. Null conversation or turn: the row is
returned as a root. An empty table gives an empty result. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MARKS = r"^\s{0,3}+((?:>\s?+)++)"
#: Rows of one hash that are ordered together.
BUCKET_ROWS = 4096
_WHITE = " \t\n\r\f\x0b"
#: Begins a passage while a text is taken apart; the text's own are escaped first.
_ESCAPE, _PASSAGE, _ITSELF = "﷐", "﷐﷑", "﷐﷒"


def _level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _passages(text: Column) -> Column:
    """The runs of lines of one level, as an array of (level, text)."""
    lines = F.split(F.replace(text, F.lit(_ESCAPE), F.lit(_ITSELF)), r"\r?\n", -1)
    previous = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.size(lines) - 1))

    def with_head(line: Column, before: Column) -> Column:
        head = F.concat(F.lit(_PASSAGE), _level(line).cast("string"), F.lit(":"))
        new = before.isNull() | (_level(line) != _level(before))
        return F.concat(F.when(new, head).otherwise(""), F.regexp_replace(line, MARKS, ""))

    found = F.split(F.array_join(F.zip_with(lines, previous, with_head), "\n"), r"\n?+" + _PASSAGE, -1)
    body = lambda p: F.replace(F.substring(p, F.instr(p, ":") + 1, F.char_length(p)), F.lit(_ITSELF), F.lit(_ESCAPE))
    return F.transform(
        F.slice(found, F.lit(2), F.size(found)),
        lambda p: F.struct(F.substring_index(p, ":", 1).cast("int").alias("level"), body(p).alias("text")),
    )


def _units(text: Column) -> Column:
    """The normalised units of a text: as a whole, its paragraphs, its lines, the sentences of either."""
    some = lambda parts: F.filter(F.transform(parts, _normal), lambda u: u != "")
    sentences = lambda units: F.flatten(F.transform(units, lambda u: F.split(u, r"(?<=[.!?])\s+")))
    paragraphs, lines = some(F.split(text, r"\n\s*\n")), some(F.split(text, r"\n"))
    return F.array_distinct(F.array(some(F.array(text)), paragraphs, lines, sentences(lines), sentences(paragraphs)))


def _run_digests(rows: DataFrame, longest: int) -> DataFrame:
    """``rows`` (``units`` and the wanted ``lengths``) with ``digest``, one row for each run of such a length."""
    rows = rows.withColumn("run_0", F.transform("units", lambda u: F.xxhash64(F.sha2(u, 256)))).withColumn("n", F.size("units")).drop("units")
    powers = [1]
    while 2 * powers[-1] <= longest:
        size, last = powers[-1], len(powers) - 1
        here = F.col(f"run_{last}")
        n = F.greatest(F.size(here) - size, F.lit(0))
        joined = F.zip_with(F.slice(here, F.lit(1), n), F.slice(here, F.lit(1 + size), n), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn(f"run_{last + 1}", joined)
        powers.append(2 * size)
    dealt = rows.withColumn("length", F.explode("lengths")).filter("length <= n")
    found = F.lit(None).cast("array<long>")
    for i, size in reversed(list(enumerate(powers))):
        here, more = F.col(f"run_{i}"), F.col("length") - size
        runs = F.zip_with(F.slice(here, F.lit(1), F.size(here) - more), F.slice(here, more + 1, F.size(here)), lambda a, b: F.xxhash64(F.col("length"), a, b))
        found = F.when(F.col("length").between(size, 2 * size - 1), runs).otherwise(found)
    return (
        dealt.withColumn("found", found)
        .drop("n", "length", "lengths", *[f"run_{i}" for i in range(len(powers))])
        .withColumn("digest", F.explode(F.array_distinct("found")))
        .drop("found")
    )


def latest_earlier(rows: DataFrame, keys: list[str], at: str, counts: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows``, distinct by ``keys`` and ``at``, with the largest smaller ``at`` of the same keys where ``counts`` holds.

    Keys with many rows are cut into buckets of ``at``; a running maximum over buckets precedes the
    one inside each.
    """
    spans = rows.groupBy(*keys).agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > bucket_rows)
    width = F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_rows") / bucket_rows))
    bucket = F.coalesce(F.floor((F.col(at) - F.col("_low")) / width), F.lit(0))
    dealt = rows.join(spans, keys, "left").withColumn("_bucket", bucket).drop("_low", "_high", "_rows")
    value = F.when(F.col(counts), F.col(at))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy(*keys, "_bucket").agg(F.max(value).alias("_in")).withColumn("_before", F.max("_in").over(before)).drop("_in")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn(out, F.max(value).over(inside)).join(earlier, [*keys, "_bucket"]).withColumn(out, F.coalesce(out, "_before")).drop("_bucket", "_before")
    )


def link_quotations(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message: ``conv_id, turn, role, text, n_quoted, parent_turn, root_turn, depth, position``."""
    scratch = Scratch(messages.sparkSession, "quotes")
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    quoting = raw.rlike(r"(?m)^\s{0,3}+>")
    parsed = messages.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        # Runs are only built for messages that quote; any other one is a single own passage.
        F.when(quoting, _passages(raw)).otherwise(F.array(F.struct(F.lit(0).alias("level"), raw.alias("text")))).alias("passages"),
    )
    own = F.array_join(F.transform(F.filter("passages", lambda p: p.getField("level") == 0), lambda p: p.getField("text")), "\n")
    cleaned = parsed.select(
        "conv_id",
        "turn",
        "role",
        F.btrim(F.regexp_replace(own, r"\n{3,}+", "\n\n"), F.lit(_WHITE)).alias("text"),
        F.filter("passages", lambda p: (p.getField("level") > 0) & (_normal(p.getField("text")) != "")).alias("quoted"),
    )
    quoted = scratch.save(
        cleaned.filter((F.size("quoted") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn", F.explode("quoted").alias("passage"))
        .select("conv_id", "turn", F.col("passage.level").alias("level"), F.explode(_units(F.col("passage.text"))).alias("units"))
        .filter(F.size("units") > 0)
        .withColumn("lengths", F.array(F.size("units"))),
        "quoted",
    )
    longest = quoted.agg(F.max(F.size("units"))).first()[0] or 1
    asked = _run_digests(quoted, longest).groupBy("conv_id", "turn", "digest").agg(F.min("level").alias("level"))
    # What each message of a conversation with quotes wrote itself, in runs of the quoted lengths.
    lengths = quoted.groupBy("conv_id").agg(F.collect_set(F.size("units")).alias("lengths"))
    written = _run_digests(
        cleaned.filter("turn IS NOT NULL").join(lengths, "conv_id").select("conv_id", "turn", "lengths", F.explode(_units(F.col("text"))).alias("units")), longest
    ).select("conv_id", "turn", "digest", F.lit(None).cast("int").alias("level"))
    marked = scratch.save(
        asked.select("conv_id", "turn", "digest", "level", F.lit(False).alias("writes"))
        .unionByName(written.withColumn("writes", F.lit(True)))
        .groupBy("conv_id", "digest", "turn")
        .agg(F.min("level").alias("level"), F.max("writes").alias("writes")),
        "marked",
    )
    parents = scratch.save(
        latest_earlier(marked, ["conv_id", "digest"], "turn", "writes", "by_turn")
        .filter("level IS NOT NULL AND by_turn IS NOT NULL")
        .groupBy("conv_id", "turn")
        .agg(F.max(F.struct(-F.col("level"), "by_turn")).alias("best"))
        .select("conv_id", "turn", F.col("best.by_turn").alias("parent_turn")),
        "parents",
    )
    places = _reply_order(parents, scratch)
    scratch.drop("quoted", "marked")
    return cleaned.join(places, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.size("quoted").cast("long").alias("n_quoted"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce(F.col("depth"), F.lit(0)).cast("long").alias("depth"),
        F.coalesce(F.col("position"), F.lit(0)).cast("long").alias("position"),
    )


def _reply_order(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, parent_turn, root_turn, depth, position`` for each message of a tree of several."""
    keys = ["conv_id", "parent_turn"]
    child = scratch.save(latest_earlier(parents.withColumn("_all", F.lit(True)), keys, "turn", "_all", "sibling").drop("_all"), "children")
    ends = child.groupBy(*keys).agg(F.min("turn").alias("first"), F.max("turn").alias("last")).withColumnRenamed("parent_turn", "turn")
    nodes = (
        child.select("conv_id", "turn").unionByName(ends.select("conv_id", "turn")).distinct().join(ends, ["conv_id", "turn"], "left")
    )
    event = lambda turn, leaves: F.struct(F.col(turn).alias("turn"), F.lit(leaves).alias("leaves"))
    entered = nodes.select(
        "conv_id",
        event("turn", False).alias("event"),
        F.when(F.col("first").isNotNull(), event("first", False)).otherwise(event("turn", True)).alias("next"),
    )
    following = child.filter("sibling IS NOT NULL").select("conv_id", event("sibling", True).alias("event"), event("turn", False).alias("next"))
    lasts = ends.select("conv_id", event("last", True).alias("event"), event("turn", True).alias("next"))
    left = nodes.select("conv_id", event("turn", True).alias("event")).join(following.unionByName(lasts), ["conv_id", "event"], "left")
    # ``entries`` and ``rise`` sum over the events from this one up to, without, the one it points to.
    tour = scratch.save(
        entered.unionByName(left.select("conv_id", "event", "next"))
        .withColumn("entries", F.when(F.col("event.leaves"), 0).otherwise(1).cast("long"))
        .withColumn("rise", F.when(F.col("event.leaves"), -1).otherwise(1).cast("long"))
        .withColumn("end", F.when(F.col("next").isNull(), F.col("event.turn"))),
        "tour-0",
    )
    step = 0
    while tour.filter("next IS NOT NULL").limit(1).count():
        behind = tour.select(
            "conv_id", F.col("event").alias("next"), F.col("next").alias("_next"), F.col("entries").alias("_entries"), F.col("rise").alias("_rise"), F.col("end").alias("_end")
        )
        step += 1
        tour = scratch.save(
            tour.join(behind, ["conv_id", "next"], "left").select(
                "conv_id",
                "event",
                F.col("_next").alias("next"),
                (F.col("entries") + F.coalesce("_entries", F.lit(0))).alias("entries"),
                (F.col("rise") + F.coalesce("_rise", F.lit(0))).alias("rise"),
                F.coalesce("end", "_end").alias("end"),
            ),
            f"tour-{step}",
        )
        scratch.drop(f"tour-{step - 1}")
    entries = tour.filter("NOT event.leaves").select("conv_id", F.col("event.turn").alias("turn"), "entries", (-F.col("rise")).alias("depth"), F.col("end").alias("root_turn"))
    total = entries.filter("turn = root_turn").select("conv_id", "root_turn", F.col("entries").alias("total"))
    return (
        entries.join(total, ["conv_id", "root_turn"])
        .withColumn("position", F.col("total") - F.col("entries"))
        .join(child.select("conv_id", "turn", "parent_turn"), ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "parent_turn", "root_turn", "depth", "position")
    )
