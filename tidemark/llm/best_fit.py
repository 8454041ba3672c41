"""Best-fit-decreasing packing of token sequences over the length histogram.

Documents are tokenised where they lie. Only documents of more than ``max_len`` ids are cut: into
pieces of ``max_len``, of which the first may be shorter. Only the histogram of piece lengths
(``max_len`` counters, whatever the input) goes to the driver. There the lengths are placed longest
first, each into the open bin with the least room that still takes it; a segment tree over the
``max_len + 1`` possible remaining capacities finds that bin in logarithmic time. Bins with the same
contents are one entry with a count, and as a bin that took a piece and can take another of its
length is again the tightest, equal pieces are placed together: exactly the bins that placing
document by document gives. Pieces find their places by their rank among those of their length.
Ranks come from bucket counts and offsets, so a length that a third of the pieces have is spread
over many tasks.

Tokenising goes unit by unit (mostly words with the space before them) through a bounded cache. That
gives the ids of the whole text, as units end only where the tokenizer splits whatever surrounds them.

Defined cases: a null or empty text is the end id alone. Repeated rows are documents of their own.
A text that spells the vocabulary's special token gets its id, as the tokenizer does by default. An empty
table gives an empty result. Only the id and text columns are read; other columns may have any names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running_total

MAX_LEN = 2048
END_ID = 0
#: Two generations of this many units are remembered, none of more than ``LONGEST_UNIT`` characters.
CACHED_UNITS = 300_000
LONGEST_UNIT = 40

_SPACE = r" \t-\r"
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Units end where the tokenizer's own splitting always does: between a letter and an ASCII character
#: that is none, after ASCII digits or marks before one of another kind, and before ASCII white space.
#: An apostrophe may join what follows, and ``<`` and ``|`` may spell a special token; what starts
#: with them, or mixes other characters, runs on to the next ASCII white space.
_UNIT = re.compile(
    rf"[{_SPACE}]*+(?:[{_LETTER}]++(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|\Z)|[0-9]++(?=[\x00-\x2f\x3a-\x7f]|\Z)"
    rf"|[!-&(-/:;=-@\[-`{{}}~]++(?=[A-Za-z0-9{_SPACE}]|\Z)|[^{_SPACE}]++|\Z)"
)
#: Other white space joins the ASCII one after it.
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def units_of(text: str) -> list[str]:
    """The text in units whose ids, one after another, are the ids of the whole text."""
    units = _UNIT.findall(text)
    if text.isascii() or not _ODD_SPACE.search(text):
        return units
    joined: list[list[str]] = []
    for unit in units:
        if joined and _ODD_SPACE.match(joined[-1][-1][-1:]):
            joined[-1].append(unit)
        else:
            joined.append([unit])
    return ["".join(parts) for parts in joined]


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes; one per Python worker and file.

    The mapping holds the ids of units.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        super().__init__({"": b""})
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= LONGEST_UNIT:
            if len(self) >= CACHED_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, units_of(text)))


def cuts(n: int, max_len: int) -> list[int]:
    """Where the pieces of a document of ``n`` ids start: the first may be shorter, all others are full."""
    return [0, *range(n % max_len or max_len, n, max_len)]


def _cut(path: str, max_len: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(path), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = encoder.encode(texts[i].as_py() or "") + end
                n = len(ids) // 4
                starts = cuts(n, max_len)
                for number, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((doc_id, number, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


class CapacityTree:
    """Open bins by remaining capacity, under a segment tree of counts."""

    def __init__(self, max_len: int):
        self.leaves = 1 << max_len.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.counts[at] += bins
            at >>= 1

    def tightest(self, length: int) -> int:
        """The least room of at least ``length`` that an open bin has, or -1."""
        at = length + self.leaves
        if self.counts[at]:
            return length
        # Up to the first ancestor with bins to its right, then down to the leftmost of them.
        while at > 1 and (at & 1 or not self.counts[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.leaves:
            at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """Runs of places ``(length, first rank, pieces, first sequence, offset)``: rank r of a run lies in the (r - first rank)-th sequence.

    Work and result depend on the number of distinct lengths and of kinds of bins, not on the number of pieces.
    """
    tree = CapacityTree(max_len)
    # Bins with equal room: how many there are, and their contents as a chain of (length, times, rest).
    open_bins: dict[int, list[tuple[int, tuple | None]]] = {}

    def put(room: int, bins: int, contents: tuple | None) -> None:
        open_bins.setdefault(room, []).append((bins, contents))
        tree.add(room, bins)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                # As many empty bins as the rest of this length fills.
                room, bins, contents = max_len, -(-left // (max_len // length)), None
            else:
                bins, contents = open_bins[room].pop()
                tree.add(room, -bins)
            each = room // length
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            if full:
                put(room - each * length, full, (length, each, contents))
            if rest:
                put(room - rest * length, 1, (length, rest, contents))
            untouched = bins - full - (rest > 0)
            if untouched:
                put(room, untouched, contents)
            left -= full * each + rest
    runs, used, sequence = [], {}, 0
    for bins, contents in (kind for room in sorted(open_bins) for kind in open_bins[room]):
        chain = []
        while contents is not None:
            length, times, contents = contents
            chain.append((length, times))
        offset = 0
        for length, times in reversed(chain):
            for _ in range(times):
                rank = used.get(length, 0)
                runs.append((length, rank, bins, sequence, offset))
                used[length] = rank + bins
                offset += length
        sequence += bins
    return runs


def pack_best_fit(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = MAX_LEN,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = Scratch(spark, "best-fit").save(
        docs.select(F.col(id_col).alias("doc_id"), text_col)
        .mapInArrow(_cut(tokenizer_path, max_len, end_id), schema)
        .withColumn("row_id", F.monotonically_increasing_id()),
        "pieces",
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, sequence, offset in best_fit(histogram, max_len):
        runs.setdefault(length, []).append((rank, sequence, offset))
    places = {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in runs.items()}
    n_buckets = max(1, int(sum(histogram.values()) ** 0.5))
    ranked = running_total(
        pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "row_id"), F.lit(n_buckets))),
        "length",
        "bucket",
        [F.col("doc_id"), F.col("start"), F.col("row_id")],
        F.lit(1),
        "rank",
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            ranks = frame["rank"].to_numpy()
            for length, at in frame.groupby("length").indices.items():
                first, first_sequence, offsets = places[length]
                run = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at] = first_sequence[run] + ranks[at] - first[run]
                offset[at] = offsets[run]
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInPandas(place, f"{schema}, sequence_id long, offset long")
