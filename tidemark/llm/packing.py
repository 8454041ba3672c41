"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenised where they lie and cut into pieces of at most ``max_len`` ids. Only the
histogram of piece lengths (``max_len`` counters, whatever the input) goes to the driver, which
places lengths longest first: the open pattern with the most room left, i.e. the shortest pack,
that fits takes as many of the pieces as there are, and the counts of the patterns are updated.
The resulting patterns list, for each length, which ranks go to which sequences; each piece finds
its place by its rank among the pieces of its length. Ranks come from bucket counts and offsets,
so a length that a third of the pieces have is spread over many tasks.

Tokenising goes word by word through a bounded cache. That gives the ids of the whole text, as
this tokenizer drops white space and never lets a token or a normalisation cross it.

Defined cases: a null or empty text is the end id alone. Repeated rows are documents of their
own. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, running_total

MAX_LEN = 2048
END_ID = 1
CACHED_WORDS = 300_000
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokenizer(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes; one per Python worker and file.

    The mapping holds the ids of words. Words of letters, with or without closing punctuation, go
    straight to the byte-pair model, as neither normalisation nor splitting changes them once
    they are composed and in lower case; all others go through the whole tokenizer. Two
    generations of ``CACHED_WORDS`` words are kept.
    """

    _open: dict[str, WordTokenizer] = {}
    _PROBES = ("then", "\u00e9tait", "gr\u00f6\u00dfe", "then,", "ni\u00f1o...")

    def __init__(self, path: str):
        super().__init__({b"": b""})
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        # The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.direct = True
        self.direct = all(self._ids(w.encode()) == self._by_tokenizer(w) for w in self._PROBES)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self._ids(word)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def _by_tokenizer(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, word: bytes) -> bytes:
        if self.direct:
            core = word.rstrip(b".,;:!?()*%#&$\"-")
            if len(core) < len(word) and core:
                # Letters that grow when lowered may end in a mark, which joins the punctuation.
                if core.isalpha() or not core.isascii() and (text := core.decode()).isalpha() and len(text.lower()) == len(text):
                    return self[core] + self[word[len(core) :]]
            elif core:
                text = core.decode()
                if not text.isascii():
                    # A final sigma and letters that grow when lowered are left to the tokenizer.
                    lower = text.lower()
                    plain = lower.isalpha() and len(lower) == len(text) and "\u03c2" not in lower and "\u03c3" not in lower
                    text = lower.encode().decode("latin-1").translate(self.alphabet) if plain and unicodedata.is_normalized("NFC", text) else ""
                else:
                    text = text.lower() if text.isalpha() else ""
                if text:
                    ids = [t.id for t in self.model.tokenize(text)]
                    return struct.pack(f"<{len(ids)}I", *ids)
        return self._by_tokenizer(word.decode())

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        # Lower-casing A-Z first only merges cache entries, unless it could spell a special token.
        if b"<|" not in raw:
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.replace(b"\n", b" ").split(b" ")))


def _cut(path: str, max_len: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = tokenizer.encode(texts[i].as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, max_len):
                    piece = ids[4 * at : 4 * (at + max_len)]
                    rows.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return run


def packing_patterns(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first on counts: ``(lengths of one sequence, number of such sequences)``.

    Work and result depend on the number of distinct lengths, not on the number of pieces.
    """
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # heap of -room

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            heapq.heappush(rooms, -room)
        open_by_room[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not open_by_room[-rooms[0]]:
                del open_by_room[-heapq.heappop(rooms)]
            room = -rooms[0] if rooms else 0
            if room < length:
                put((length,), left, max_len - length)
                break
            pattern, count = open_by_room[room].pop()
            taken = min(count, left)
            if taken < count:
                open_by_room[room].append((pattern, count - taken))
            put((*pattern, length), taken, room - length)
            left -= taken
    return sorted(found for group in open_by_room.values() for found in group)


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequence ids and offsets of its runs of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in runs.items()}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = MAX_LEN,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.format(id=kind)
    pieces = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), text_col)
        .mapInArrow(_cut(tokenizer_path, max_len, end_id), schema)
        .withColumn("row_id", F.monotonically_increasing_id()),
        "pieces",
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = placements(packing_patterns(histogram, max_len))
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

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    return ranked.select(*columns).mapInPandas(place, f"{schema}, sequence_id long, offset long")
