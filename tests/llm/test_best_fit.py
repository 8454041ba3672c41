"""Best-fit packing: bins against placing one by one, ids against the tokenizer, rows against the whole table."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
from conftest import SMALL

from tidemark.llm import best_fit, queries

PATH = queries.tokenizer_file("byte_bpe_50k.json")


def one_by_one(lengths, max_len):
    """Contents of all bins when each piece, longest first, goes to the tightest open bin."""
    rooms = []  # (room, -number): of equal rooms any bin may be taken
    bins = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, (length,))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = max_len, len(bins)
            bins.append([])
        bins[number].append(length)
        bisect.insort(rooms, (room - length, number))
    return bins


def packed(histogram, max_len):
    bins = {}
    seen = {}
    for length, rank, n, sequence, offset in best_fit.best_fit(histogram, max_len):
        assert rank == seen.get(length, 0)
        seen[length] = rank + n
        for i in range(n):
            bins.setdefault(sequence + i, []).append((offset, length))
    assert seen == {k: v for k, v in histogram.items() if v}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_len
    return bins


def test_bins_are_those_of_placing_one_by_one():
    draw = random.Random(7)
    for trial in range(300):
        max_len = draw.choice([1, 2, 7, 16, 31, 100])
        kinds = draw.randrange(1, 12)
        histogram = Counter(draw.choice([draw.randrange(1, max_len + 1) for _ in range(kinds)]) for _ in range(draw.choice([1, 5, 60, 400])))
        got, want = packed(histogram, max_len), one_by_one(histogram.elements(), max_len)
        # Bins of equal room may be taken in any order; the rooms that stay open are the same.
        assert sorted(sum(n for _, n in b) for b in got.values()) == sorted(map(sum, want)), (trial, histogram)
    assert packed({}, 8) == {}
    huge = best_fit.best_fit({2048: 10**12, 1500: 10**12, 548: 10**12 + 5, 1: 10**13})
    assert sum(n for length, _, n, _, _ in huge if length == 1) == 10**13 and len(huge) < 10_000


def test_segment_tree_against_a_scan():
    draw = random.Random(1)
    for max_len in (1, 5, 64, 100):
        tree, counts = best_fit.CapacityTree(max_len), [0] * (max_len + 1)
        for _ in range(500):
            room = draw.randrange(max_len + 1)
            change = draw.choice([1, 3, -counts[room]])
            counts[room] += change
            tree.add(room, change)
            length = draw.randrange(1, max_len + 1)
            assert tree.tightest(length) == next((r for r in range(length, max_len + 1) if counts[r]), -1)


def test_ids_of_units_are_those_of_the_whole():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    draw = random.Random(2)
    alphabets = [
        "ab c",
        "aB1 .,'sx\n\t",
        "a   \x1c\x85z \xa0\u2003\u3000\n",
        ["don't", "we'll", "'s", "'", " ", "it'S", "12", ",", "'re"],
        "é\u0301中😀 aß½²٣,1",
        ["<|endoftext|>", " ", "a", "<|", "|>", "<", "|", ","],
        "".join(map(chr, range(0x20, 0x250))),
        "".join(map(chr, [*range(0x370, 0x530), 32, 46])),
        "\u180e\u200b\ufeff a\u2028.",
    ]
    encoder = best_fit.Encoder(PATH)
    for _ in range(9000):
        pool = draw.choice(alphabets) if draw.random() < 0.6 else [*draw.choice(alphabets), *draw.choice(alphabets)]
        text = "".join(draw.choice(pool) for _ in range(draw.randrange(60)))
        assert "".join(best_fit.units_of(text)) == text
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_cache_stays_bounded(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(best_fit, "CACHED_UNITS", 7)
    encoder, whole = best_fit.Encoder(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"{chr(97 + i % 26)}{'word' * (i % 13)} {i % 40}," for i in range(2000))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(encoder) <= 7 and len(encoder.older) <= 7 and all(len(u) <= best_fit.LONGEST_UNIT for u in encoder)


def check(rows, docs, max_len):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % max_len or max_len
        starts = [0, *range(first, len(ids), max_len)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_len
    assert len(sequences) == len(one_by_one([r.length for r in rows], max_len))
    return sequences


def test_whole_smallest_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.QUERIES["op13_best_fit_packing"](spark, SMALL).collect()
    check(rows, docs, 2048)


def test_edges(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "<|endoftext|>"), (3, "a" * 2_000_000), (4, "x y " * 300_000), (5, "\u0000\n\n"), (6, "one"), (6, "one")]
    table = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, piece int, rank string").repartition(4)
    check(best_fit.pack_best_fit(table, PATH).collect(), docs, 2048)
    check(best_fit.pack_best_fit(table.filter("doc_id <> 3"), PATH, max_len=1).collect(), [d for d in docs if d[0] not in (3, None)], 1)
    assert best_fit.pack_best_fit(table.limit(0), PATH).count() == 0
