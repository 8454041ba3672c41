"""The corpus operators against brute force, on small fixtures with nulls, ties and repeated rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest
from conftest import SMALL
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, induced_sort, langid, mixing, neardup, packing, pii, queries, quotes, suffix_dedup, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int"


def fixture(spark):
    base = "the quick brown fox jumps over the lazy dog while the cat sleeps on a warm mat near the old stone wall by the river " * 3
    texts = [
        None,
        "",
        " \t\n",
        base,
        base,
        base + "x",
        base.replace("fox", "wolf", 1),
        "one",
        "one two",
        "ONE\ttwo",
        "é" * 300,
        "ab" * 400,
        "Der Hund und die Katze",
        base.upper(),
        "long " * 5000,
    ]
    rows = [(i, t, "de" if t and "Hund" in t else "en", f"s{i % 3}" if i % 4 else None, 0, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base, None, "s1", 0, "x", 1), (None, "one", None, "s1", 0, "x", 1)]
    return rows, spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark):
    rows, docs = fixture(spark)
    got = exact_dedup.exact_dedup(docs, counters=2).collect()
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(digest(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        assert r.keep_id == min(groups[r.text_sha256])[3] and r.group_size == len(groups[r.text_sha256])
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_and_top_k_match_sql(spark):
    for name in ("op6_exact_dedup", "op1_topk_search"):
        got = queries.QUERIES[name](spark, SMALL).toPandas()
        assert oracle.normal(got) == oracle.normal(oracle.by_sql(queries.ORACLES[name], SMALL))


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, float("nan")]), (1, None), (2, [0.5]), (3, [0.5, 0.0]), (4, [-1.0, None]), (None, [1.0, 1.0]), (3, [0.5, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(vectors, lambda i: i % 20 == 0, k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2048), (0, 2, 3, 2048), (0, 3, 3, 2048)]
    assert topk.top_k(vectors.limit(0), lambda i: i % 20 == 0).count() == 0


def test_mixing(spark):
    rows, docs = fixture(spark)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = lambda t: len(WORD.findall(t or ""))
    per = Counter()
    for _, text, _, source, *_ in rows:
        per[source] += size(text)
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(per.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * per[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * per[s] for s in over}
        left -= sum(2.0 * per[s] for s in over)
        free -= over
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(size(r[1]) for r in rows)
    for source in names:
        mine = [r for r in got if r.mixed_source == source]
        assert all(abs(r.target - target[source]) < 1e-6 and r.source_size == per[source] and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[source]) <= max(r.size for r in mine) / 2 + 1
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, rng.integers(20, 120)))
        for _ in range(8):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[at] = "z" + str(rng.integers(9))
            texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "w1 w2"), (903, "W1  w2"), (904, texts[0])]
    sets = {i: shingles(t, 3) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, words=3, similarity=(85, 100)).collect()}
    assert {i: (len(s), find(i), find(i) == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert neardup.near_duplicates(empty(spark)).count() == 0
    mixed, full = fixture(spark)
    assert neardup.near_duplicates(full).count() == len(mixed)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    word = lambda name, n=40: [f"{name}{i}" for i in range(n)]
    a, b, c, clean, other = (" ".join(word(x)) for x in ("a", "b", "c", "d", "e"))
    rows = [
        (3, a),
        (7, a + " end"),  # a copy of document 3 ...
        (7, clean),  # ... whose id another document has too
        (None, a + " tail"),  # a copy without an id ...
        (None, other),  # ... beside a clean document without one
        (None, b),  # a group whose rows all lack an id
        (None, b + " end"),
        (None, b),
        (9, c),  # identical rows
        (9, c),
        (8, c + " end"),
        (None, None),
        (None, ""),
        (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in neardup.keep_one_of_each_group(docs).collect()]
    group_b = [r for r in kept if r[1] and r[1].startswith("b0")]
    assert len(group_b) == 1 and group_b[0] in ((None, b), (None, b + " end"))
    want = [(3, a), (7, clean), (None, other), (8, c + " end"), (None, None), (None, ""), (None, "")]
    assert sorted(map(str, kept)) == sorted(map(str, want + group_b))
    assert sum(r.kept for r in neardup.near_duplicates(docs).collect()) == len(want) + 1
    same = spark.createDataFrame([(9, c), (9, c), (10, a), (None, ""), (None, "")], "doc_id long, text string")
    assert sorted(map(str, neardup.keep_one_of_each_group(same).collect())) == sorted(map(str, [Row(doc_id=i, text=t) for i, t in ((9, c), (10, a), (None, ""), (None, ""))]))


def test_overlaps_count_each_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 90))) for _ in range(70)] + [np.arange(5)]
    want = [[len(np.intersect1d(x, y)) for y in sets[30:]] for x in sets[:40]]
    assert (neardup.overlaps(sets[:40], sets[30:], width=7) == want).all()


def test_frequent_lists_are_divided(spark, monkeypatch):
    """Templates below the threshold, with true copies of several sizes among them, in blocks of few sets."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 8)
    common = " ".join(f"c{i}" for i in range(11))
    long = " ".join(f"l{i}" for i in range(90))
    texts = [f"{common} own{i}" for i in range(60)] + [common]
    texts += [f"{common} x{i % 4} y{i % 4} z{i}" for i in range(12)]
    texts += [f"{long} {' '.join(f'm{i % 3}v{j}' for j in range(20))} t{i}" for i in range(24)]
    rows = list(enumerate(texts))
    sets = {i: shingles(t, 3) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=3, similarity=(85, 100)).collect()}
    assert got == {i: find(i) for i in sets} and 1 < len(set(got.values())) < len(texts)

    # Of one frequent list of sets of 10 with 9 common values no pair is compared; beside a set of 9 only pairs with that one.
    entry = lambda i, n: (1, i, n, 9, i)
    schema = "value long, cls long, n long, rest int, label long"
    for members, want in (([entry(i, 10) for i in range(50)], Counter()), ([*(entry(i, 10) for i in range(50)), entry(99, 9)], Counter({(9, 9, 0): 1, (9, 10, 0): 1, (9, 10, 1): 50}))):
        sized = neardup._by_sizes(spark.createDataFrame(members, schema), (85, 100), 64, neardup.Scratch(spark, "test")).collect()
        assert Counter((r.size_a, r.size_b, r.side) for r in sized) == want


@pytest.mark.parametrize("memory", [7, 1 << 20])
def test_induced_sort(memory):
    rng = np.random.default_rng(memory)
    for letters, n in ((2, 300), (3, 50), (200, 400), (1, 30), (2, 1500)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        raw = text.tobytes()
        blocks = list(induced_sort.suffix_order(text, 256, 40, memory))
        order, shared = (np.concatenate(x).tolist() for x in zip(*blocks, strict=True))
        assert sorted(order) == list(range(n))
        assert [raw[i : i + 40] for i in order] == sorted(raw[i : i + 40] for i in range(n)) or letters == 1
        for before, at, common in zip(order[:-1], order[1:], shared[1:], strict=True):
            a, b = raw[before : before + 40], raw[at : at + 40]
            assert common == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_induced_sort_keeps_few_tuples_in_memory(monkeypatch):
    """A hundredth of the shard's tuples in RAM: most go through the files."""
    queues = []
    real = induced_sort.SpooledQueues

    class Watched(real):
        most = 0

        def __init__(self, *args):
            super().__init__(*args)
            queues.append(self)

        def push(self, c, tuples):
            super().push(c, tuples)
            self.most = max(self.most, self.held)

    monkeypatch.setattr(induced_sort, "SpooledQueues", Watched)
    text = np.frombuffer((b"some words that come again and again, " * 3 + b"others do not %d ") * 1500, np.uint8)
    memory = len(text) // 100
    assert sum(len(b) for b, _ in induced_sort.suffix_order(text, 256, 100, memory)) == len(text)
    assert all(q.most <= memory for q in queues) and sum(q.spooled for q in queues) > len(text)


@pytest.mark.parametrize(("shard", "counters"), [(600, 3), (1 << 22, 1024)])
def test_suffix_dedup(spark, monkeypatch, shard, counters):
    monkeypatch.setattr(suffix_dedup, "COUNTERS", counters)
    _, docs = fixture(spark)
    line = "This line is found in very many documents, word by word, and it is a bit longer than a hundred bytes in all."
    more = [(100 + i, f"{'x' * i}{i} {line} {i * i} end", None, "s", 0, "x", 1) for i in range(40)] + [(200 + i, line, None, "s", 0, "x", 1) for i in range(20)]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS)).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen, want = set(), []
    by_hash = {(r.doc_id, r.text): r.h for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, by_hash[r])):
        raw = (text or "").encode()
        covered = np.zeros(len(raw), int)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                covered[s : s + 100] = 1
            seen.add(raw[s : s + 100])
        left = np.frombuffer(raw, np.uint8)[covered == 0].tobytes()
        spans = int((np.diff(np.append(0, covered)) == 1).sum())
        want.append((doc_id, len(raw), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, shard_bytes=shard, memory=500).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rows, docs = fixture(spark)
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    got = packing.pack(docs, queries.tokenizer_file()).toPandas()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[(-1 if doc_id is None else doc_id, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.start, got.length, got.ids_crc32, got.doc_tokens, strict=True)) == want
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        ends = sequence.length.cumsum()
        assert (sequence.offset == ends - sequence.length).all() and ends.max() <= 2048
    assert packing.pack(empty(spark), queries.tokenizer_file()).count() == 0


def test_packing_patterns_place_each_piece_once():
    histogram = {2048: 3, 1500: 4, 900: 10, 548: 7, 300: 11, 5: 100}
    patterns = packing.packing_patterns(histogram)
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 2048
        for length in lengths:
            placed[length] += count
    assert placed == histogram


def test_language_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(docs).withColumnRenamed("doc_id", "id").join(docs, F.col("id") == F.col("doc_id")).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    rows, mixed = fixture(spark)
    found = langid.identify(mixed).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.lang_pred == "und" for r in found if r.doc_id in (0, 1, 2))
    assert langid.identify(empty(spark)).count() == 0
    assert langid.identified_documents(mixed).count() == len(rows) - 3


def test_pseudonyms(spark):
    rows = [
        (1, "a 4111111111111111, 4111 1111 1111 1111 and 4111111111111112; 10.1.2.3 on 2021-02-28, 28.02.2021, 2021-02-30"),
        (2, "4111111111111111 +1 (017) 555-7713 ab.c9@mail.example.com 078-05-1120 300.1.1.1"),
        (3, None),
        (4, ""),
        (5, "clean words only"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    one, two = got[1].text.split(), got[2].text.split()
    card = one[1].rstrip(",")
    luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card)))
    assert card != "4111111111111111" and card[0] == "4" and luhn % 10 == 0 and two[0] == card and "".join(one[2:6]) == card
    assert one[7] == "4111111111111112;" and one[-1] == "2021-02-30"
    iso, dotted = one[-3].rstrip(","), one[-2].rstrip(",")
    assert iso != "2021-02-28" and ".".join(reversed(iso.split("-"))) == dotted
    assert two[1] == "+1" and re.fullmatch(r"\(\d{3}\)", two[2]) and re.fullmatch(r"\d{3}-\d{4}", two[3])
    assert re.fullmatch(r"[a-z]{2}\.[a-z]\d@mail\.example\.com", two[4]) and two[4] != "ab.c9@mail.example.com"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", two[5]) and two[5] != "078-05-1120" and two[6] == "300.1.1.1"
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "clean words only") and got[5].n_replaced == 0
    assert pii.pseudonymise(empty(spark), "key").count() == 0


def test_pseudonyms_of_values_beside_others_and_in_other_notations(spark):
    card, invalid = "4111 1111 1111 1111", "4111 1111 1111 1112"
    secrets = [
        (f"order 1234 {card}", card),
        (f"in 2021 {card}", card),
        (f"+14155550123 {card}", card),
        (f"+49 30 12345678 {card}", "12345678"),
        ("call 415-555-0123 now", "415-555-0123"),
        ("call +14155550123.", "4155550123"),
        ("call +49 30 12345678", "30 12345678"),
        ("call +33 1 42 68 53 00", "1 42 68 53 00"),
        ("call 01 42 68 53 00", "1 42 68 53 00"),
        ("on 2021/03/04", "2021/03/04"),
        ("on 3 March 2021", "3 March 2021"),
        ("on Mar 3, 2021 or", "Mar 3, 2021"),
    ]
    clean = [f"no {invalid}", "on 31 June 2021", "page 1234 of 2021", "2021/13/45"]
    rows = list(enumerate([t for t, _ in secrets] + clean))
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    shape = lambda t: re.sub(r"\d", "0", t)
    for i, (text, secret) in enumerate(secrets):
        assert secret not in got[i], text
        assert i >= 10 or shape(got[i]) == shape(text), text
    assert got[0].startswith("order 1234 4") and got[1].startswith("in 2021 4") and got[0][-19:] == got[1][-19:] == got[2][-19:] == got[3][-19:]
    assert re.fullmatch(r"on \d{1,2} [A-Z][a-z]+ \d{4}", got[10]) and re.fullmatch(r"on [A-Z][a-z]{2} \d{1,2}, \d{4} or", got[11])
    assert [got[len(secrets) + i] for i in range(len(clean))] == clean


def test_feistel_is_a_permutation(spark):
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pii.permuted_digits("key", "test", F.col("d"))).distinct().count() == 1000
    days = spark.range(2000).select(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int") * 73).alias("d"))
    assert days.select(pii.permuted_day("key", F.col("d")).alias("p")).filter("p IS NOT NULL").distinct().count() == 2000


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"),
        (1, 1, "assistant", "> How are you?\nFine.\n\nAnd you?"),
        (1, 2, "user", ">> How are you?\n> Fine.\nGood."),
        (1, 3, "assistant", "> And   YOU?\nok"),
        (1, 4, "user", "> nothing\n"),
        (2, 0, "user", None),
        (None, None, None, "x"),
        (2, 1, "user", "> > a"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert [(got[1, t].parent_turn, got[1, t].depth, got[1, t].text) for t in range(5)] == [
        (None, 0, "Hello there.\nHow are you?"),
        (0, 1, "Fine.\n\nAnd you?"),
        (1, 2, "Good."),
        (1, 2, "ok"),
        (None, 0, ""),
    ]
    assert [(got[1, t].root_turn, got[1, t].position) for t in range(5)] == [(0, 0), (0, 1), (0, 2), (0, 3), (4, 0)]


def test_partial_quotations(spark):
    first = "One is here. Two is there. Three is gone.\n\nNext part,\nsecond line,\nthird line.\n\nLast part."
    rows = [
        (0, first),
        (1, "Something else.\nsecond line,\n\nthird line, other"),
        (2, "> One is here. Two is there. Three is gone.\n>\n> Next part,\n> second line,\n> third line.\nTwo paragraphs"),
        (3, "> Next part,\n> second line,\nTwo lines"),
        (4, "> Two is there.\nOne sentence"),
        (5, "> Two is there.\n> Three is gone.\nTwo sentences in lines of their own"),
        (6, "> Three is gone.\n> One is here.\nNot in this order"),
        (7, "> second line,\n> third line, other\nOf the later message"),
        (8, "> Two is\nCut within a sentence"),
    ]
    docs = spark.createDataFrame([(1, t, "user", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.parent_turn for r in quotes.link_quotations(docs).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: 0, 6: None, 7: 1, 8: None}


def test_warc(spark):
    page = "<html lang='en'><head><title>A &amp; B</title></head><body><script>x</script><p>One &lt;two</p><a href='/z'>link</a></body></html>"
    rows = [Row(page_id=1, url="http://a/", html=page), Row(page_id=2, url=None, html=None)]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.record_type for r in got] == ["metadata", "conversion"] * 2 and len({r.record_id for r in got}) == 4
    meta, text = got[:2]
    assert meta.refers_to == text.refers_to and meta.text == "title: A & B\r\nlanguage: en\r\noutlink: /z L a/@href\r\n"
    assert text.text == "One <two\nlink" and text.source_headers.startswith("HTTP/1.1 200")
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == r.text.encode() + b"\r\n\r\n" and f"Content-Length: {len(r.text.encode())}" in head.decode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.text.encode()).digest()).decode()


def test_warc_open_heads_and_source_fields(spark):
    body = "<p>All of the page</p>"
    for page in (
        f"<html><head><title>T</title><body>{body}</body></html>",
        f"<html><head><meta charset=utf-8><title>T</title><style>p {{}}</style>{body}",
        f"<title>T</title>{body}",
        f"<html><head><title>T</title></head><body>{body}</body></html>",
    ):
        assert warc.plain_text(page) == "All of the page"
    docs = spark.createDataFrame([(1, "http://a/", body)], "page_id long, url string, html string")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
    for r in warc.derivatives(docs, headers=F.lit("HTTP/1.1 203 X\r\nServer: s")).collect():
        head = bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n")
        assert f"WARC-Source-Payload-Digest: {digest}" in head
        assert [x for x in head if "HTTP-Header" in x] == ["WARC-Source-HTTP-Header: HTTP/1.1 203 X", "WARC-Source-HTTP-Header: Server: s"]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    columns = docs.columns
    before = docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        if number < 3:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.count() > 0
