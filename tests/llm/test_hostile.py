"""Texts built to break patterns: very long runs, repeated marks, quadratic traps. Each must take seconds."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from tidemark.llm import langid, mixing, neardup, packing, pii, queries, quotes, topk, warc

MANY = 100_000


def within(seconds, job):
    began = time.monotonic()
    found = job()
    assert time.monotonic() - began < seconds
    return found


def test_pseudonyms_of_hostile_texts(spark):
    card = "4111 1111 1111 1111"
    texts = [
        "a" * 10_000_000,
        "a@" + "b." * MANY,
        "a@b." * MANY,
        "1 " * (10 * MANY),
        "1" * (10 * MANY),
        (card + " ") * MANY,
        "0" + "1-" * MANY,
        "+1" + " (" * MANY,
        "AB12 " * MANY,
        "﷐﷑" * MANY,
        "." * MANY + "a.b@c.de",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = within(60, lambda: {r.doc_id: r for r in pii.pseudonymise(docs, "key").collect()})
    for i in (0, 1, 2, 3, 4, 7, 8, 9):
        assert got[i].text == texts[i] and got[i].n_replaced == 0, i
    assert got[5].n_replaced == MANY and len(set(got[5].text.split("4")[1:2])) == 1 and card not in got[5].text
    assert len(got[10].text) == len(texts[10])


def test_pseudonyms_keep_marks_and_find_ibans(spark):
    iban, compact = "DE89 3704 0044 0532 0130 00", "NO9386011117947"
    rows = [(0, "﷐ ﷐﷑ 10.1.2.3 ﷐﷓x"), (1, f"pay {iban} now"), (2, compact), (3, "DE89 3704 0044 0532 0130 01"), (4, "jürgen.ж@mail.de x")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert got[0].startswith("﷐ ﷐﷑ ") and got[0].endswith(" ﷐﷓x") and "10.1.2.3" not in got[0]
    for text, other in ((iban, got[1][4:-4]), (compact, got[2])):
        assert other != text and len(other) == len(text) and other[:2] == text[:2]
        plain = other.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[3] == rows[3][1]
    name = got[4].split("@")[0]
    assert got[4].endswith("@mail.de x") and name != "jürgen.ж" and name[6] == "." and "а" <= name[7] <= "я" and not name[1].isascii()


def test_key_is_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "10.1.2.3")], "doc_id long, text string")
    found = pii.pseudonymise(docs, "not-to-be-seen")
    assert "not-to-be-seen" not in found._jdf.queryExecution().toString()
    found.collect()
    assert "not-to-be-seen" not in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


SCHEMA = "conv_id long, turn long, role string, text string"


def test_quotations_of_hostile_texts(spark):
    rows = [
        (1, 0, "user", ">" * MANY),
        (1, 1, "user", "> " * MANY + "x"),
        (1, 2, "user", ">" * 50 + "\n"),
        (1, 3, "user", "\n".join(f"{'>' * (i % 3)} line {i}" for i in range(MANY))),
        (1, 4, "user", "> x" + " " * (10 * MANY) + "y\nown"),
        (1, 5, "user", "\n" * (10 * MANY) + "> q\n﷐﷑7:z"),
        (2, 0, "user", "\n".join(f"row {i}" for i in range(MANY))),
        (2, 1, "user", "\n".join(f"> row {i}" for i in range(MANY)) + "\nagreed"),
        (2, 2, "user", "\n".join(f"> row {i}" for i in range(40_000, 90_000)) + "\nand this"),
    ]
    got = within(120, lambda: {(r.conv_id, r.turn): r for r in quotes.link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()})
    assert (got[1, 0].text, got[1, 1].text, got[1, 4].text, got[1, 5].text) == ("", "", "own", "﷐﷑7:z")
    assert got[1, 3].n_quoted == 2 * MANY // 3
    assert [(got[2, t].parent_turn, got[2, t].position) for t in range(3)] == [(None, 0), (0, 1), (0, 2)]


def test_long_conversations_that_quote_one_line(spark):
    n = MANY
    turns = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") == 0, "yes").otherwise("> yes\n\nyes").alias("text")
    )
    found = within(120, lambda: quotes.link_quotations(turns).agg(F.sum(F.expr("int(parent_turn = turn - 1 AND depth = turn AND position = turn AND root_turn = 0)")), F.count("*")).first())
    assert tuple(found) == (n - 1, n)


def test_reply_order_against_brute_force(spark):
    import random

    draw = random.Random(4)
    rows, parent = [], {}
    for turn in range(300):
        parent[turn] = draw.randrange(turn) if turn and draw.random() < 0.9 else None
        quote = f"> said {parent[turn]} here\n" if parent[turn] is not None else ""
        rows.append((7, turn, "user", f"{quote}said {turn} here"))
    order, stack = [], [t for t in range(299, -1, -1) if parent[t] is None]
    while stack:
        order.append(stack.pop())
        stack += [t for t in range(299, -1, -1) if parent[t] == order[-1]]
    got = quotes.link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.turn: r.parent_turn for r in got} == parent
    assert [r.turn for r in sorted(got, key=lambda r: (r.root_turn, r.position))] == order
    depth = lambda t: 0 if parent[t] is None else 1 + depth(parent[t])
    assert all(r.depth == depth(r.turn) for r in got)


def test_latest_earlier_in_buckets(spark):
    rows = [(k, t, (t * 7 + k) % 3 == 0) for k in range(3) for t in {i * i % 977 for i in range(40 * (k + 1))}]
    got = quotes.latest_earlier(spark.createDataFrame(rows, "k long, t long, w boolean"), ["k"], "t", "w", "found", bucket_rows=5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.found == max((t for k, t, w in rows if k == r.k and w and t < r.t), default=None)


def test_quotation_tables_with_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a line", "x", 1), (1, 1, "user", "> a line\nb", "y", 2), (1, 1, "user", "> a line\nb", "y", 2), (None, 1, "user", "> a line", None, None), (1, None, None, "> b", "z", 3)]
    docs = spark.createDataFrame(rows, SCHEMA + ", quoted string, _bucket int")
    got = quotes.link_quotations(docs).collect()
    assert sorted((str(r.conv_id), str(r.turn), str(r.parent_turn)) for r in got) == sorted([("1", "0", "None"), ("1", "1", "0"), ("1", "1", "0"), ("None", "1", "None"), ("1", "None", "None")])
    assert quotes.link_quotations(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("<a " * 3_000_000, None),
        ("<html " * 200_000, None),
        ("<a href=\"" * MANY + ">end", None),
        ("<a href='x\">" * MANY, None),
        ("<!-- " * MANY, ""),
        ("<script>" * MANY, ""),
        ("<" * 10 * MANY, "<" * 10 * MANY),
        ("a" + " " * 10 * MANY + "b", "a b"),
        ("<head>" * MANY + "<body>seen", "seen"),
        ("<meta " + "charset " * MANY + ">x", "x"),
        ("&#" + "1" * MANY + "; &#0000065;", "\ufffd A"),
        ("&" * MANY, "&" * MANY),
    ],
)
def test_pages_of_hostile_texts(page, shown):
    found = within(10, lambda: warc.read_page(page))
    assert shown is None or found[1] == shown


def test_tags_with_marks_in_attributes():
    fields, shown = warc.read_page("<p title='a > b'>One</p><a title=\"x>y\" href=\"/z?a=1&amp;b=2\">two</a> 1 < 2 <b class=x'>three</b><a href='>never closed")
    assert shown == "One\ntwo 1 < 2 threenever closed" and fields == "outlink: /z?a=1&b=2 L a/@href\r\n"


def test_records_with_line_breaks_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>t", "r", "d"), (1, "http://a/\r\nX: y", "<p>t", "r", "d"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, record string, date string")
    got = warc.derivatives(docs).collect()
    assert len(got) == 6 and all(b"\r\nX: y" not in bytes(r.record) for r in got)
    assert b"WARC-Target-URI: http://a/%0D%0AX:%20y\r\n" in bytes(got[0].record)
    assert warc.derivatives(docs.limit(0)).count() == 0


def test_packing_ids_of_any_text():
    import random

    tokenizer = packing.WordTokenizer(queries.tokenizer_file())
    draw = random.Random(11)
    alphabets = [
        "abcXYZ.,;:!?()*%#&$\"- '\n\t",
        "\u0130\u0131\u00df\u1e9e\u03a3\u03c3\u03c2\u0149\u01f0 .,!-aB",
        "e\u0301\u00e9\u0307I\u0130 .-",
        "".join(map(chr, range(0x20, 0x250))),
        "".join(map(chr, [*range(0x370, 0x530), 32, 46])),
        "<|endoftext|>UNK[] .a",
    ]
    for round_ in range(6000):
        if round_ % 7:
            text = "".join(draw.choices(alphabets[round_ % 6], k=draw.randrange(1, 40)))
        else:
            text = "".join(c for c in map(chr, (draw.randrange(1, 0x30000) for _ in range(20))) if not "\ud800" <= c <= "\udfff")
        assert tokenizer.encode(text) == tokenizer._by_tokenizer(text), ascii(text)


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ends = packing.pack(docs, queries.tokenizer_file()).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()["n"]
    padded = sum(1 << (int(n) - 1).bit_length() for n in ends if n & (n - 1) == 0) + sum(2048 for n in ends if n & (n - 1))
    assert padded >= ends.sum() and (padded - ends.sum()) / padded < 0.01


def test_complementary_words_are_not_linked(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(word) == 1024
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_many_short_texts_of_one_template(spark):
    docs = spark.range(2 * MANY).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight "), F.col("id").cast("string")).alias("text"))
    found = within(240, lambda: neardup.near_duplicates(docs, words=3, similarity=(85, 100)).agg(F.count_if("kept"), F.max("n_shingles")).first())
    assert tuple(found) == (2 * MANY, 7)


def test_stages_with_clashing_columns_and_awkward_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(
        f"{c} string" for c in "_id _n _text _copies _digest_of _key gone_id gone_key stays rows at copies place again key bucket id lang_pred as _ID2".split()
    )
    n_extra = len(schema.split(",")) - 4
    plain = [
        (1, words, "en", "a"),
        (2, words + " end", "en", "a"),
        (2, words, "en", None),
        (None, words, None, "a"),
        (None, None, None, None),
        (3, "", "en", "a"),
        (4, "12 34 ²½", "en", "a"),
        (5, " ".join(f"v{i}" for i in range(70)), "en", "b"),
        (5, " ".join(f"v{i}" for i in range(70)), "en", "b"),
    ]
    docs = spark.createDataFrame([(*r, *[f"x{i}"] * n_extra) for i, r in enumerate(plain)], schema)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if number < 4:
            found = stage(spark, docs, SMALL)
            assert found.columns == docs.columns
            assert number == 3 or found.count() == (6, 5, 5)[number]
            assert all(len({r[c] for c in docs.columns[4:]}) == 1 for r in found.collect())
    assert corpus_pipeline.STAGES[4][1](spark, docs, SMALL).count() == len(plain)


def test_language_filter_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "²½ 12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.identified_documents(docs).collect()] == [1]


def test_every_label_is_learned(spark):
    from itertools import product

    labels = ["".join(p) for p in product("xyz", "abcdefghij", "qrstu")][:66]
    rows = [(i, " ".join(f"{labels[i % 66]}{labels[i % 66]}{(i + j) % 7}" for j in range(12)), f"l-{labels[i % 66]}") for i in range(660)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) > 625


def test_buckets_of_the_mix_are_even(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.when(F.col("id") % 10 == 0, "# # #").otherwise(F.repeat(F.lit("word "), 60)).alias("text")
    )
    seen = []
    real = mixing.running_total

    def spy(df, group, bucket, *rest):
        seen.extend(r["count"] for r in df.groupBy(bucket).count().collect())
        return real(df, group, bucket, *rest)

    mixing.running_total = spy
    try:
        mixing.mix(docs).count()
    finally:
        mixing.running_total = real
    assert sum(seen) == 40_000 and max(seen) < 2 * 40_000 / len(seen)


def test_top_k_over_many_shards_and_query_groups(spark, monkeypatch):
    """Ties at the k-th place, several shards, groups and copies, repeated ids and rows, against brute force."""
    monkeypatch.setattr(topk, "MOST_CELLS", 7)
    monkeypatch.setattr(topk, "CHUNK_SHARDS", 5)
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 2, (6, 8))
    rows = [(i, [float(x) for x in np.round((centres[i % 6] + rng.normal(0, 0.2, 8)) * 4) / 4]) for i in range(4000)]
    rows += [(i, rows[0][1]) for i in range(5000, 5040)] + rows[40:60] + [(9000, []), (9001, [1.0]), (9020, [0.5] * 8)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, shard string, id int")
    got = {}
    for r in topk.top_k(vectors, lambda i: i % 20 == 0, k=10, query_rows=30, shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    matrix = np.zeros((len(rows), 8), np.int64)
    for i, (_, v) in enumerate(rows):
        matrix[i, : len(v)] = np.floor(64 * np.array(v, np.float32).astype(float))
    ids = np.array([i for i, _ in rows])
    for at in np.flatnonzero(ids % 20 == 0):
        if (ids == ids[at]).sum() > 1:
            continue
        scores = matrix @ matrix[at]
        found = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != ids[at])[:10]
        assert sorted(got[ids[at]]) == [(place, -s, i) for place, (s, i) in enumerate(found, 1)], ids[at]


def test_top_k_prunes_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (40, 16))
    rows = np.floor(64 * (centres[rng.integers(0, 40, 8000)] + rng.normal(0, 0.1, (8000, 16))))
    queries = rows[::200]
    *_, scored = topk.search_shard(np.arange(len(queries)) + 10**6, queries, np.arange(8000), rows, 20)
    assert scored < 0.25 * len(queries) * len(topk.blocks_of(rows))


def test_top_k_beyond_doubles():
    big = 2**30
    rows = np.array([[big + 1, 1], [big, 2], [big + 1, 0]], float)
    at, ids, scores, _ = topk.search_shard(np.array([99]), np.array([[big + 1, 1.0]]), np.arange(3), rows, 2)
    assert scores.tolist() == [(big + 1) ** 2 + 1, (big + 1) ** 2] and ids.tolist() == [0, 2]
