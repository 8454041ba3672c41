"""Source divergence against a dense recomputation in Python integers, and against its SQL."""

import random
import re
from collections import Counter

import oracle
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.llm import divergence, queries
from tidemark.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, value long, part string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dense(rows, least, most):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, words in mine for t in set(words))
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = sorted({s for _, s, _ in mine})
        counts = {s: Counter(t for _, x, words in mine if x == s for t in words) for s in sources}
        counts[None] = sum(counts.values(), Counter())
        shares = {}
        for s, c in counts.items():
            total = sum(c[t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            best = [(shares[None][t] - shares[s][t], t.encode(), t) for t in kept if counts[s][t] and shares[s][t] > shares[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:most])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def documents(draw, n, words, sources):
    rows = []
    for i in range(n):
        source = draw.choice(sources)
        pool = words if draw.random() < 0.7 else words[: 1 + len(words) // 3]
        sep = draw.choice([" ", ", ", "1", "\n"])
        rows.append((i, sep.join(draw.choice(pool) for _ in range(draw.randrange(20))), draw.choice(["en", "en", "de", None]), source, 1, "x"))
    return rows


@pytest.mark.parametrize(("tile_terms", "tile_sources", "bits", "few", "flush"), [(2048, 256, 10, 256, 1 << 24), (3, 2, 3, 0, 50), (7, 3, 5, 1, 1000)])
def test_against_dense_recomputation(spark, tile_terms, tile_sources, bits, few, flush):
    draw = random.Random(tile_terms)
    words = [w * n for w in ("a", "B", "ab", "é", "É", "ß", " ", "字", "😀", "Zz") for n in (1, 2, 3)]
    rows = documents(draw, 400, words, ["s1", "s2", "s10", "S", "é", "", None])
    rows += rows[:40] + [(None, None, "fr", "s1", 1, "x"), (1, "", "fr", None, 1, "x"), (2, "rare", "fr", "s3", 1, "x"), (3, "1 2 3", "it", "only", 1, "x")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = divergence.audit(table, least_documents=12, terms=4, tile_terms=tile_terms, tile_sources=tile_sources, bits=bits, few=few, flush_bytes=flush).collect()
    want = dense(rows, 12, 4)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_very_long_texts_and_terms(spark):
    long = "q" * 3_000_000
    rows = [(i, f"{long} word{'x' * i} " + "the of " * (100_000 if i == 0 else 1), "en", f"s{i % 2}", 1, "x") for i in range(6)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least_documents=5, terms=2).collect()
    assert {tuple(r) for r in got} == dense(rows, 5, 2)
    assert any(r.item == long for r in got)


@pytest.mark.parametrize("few", [0, 3])
def test_radix_select_against_sorting(spark, few):
    draw = random.Random(few)
    names = ["", "a", "ab", "abc", "abcd", "b" * 300, "b" * 300 + "c", "é", "zz"] + [f"{'p' * 50}{i:04}" for i in range(200)]
    rows = [(g, n, draw.choice([0, 1, 7, 7, 7, 1 << 40, (1 << 40) + 1])) for g in ("x", "y", "z") for n in draw.sample(names, 150 if g != "z" else 5)]
    rows += [("t", n, 9) for n in names] + [("same", "equal", 4)] * 60
    got = divergence.radix_select(spark.createDataFrame(rows, "g string, n string, v long"), ["g"], "v", "n", 20, Scratch(spark, "radix"), bits=4, few=few).collect()
    want = Counter()
    for g in {r[0] for r in rows}:
        want.update(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:20])
    assert Counter(map(tuple, got)) == want


def test_common_prefix(spark):
    rows = [("", ""), ("abc", "abd"), ("abc", "abc"), ("a", "ab"), ("x", "y"), ("é", "è"), ("w" * 70000 + "a", "w" * 70000 + "b")]
    found = spark.createDataFrame(rows, "a string, b string").select(divergence.common_prefix(F.col("a").cast("binary"), F.col("b").cast("binary")).alias("n"))
    assert [r.n for r in found.collect()] == [0, 2, 3, 1, 0, 1, 70000]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(none).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, 1, "x")], SCHEMA)
    assert divergence.audit(alone).count() == 0


def test_matches_sql(spark):
    for sf in (SMALL, SMALL.replace("0.001", "0.01")):
        got = queries.QUERIES["op12_source_divergence"](spark, sf).toPandas()
        want = oracle.by_sql(queries.ORACLES["op12_source_divergence"], sf)
        assert oracle.normal(got) == oracle.normal(want) and len(got) > 1500
