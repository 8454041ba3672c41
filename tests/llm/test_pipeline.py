"""Every stage of the pipeline on the whole small table, each against brute force on its own input."""

import re

from conftest import SMALL
from test_corpus import WORD, shingles

import corpus_pipeline
from tidemark.llm import mixing
from tidemark.llm.common import Scratch
from tidemark.llm.queries import tokenizer_file


def one_of_each_group(rows):
    """Smallest ids of the groups that 5-word shingles link at a similarity of 0.8 or more."""
    sets = {r.doc_id: shingles(r.text, 5) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i for i in ids if find(i) == i}


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, scratch, inputs, outputs = docs.columns, Scratch(spark, "test"), [], []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        docs = scratch.save(stage(spark, docs, SMALL), str(number))
        outputs.append(docs)
    rows = [frame.collect() for frame in inputs]
    assert all(frame.columns == columns for frame in inputs)

    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if re.search(r"[^\W\d_]", r.text or "")}

    best = {}
    for r in rows[1]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in rows[2]) == sorted(doc_id for _, doc_id in best.values())

    assert sorted(r.doc_id for r in rows[3]) == sorted(one_of_each_group(rows[2]))

    mixed = {r.doc_id: r.copies for r in mixing.mix(inputs[3]).collect()}
    assert len(mixed) == len(rows[3]) and sum(mixed.values()) == len(rows[4])
    per_doc = {r.doc_id: len(WORD.findall(r.text)) for r in rows[3]}
    assert abs(sum(per_doc[r.doc_id] for r in rows[4]) - 1.5 * sum(per_doc.values())) <= len({r.source for r in rows[3]}) * max(per_doc.values())

    tokenizer = Tokenizer.from_file(tokenizer_file())
    pieces = outputs[4].collect()
    assert sum(r.length for r in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows[4])
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
