"""Each stage against a plain computation over its own input."""

import zlib

import numpy as np

import corpus_pipeline
from paperloom.llm import op2_toxicity, op5_pii, op6_packing, op8_quality
from paperloom.llm.common import table, vocabulary, written
from tests.conftest import oracle_rows
from tests.llm.test_near_duplicates import brute_fingerprint, roots


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "pii", "packing"]

    def after(name, at):
        out = written(stages[name](spark, at, sf), "test")
        assert out.columns == columns
        return out, {r.doc_id: r for r in out.collect()}

    at, kept = after("quality", docs)
    want = oracle_rows(f"select doc_id from ({op8_quality.SQL}) where kept", sf)
    assert set(kept) == set(want.doc_id) and all(kept[i] == seen[i] for i in kept)

    before = kept
    model = op2_toxicity.fit(at, table(spark, sf, "labels"))
    at, kept = after("toxicity", at)
    ids = sorted(before)
    scores = op2_toxicity._scores(model, [before[i].text.encode() for i in ids], op2_toxicity.Words())
    assert set(kept) == {i for i, s in zip(ids, scores) if s < 0.3} and all(kept[i] == before[i] for i in kept)

    before = kept
    at, kept = after("near_duplicates", at)
    ids = sorted(before)
    fp = [brute_fingerprint(before[i].text) for i in ids]
    group = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4])
    assert set(kept) == {ids[g] for g in group} and all(kept[i] == before[i] for i in kept)

    before = kept
    at, kept = after("pii", at)
    assert set(kept) == set(before)
    found = {r.doc_id: r.n_entities for r in op5_pii.replace_pii(spark.createDataFrame(list(before.values()))).collect()}
    for i, r in kept.items():
        assert (r.text != before[i].text) == (found[i] > 0) and r.n_chars == len(r.text) and r.source == before[i].source

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(op6_packing.VOCABULARY))
    pieces = {}
    for r in stages["packing"](spark, at, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(kept)
    for i, own in pieces.items():
        ids = np.array(library.encode(kept[i].text, add_special_tokens=False).ids + [1], "<u4")
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)


def test_run_is_its_stages_one_after_the_other(spark, sf):
    """The surrogates of one application are the same each time, so whole runs can be compared."""
    at = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, sf), "test")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(op6_packing.VOCABULARY))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in at.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and len(want) > 50


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()
