"""The pipeline's stages, each against brute force on its own input."""

import brute
import pytest

from vicinage.llm._store import load, table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    stages = dict(pipeline.STAGES)
    assert len(stages) == 5
    good = table(stages["quality_classifier"](spark, docs, sf_dir), "t")
    labels = load(spark, sf_dir, "labels")
    judged = docs.join(labels, "doc_id").select("doc_id", "quality").collect()
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum((r.doc_id in kept) == (r.quality == 1) for r in judged) >= 0.9 * len(judged)

    single = table(stages["minhash_near_dedup"](spark, good, sf_dir), "t")
    want = brute.near_duplicates([(r.doc_id, r.text) for r in good.collect()], pipeline.SHINGLE_WORDS, pipeline.SIMILARITY)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}

    cut = table(stages["suffix_array_dedup"](spark, single, sf_dir), "t")
    rest = brute.repeats([(r.doc_id, r.text) for r in single.collect()])
    before = {r.doc_id: r.text for r in single.collect()}
    got = {r.doc_id: r for r in cut.collect()}
    for i, n, removed, _, _ in rest:
        if i in got:
            assert abs(len(got[i].text.encode()) - (n - removed)) <= 6 and got[i].n_chars == len(got[i].text)
            assert removed or got[i].text == before[i]
        else:
            assert removed and n - removed < 100, "only what is blank without its repeats goes"

    clean = table(stages["decontamination"](spark, cut, sf_dir), "t")
    left = {r.doc_id for r in clean.collect()}
    items = [brute.plain_words(r.text) for r in load(spark, sf_dir, "benchmark").collect()]
    for i, r in got.items():
        text = " " + " ".join(brute.plain_words(r.text)) + " "
        if any(" " + " ".join(item) + " " in text for item in items):
            assert i not in left
    assert len(left) >= 0.85 * len(got)

    for df in (good, single, cut, clean):
        assert df.columns == docs.columns
    mixed = stages["source_mixing"](spark, clean, sf_dir)
    assert {r.doc_id for r in mixed.collect()} <= left and mixed.count() > 0


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0
