"""Pairs scored in their buckets against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from vicinage.operators import buckets
from vicinage.plans import inputs

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("threshold", (None, 0.5))
def test_pairs_are_scored_once_where_they_first_meet(spark, threshold):
    sets = [sorted(RNG.choice(12, RNG.integers(0, 9), replace=False).tolist()) for _ in range(60)] + [[1, 2, 3]] * 9
    keys = [RNG.integers(0, 4, 3).tolist() for _ in range(60)] + [[7, 7, 7]] * 9
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(keys, sets))], "id long, keys array<long>, v array<long>")
    df = buckets.met(rows, buckets.jaccard_kernel(threshold), "score double")
    got = [(r.id, r.other_id, r.score) for r in df.collect()]
    want = []
    for i in range(69):
        for j in range(i + 1, 69):
            if any(a == b for a, b in zip(keys[i], keys[j])):
                union = len(set(sets[i]) | set(sets[j]))
                score = len(set(sets[i]) & set(sets[j])) / union if union else 0.0
                if threshold is None or score >= threshold:
                    want.append((i, j, score))
    assert sorted(got) == want
    # Copies are sent to one of their equal buckets, and no pair is a row before it is scored.
    assert "id < other_id" not in df._jdf.queryExecution().analyzed().toString()
    same = buckets.met(rows.where("id >= 60"), buckets.same_kernel(3), "same long").collect()
    assert len(same) == 36 and {r.same for r in same} == {3}


def test_words_are_coded_a_bounded_number_at_a_time(spark, monkeypatch):
    texts = [" ".join(f"w{n}" for n in range(i % 7 * 5)) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", inputs.words().alias("w")).coalesce(1)
    whole = {r.id: r.item for r in inputs.coded_sets(rows, "doc_id", "w").collect()}
    held = []


    def function_of(df):
        found = []
        monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f))
        inputs.coded_sets(df, "doc_id", "w")
        monkeypatch.undo()
        return found[0]

    run = function_of(rows)
    monkeypatch.setattr(inputs, "WORDS", 8)
    lists = pa.array([t.split() for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), lists], names=["doc_id", "w"])
    for out in run(iter([batch])):
        held.append(out.num_rows)
        for i, item in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            assert item == whole[i]
    assert sum(held) == 40 and len(held) > 20
