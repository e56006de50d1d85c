import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinage.llm import minhash_dedup, suffix_dedup
from vicinage.llm._store import arrow_map


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(make_docs, odd_rows, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(make_docs(odd_rows), k).collect()}
    assert got == brute.near_duplicates(odd_rows, k)


def test_near_duplicates_of_a_chain(make_docs):
    """Each text is linked with the next only: the component spans all, though the bucket's stars don't."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 9 : i * 9 + 200])) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(make_docs(rows), 2).collect()}
    want = brute.near_duplicates(rows, 2)
    assert got == want and set(want.values()) == {(199, 0)}


def test_near_duplicates_edges(make_docs):
    empty = make_docs([])
    assert minhash_dedup.near_duplicates(empty, 2).count() == 0
    rows = minhash_dedup.near_duplicates(make_docs([(5, "a b c"), (5, "a b c"), (None, "a b c"), (6, "a b c")]), 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(5, 5, True), (6, 5, False)]


def test_one_template_below_the_threshold(make_docs):
    """Documents that share a template, 70 to 85 % alike, in one hot bucket: some are linked, most aren't."""
    rng = np.random.default_rng(5)
    template = [f"t{i}" for i in range(160)]
    rows = []
    for i in range(120):
        words = template + [f"u{i}.{j}" for j in range(int(rng.integers(8, 60)))]
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join([*template[:150], *(f"v{i}.{j}" for j in range(20)), *template[150:]])) for i in range(20)]
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(make_docs(rows), k).collect()}
        want = brute.near_duplicates(rows, k)
        assert got == want and 1 < len({c for _, c in want.values()}) < 140


def test_an_id_with_several_texts(make_docs):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, "x y z"), (2, " ".join(words)), (3, "x y z"), (4, " ".join(words[:58]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(make_docs(rows), 2).collect())
    assert got == [(1, 2, 1), (2, 59, 2), (3, 2, 1), (4, 57, 2)]


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(0)
    for true in (0.2, 0.6, 0.9):
        n = 3000
        common = rng.integers(0, 1 << 63, int(n * true), dtype=np.uint64)
        rest = (n - len(common)) // 2
        sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, rest, dtype=np.uint64)])) for _ in range(2)]
        mins = minhash_dedup.minima(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        a, b = minhash_dedup.pack(mins).view(np.uint64)
        cells = np.unpackbits((a ^ b).view(np.uint8)).reshape(-1, 2).any(axis=1)
        estimate = ((~cells).mean() - 0.25) / 0.75
        assert abs(estimate - len(common) / (len(common) + 2 * rest)) < 0.13


def test_minima_of_long_and_short_texts_in_one_block():
    rng = np.random.default_rng(1)
    sizes = [3, minhash_dedup.CHUNK * 9, 0, 5]
    sets = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    together = minhash_dedup.minima(sets, bounds)
    for i in (0, 1, 3):
        alone = minhash_dedup.minima(sets[bounds[i] : bounds[i + 1]], np.array([0, sizes[i]]))
        assert (together[i] == alone[0]).all()


def repeat_rows(odd_rows):
    passage = dict(odd_rows)[12][:260]
    more = [(300 + i, f"head {i} " * 9 + passage[i : 200 + i] + f" tail {i}" * 12) for i in range(25)]
    return odd_rows + more + [(400, "ab" * 400), (401, "x" * 99), (402, "x" * 100), (403, "x" * 100), (404, "é" * 90)]


def judged(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def repeated_ids(rows):
    """Rows that repeat as they are, and ids with several texts that share passages at equal and other places."""
    passage = dict(rows)[12][:300]
    return rows + rows[7:9] + [(7, "x" + dict(rows)[7])] + [(500, passage + " one"), (500, passage + " two"), (500, "later " + passage), (501, passage), (501, passage)] + [(502, "new " * 3 + dict(rows)[11])] * 3


@pytest.mark.parametrize("hot", [None, "all"])
def test_repeats_match_brute_force(make_docs, odd_rows, hot):
    for rows in (repeat_rows(odd_rows), repeated_ids(repeat_rows(odd_rows))):
        docs = make_docs(rows)
        anchors = hot and suffix_dedup.hot_anchors(suffix_dedup._versioned(docs)[0], every=1, least=2)
        assert anchors is None or len(anchors) > 10
        assert judged(suffix_dedup.remove_repeats(docs, hot=anchors)) == brute.repeats(rows)


def test_repeats_edges(spark, make_docs):
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0
    text = "".join(chr(97 + (i * i) % 26) for i in range(300))
    rows = [(1, text), (1, text)]
    assert judged(suffix_dedup.remove_repeats(make_docs([*rows, (None, text)]))) == brute.repeats(rows)
    assert suffix_dedup.without_repeats(make_docs(rows)).count() == 2, "a row that is merely repeated loses nothing it doesn't repeat itself"
    left = suffix_dedup.without_repeats(make_docs([(1, text), (2, text), (3, "short"), (4, None)]))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4] and left.columns[:3] == ["doc_id", "text", "lang"]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(make_docs([]), length=30)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "bytes", "removed", "left", "runs", "version", "_0", "at", "low"]
    clash = make_docs([(1, "ab" * 90), (2, "cd" * 30 + "ab" * 90)]).select("*", *(F.lit(n).alias(n) for n in names))
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(clash).collect()}
    assert got[2].text == "cd" * 30 and got[2].n_chars == 60 and all(got[2][n] == n for n in names)
    assert judged(suffix_dedup.remove_repeats(clash)) == brute.repeats([(1, "ab" * 90), (2, "cd" * 30 + "ab" * 90)])


def test_documents_are_not_cut_by_batches(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 1)
    rows = repeated_ids(repeat_rows(odd_rows))
    columns = list(zip(*((7, 0, p, dict(rows)[7].encode()[p : p + 160]) for p in range(0, 400, 61))))
    batch = suffix_dedup.pa.RecordBatch.from_arrays([suffix_dedup.pa.array(c) for c in columns], names=["doc_id", "version", "start", "part"])
    assert sum(b.num_rows for b in suffix_dedup._resolve_task(100)(iter([batch]))) == 0


def test_index_family_levels():
    rng = np.random.default_rng(2)
    family, seen = suffix_dedup.IndexFamily(20), {}
    for n in range(30):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        starts = np.arange(381)
        got = family.add(data, starts, np.stack([np.full(381, n), starts], axis=1))
        for s, g in zip(starts, got):
            w = data[s : s + 20].tobytes()
            assert g == (w in seen)
            seen.setdefault(w, (n, s))
    windows = [w for w, _ in family.levels]
    assert all(len(a) > 2 * len(b) for a, b in zip(windows, windows[1:]))
    assert all((w[1:] > w[:-1]).all() for w in windows) and sum(map(len, windows)) == len(seen)
    assert {w: tuple(p) for level in family.levels for w, p in zip(level[0].tolist(), level[1].tolist())} == seen


@pytest.mark.parametrize("letters", [2, 20])
def test_levels_merge_in_pieces(monkeypatch, letters):
    """Pieces far smaller than the levels: windows known and new, single and in long runs between two of the other level."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 5)
    rng = np.random.default_rng(4)
    family, seen, last = suffix_dedup.IndexFamily(20), {}, np.zeros(0, np.uint8)
    for n, size in enumerate([20, 90, 300, 21, 64, 150, 40, 200]):
        data = np.concatenate([rng.integers(97, 97 + letters, size), np.full(n * 3, 97), last[-30:]]).astype(np.uint8)
        last, starts = data, np.arange(len(data) - 19)
        got = family.add(data, starts, np.stack([np.full(len(starts), n), starts], axis=1))
        windows = [data[s : s + 20].tobytes() for s in starts]
        assert got.tolist() == [w in seen or windows.index(w) < s for s, w in enumerate(windows)]
        for s, w in enumerate(windows):
            seen.setdefault(w, (n, s))
    assert {w: tuple(p) for level in family.levels for w, p in zip(level[0].tolist(), level[1].tolist())} == seen
    assert all((w[1:] > w[:-1]).all() for w, _ in family.levels)


def test_a_full_task_resolves_in_little_memory():
    """Every window of a task's contexts is new: the levels hold all of them."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(100, 177, suffix_dedup.OPEN_ROWS)
    columns = [np.arange(len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)]
    parts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in sizes]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts)], names=["doc_id", "version", "start", "part"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in suffix_dedup._resolve_task(100)(iter([batch]))) == 0
        assert tracemalloc.get_traced_memory()[1] < 120e6, "twice what it takes, half of what windows in full would"
    finally:
        tracemalloc.stop()


def test_anchors_of_a_long_text_take_little_memory():
    data = np.random.default_rng(8).integers(97, 100, 3 << 20).astype(np.uint8)
    columns = [pa.array([1]), pa.array([0]), pa.array([data.tobytes().decode()])]
    tracemalloc.start()
    try:
        found = list(suffix_dedup._anchors(iter([pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "text"])]), 100))
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    windows = np.concatenate([np.arange(a + lo, a + hi + 1) for f in found for a, lo, hi in zip(f["at"], f["low"], f["high"])])
    assert np.array_equal(np.sort(windows), np.arange(len(data) - 99))


def test_workers_give_memory_back(spark):
    """Freed arrays between ones that stay, which the C library keeps as holes."""

    def fill(batches):
        import sys

        arrays = [np.ones(12_500) for _ in range(1500)]
        sys.stays = arrays[::50]
        yield from batches

    def look(batches):
        from pathlib import Path

        for batch in batches:
            held = int(Path("/proc/self/statm").read_text().split()[1]) * 4096
            yield pa.RecordBatch.from_arrays([pa.array([held] * batch.num_rows)], names=["id"])

    rows = spark.range(0, 4, 1, 4)
    before = arrow_map(rows, look, "id long").agg(F.max("id")).first()[0]
    assert arrow_map(rows, fill, "id long").count() == 4
    assert arrow_map(rows, look, "id long").agg(F.max("id")).first()[0] < before + 50e6


def test_long_texts_in_pieces():
    data = np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.window_anchors(data, np.array([0, 5000]))
    pieces = list(suffix_dedup._in_pieces(data, np.array([0, 5000]), 100, limit=1024))
    cover = lambda parts: sorted(w for p in parts for a, lo, hi in zip(p["at"], p["low"], p["high"]) for w in range(a + lo, a + hi + 1))
    assert cover([whole]) == cover(pieces) == list(range(4901))
