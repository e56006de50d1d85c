import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.functions import sets as st
from vicinage.operators import bloom, clustering, factorization, frequency, metric, signatures, sorting
from vicinage.operators.similarity import BuildConfig, QueryConfig, build_index, top_k
from vicinage.plans import vector_queries
from vicinage.sources import images, index_store
from vicinage.sources.tables import shared_path


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_sets(n, seed=0):
    rng = random.Random(seed)
    base = [sorted(rng.sample(range(400), 60)) for _ in range(n // 4)]
    out = []
    for i in range(n):
        s = set(base[i % len(base)])
        for _ in range(rng.randrange(12)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(400))
        out.append((i, sorted(s)))
    return out


@pytest.fixture(scope="module")
def sets(spark):
    return table(spark, [*random_sets(80), (80, []), (81, []), (82, None), (83, [7])], "id long, item array<int>")


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def test_minhash_estimates_and_recall(spark, sets):
    sig = {r.id: r.sig for r in signatures.MinHash(128).transform(sets).collect()}
    assert 82 not in sig and sig[80] == [2**31 - 1] * 128
    items = {r.id: r.item for r in sets.collect() if r.item is not None}
    errors = [abs(sum(x == y for x, y in zip(sig[a], sig[b])) / 128 - jaccard(items[a], items[b])) for a in range(40) for b in range(a)]
    assert np.mean(errors) < 0.04
    index = build_index(sets, signatures.MinHash(128), BuildConfig(32), config=QueryConfig(threshold=0.5))
    found = {(r.id, r.other_id): r.score for r in index.self_join().collect()}
    true = {(a, b) for a in items for b in items if a != b and jaccard(items[a], items[b]) >= 0.5}
    assert set(found) == {(b, a) for a, b in found} and set(found) <= true
    assert len(found) >= 0.98 * len(true)
    assert all(s == pytest.approx(jaccard(items[a], items[b])) for (a, b), s in found.items())


def test_weights_and_single_bits(spark, sets):
    ones = table(spark, [(e, 1) for e in range(400)], "element int, weight int")
    same = lambda x, y: {r.id: r.sig for r in x.transform(sets).collect()} == {r.id: r.sig for r in y.transform(sets).collect()}
    assert same(signatures.MinHash(8), signatures.MinHash(8, weights=ones, max_weight=2))
    none = table(spark, [(7, 0)], "element int, weight int")
    weighted = {r.id: r.sig for r in signatures.MinHash(8, weights=none, max_weight=2).transform(sets).collect()}
    assert weighted[83] == [2**31 - 1] * 8
    bits = {r.id: r.sig for r in signatures.MinHash(64, single_bit=True).transform(sets).collect()}
    full = {r.id: r.sig for r in signatures.MinHash(64).transform(sets).collect()}
    assert all([(bits[i][0] >> b) & 1 for b in range(64)] == [x & 1 for x in full[i]] for i in full)
    with pytest.raises(ValueError):
        signatures.MinHash(60, single_bit=True)


def test_index_configs(spark, sets):
    build = lambda **k: build_index(sets, signatures.MinHash(64), BuildConfig(16), config=QueryConfig(**k))
    pairs = {(r.id, r.other_id): r.collisions for r in build().candidate_pairs().collect()}
    assert not {80, 81} & {x for p in pairs for x in p}, "empty sets are in no bucket"
    limited = build(max_candidates=2).self_join().groupBy("id").count().agg(F.max("count")).first()[0]
    assert limited <= 2
    assert build(max_results=1).self_join().groupBy("id").count().agg(F.max("count")).first()[0] == 1
    lonely = build(threshold=0.99).self_join(keep_lonely=True)
    assert lonely.select("id").distinct().count() == 83
    mine = {r.other_id for r in build().candidates_of(sets.where("id = 3")).collect()}
    assert 3 in mine and 3 not in {r.other_id for r in build().candidates_of(sets.where("id = 3"), include_self=False).collect()}
    outside = build(threshold=0.9).query(sets.where("id = 3")).collect()
    assert any(r.other_id == 3 and r.score == 1.0 for r in outside)
    one_probe = {(r.id, r.other_id) for r in build().candidates(sets.where("id < 9")).collect()}
    assert one_probe <= {(r.id, r.other_id) for r in build(probes=3).candidates(sets.where("id < 9")).collect()}
    with pytest.raises(ValueError):
        build(probes=6).candidates(sets).collect()
    by_number = build_index(sets, signatures.MinHash(64), BuildConfig(16, hash_bits=0), config=QueryConfig(probes=2))
    assert by_number.build.hash_bits == 7 and one_probe <= {(r.id, r.other_id) for r in by_number.candidates(sets.where("id < 9")).collect()}
    with pytest.raises(ValueError):
        QueryConfig(partial_result_size=0)
    hashed = build_index(sets, signatures.MinHash(64), BuildConfig(16, hash_bits=4), config=QueryConfig(threshold=0.5))
    assert {(r.id, r.other_id) for r in build(threshold=0.5).self_join().collect()} <= {(r.id, r.other_id) for r in hashed.self_join().collect()}
    dist = build(threshold=0.5).with_score(lambda a, b: 1 - st.jaccard(a, b), "dist")
    assert {(r.id, r.other_id) for r in dist.self_join().collect()} == {(r.id, r.other_id) for r in build(threshold=0.5).self_join().collect()}


def test_index_on_disk(spark, sets):
    index = build_index(sets, signatures.MinHash(64), BuildConfig(16))
    path = shared_path(spark, "index")
    index_store.write_index(index, path)
    back = index_store.read_index(spark, path, signatures.MinHash(64))
    assert {(r.id, r.other_id) for r in back.candidate_pairs().collect()} == {(r.id, r.other_id) for r in index.candidate_pairs().collect()}
    wanted = index.bands.where("id = 3 and band = 5").select("slice")
    assert 3 in {r.id for r in index_store.lookup(back, 5, wanted).collect()}
    with pytest.raises(ValueError):
        index_store.read_index(spark, path, signatures.MinHash(32))


def test_hyperplanes_projections_and_bits(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((30, 16))
    v[1] = -v[0]
    v[2] = 0
    rows = table(spark, [(i, x.tolist()) for i, x in enumerate(v)], "id long, item array<double>")
    sig = {r.id: [(w >> b) & 1 for w in r.sig for b in range(64)] for r in signatures.Hyperplanes(128, 16).transform(rows).collect()}
    planes = signatures.signs(128, 16)
    assert all(sig[i] == [int(x) for x in (planes @ v[i] > 0)] for i in range(30))
    assert not any(sig[2]) and sum(a == b for a, b in zip(sig[0], sig[1])) == 0
    p = signatures.Projections(8, 0.5, 16)
    got = {r.id: r for r in p.transform(rows, with_cost=True).collect()}
    at = v @ p.vectors().T / 0.5
    assert all(got[i].sig == np.floor(at[i]).astype(int).tolist() for i in range(30))
    assert all(0 <= c <= 0.5 for r in got.values() for c in r.cost)
    cut = {r.id: r.sig for r in signatures.Projections(8, 0.5, 16, rounding="trunc").transform(rows).collect()}
    assert all(cut[i] == np.trunc(at[i]).astype(int).tolist() for i in range(30))
    sparse = table(spark, [(0, [(3, 2.0), (17, -1.0)]), (1, [(3, 4.0), (17, -2.0)]), (2, [])], "id long, item array<struct<dim:int,value:double>>")
    s = {r.id: r.sig for r in signatures.SparseHyperplanes(64).transform(sparse).collect()}
    assert s[0] == s[1] and s[2] == [0]
    custom = signatures.CustomSketcher(2, lambda i: lambda x: F.size(x) + i).transform(rows)
    assert custom.first().sig == [16, 17]


def test_many_empty_sets_make_no_pairs(spark):
    rows = spark.range(0, 100_000).select("id", F.expr("cast(array() as array<int>)").alias("item"))
    assert build_index(rows, signatures.MinHash(16), BuildConfig(4)).candidate_pairs().count() == 0


def test_probes_flip_the_cheapest_bits(spark):
    v = np.random.default_rng(7).standard_normal((40, 8))
    rows = table(spark, [(i, x.tolist()) for i, x in enumerate(v)], "id long, item array<double>")
    dots = v @ signatures.signs(64, 8).T
    bits = (dots > 0).reshape(40, 8, 8)
    cheap = np.argsort(np.abs(dots).reshape(40, 8, 8), axis=2, kind="stable")[:, :, :2]
    want = set()
    for i in range(40):
        for b in range(8):
            probes = [bits[i, b]] + [np.where(np.arange(8) == j, ~bits[i, b], bits[i, b]) for j in cheap[i, b]]
            want |= {(i, k) for k in range(40) if any((bits[k, b] == p).all() for p in probes)}
    index = build_index(rows, signatures.Hyperplanes(64, 8), BuildConfig(8), config=QueryConfig(probes=3))
    assert {(r.id, r.other_id) for r in index.candidates(rows).collect()} == want
    family = signatures.Projections(4, 0.5, 8)
    got = {r.id: r for r in family.transform(rows, with_cost=True).collect()}
    index = build_index(rows, family, BuildConfig(2), score=st.euclidean, kind="dist", config=QueryConfig(probes=2))
    want = set()
    for i, r in got.items():
        for b in range(2):
            own = r.sig[2 * b : 2 * b + 2]
            j = min(range(2), key=lambda j: (r.cost[2 * b + j], j))
            flipped = [r.next[2 * b + k] if k == j else x for k, x in enumerate(own)]
            want |= {(i, k) for k, o in got.items() if o.sig[2 * b : 2 * b + 2] in (own, flipped)}
    assert {(r.id, r.other_id) for r in index.candidates(rows).collect()} == want


def test_recall_of_the_cosine_join(spark, sf_dir):
    found = {(r.id, r.other_id) for r in vector_queries.hyperplane_cosine_join(spark, sf_dir).collect()}
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in data], float)
    true = {(data[i].vec_id, data[j].vec_id) for i, j in zip(*np.nonzero(np.triu(x @ x.T, 1) >= vector_queries.COSINE))}
    assert len(true) > 20 and len(found & true) >= 0.9 * len(true)


def test_simhash_and_images(spark):
    rows = table(spark, [(0, ["a", "b", "c"]), (1, ["c", "b", "a"]), (2, []), (3, ["x"])], "id long, item array<string>")
    sig = {r.id: r.sig for r in signatures.SimHash().transform(rows).collect()}
    assert sig[0] == sig[1] and sig[2] == [0]
    assert sig[3] == [spark.range(1).select(signatures.string_hash64(F.lit("x")).alias("h")).first().h]
    low = {r.id: r.sig[0] & (2**64 - 1) for r in signatures.SimHash(compat32=True).transform(rows).collect()}
    assert all(v >> 32 == v & 0xFFFFFFFF for v in low.values())
    ramp = [[float(x + y) for x in range(32)] for y in range(32)]
    bright = [[p + 40 for p in row] for row in ramp]
    other = [[float((x * 7 + y * 3) % 11) for x in range(32)] for y in range(32)]
    pix = table(spark, [(0, ramp), (1, bright), (2, other)], "id long, item array<array<double>>")
    h = {r.id: r.sig[0] for r in signatures.PHash().transform(pix).collect()}
    assert h[0] == h[1] != h[2] and h[0] & 1 == 0


def test_image_files(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 4 2 255\n" + bytes(range(8)))
    rows = images.grey_pixels(images.image_files(spark, str(tmp_path), "*.pgm")).collect()
    assert rows[0].pixels == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]]


def test_top_k_ties(spark):
    rows = table(spark, [(1, 5, 0.5), (1, 4, 0.5), (1, 9, 0.9), (1, 2, 0.1)], "id long, other_id long, score double")
    assert [r.other_id for r in top_k(rows, 3).orderBy("rank").collect()] == [9, 4, 5]
    assert [r.other_id for r in top_k(rows, 2, "dist").orderBy("rank").collect()] == [2, 4]


def test_bloom(spark):
    assert bloom.optimal_size(1000, 0.01) == (9586, 7)
    shape = bloom.BloomShape.for_elements(500, 0.01)
    keys = spark.range(0, 500).select(F.col("id").cast("int").alias("k"))
    f = bloom.BloomFilter.build(keys, "k", shape)
    asked = f.contains(spark.range(0, 20500).select(F.col("id").cast("int").alias("k")), "k")
    assert asked.where("k < 500 and not maybe").count() == 0
    assert asked.where("k >= 500 and maybe").count() / 20000 <= 1.5 * shape.false_positive_rate(500)
    size = f.statistics().first().approximate_size
    assert abs(size - 500) < 40
    with pytest.raises(ValueError):
        f.union(bloom.BloomFilter.build(keys, "k", bloom.BloomShape.of(2, 64)))
    counted = bloom.CountingBloomFilter.build(keys.union(keys).union(keys.where("k = 1")), "k", shape, 2)
    got = {r.k: r.at_most for r in counted.count(keys, "k").collect()}
    assert got[1] == 3 and min(got.values()) >= 2 and max(got.values()) <= 3
    rows = table(spark, [("a", 1), (None, 2), ("a", 3), (None, 4)], "k string, t int")
    assert [r.seen for r in bloom.seen_before(rows, "k", "t").orderBy("t").collect()] == [False, False, True, True]


def test_dictionary_edges(spark):
    words = table(spark, [("b", 5), ("a", 70000), ("b", 1), ("c", 140000), (None, 0)], "s string, t long")
    index = frequency.string_index(words, "s", "t")
    assert {r.s: r.ordinal for r in index.collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r.s: r.ordinal for r in frequency.ordinal_of(table(spark, [("z",), ("c",)], "s string"), index, "s").collect()} == {"z": -1, "c": 2}
    empty = words.where("false")
    assert frequency.overlap_sizes(words, empty, "s").first().common == 0
    assert frequency.string_index(empty, "s", "t").count() == 0


def test_numbers_by_frequency(spark):
    rng = random.Random(6)
    rows = [(n, e) for n in range(60) for e in rng.sample(range(500), 9)]
    for kind in ("int", "string"):
        df = table(spark, [(n, e if kind == "int" else f"e{e:03}") for n, e in rows], f"id int, element {kind}")
        counts = {}
        for r in df.collect():
            counts[r.element] = counts.get(r.element, 0) + 1
        want = sorted(counts, key=lambda e: (counts[e], e))
        assert [r.element for r in st.renumber_by_frequency(df).orderBy("number").collect()] == want


def points(spark, rows):
    return table(spark, [(i, [float(x), float(y)]) for i, (x, y) in enumerate(rows)], "id long, item array<double>")


def test_metric_search_is_exact(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((120, 2))
    df = points(spark, xy)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    near = {(r.id, r.other_id) for r in metric.within(df, df, st.euclidean, 0.2).collect()}
    assert near == {(a, b) for a in range(120) for b in range(120) if d[a, b] <= 0.2}
    got = metric.nearest(df, df, st.euclidean, 5).collect()
    assert {(r.id, r.other_id) for r in got} == {(a, int(b)) for a in range(120) for b in np.argsort(d[a], kind="stable")[:5]}
    assert metric.nearest(df.limit(3), df, st.euclidean, 5).count() == 3 * 120
    assert metric.cell_sizes(df, st.euclidean).agg(F.sum("size")).first()[0] == 120
    assert metric.approximate_nearest(df, df, st.euclidean).where("distance = 0").count() == 120
    assert metric.within(df.where("false"), df, st.euclidean, 0.2).count() == 0
    manhattan = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    m = np.abs(xy[:, None] - xy[None]).sum(axis=2)
    assert {(r.id, r.other_id) for r in metric.within(df, df.where("id % 3 = 0"), manhattan, 0.2).collect()} == {(a, b) for a in range(0, 120, 3) for b in range(120) if m[a, b] <= 0.2}
    metric.BLOCK, kept = 7, metric.BLOCK
    assert {(r.id, r.other_id) for r in metric.within(df, df, st.euclidean, 0.2).collect()} == near
    metric.BLOCK = kept


def test_nearest_other_recall_on_embeddings(spark, sf_dir):
    rows = vector_queries.approximate_nearest(spark, sf_dir).collect()
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    vec_ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    asked = vec_ids[vec_ids % 20 == 0]
    assert sorted(r.id for r in rows) == asked.tolist() and all(r.other_id != r.id for r in rows)
    d = {int(q): np.where(vec_ids == q, np.inf, np.sqrt(((x - x[vec_ids == q]) ** 2).sum(axis=1))) for q in asked}
    assert np.mean([r.distance <= d[r.id].min() + 1e-6 for r in rows]) >= 0.9


def test_dbscan_cases(spark):
    line = [(i * 0.5, 0) for i in range(6)] + [(20 + i * 0.5, 0) for i in range(6)] + [(100, 0)]
    got = {r.id: r for r in clustering.dbscan(points(spark, line), 0.6, 3, st.euclidean).collect()}
    # A line's ends are border items: the least core id names the cluster.
    assert [got[i].cluster for i in range(13)] == [1] * 6 + [7] * 6 + [None]
    assert not got[0].is_core and got[1].is_core
    every = clustering.dbscan(points(spark, line[:6]), 0.6, 2, st.euclidean)
    assert every.where("cluster is null").count() == 0
    noise = clustering.dbscan(points(spark, [(0, 0), (9, 9)]), 0.5, 2, st.euclidean)
    assert noise.where("cluster is not null").count() == 0


def test_optics(spark):
    line = [(i * 0.5, 0) for i in range(6)] + [(20 + i * 0.5, 0) for i in range(6)]
    rows = clustering.optics(points(spark, line), 0.6, 2, st.euclidean).orderBy("start", "place").collect()
    assert [r.id for r in rows] == list(range(12))
    assert [r.reachability for r in rows] == [-1.0] + [0.5] * 5 + [-1.0] + [0.5] * 5
    assert all(r.core_distance == 0.5 for r in rows)


def plain_optics(d, eps, min_points):
    n = len(d)
    core = [sorted(row)[min_points - 1] if (row <= eps).sum() >= min_points else -1.0 for row in d]
    reach, done, out = {}, set(), []
    for start in range(n):
        if start in done:
            continue
        queue = {start: -1.0}
        while queue:
            i = min(queue, key=lambda k: (queue[k], k))
            del queue[i]
            done.add(i)
            out.append((i, reach.get(i, -1.0)))
            if core[i] >= 0:
                for j in np.flatnonzero(d[i] <= eps).tolist():
                    new = max(core[i], d[i, j])
                    if j not in done and new < reach.get(j, np.inf):
                        reach[j] = queue[j] = new
    return out


def test_optics_on_random_points(spark):
    xy = np.random.default_rng(9).random((90, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    rows = clustering.optics(points(spark, xy), 0.12, 4, st.euclidean).orderBy("start", "place").collect()
    want = plain_optics(d, 0.12, 4)
    assert [r.id for r in rows] == [i for i, _ in want]
    assert [r.reachability for r in rows] == pytest.approx([r for _, r in want])


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = clustering.connected_components(table(spark, edges, "id long, other_id long")).collect()
    assert all(r.component == root(r.id) for r in got)


def test_factors(spark):
    rng = np.random.default_rng(4)
    u, v = rng.random((20, 2)) + 0.5, rng.random((15, 2)) + 0.5
    rows = [(i, j, float(u[i] @ v[j])) for i in range(20) for j in range(15) if (i * 7 + j * 3) % 4]
    ratings = table(spark, rows, "user long, item long, rating double")
    users, items = factorization.als(ratings, 3, alpha=2.0, iterations=2)
    x, y = ({r.id: np.array(r.v) for r in t.collect()} for t in (users, items))
    # Each user's factors solve the normal equations for the items before the last half step: check the items' own.
    g = sum(np.outer(f, f) for f in x.values())
    for j in range(15):
        own = [(i, r) for i, k, r in rows if k == j]
        m = g + sum(2.0 * r * np.outer(x[i], x[i]) for i, r in own) + 0.1 * np.eye(3)
        assert np.allclose(y[j], np.linalg.solve(m, sum((1 + 2.0 * r) * x[i] for i, r in own)), atol=1e-8)

    def loss(t):
        p, q = ({r.id: np.array(r.v) for r in s.collect()} for s in t)
        return np.mean([(r - p[i] @ q[j]) ** 2 for i, j, r in rows])

    assert loss(factorization.funk_svd(ratings, 2, epochs=4, rate=0.05, regularization=0.01, init=0.5, blocks=2)) < 0.5 * loss(factorization.funk_svd(ratings, 2, epochs=0, init=0.5))


def test_gradient_steps_equal_plain_loops(spark):
    rng = np.random.default_rng(8)
    rows = [(i, j, float(rng.integers(1, 6))) for i in range(9) for j in range(7) if rng.random() < 0.6]
    start = [{r.id: list(r.v) for r in t.collect()} for t in factorization.funk_svd(table(spark, rows, "user long, item long, rating double"), 2, epochs=0)]
    u, v = start
    for _ in range(2):
        for i, j, r in sorted(rows):
            error = r - sum(a * b for a, b in zip(u[i], v[j]))
            u[i], v[j] = [a + 0.05 * (error * b - 0.1 * a) for a, b in zip(u[i], v[j])], [b + 0.05 * (error * a - 0.1 * b) for a, b in zip(u[i], v[j])]
    got = [{r.id: r.v for r in t.collect()} for t in factorization.funk_svd(table(spark, rows, "user long, item long, rating double"), 2, epochs=2, rate=0.05)]
    assert all(got[s][k] == pytest.approx((u, v)[s][k]) for s in range(2) for k in (u, v)[s])


STRINGS = [[], [""], ["", ""], ["a", "c", "b"], ["a", "", "aa"]]


@pytest.mark.parametrize("values", STRINGS)
def test_sort_small_strings(spark, values):
    df = table(spark, list(enumerate(values)), "seq int, s string")
    assert [r.s for r in sorting.sorted_by(df, F.col("s"), stable=F.col("seq")).collect()] == sorted(values)
    assert [r.s for r in sorting.lazily(df, F.col("s"))] == sorted(values)


def test_sort_random(spark):
    rng = random.Random(4747)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(16))) for _ in range(4096)]
    df = table(spark, list(enumerate(values)), "seq int, s string")
    placed = sorting.with_place(df, F.col("s"), F.col("seq")).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(4096)) and [r.s for r in placed] == sorted(values)
    assert [r.s for r in sorting.sorted_by(df, F.col("s"), descending=True).collect()] == sorted(values, reverse=True)
    blobs = [bytes(rng.randrange(256) for _ in range(rng.randrange(16))) for _ in range(256)]
    b = table(spark, [(bytearray(x),) for x in blobs], "b binary")
    assert [bytes(r.b) for r in b.orderBy("b").collect()] == sorted(blobs)
    assert [bytes(r.b) for r in b.orderBy(sorting.signed_bytes(F.col("b"))).collect()] == sorted(blobs, key=lambda x: [c - 256 if c > 127 else c for c in x])


def test_sort_numbers_options_unions(spark):
    ints = [*range(50), *[7] * 20, *range(50, 0, -1), *(256**k for k in range(4)), -1, -(2**31)]
    assert [r.k for r in sorting.sorted_by(table(spark, [(x,) for x in ints], "k int"), F.col("k")).collect()] == sorted(ints)
    some = [1, None, 2, None, -1]
    assert [r.k for r in sorting.sorted_by(table(spark, [(x,) for x in some], "k int"), F.col("k")).collect()] == [None, None, -1, 1, 2]
    both = [(1, None, "b"), (0, 5, None), (1, None, "a"), (0, -3, None)]
    df = table(spark, both, "tag int, l int, r string")
    assert [(x.l, x.r) for x in sorting.sorted_by(df, sorting.either(F.col("tag"), F.col("l"), F.col("r"))).collect()] == [(-3, None), (5, None), (None, "a"), (None, "b")]


def test_streams(spark, tmp_path):
    from vicinage.streaming.incoming import first_seen, stream_candidates

    v = np.random.default_rng(5).standard_normal((20, 8))
    rows = table(spark, [(i, x.tolist()) for i, x in enumerate(v)], "id long, item array<double>")
    index = build_index(rows, signatures.Hyperplanes(64, 8), BuildConfig(8))
    index.signatures.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, sig array<long>").parquet(str(tmp_path / "in"))
    run = stream_candidates(stream, index).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("found").where("id = other_id").select("id").distinct().count() == 20
    events = table(spark, [("a", 1), ("b", 2), ("a", 3)], "k string, s int").withColumn("t", F.timestamp_seconds("s"))
    events.write.parquet(str(tmp_path / "events"))
    once = first_seen(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "k", "t")
    run = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r.k for r in spark.table("once").collect()) == ["a", "b"]
