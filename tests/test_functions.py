import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.functions import estimators as es
from vicinage.functions import hashing as h
from vicinage.functions import sets as st


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_seeded_hash_values(spark):
    assert h.seeded_parameters(0) == (8521207142356787825, 2604232894)
    assert h.seeded_hash_value(0, 1) == 1983998144
    assert h.seeded_hash_value(0, -7) == -1003085118
    xs = [0, 1, -1, -7, 12345, 2**31 - 1, -(2**31)]
    for seed in (0, 1, 1000, 63000):
        got = spark.createDataFrame([(x,) for x in xs], "x int").select("x", h.seeded_hash(seed, F.col("x")).alias("v")).collect()
        a, b = h.seeded_parameters(seed)
        for r in got:
            word = ((a * r.x + b) >> 32) & 0xFFFFFFFF
            assert r.v == (word - (1 << 32) if word >> 31 else word)


def test_seeded_hash16(spark):
    a, b = h.seeded_parameters(3000, 16)
    for r in spark.range(0, 1 << 27, 1 << 20).select("id", h.seeded_hash16(3000, F.col("id")).alias("v")).collect():
        assert r.v == ((a * r.id + b) >> 48) & 0xFFFF


def test_string_hashes(spark):
    r = spark.createDataFrame([("Hello é",), ("",)], "s string").select(h.string_hash32(F.col("s")).alias("v")).collect()
    assert [x.v for x in r] == [2470365435, 0]
    assert one(spark, h.element_code(F.lit("a")).alias("v")).v == 214005177 >> 4


def test_generators():
    g = h.Lcg(42)
    values = [g.next_gaussian() for _ in range(2000)]
    assert abs(np.mean(values)) < 0.1 and abs(np.std(values) - 1) < 0.1
    x = h.Xorshift128()
    assert len({x.next_int() for _ in range(1000)}) == 1000


def test_bit_helpers(spark):
    words = [0x0123456789ABCDEF, -1]
    r = spark.createDataFrame([(words,)], "w array<long>").select(h.bit_slice(F.col("w"), 4, 8).alias("a"), h.bit_slice(F.col("w"), 60, 8).alias("b")).first()
    whole = words[0] | (((1 << 64) - 1) << 64)
    assert r.a == (whole >> 4) & 255 and r.b == (whole >> 60) & 255
    bits = [i % 3 == 0 for i in range(128)]
    packed = spark.createDataFrame([([int(b) for b in bits],)], "b array<int>").select(h.pack_bits(F.col("b")).alias("p")).first().p
    assert [(packed[i // 64] >> (i % 64)) & 1 for i in range(128)] == [int(b) for b in bits]
    r = one(spark, *(h.higher_power_of_two(F.lit(x)).alias(f"p{x}") for x in (0, 1, 3, 64, 65)))
    assert list(r) == [1, 1, 4, 64, 128]
    pair = h.pack_pair(F.lit(-5), F.lit(-9))
    assert list(one(spark, h.unpack_high(pair).alias("a"), h.unpack_low(pair).alias("b"))) == [-5, -9]


def test_set_functions(spark):
    rng = np.random.default_rng(0)
    rows = [([], []), ([1], []), ([1, 2, 3], [1, 2, 3])] + [(sorted({*map(int, rng.integers(0, 30, rng.integers(0, 20)))}), sorted({*map(int, rng.integers(0, 30, rng.integers(0, 20)))})) for _ in range(60)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select(
        "a", "b", st.union(a, b).alias("u"), st.intersection(a, b).alias("i"), st.difference(a, b).alias("d"), st.jaccard(a, b).alias("j"), st.may_overlap(a, b).alias("o"), st.merge_sorted(a, b).alias("m"), st.is_strictly_increasing(a).alias("s"), st.union_size(a, b).alias("n")
    ).collect()
    for r in got:
        x, y = set(r.a), set(r.b)
        assert r.u == sorted(x | y) and r.i == sorted(x & y) and r.d == sorted(x - y) and r.m == sorted(r.a + r.b) and r.s and r.n == len(x | y)
        assert r.j == pytest.approx(len(x & y) / len(x | y) if x | y else 0)
        assert r.o or not (x & y)


def test_bands_and_estimators(spark):
    assert [es.pick_bands(t, n) for t, n in ((0.5, 64), (0.85, 64), (0.8, 128), (0.5, 128))] == [16, 6, 12, 27]
    assert [es.pick_hashes_and_bands(t, n) for t, n in ((0.5, 64), (0.85, 64), (0.8, 128), (0.5, 128))] == [(64, 16), (60, 6), (120, 12), (108, 27)]
    assert es.Estimator(64).least_same(0.85) == 54 and es.CosineEstimator(64).least_same(0.6) == 45
    assert es.SingleBitEstimator(64).least_same(1.0) == 64
    r = one(spark, es.CosineEstimator(64).estimate(F.lit(64)).alias("a"), es.SingleBitEstimator(64).estimate(F.lit(32)).alias("b"), es.inclusion_probability(F.lit(0.5), 64, 16).alias("c"))
    assert r.a == pytest.approx(1) and r.b == pytest.approx(0) and r.c == pytest.approx(1 - (1 - 0.5**4) ** 16)
    assert es.estimated_threshold(64, 16) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        es.NoEstimator(8).estimate(F.lit(1))
    with pytest.raises(ValueError):
        es.pick_bands(0, 64)
    assert math.isclose(es.estimated_threshold(64, 1), 1.0)


def test_sparse_dot(spark):
    r = spark.createDataFrame([([1, 5, 9], [1.0, 2.0, 3.0], [5, 9, 11], [4.0, 0.5, 7.0])], "a array<int>, x array<double>, b array<int>, y array<double>")
    assert r.select(st.sparse_dot(*map(F.col, "axby")).alias("d")).first().d == 9.5


def test_weighted_overlaps(spark):
    pairs = spark.createDataFrame([(1, [1, 2], [2, 3]), (2, [], [])], "k int, a array<int>, b array<int>")
    weights = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0)], "element int, weight double")
    got = {r.k: r.weighted_jaccard for r in st.weighted_overlaps(pairs, weights, "a", "b", ["k"]).collect()}
    assert got == {1: 0.25, 2: 0.0}
