"""What an operator must not shuffle or make again."""

import random

from pyspark.sql import functions as F

from vicinage.operators import factorization, signatures
from vicinage.operators.similarity import BuildConfig, build_index


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_and_sparse_sides_are_taken_within_a_batch(spark):
    rows = spark.createDataFrame([(1, [5, 9, -3]), (2, [7]), (3, [])], "id long, item array<long>")
    found = signatures.MinHash(4).neighbours(rows)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    by = {r.id: r for r in found.collect()}
    from vicinage.functions.hashing import seeded_hash_value

    for c in range(4):
        assert [by[1].sig[c], by[1].next[c]] == sorted(seeded_hash_value(c * 1000, x) for x in (5, 9, -3))[:2]
    assert by[2].next == [None] * 4 and by[3].sig == [signatures.EMPTY] * 4
    sparse = spark.createDataFrame([(1, [(3, 2.0), (40, -1.0)]), (2, []), (3, [(3, 2.0), (40, -1.0)])], "id long, item array<struct<dim: long, value: double>>")
    sides = signatures.SparseHyperplanes(64).transform(sparse)
    assert "Aggregate" not in plan(sides) and "Generate" not in plan(sides)
    by = {r.id: r.sig for r in sides.collect()}
    assert by[1] == by[3] and by[2] == [0]


def test_collisions_are_counted_in_the_buckets(spark):
    rng = random.Random(3)
    items = [(i, sorted(rng.sample(range(40), 20))) for i in range(40)]
    index = build_index(spark.createDataFrame(items, "id long, item array<long>"), signatures.MinHash(16), BuildConfig(8))
    found = index.candidate_pairs()
    assert "collisions" in found.columns and "(id#" not in plan(found).split("MapInArrow")[0]
    b = index.bands.select("band", "slice", F.col("id").alias("other_id"))
    want = index.bands.join(b, ["band", "slice"]).where("id < other_id").groupBy("id", "other_id").count()
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def test_ratings_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ratings = spark.createDataFrame([(u, i, 1.0) for u in range(5) for i in range(4)], "user long, item long, rating double").mapInArrow(counted, "user long, item long, rating double")
    users, items = factorization.als(ratings, 2, iterations=2)
    assert users.count() == 5 and items.count() == 4 and seen.value == 20
