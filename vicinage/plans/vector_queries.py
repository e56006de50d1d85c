"""Embeddings: hyperplanes, projections, metric search and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sets as st
from ..functions.hashing import seeded_hash16_sql
from ..operators import blocks, clustering, metric
from ..operators.similarity import BuildConfig, QueryConfig, build_index, top_k
from ..operators.signatures import Hyperplanes, PHash, Projections, SparseHyperplanes, signs
from .document_queries import JOINED, index_of
from .inputs import bands_sql, load, vectors
from .registry import register

DIM = 64


def _product_sql(v: str, plane) -> str:
    return "(" + " ".join(f"{'+' if s > 0 else '-'} {v}[{j + 1}]::double" for j, s in enumerate(plane)) + ")"


def bits_sql(n: int) -> str:
    return "with v as materialized (select vec_id as id, " + ", ".join(f"({_product_sql('embedding', p)} > 0)::int as b{i}" for i, p in enumerate(signs(n, DIM))) + " from embeddings)"


BITS_SQL = bits_sql(64)
#: For cosines of at least 0.4: bands of six bits, of which two such vectors share one with a probability of 0.94.
BITS, BANDS, COSINE = 256, 42, 0.4
PACKED_SQL = "(" + " + ".join(f"(b{i}::bigint << {i})" for i in range(63)) + " + case when b63 = 1 then -9223372036854775808 else 0 end)"
DOT_SQL = "list_dot_product(a.embedding::double[], b.embedding::double[])"
DISTANCE_SQL = "list_distance(a.embedding::double[], b.embedding::double[])"


@register("hyperplane_bits", f"{BITS_SQL} select id, {PACKED_SQL} as bits from v")
def hyperplane_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Hyperplanes(64, DIM).transform(vectors(spark, sf_dir)).select("id", F.get("sig", F.lit(0)).alias("bits"))


@register("hyperplane_costs", "select vec_id as id, " + ", ".join(f"round(abs({_product_sql('embedding', p)}), 6) as c{i}" for i, p in enumerate(signs(64, DIM))) + " from embeddings")
def hyperplane_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flipping each bit would cost: the distance from the hyperplane."""
    sig = Hyperplanes(64, DIM).transform(vectors(spark, sf_dir), with_cost=True)
    return sig.select("id", *(F.round(F.get("cost", F.lit(i)), 6).alias(f"c{i}") for i in range(64)))


_HYPERPLANE_PAIRS_SQL = f"{bits_sql(BITS)}, {bands_sql(BITS, BANDS, 'b', 'v')}, p as (select distinct a.id, b.id as other_id from bands a join bands b on a.band = b.band and a.slice = b.slice and a.id < b.id)"


@register("hyperplane_cosine_join", f"{_HYPERPLANE_PAIRS_SQL}, s as (select p.id, p.other_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as score from p join embeddings a on a.vec_id = p.id join embeddings b on b.vec_id = p.other_id) select * from s where score >= {COSINE}")
def hyperplane_cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.4; recall is measured in tests/test_operators.py."""
    index = build_index(vectors(spark, sf_dir), Hyperplanes(BITS, DIM), BuildConfig(BANDS), config=QueryConfig(threshold=COSINE - 1e-5))  # what rounds up to it counts
    return index.scored_pairs().withColumn("score", F.round("score", 5)).where(f"score >= {COSINE}")


_LEAST = Hyperplanes(BITS, DIM).estimator.least_same(COSINE)


@register("hyperplane_estimates", f"{_HYPERPLANE_PAIRS_SQL}, s as (select p.id, p.other_id, {' + '.join(f'(a.b{i} = b.b{i})::int' for i in range(BITS))} as same from p join v a on a.id = p.id join v b on b.id = p.other_id), m as (select id, other_id, round(cos(pi() * (1 - same / {BITS}.0)), 6) as score from s where same >= {_LEAST}) select * from m union all select other_id, id, score from m")
def hyperplane_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of at least 0.4 estimated from bits."""
    index = build_index(vectors(spark, sf_dir), Hyperplanes(BITS, DIM), BuildConfig(BANDS), score="estimate", config=QueryConfig(threshold=COSINE))
    return index.self_join().select("id", "other_id", F.round("score", 6).alias("score"))


_PROBES_SQL = f"""{BITS_SQL.replace(' from embeddings)', ', ' + ', '.join(f"abs({_product_sql('embedding', p)}) as c{i}" for i, p in enumerate(signs(64, DIM))) + ' from embeddings)')},
l as materialized (select id, unnest([{', '.join(f"{{band: {i // 8}, j: {i % 8}, bit: b{i}, cost: c{i}}}" for i in range(64))}], recursive := true) from v),
s as materialized (select id, band, sum(bit << j)::bigint as slice from l group by all),
f as (select id, band, j from (select *, row_number() over (partition by id, band order by cost, j) as nth from l where id % 20 = 0) where nth <= 2),
p as (select id, band, slice from s where id % 20 = 0 union all select f.id, f.band, xor(slice, (1 << j)::bigint) from f join s on s.id = f.id and s.band = f.band)
select p.id, s.id as other_id, count(*) as collisions from p join s on s.band = p.band and s.slice = p.slice group by all"""


@register("hyperplane_probes", _PROBES_SQL)
def hyperplane_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every twentieth vector; each band is also looked up with either of the two bits flipped that cost the least."""
    index = build_index(vectors(spark, sf_dir), Hyperplanes(64, DIM), BuildConfig(8), config=QueryConfig(probes=3))
    return index.candidates(index.items.where("id % 20 = 0"))


def _sparse_sign_sql(i: int) -> str:
    return f"(case when (({seeded_hash16_sql(i * 1000, '((d + 1337) // 16)')} >> ((d + 1337) % 16)::int) & 1) = 1 then 1 else -1 end)"


@register("sparse_hyperplanes", "with t as (select l_orderkey as id, l_partkey as d, sum(l_quantity) as q from lineitem group by all), v as (select id, " + ", ".join(f"(sum(q * {_sparse_sign_sql(i)}) > 0)::int as b{i}" for i in range(64)) + f" from t group by id) select id, {PACKED_SQL} as bits from v")
def sparse_hyperplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
    items = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("dim"), "value")).alias("item"))
    return SparseHyperplanes(64).transform(items).select("id", F.get("sig", F.lit(0)).alias("bits"))


def _projection_sql(i: int) -> str:
    v = Projections(4, 0.05, DIM).vectors()[i]
    return "floor((" + " + ".join(f"embedding[{j + 1}]::double * {x!r}" for j, x in enumerate(v.tolist())) + ") / 0.05)::int"


@register("projection_buckets", "select vec_id as id, " + ", ".join(f"{_projection_sql(i)} as p{i}" for i in range(4)) + " from embeddings")
def projection_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = Projections(4, 0.05, DIM).transform(vectors(spark, sf_dir))
    return sig.select("id", *(F.get("sig", F.lit(i)).alias(f"p{i}") for i in range(4)))


@register("distance_join", f"select a.vec_id as id, b.vec_id as other_id, round({DISTANCE_SQL}, 6) as score from embeddings a join embeddings b on a.vec_id < b.vec_id where {DISTANCE_SQL} <= 1.15")
def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at a distance of at most 1.15, by metric search: exact."""
    rows = vectors(spark, sf_dir).select("id", "item")
    return metric.pairs_within(rows, st.euclidean, 1.15).select("id", "other_id", F.round("distance", 6).alias("score"))


def _projections_sql(n: int, bucket: float) -> str:
    rows = Projections(n, bucket, DIM).vectors().tolist()
    return ", ".join("floor((" + " + ".join(f"embedding[{j + 1}]::double * {x!r}" for j, x in enumerate(row)) + f") / {bucket})::int as p{i}" for i, row in enumerate(rows))


@register("projection_join", f"with v as materialized (select vec_id as id, {_projections_sql(16, 0.3)} from embeddings), {bands_sql(16, 8, 'p', 'v')}, p as (select distinct a.id, b.id as other_id from bands a join bands b on a.band = b.band and a.slice = b.slice and a.id < b.id), s as (select p.id, p.other_id, {DISTANCE_SQL} as d from p join embeddings a on a.vec_id = p.id join embeddings b on b.vec_id = p.other_id) select id, other_id, round(d, 6) as score from s where d <= 1.15")
def projection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As distance_join by buckets of projections, a distance rank: a subset of its rows."""
    index = build_index(vectors(spark, sf_dir), Projections(16, 0.3, DIM), BuildConfig(8), score=st.euclidean, kind="dist", config=QueryConfig(threshold=1.15))
    return index.scored_pairs().select("id", "other_id", F.round("score", 6).alias("score"))


@register("brute_force_cosine", f"with p as (select a.vec_id as id, b.vec_id as other_id, round({DOT_SQL}, 5) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by id order by score desc, other_id) as rank from p) select id, other_id, score, rank::int as rank from r where rank <= 5")
def brute_force_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of every twentieth vector among all: a stated query set against all rows."""
    rows = vectors(spark, sf_dir).select("id", "item")
    return top_k(blocks.met(rows, rows.where("id % 20 = 0"), blocks.largest_dots_kernel(5, 5), "id long, other_id long, score double"), 5)


@register("vector_functions", "select vec_id as id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(list_dot_product(embedding::double[], list_reverse(embedding::double[])), 5) as mirrored from embeddings")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.round(st.norm(F.col("item")), 6).alias("norm"), F.round(st.dot(F.col("item"), F.reverse("item")), 5).alias("mirrored"))


@register("metric_range", f"select a.vec_id as id, b.vec_id as other_id, round({DISTANCE_SQL}, 6) as distance from embeddings a join embeddings b on {DISTANCE_SQL} <= 1.15 where a.vec_id % 20 = 0")
def metric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "item")
    return metric.within(rows, rows.where("id % 20 = 0"), st.euclidean, 1.15).withColumn("distance", F.round("distance", 6))


@register("knn_embeddings", f"with p as (select a.vec_id as id, b.vec_id as other_id, {DISTANCE_SQL} as distance from embeddings a, embeddings b where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by id order by distance, other_id) as rank from p) select id, other_id, round(distance, 6) as distance, rank::int as rank from r where rank <= 4")
def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "item")
    return metric.nearest(rows, rows.where("id % 20 = 0"), st.euclidean, 4).withColumn("distance", F.round("distance", 6))


@register("approximate_nearest", f"with p as (select a.vec_id as id, b.vec_id as other_id, {DISTANCE_SQL} as d from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by id order by d, other_id) as nth from p) select id, other_id, round(d, 6) as distance from r where nth = 1")
def approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of every twentieth."""
    rows = vectors(spark, sf_dir).select("id", "item")
    return metric.approximate_nearest(rows, rows.where("id % 20 = 0"), st.euclidean, others=True).withColumn("distance", F.round("distance", 6))


@register("pivot_cells", f"with n as (select least({metric.MOST_PIVOTS}, greatest(16, floor(sqrt(count(*)))))::bigint as n from embeddings), o as (select vec_id, embedding, row_number() over (order by md5(vec_id::varchar), vec_id) - 1 as nth from embeddings), p as (select nth, embedding from o, n where nth < n.n), d as (select a.vec_id, b.nth, {DISTANCE_SQL} as d from embeddings a, p b), c as (select vec_id, arg_min(nth, d) as cell, min(d) as d from d group by vec_id) select cell::int as cell, count(*) as size, round(max(d), 6) as radius from c group by cell")
def pivot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.cell_sizes(vectors(spark, sf_dir).select("id", "item"), st.euclidean).withColumn("radius", F.round("radius", 6))


EPS, POINTS = 1.19, 4
NEAR_SQL = f"with near as materialized (select a.vec_id as id, b.vec_id as other_id, {DISTANCE_SQL} as d from embeddings a join embeddings b on {DISTANCE_SQL} <= {EPS})"


@register("region_query", f"{NEAR_SQL} select id, count(*) as n from near group by id")
def region_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.counts_within(vectors(spark, sf_dir).select("id", "item"), st.euclidean, EPS)


@register("dbscan_core_flags", f"{NEAR_SQL} select id, count(*) as n_neighbours, count(*) >= {POINTS} as is_core from near group by id")
def dbscan_core_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "item")
    return clustering.core_flags(rows, None, POINTS, st.euclidean, EPS)


@register("dbscan_clusters", f"{NEAR_SQL.replace('with near', 'with recursive near')}, core as materialized (select id from near group by id having count(*) >= {POINTS}), ce as materialized (select n.id, n.other_id from near n join core a on a.id = n.id join core b on b.id = n.other_id), reach(id, c) as (select id, id from core union select ce.other_id, r.c from reach r join ce on ce.id = r.id where r.c <= ce.other_id), label as (select id, min(c) as c from reach group by id), border as (select n.id, min(l.c) as c from near n join label l on l.id = n.other_id group by n.id) select e.vec_id as id, c.id is not null as is_core, coalesce(l.c, b.c, -1) as cluster from embeddings e left join core c on c.id = e.vec_id left join label l on l.id = e.vec_id left join border b on b.id = e.vec_id")
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 is noise."""
    return clustering.dbscan(vectors(spark, sf_dir).select("id", "item"), EPS, POINTS, st.euclidean).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


_CLOSE_SQL = f"{JOINED}, near as (select id, id as other_id from docs union all select id, other_id from scored where score >= 0.5 union all select other_id, id from scored where score >= 0.5)"


@register("dbscan_documents", f"{_CLOSE_SQL.replace('with ', 'with recursive ', 1)}, core as materialized (select id from near group by id having count(*) >= 2), ce as materialized (select n.id, n.other_id from near n join core a on a.id = n.id join core b on b.id = n.other_id), reach(id, c) as (select id, id from core union select ce.other_id, r.c from reach r join ce on ce.id = r.id where r.c <= ce.other_id), label as (select id, min(c) as c from reach group by id), border as (select n.id, min(l.c) as c from near n join label l on l.id = n.other_id group by n.id) select d.id, c.id is not null as is_core, coalesce(l.c, b.c, -1) as cluster from docs d left join core c on c.id = d.id left join label l on l.id = d.id left join border b on b.id = d.id")
def dbscan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents with the caller's neighbours: those that an index finds at a similarity of at least 0.5. -1 is noise."""
    index = index_of(spark, sf_dir, threshold=0.5)
    near = index.self_join().select("id", "other_id", (1 - F.col("score")).alias("distance")).union(index.items.select("id", "id", F.lit(0.0)))
    return clustering.dbscan(index.items, 0.5, 2, neighbours=near).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


@register("optics_core_distance", f"{NEAR_SQL}, r as (select id, d, row_number() over (partition by id order by d, other_id) as nth from near) select e.vec_id as id, round(coalesce(r.d, -1), 6) as core_distance from embeddings e left join r on r.id = e.vec_id and nth = {POINTS}")
def optics_core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "item")
    near = metric.nearest(rows, rows, st.euclidean, POINTS, radius=EPS)
    return clustering.core_distances(rows, near, POINTS).withColumn("core_distance", F.round("core_distance", 6))


@register("optics_order")
def optics_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a priority queue decides. tests/test_operators.py compares it with a plain version."""
    return clustering.optics(vectors(spark, sf_dir).select("id", "item"), EPS, POINTS, st.euclidean)


def _image_sql() -> str:
    """The low corner of the cosine transform is linear in the 64 pixels, each of which fills four by four of the picture's 32 by 32."""
    basis = PHash().basis()[:8].reshape(8, 8, 4).sum(axis=2)
    weights = np.einsum("ur,vc->uvrc", basis, basis).reshape(64, 64) / 4
    corner = ", ".join("(" + " + ".join(f"embedding[{j + 1}]::double * {x!r}" for j, x in enumerate(row)) + f") as k{i}" for i, row in enumerate(weights.tolist()))
    mean = "(" + " + ".join(f"k{i}" for i in range(1, 64)) + ") / 63"
    return f"with k as materialized (select vec_id as id, {corner} from embeddings), m as (select *, {mean} as mean from k), v as (select id, 0 as b0, {', '.join(f'(k{i} > mean)::int as b{i}' for i in range(1, 64))} from m) select id, {PACKED_SQL} as bits from v"


@register("image_hashes", _image_sql())
def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings seen as grey pictures of 8 by 8 pixels."""
    pixels = vectors(spark, sf_dir).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("item", r * 8 + 1, 8)).alias("item"))
    return PHash().transform(pixels).select("id", F.get("sig", F.lit(0)).alias("bits"))
