"""Sets and sparse vectors: parts of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sets as st
from .inputs import baskets, load
from .registry import register

#: Pairs of orders of one customer: an equi-join with few rows for each key.
BASKETS_SQL = "b as materialized (select l_orderkey as id, list_sort(list(distinct l_partkey)) as item from lineitem group by l_orderkey)"
PAIRS_SQL = f"with {BASKETS_SQL}, o as (select o_custkey, o_orderkey from orders), p as materialized (select x.id, y.id as other_id, x.item as a, y.item as b from o m join o n on m.o_custkey = n.o_custkey and m.o_orderkey < n.o_orderkey join b x on x.id = m.o_orderkey join b y on y.id = n.o_orderkey)"
LONG_SQL = "with l as materialized (select distinct l_orderkey as id, l_partkey as element from lineitem)"


def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id < other_id, a, b``: the sets of two orders of one customer."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"))
    mine = baskets(spark, sf_dir).join(orders, "id")
    a = mine.select("o_custkey", "id", F.col("item").alias("a"))
    b = mine.select("o_custkey", F.col("id").alias("other_id"), F.col("item").alias("b"))
    return a.join(b, "o_custkey").where("id < other_id").drop("o_custkey")


def basket_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("element")).distinct()


@register("jaccard_baskets", f"{PAIRS_SQL}, c as (select id, other_id, len(list_intersect(a, b)) as c, len(a) as n, len(b) as m from p) select id, other_id, c::int as common, (n + m - c)::int as total, round(c / (n + m - c), 9) as jaccard from c where c > 0")
def jaccard_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = basket_pairs(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    return pairs.select("id", "other_id", st.intersection_size(a, b).alias("common"), st.union_size(a, b).alias("total"), F.round(st.jaccard(a, b), 9).alias("jaccard")).where("common > 0")


@register("set_functions", f"{PAIRS_SQL} select id, other_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as joined, array_to_string(list_sort(list_intersect(a, b)), ',') as common, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as difference, array_to_string(list_sort(list_concat(a, b)), ',') as merged, (a[-1] >= b[1] and b[-1] >= a[1]) as may_overlap, len(list_filter(a, lambda x: not list_contains(b, x)))::int as n_difference from p")
def set_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return basket_pairs(spark, sf_dir).select(
        "id", "other_id", text(st.union(a, b)).alias("joined"), text(st.intersection(a, b)).alias("common"), text(st.difference(a, b)).alias("difference"), text(st.merge_sorted(a, b)).alias("merged"), st.may_overlap(a, b).alias("may_overlap"), st.difference_size(a, b).alias("n_difference")
    )


@register("array_order_checks", "with x as (select l_orderkey as id, list(l_partkey order by l_linenumber, l_partkey) as a from lineitem group by l_orderkey) select id, a = list_sort(a) as increasing, a = list_sort(list_distinct(a)) as strictly, len(list_distinct(a))::int as n_distinct from x")
def array_order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in line order: whether they rise, and strictly."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    a = F.col("s.l_partkey")
    return lines.select("id", st.is_increasing(a).alias("increasing"), st.is_strictly_increasing(a).alias("strictly"), F.size(st.make_set(a)).alias("n_distinct"))


WEIGHTED_SQL = f"{PAIRS_SQL}, u as (select id, other_id, unnest(list_distinct(list_concat(a, b))) as e, a, b from p), s as (select id, other_id, sum(case when list_contains(a, e) and list_contains(b, e) then p_size else 0 end) as c, sum(p_size) as t from u join part on p_partkey = e group by all) select id, other_id, c::double as common_weight, t::double as union_weight, round(coalesce(c / nullif(t, 0), 0), 9) as weighted_jaccard from s where c > 0"


@register("weighted_jaccard", WEIGHTED_SQL)
def weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts weigh their size."""
    weights = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("element"), F.col("p_size").cast("double").alias("weight"))
    out = st.weighted_overlaps(basket_pairs(spark, sf_dir), weights, "a", "b", ["id", "other_id"]).where("common_weight > 0")
    return out.select("id", "other_id", "common_weight", "union_weight", F.round("weighted_jaccard", 9).alias("weighted_jaccard"))


@register("multiway_union", f"{LONG_SQL} select distinct element from l")
def multiway_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.union_of(basket_elements(spark, sf_dir))


@register("union_sizes_by_customer", "select o_custkey, count(distinct l_partkey) as n_parts from orders join lineitem on o_orderkey = l_orderkey group by o_custkey")
def union_sizes_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("n_parts"))


@register("frequent_items", f"{LONG_SQL} select element, count(*) as n_sets from l group by element having count(*) >= 35")
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.frequent_elements(basket_elements(spark, sf_dir), 35, "id")


@register("common_items", "with l as (select distinct l_linenumber as id, l_returnflag as element from lineitem) select element from l group by element having count(*) = (select count(distinct id) from l)")
def common_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags that occur at every line number."""
    sets = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("element")).distinct()
    return st.common_elements(sets, "id")


@register("renumber_by_frequency", f"{LONG_SQL}, c as (select element, count(*) as n from l group by element) select element, n, row_number() over (order by n, element) - 1 as number from c")
def renumber_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.renumber_by_frequency(basket_elements(spark, sf_dir))


@register("sparse_dot", "with v as materialized (select l_orderkey as id, l_partkey as d, sum(l_quantity) as q from lineitem group by all), o as (select o_custkey, o_orderkey from orders) select m.o_orderkey as id, n.o_orderkey as other_id, round(sum(x.q * y.q), 6) as dot from o m join o n on m.o_custkey = n.o_custkey and m.o_orderkey < n.o_orderkey join v x on x.id = m.o_orderkey join v y on y.id = n.o_orderkey and y.d = x.d group by all")
def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of parts as sparse vectors: products of two orders of one customer that share a part."""
    v = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_partkey", "q"))).alias("s"))
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id")).join(v, "id")
    other = rows.select("o_custkey", F.col("id").alias("other_id"), F.col("s").alias("t"))
    pairs = rows.join(other, "o_custkey").where("id < other_id").where(F.arrays_overlap("s.l_partkey", "t.l_partkey"))
    return pairs.select("id", "other_id", F.round(st.sparse_dot(F.col("s.l_partkey"), F.col("s.q"), F.col("t.l_partkey"), F.col("t.q")), 6).alias("dot"))
