"""Sets as sorted arrays of distinct values, and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window


def make_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def is_increasing(a: Column) -> Column:
    return a == F.array_sort(a)


def is_strictly_increasing(a: Column) -> Column:
    return a == make_set(a)


def intersection_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def union_size(a: Column, b: Column) -> Column:
    return F.size(F.array_union(a, b))


def difference_size(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets. The union's size follows from the sizes, so only one pass over the elements is made."""
    common = intersection_size(a, b)
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def may_overlap(a: Column, b: Column) -> Column:
    """Whether the ranges of two sorted sets meet; false if one is empty."""
    last = lambda x: F.get(x, F.size(x) - 1)
    return F.coalesce((last(a) >= F.get(b, F.lit(0))) & (last(b) >= F.get(a, F.lit(0))), F.lit(False))


def merge_sorted(a: Column, b: Column) -> Column:
    """All values of both arrays in order, repeats kept."""
    return F.array_sort(F.concat(a, b))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squared = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squared, F.lit(0.0), lambda s, x: s + x))


def sparse_dot(a_dims: Column, a_values: Column, b_dims: Column, b_values: Column) -> Column:
    """Dot product of two sparse vectors given as equally long arrays of dimensions and values."""
    b = F.map_from_arrays(b_dims, b_values)
    return F.aggregate(F.arrays_zip(a_dims.alias("d"), a_values.alias("v")), F.lit(0.0), lambda s, x: s + x["v"] * F.coalesce(F.element_at(b, x["d"]), F.lit(0.0)))


def union_of(sets: DataFrame, element: str = "element") -> DataFrame:
    """The distinct elements of all sets of a long table."""
    return sets.select(element).distinct()


def frequent_elements(sets: DataFrame, least: int, id_column: str, element: str = "element") -> DataFrame:
    """Elements of at least ``least`` sets, with their number; ``least`` up to 1 gives the union."""
    return sets.groupBy(element).agg(F.countDistinct(id_column).alias("n_sets")).where(F.col("n_sets") >= least)


def common_elements(sets: DataFrame, id_column: str, element: str = "element") -> DataFrame:
    """Elements that every set has."""
    total = sets.agg(F.countDistinct(id_column).alias("total"))
    return frequent_elements(sets, 1, id_column, element).join(F.broadcast(total), F.col("n_sets") == F.col("total")).select(element)


def renumber_by_frequency(sets: DataFrame, element: str = "element") -> DataFrame:
    """``element, n, number``: elements numbered from 0, rare ones first, ties by element.

    Numbers are global but not drawn in one task: most elements are rare, so a frequency's elements are cut into ranges, whose sizes are added up, and ranked within."""
    counts = sets.groupBy(element).agg(F.count("*").alias("n"))
    # Ranges at quantiles of the elements, the same for every frequency; as many as there are shuffle partitions.
    shares = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(sets.schema[element].dataType, NumericType):
        cuts = counts.agg(F.percentile_approx(element, F.array(*(F.lit(i / shares) for i in range(1, shares))), 1000).alias("c")).first().c if shares > 1 else None
        share = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [])))).cast(f"array<{sets.schema[element].dataType.simpleString()}>"), lambda c: c < F.col(element)))
    else:
        share = F.lit(0)
    placed = counts.withColumn("share", share)
    below = placed.groupBy("n", "share").agg(F.count("*").alias("m")).withColumn("start", F.sum("m").over(Window.orderBy("n", "share")) - F.col("m")).select("n", "share", "start")
    within = F.row_number().over(Window.partitionBy("n", "share").orderBy(element)) - 1
    return placed.join(below, ["n", "share"]).select(element, "n", (F.col("start") + within).alias("number"))


def weighted_overlaps(pairs: DataFrame, weights: DataFrame, a: str, b: str, keys: list[str], element: str = "element", weight: str = "weight") -> DataFrame:
    """For rows with two arrays, told apart by ``keys``: weights of intersection and union, and their quotient (0 if the union has none)."""
    marked = pairs.select(*keys, F.explode(F.array_union(a, b)).alias(element), F.col(a).alias("_a"), F.col(b).alias("_b")).select(*keys, element, (F.array_contains("_a", F.col(element)) & F.array_contains("_b", F.col(element))).alias("_both"))
    sums = marked.join(weights, element, "left").groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_both"), F.col(weight))), F.lit(0.0)).alias("common_weight"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("union_weight"))
    out = pairs.join(sums, keys, "left").fillna(0.0, ["common_weight", "union_weight"])
    return out.withColumn("weighted_jaccard", F.coalesce(F.try_divide("common_weight", "union_weight"), F.lit(0.0)))
