"""Orders: Spark sorts by range partition and, within it, by radix sort of key prefixes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.tables import saved


def sorted_by(df: DataFrame, *keys: Column, stable: Column | None = None, descending: bool = False) -> DataFrame:
    """Nulls first (last if descending); ``stable`` settles ties as given."""
    order = [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
    return df.orderBy(*order, *([stable.asc()] if stable is not None else []))


def with_place(df: DataFrame, *keys: Column, descending: bool = False, name: str = "place") -> DataFrame:
    """Adds each row's place, from 0, in the order of all rows: a global sort by range, counts of the ranges added up, places within."""
    order = [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
    # A constant number of ranges would cap the cluster: Spark's own shuffle setting decides.
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).select("*", F.monotonically_increasing_id().alias("_mark"))
    marked = saved(ranged, "ranges")
    starts = marked.groupBy("_part").agg(F.count("*").alias("_m")).withColumn("_start", F.sum("_m").over(Window.orderBy("_part")) - F.col("_m"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_mark")) - 1
    return marked.join(starts.select("_part", "_start"), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start", "_mark")


def signed_bytes(b: Column) -> Column:
    """A key that orders binary values by signed bytes; binary itself orders by unsigned ones."""
    return F.transform(F.filter(F.split(F.hex(b), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.pmod(F.conv(h, 16, 10).cast("int") + 128, F.lit(256)))


def either(tag: Column, left: Column, right: Column) -> Column:
    """A key that puts left values (tag 0) before right ones."""
    return F.struct(tag.alias("tag"), left.alias("left"), right.alias("right"))


def lazily(df: DataFrame, *keys: Column) -> Iterator[Row]:
    """Rows in order, a partition at a time on the driver."""
    return sorted_by(df, *keys).toLocalIterator(prefetchPartitions=False)
