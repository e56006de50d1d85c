"""Range and nearest-neighbour search in metric spaces, pruned by distances to pivots.

For every pivot p, |d(x, p) - d(q, p)| <= d(x, q). Items lie in the cell of their nearest pivot; a query meets only the cells, and in them the items, that this doesn't
rule out, in an equi-join on the cell. The number of pivots grows with the root of the number of items (up to ``MOST_PIVOTS``). Where vectors have many dimensions nearly all distances are alike and
no cell can be ruled out: Euclidean distances are therefore found by ``blocks``, in products of matrices, which send each vector a fixed number of times whatever the number of pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as st
from . import blocks

MOST_PIVOTS, BLOCK = 1024, 1024
Distance = Callable[[Column, Column], Column]


def pick_pivots(items: DataFrame, n: int | None = None, id_column: str = "id", item_column: str = "item") -> DataFrame:
    """One row, ``ps``: the items of the ``n`` ids with the least MD5."""
    known = items.where(F.col(item_column).isNotNull())
    n = n or min(MOST_PIVOTS, max(16, math.isqrt(known.count())))
    first = known.select(F.md5(F.col(id_column).cast("string").cast("binary")).alias("h"), F.col(id_column).alias("i"), F.col(item_column).alias("p")).orderBy("h", "i").limit(n)
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "i", "p"))), lambda x: x["p"]).alias("ps"))


def with_pivots(items: DataFrame, distance: Distance, pivots: DataFrame, item_column: str = "item") -> DataFrame:
    """Adds ``pivots``, the array of distances to each. The pivots, of bounded number, are one row that meets all others."""
    return items.crossJoin(F.broadcast(pivots)).withColumn("pivots", F.transform("ps", lambda p: distance(F.col(item_column), p))).drop("ps")


def _cells(items: DataFrame, distance: Distance, pivots: DataFrame) -> DataFrame:
    """``other_id, _b, cell, _own``: each item's cell and its distance from that pivot."""
    nearest_cell = F.array_position("pivots", F.array_min("pivots")).cast("int") - 1
    return with_pivots(items.where("item is not null"), distance, pivots).select(F.col("id").alias("other_id"), F.col("item").alias("_b"), nearest_cell.alias("cell"), F.array_min("pivots").alias("_own"))


def _asked(queries: DataFrame, distance: Distance, pivots: DataFrame) -> DataFrame:
    """``id, _a, cell, _d``: each query's distance from each pivot."""
    return with_pivots(queries.where("item is not null"), distance, pivots).select("id", F.col("item").alias("_a"), F.posexplode("pivots").alias("cell", "_d"))


def _extents(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.min("_own").alias("_low"), F.max("_own").alias("_high"), F.count("*").alias("_n"))


def _vectors(items: DataFrame) -> DataFrame:
    return items.where("item is not null").select("id", F.col("item").cast("array<double>").alias("item"))


def _kinds(items: DataFrame, queries: DataFrame) -> str:
    return f"id {queries.schema['id'].dataType.simpleString()}, other_id {items.schema['id'].dataType.simpleString()}, distance double"


def within(items: DataFrame, queries: DataFrame, distance: Distance, radius: float, n_pivots: int | None = None) -> DataFrame:
    """``id, other_id, distance`` of all items within ``radius`` of each query (both tables: id, item); exact in any metric."""
    if distance is st.euclidean:
        return blocks.met(_vectors(items), None if items is queries else _vectors(queries), blocks.within_kernel(radius, BLOCK), _kinds(items, queries))
    pivots = pick_pivots(items, n_pivots)
    slack = radius * (1 + 1e-12) + 1e-12
    cells = _cells(items, distance, pivots)
    extent = _extents(cells)
    # As many rows as pivots: their number is bounded.
    reach = _asked(queries, distance, pivots).join(F.broadcast(extent), "cell").where((F.col("_d") - slack <= F.col("_high")) & (F.col("_d") + slack >= F.col("_low")))
    near = reach.join(cells, "cell").where(F.abs(F.col("_d") - F.col("_own")) <= slack)
    return near.select("id", "other_id", distance(F.col("_a"), F.col("_b")).alias("distance")).where(F.col("distance") <= radius)


def pairs_within(items: DataFrame, distance: Distance, radius: float) -> DataFrame:
    """As ``within`` of a table with itself, each pair once: ``id < other_id, distance``."""
    if distance is st.euclidean:
        return blocks.met(_vectors(items), None, blocks.pairs_kernel(radius, BLOCK), _kinds(items, items))
    return within(items, items, distance, radius).where("id < other_id")


def counts_within(items: DataFrame, distance: Distance, radius: float) -> DataFrame:
    """``id, n``: how many items, itself included, lie within ``radius`` of each; pairs are counted where they are found."""
    if distance is st.euclidean:
        parts = blocks.met(_vectors(items), None, blocks.count_kernel(radius), f"id {items.schema['id'].dataType.simpleString()}, n long")
        return parts.groupBy("id").agg(F.sum("n").alias("n"))
    return within(items, items, distance, radius).groupBy("id").agg(F.count("*").alias("n"))


def nearest(items: DataFrame, queries: DataFrame, distance: Distance, k: int, n_pivots: int | None = None, seen: int = 2, radius: float = math.inf) -> DataFrame:
    """``id, other_id, distance, rank``: the exact ``k`` nearest items of each query, of those within ``radius``.

    A query first looks at the ``seen`` nearest cells, which bounds its radius by the k-th distance found there; then at the cells that the triangle
    inequality can't rule out for that radius. Both steps are equi-joins on the cell. Euclidean distances go by ``blocks``, whose ``k`` best by tile are merged."""
    order = Window.partitionBy("id").orderBy("distance", "other_id")
    if distance is st.euclidean:
        found = blocks.met(_vectors(items), _vectors(queries), blocks.nearest_kernel(k, radius), _kinds(items, queries))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    pivots = pick_pivots(items, n_pivots)
    cells, asked = _cells(items, distance, pivots), _asked(queries, distance, pivots)
    extent = _extents(cells)
    # Enough of the nearest cells to hold k items give the radius.
    by_near = Window.partitionBy("id").orderBy("_d", "cell")
    ranked = asked.join(F.broadcast(extent), "cell").withColumn("_nth", F.row_number().over(by_near)).withColumn("_before", F.sum("_n").over(by_near.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    first = ranked.where((F.col("_nth") <= seen) | (F.col("_before") < k))
    scored = first.join(cells, "cell").select("id", distance(F.col("_a"), F.col("_b")).alias("distance"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("distance"))
    radius = scored.withColumn("_k", nth).where(F.col("_k") <= k).groupBy("id").agg(F.max("distance").alias("_r"), F.count("*").alias("_found"))
    reach = ranked.join(radius, "id").where((F.col("_found") < k) | ((F.col("_d") - F.col("_r") <= F.col("_high") + 1e-12) & (F.col("_d") + F.col("_r") >= F.col("_low") - 1e-12)))
    found = reach.join(cells, "cell").where((F.col("_found") < k) | (F.abs(F.col("_d") - F.col("_own")) <= F.col("_r") + 1e-12)).select("id", "other_id", distance(F.col("_a"), F.col("_b")).alias("distance"))
    return found.where(F.col("distance") <= radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def approximate_nearest(items: DataFrame, queries: DataFrame, distance: Distance, n_pivots: int | None = None, others: bool = False) -> DataFrame:
    """The nearest item of each query: ``id, other_id, distance``; with ``others``, of those with another id than the query's.

    A query's own cell alone holds too few of the nearest items, so the search goes on to all cells that ``nearest`` can't rule out: recall is 1."""
    found = nearest(items, queries, distance, 2 if others else 1, n_pivots)
    if others:
        found = found.where("other_id <> id")
    return found.groupBy("id").agg(F.min(F.struct("distance", "other_id")).alias("m")).select("id", "m.other_id", "m.distance")


def cell_sizes(items: DataFrame, distance: Distance, n_pivots: int | None = None) -> DataFrame:
    """How evenly the pivots cut the items: ``cell, size, radius``."""
    pivots = pick_pivots(items, n_pivots)
    rows = with_pivots(items.where("item is not null"), distance, pivots).select((F.array_position("pivots", F.array_min("pivots")) - 1).alias("cell"), F.array_min("pivots").alias("d"))
    return rows.groupBy("cell").agg(F.count("*").alias("size"), F.max("d").alias("radius"))
