"""Counts, dictionaries, ordinals and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved


def frequencies(df: DataFrame, key: str, amount: str | None = None) -> DataFrame:
    """``key, n``."""
    return df.groupBy(key).agg((F.sum(amount) if amount else F.count("*")).cast("long").alias("n"))


def most_frequent(df: DataFrame, key: str, k: int, amount: str | None = None) -> DataFrame:
    return frequencies(df, key, amount).orderBy(F.col("n").desc(), key).limit(k)


def approx_most_frequent(df: DataFrame, key: str, k: int, tracked: int = 10_000) -> DataFrame:
    """By a bounded sketch, in one pass without a shuffle of keys."""
    return df.agg(F.expr(f"approx_top_k({key}, {k}, {tracked})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias(key), F.col("t.count").alias("n"))


def put_all(df: DataFrame, key: str, value: str, order: str, keep: str = "last") -> DataFrame:
    """A dictionary from writes: the last (or first) value by ``order`` for each key. Ties take the larger (smaller) value."""
    pick = F.max if keep == "last" else F.min
    return df.groupBy(key).agg(pick(F.struct(order, value)).alias("_w")).select(key, F.col(f"_w.{value}").alias("value"))


def add_all(df: DataFrame, key: str, amount: str, default: int = 0) -> DataFrame:
    """Counting writes: ``default`` plus all amounts for each key."""
    return df.groupBy(key).agg((F.sum(amount) + default).cast("long").alias("value"))


def lookup(keys: DataFrame, dictionary: DataFrame, key: str, default: int = 0) -> DataFrame:
    """``value`` for each key row, ``default`` for missing keys, and whether it is contained."""
    found = keys.join(dictionary.select(key, "value", F.lit(True).alias("contained")), key, "left")
    return found.withColumns({"value": F.coalesce("value", F.lit(default)), "contained": F.coalesce("contained", F.lit(False))})


def remove(dictionary: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return dictionary.join(keys.select(key), key, "left_anti")


def overlap_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ``common`` and ``total`` distinct keys of two dictionaries or sets."""
    both = a.select(key, F.lit(1).alias("_side")).union(b.select(key, F.lit(2))).groupBy(key).agg(F.countDistinct("_side").alias("sides"))
    return both.agg(F.coalesce(F.sum((F.col("sides") == 2).cast("long")), F.lit(0)).alias("common"), F.count("*").alias("total"))


def string_index(df: DataFrame, text: str, order: str) -> DataFrame:
    """``text, ordinal``: strings numbered from 0 in the order in which they first occur.

    Ordinals are global: first places are counted by range of ``order``, ranges are added up, and rows are numbered within their range."""
    first = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(order).alias("_first"))
    bucketed = first.withColumn("_range", F.floor(F.col("_first") / 65536))
    starts = bucketed.groupBy("_range").agg(F.count("*").alias("_m")).withColumn("_start", F.sum("_m").over(Window.orderBy("_range")) - F.col("_m"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_first", text)) - 1
    return bucketed.join(starts.select("_range", "_start"), "_range").select(text, (F.col("_start") + within).alias("ordinal"))


def ordinal_of(keys: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """The ordinal of each row's string, -1 if it has none."""
    return keys.join(index, text, "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))


def vector_sum(vectors: DataFrame, dim: str, value: str) -> DataFrame:
    return vectors.groupBy(dim).agg(F.sum(value).alias("total"))


def document_frequency(vectors: DataFrame, id_column: str, dim: str) -> DataFrame:
    return vectors.groupBy(dim).agg(F.countDistinct(id_column).alias("df"))


def scaled_frequency(terms: DataFrame, id_column: str, f: str = "f", scaling: str = "log") -> DataFrame:
    """``tf``: boolean 1, log 1 + ln f, augmented 0.5 + 0.5 f / (largest f of the document), or raw."""
    if scaling == "augmented":
        tf = 0.5 + 0.5 * F.col(f) / F.max(f).over(Window.partitionBy(id_column))
    else:
        tf = {"boolean": F.lit(1.0), "log": 1 + F.log(F.col(f)), "raw": F.col(f).cast("double")}[scaling]
    return terms.withColumn("tf", tf)


def tf_idf(terms: DataFrame, id_column: str, term: str, f: str = "f", scaling: str = "log") -> DataFrame:
    """tf times ln(N / df), N the number of documents with a term. The terms are read three times, so they are written once."""
    terms = saved(terms, "terms")
    n = terms.select(id_column).distinct().count()
    df = terms.groupBy(term).agg(F.count("*").alias("df"))
    weighted = scaled_frequency(terms, id_column, f, scaling).join(df, term)
    return weighted.withColumn("tfidf", F.col("tf") * F.log(F.lit(n) / F.col("df")))
