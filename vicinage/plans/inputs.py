"""Inputs of the registered queries, and the same in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.memory import release
from ..sources.shipping import ship
from ..functions.hashing import element_code, element_code_sql, seeded_hash_sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str = "text"):
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def codes(text: str = "text"):
    """The 28-bit codes of a text's distinct words, an array."""
    return F.transform(words(text), element_code)


#: Words that a worker codes together.
WORDS = 1 << 16


def coded_sets(rows: DataFrame, id_column: str, words_column: str) -> DataFrame:
    """``id, item``: arrays of words as sorted sets of their codes (as ``element_code``). Rows are taken about ``WORDS`` words at a time, whose words are coded once each, not at every place: what a
    worker holds besides a batch doesn't depend on the batch's texts, and is given back."""
    from hashlib import md5

    ship(rows.sparkSession)

    def pieces(batch):
        bounds = batch.column(1).offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WORDS, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end

    def run(batches):
        try:
            for batch in batches:
                yield from coded_batch(batch)
                del batch
        finally:
            release()

    def coded_batch(batch):
        for piece in pieces(batch):
            lists = piece.column(1)
            coded = lists.flatten().dictionary_encode()
            table = np.array([int(md5(w.encode()).hexdigest()[:7], 16) for w in coded.dictionary.to_pylist()], np.int64)
            flat = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.int64)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            key = np.unique((row << 28) | flat)
            ends = np.searchsorted(key >> 28, np.arange(len(bounds)))
            sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key & ((1 << 28) - 1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), sets], names=["id", "item"])

    return rows.select(id_column, words_column).mapInArrow(run, f"id {rows.schema[id_column].dataType.simpleString()}, item array<long>")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, item``: documents as sorted sets of word codes."""
    return coded_sets(load(spark, sf_dir, "documents").select("doc_id", words().alias("w")), "doc_id", "w")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, item``: parts of each order as sorted sets. Lines are combined in the partition before the shuffle."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("item"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("item"), "label")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, item, rating``: how often a customer ordered a part."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    joined = orders.select("o_orderkey", "o_custkey").join(lines.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.count("*").cast("double").alias("rating"))


WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"
#: items(id, x): one row for each document and distinct word code.
ELEMENTS_SQL = f"e as materialized (select distinct doc_id as id, {element_code_sql('w')} as x from (select doc_id, unnest({WORDS_SQL.format('text')}) as w from documents))"
#: docs(id): all documents, those without words too.
DOCS_SQL = "docs as (select doc_id as id from documents)"


def minima_sql(n: int, source: str = "e", value: str = "x") -> str:
    """sig(id, h0 .. h{n-1}): minima, 2**31 - 1 for documents without elements."""
    parts = ", ".join(f"coalesce(min({seeded_hash_sql(i * 1000, value)}), 2147483647) as h{i}" for i in range(n))
    return f"sig as materialized (select docs.id, {parts} from docs left join {source} on docs.id = {source}.id group by docs.id)"


def bands_sql(n: int, bands: int, prefix: str = "h", source: str = "sig", name: str = "bands") -> str:
    length = n // bands
    # Minima of empty sets are in no bucket.
    told = " where h0 <> 2147483647 or h1 <> 2147483647" if source == "sig" and prefix == "h" else ""
    one = lambda b: f"select id, {b} as band, [{', '.join(f'{prefix}{b * length + j}' for j in range(length))}] as slice from {source}{told}"
    return f"{name} as materialized ({' union all '.join(one(b) for b in range(bands))})"


PAIRS_SQL = "pairs as materialized (select a.id, b.id as other_id, count(*) as collisions from bands a join bands b on a.band = b.band and a.slice = b.slice and a.id < b.id group by all)"
SIZES_SQL = "sizes as (select docs.id, count(x) as n from docs left join e on e.id = docs.id group by docs.id)"
COMMON_SQL = "common as (select p.id, p.other_id, count(b.x) as c from pairs p join e a on a.id = p.id left join e b on b.id = p.other_id and b.x = a.x group by all)"
SCORED_SQL = "scored as materialized (select p.id, p.other_id, coalesce(c / (sa.n + sb.n - c), 0)::double as score from pairs p join sizes sa on sa.id = p.id join sizes sb on sb.id = p.other_id left join common m on m.id = p.id and m.other_id = p.other_id)"


def same_sql(n: int, a: str = "a", b: str = "b") -> str:
    return "(" + " + ".join(f"({a}.h{i} = {b}.h{i})::int" for i in range(n)) + ")"
