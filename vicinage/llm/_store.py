"""Access to the shared folder, and a few column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.memory import release
from ..sources.shipping import ship
from ..sources.tables import dropped as drop_table
from ..sources.tables import saved as table
from ..sources.tables import shared_path as new_path

__all__ = ["WORD_SPLIT", "arrow_map", "bucket_of", "drop_table", "ids", "load", "new_path", "partitions", "table"]

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(id_column: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``: the fold of a row."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids(docs: DataFrame) -> DataFrame:
    """The rows that take part: those with a ``doc_id``."""
    return docs.where(F.col("doc_id").isNotNull())


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, after this package has been sent to the executors once for each application. Workers give back a task's memory at its end."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)
