"""A band table on disk: Parquet partitioned by band, signatures, items and one row of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import BuildConfig, Index, band_table
from ..operators.signatures import Sketcher


def write_index(index: Index, path: str) -> None:
    """Rows of a band are clustered by slice, so a lookup reads few row groups of one directory."""
    build = index.build
    index.items.write.parquet(f"{path}/items")
    index.signatures.write.parquet(f"{path}/signatures")
    # Signatures are made once: the bands are cut from the stored ones.
    stored = index.items.sparkSession.read.parquet(f"{path}/signatures")
    bands = band_table(stored, index.sketcher, build)
    # As many tasks as Spark's shuffle setting says; each holds a share of a few bands' slices.
    share = F.pmod(F.xxhash64("slice"), F.lit(max(1, int(index.items.sparkSession.conf.get("spark.sql.shuffle.partitions")) // build.bands)))
    bands.repartition("band", share).sortWithinPartitions("band", F.xxhash64("slice")).write.partitionBy("band").parquet(f"{path}/bands")
    row = [(type(index.sketcher).__name__, index.sketcher.n, build.bands, build.hash_bits, build.min_bucket_size, build.max_bucket_size)]
    schema = "family string, n int, bands int, hash_bits int, min_bucket_size int, max_bucket_size long"
    index.items.sparkSession.createDataFrame(row, schema).coalesce(1).write.parquet(f"{path}/parameters")


def read_index(spark: SparkSession, path: str, sketcher: Sketcher) -> Index:
    p = spark.read.parquet(f"{path}/parameters").first()
    if (p.family, p.n) != (type(sketcher).__name__, sketcher.n):
        raise ValueError(f"the index holds {p.family} signatures of length {p.n}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("items"), read("signatures"), read("bands").select("band", "slice", "id"), sketcher, BuildConfig(p.bands, p.hash_bits, p.min_bucket_size, p.max_bucket_size))


def lookup(index: Index, band: int, slices: DataFrame) -> DataFrame:
    """The ids in the buckets of one band: only that band's directory is read."""
    return index.bands.where(F.col("band") == band).join(slices, "slice").select("band", "slice", "id")
