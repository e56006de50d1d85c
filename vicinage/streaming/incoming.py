"""Streams against stored indexes: extensions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import BuildConfig, Index, slices


def stream_candidates(arriving: DataFrame, index: Index, signature: str = "sig") -> DataFrame:
    """``id, other_id`` for a stream of (id, sig): a stream-static join on band and slice. Signatures are made by row-wise families (Hyperplanes, Hamming, Custom)."""
    build: BuildConfig = index.build
    probes = arriving.select("id", F.posexplode(slices(F.col(signature), index.sketcher, build.bands)).alias("band", "slice"))
    return probes.join(index.bands.withColumnRenamed("id", "other_id"), ["band", "slice"]).select("id", "other_id", "band")


def first_seen(arriving: DataFrame, key: str, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Only the first row of each key within the watermark: test and set on a stream, with bounded state."""
    return arriving.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
