"""Bloom filters as tables of 64-bit words, and counting filters as tables of counters.

Words are built by ``bit_or``, which combines before the shuffle; a filter of m bits is at most m / 64 rows whatever the number of elements.
Membership joins the k positions of a key with the words, so a filter is never required to fit in one place."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash


def optimal_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for ``n`` elements at a false-positive rate ``p``."""
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, round(math.log(2) * bits / n))


@dataclass(frozen=True)
class BloomShape:
    hashes: int
    bits: int

    @classmethod
    def of(cls, hashes: int, bits: int) -> BloomShape:
        """The bits are rounded up to a power of two, 64 at least."""
        return cls(hashes, max(64, 1 << (bits - 1).bit_length()))

    @classmethod
    def for_elements(cls, n: int, p: float) -> BloomShape:
        bits, hashes = optimal_size(n, p)
        return cls.of(hashes, bits)

    def positions(self, x):
        return F.array(*(seeded_hash(i * 4747, x).bitwiseAND(F.lit(self.bits - 1)) for i in range(self.hashes)))

    def false_positive_rate(self, n: int) -> float:
        return (1 - (1 - 1 / self.bits) ** (self.hashes * n)) ** self.hashes

    @property
    def size_in_bytes(self) -> int:
        return self.bits // 8


@dataclass(frozen=True)
class BloomFilter:
    shape: BloomShape
    words: DataFrame  # word, bits

    @classmethod
    def build(cls, df: DataFrame, key: str, shape: BloomShape) -> BloomFilter:
        at = df.where(F.col(key).isNotNull()).select(F.explode(shape.positions(F.col(key))).alias("p"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
        return cls(shape, at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("bits")))

    def contains(self, df: DataFrame, key: str) -> DataFrame:
        """Adds ``maybe``: false is certain."""
        keys = df.select(key).where(F.col(key).isNotNull()).distinct()
        asked = keys.select(key, F.explode(self.shape.positions(F.col(key))).alias("p")).withColumn("word", F.shiftright("p", 6))
        is_set = F.call_function("shiftrightunsigned", F.coalesce("bits", F.lit(0).cast("long")), F.pmod("p", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        known = asked.join(self.words, "word", "left").groupBy(key).agg(F.bool_and(is_set).alias("maybe"))
        return df.join(known, key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))

    def _checked(self, other: BloomFilter) -> None:
        if self.shape != other.shape:
            raise ValueError("filters of different shapes")

    def union(self, other: BloomFilter) -> BloomFilter:
        self._checked(other)
        return BloomFilter(self.shape, self.words.union(other.words).groupBy("word").agg(F.bit_or("bits").alias("bits")))

    def intersection(self, other: BloomFilter) -> BloomFilter:
        self._checked(other)
        both = self.words.join(other.words.withColumnRenamed("bits", "_b"), "word").select("word", F.col("bits").bitwiseAND(F.col("_b")).alias("bits"))
        return BloomFilter(self.shape, both.where("bits <> 0"))

    def statistics(self) -> DataFrame:
        """One row: bits set, approximate number of elements, size in bytes."""
        m, k = self.shape.bits, self.shape.hashes
        n_set = self.words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("bits_set"))
        return n_set.select("bits_set", (F.lit(-m / k) * F.log(1 - F.col("bits_set") / m)).alias("approximate_size"), F.lit(self.shape.size_in_bytes).alias("size_in_bytes"))


def seen_before(df: DataFrame, key: str, order: str) -> DataFrame:
    """Test and set, exactly: ``seen`` is false for a key's first row by ``order`` and true for later ones."""
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_k"))).withColumn("seen", F.col(order) > F.col("_first")).drop("_k", "_first")


@dataclass(frozen=True)
class CountingBloomFilter:
    shape: BloomShape
    counters: DataFrame  # p, n
    largest: int

    @classmethod
    def build(cls, df: DataFrame, key: str, shape: BloomShape, counter_bits: int = 8) -> CountingBloomFilter:
        """Counters saturate at their largest value."""
        if not 0 < counter_bits < 64:
            raise ValueError("counters have 1 to 63 bits")
        largest = (1 << counter_bits) - 1
        at = df.where(F.col(key).isNotNull()).select(F.explode(shape.positions(F.col(key))).alias("p"))
        return cls(shape, at.groupBy("p").agg(F.least(F.count("*"), F.lit(largest)).alias("n")), largest)

    def count(self, df: DataFrame, key: str) -> DataFrame:
        """Adds ``at_most``: the least of the key's counters, never below its true count unless saturated."""
        keys = df.select(key).where(F.col(key).isNotNull()).distinct()
        asked = keys.select(key, F.explode(self.shape.positions(F.col(key))).alias("p"))
        known = asked.join(self.counters, "p", "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("at_most"))
        return df.join(known, key, "left").withColumn("at_most", F.coalesce("at_most", F.lit(0)))
