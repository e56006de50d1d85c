"""Signatures: items become short sequences whose equal components tell how similar the items are.

Every family has ``transform(df, id_column, item_column)``, which adds the signature ``sig`` to one row for each item,
``estimator``, and ``packed`` (signature of 64-bit words instead of integers). Null items are dropped; ids are assumed distinct.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as es
from ..functions import sets as st
from ..sources.memory import release
from ..sources.shipping import ship
from ..functions.hashing import Lcg, pack_bits, seeded_hash, seeded_hash16, seeded_parameters, string_hash64

EMPTY = 2**31 - 1


class Sketcher:
    n: int
    packed = False
    uniform_cost = True

    @property
    def estimator(self) -> es.Estimator:
        return es.Estimator(self.n)

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        raise NotImplementedError

    def tells(self, sig: Column) -> Column:
        """Whether a signature can be similar to another at all."""
        return F.lit(True)

    def same(self, a: Column, b: Column) -> Column:
        return es.same_bits(a, b, self.n) if self.packed else es.same_components(a, b)

    def estimate(self, a: Column, b: Column) -> Column:
        return self.estimator.estimate(self.same(a, b))

    def score(self, a: Column, b: Column) -> Column:
        """The exact similarity of two items, where the family has one."""
        raise ValueError("this family has no exact similarity; give a score")


@dataclass
class MinHash(Sketcher):
    """Component i is the least hash, with seed 1000 i, over an array of integers; all components of an empty set are 2**31 - 1.
    Without weights a row's minima are taken by numpy within its Arrow batch: nothing is exploded or shuffled. (As 64 aggregate
    columns the generated code exceeds what the JVM compiles, and ran ten times slower.)

    ``weights``: a table (element, weight): an element of weight w offers f(x), f(f(x)), ... w times. ``single_bit``: the lowest bit of every
    component, packed. Weighted arrays are taken apart, as elements meet their weights in a join; minima are combined before the shuffle."""

    n: int
    weights: DataFrame | None = None
    single_bit: bool = False
    max_weight: int = 16

    def __post_init__(self):
        if self.single_bit and self.n % 64:
            raise ValueError("single-bit signatures have a multiple of 64 bits")
        self.packed = self.single_bit

    @property
    def estimator(self) -> es.Estimator:
        return es.SingleBitEstimator(self.n) if self.single_bit else es.Estimator(self.n)

    def score(self, a: Column, b: Column) -> Column:
        return st.jaccard(a, b)

    def tells(self, sig: Column) -> Column:
        """Not that of an empty set. (Single bits don't show it.)"""
        return F.lit(True) if self.single_bit else F.exists(sig, lambda h: h != EMPTY)

    def _offers(self, i: int) -> Column:
        """The least of the chained hashes that an element offers to component i."""
        if self.weights is None:
            return seeded_hash(i * 1000, F.col("x"))
        least, value = F.lit(None).cast("long"), F.col("x")
        for step in range(1, self.max_weight + 1):
            value = seeded_hash(i * 1000, value)
            least = F.when(F.col("w") >= step, F.least(least, value)).otherwise(least)
        return least

    def long_form(self, df: DataFrame, id_column: str, item_column: str) -> DataFrame:
        elements = df.where(F.col(item_column).isNotNull()).select(F.col(id_column).alias("_id"), F.explode_outer(item_column).alias("x"))
        if self.weights is not None:
            if self.weights.where(F.col("weight") > self.max_weight).limit(1).count():
                raise ValueError(f"a weight is above {self.max_weight}")
            elements = elements.join(self.weights.select(F.col("element").alias("x"), F.col("weight").alias("w")), "x", "left").fillna(1, ["w"])
        return elements

    def _minima(self, df: DataFrame, id_column: str, item_column: str, second: bool = False) -> DataFrame:
        """``second``: with ``next``, the least hash above each minimum, null if there is none."""
        parameters = [seeded_parameters(i * 1000) for i in range(self.n)]
        n, empty, block, none = self.n, EMPTY, 1 << 16, 2**31

        def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            out = np.full((len(bounds) - 1, n * (1 + second)), empty, np.int64 if second else np.int32)
            if second:
                out[:, n:] = none
            rows = np.flatnonzero(np.diff(bounds))
            i = 0
            while i < len(rows):  # whole rows, about a block of elements at a time
                j = max(i + 1, int(np.searchsorted(bounds[rows], bounds[rows[i]] + block)))
                first, last = bounds[rows[i]], bounds[rows[j - 1] + 1]
                x, cuts = values[first:last].astype(np.int64).view(np.uint64), bounds[rows[i:j]] - first
                for c, (a, b) in enumerate(parameters):
                    hashed = ((x * np.uint64(a & (2**64 - 1)) + np.uint64(b)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    out[rows[i:j], c] = least = np.minimum.reduceat(hashed, cuts)
                    if second:
                        above = hashed > np.repeat(least, np.diff([*cuts, len(hashed)]))
                        out[rows[i:j], n + c] = np.minimum.reduceat(np.where(above, hashed.astype(np.int64), none), cuts)
                i = j
            return out

        def run(batches):
            try:
                for batch in batches:
                    item = batch.column(1)
                    bounds = item.offsets.to_numpy().astype(np.int64)
                    found = minima(item.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0])
                    parts = [pa.array(found[:, :n].reshape(-1).astype(np.int32))]
                    if second:
                        missing = found[:, n:].reshape(-1) == none
                        parts.append(pa.array(np.where(missing, 0, found[:, n:].reshape(-1)).astype(np.int32), mask=missing))
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n), part) for part in parts]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[id_column, "sig", "next"][: 2 + second])
                    del batch, item, found, lists
            finally:
                release()

        ship(df.sparkSession)
        rows = df.where(F.col(item_column).isNotNull()).select(id_column, F.filter(F.col(item_column).cast("array<long>"), lambda x: x.isNotNull()).alias("item"))
        return rows.mapInArrow(run, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, sig array<int>" + ", next array<int>" * second)

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        if self.weights is None:
            minima = self._minima(df, id_column, item_column)
            if not self.single_bit:
                return minima
            return minima.select(id_column, pack_bits(F.transform("sig", lambda h: h.bitwiseAND(F.lit(1)))).alias("sig"))
        minima = self.long_form(df, id_column, item_column).groupBy("_id").agg(*(F.coalesce(F.min(self._offers(i)), F.lit(EMPTY)).cast("int").alias(f"h{i}") for i in range(self.n)))
        parts = [F.col(f"h{i}") for i in range(self.n)]
        sig = pack_bits(F.array(*(p.bitwiseAND(F.lit(1)) for p in parts))) if self.single_bit else F.array(*parts)
        return minima.select(F.col("_id").alias(id_column), sig.alias("sig"))

    def neighbours(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        """``sig`` and ``next``: for each component the second least distinct hash (null if there is one only); every flip costs 1."""
        if self.single_bit:
            raise ValueError("a single bit has no second least hash")
        if self.weights is None:
            return self._minima(df, id_column, item_column, second=True)
        elements = self.long_form(df, id_column, item_column).select("_id", "x", *(["w"] if self.weights is not None else []))
        # Two least distinct values by component, in one pass: the minimum, and the minimum of what is above a minimum joined back.
        sig = self.transform(df, id_column, item_column).withColumnRenamed(id_column, "_id")
        second = elements.join(sig, "_id").groupBy("_id").agg(*(F.min(F.when(self._offers(i) > F.get("sig", F.lit(i)), self._offers(i))).cast("int").alias(f"s{i}") for i in range(self.n)))
        return sig.join(second, "_id").select(F.col("_id").alias(id_column), "sig", F.array(*(F.col(f"s{i}") for i in range(self.n))).alias("next"))


def signs(n: int, dim: int) -> np.ndarray:
    """Random hyperplanes: +1 or -1 for each component and dimension."""
    rows = []
    for i in range(n):
        lcg = Lcg(i * 1000)
        rows.append([-1.0 if lcg.next_double() < 0.5 else 1.0 for _ in range(dim)])
    return np.array(rows)


@dataclass
class Hyperplanes(Sketcher):
    """Bit i tells the side of hyperplane i on which an array of ``dim`` numbers lies. ``with_cost`` adds ``cost``, the absolute dot products."""

    n: int
    dim: int
    normalized: bool = False
    packed = True
    uniform_cost = False

    def __post_init__(self):
        if self.n % 64:
            raise ValueError("bit signatures have a multiple of 64 bits")

    @property
    def estimator(self) -> es.Estimator:
        return es.CosineEstimator(self.n)

    def score(self, a: Column, b: Column) -> Column:
        return st.dot(a, b) if self.normalized else st.cosine(a, b)

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item", with_cost: bool = False) -> DataFrame:
        planes = signs(self.n, self.dim)
        power = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                dots = np.stack(batch[item_column].to_numpy()).astype(np.float64) @ planes.T
                words = ((dots > 0).reshape(len(batch), -1, 64) * power).sum(axis=2, dtype=np.uint64).view(np.int64)
                out = {id_column: batch[id_column], "sig": list(words)}
                yield pd.DataFrame(out | ({"cost": list(np.abs(dots))} if with_cost else {}))

        rows = df.where(F.col(item_column).isNotNull()).select(id_column, item_column)
        kind = df.schema[id_column].dataType.simpleString()
        return rows.mapInPandas(run, f"{id_column} {kind}, sig array<long>" + (", cost array<double>" if with_cost else ""))


def sparse_sign(i: int, dim: Column) -> Column:
    """The sign of a dimension: one of 16 bits of a hash of its sixteenth."""
    shifted = dim.cast("long") + 1337
    word = seeded_hash16(i * 1000, F.floor(shifted / 16).cast("long"))
    return F.when(F.call_function("shiftright", word, (shifted % 16).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


@dataclass
class SparseHyperplanes(Sketcher):
    """Hyperplanes for sparse vectors: structs of dimension and value, in an array of any length."""

    n: int
    packed = True
    uniform_cost = False

    @property
    def estimator(self) -> es.Estimator:
        return es.CosineEstimator(self.n)

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        """Sides are taken by numpy within a row's Arrow batch: nothing is exploded or shuffled."""
        ship(df.sparkSession)
        planes = [seeded_parameters(i * 1000, 16) for i in range(self.n)]
        words = self.n // 64

        def sides(d: np.ndarray, v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            out = np.zeros((len(bounds) - 1, self_n), np.uint8)
            rows = np.flatnonzero(np.diff(bounds))
            if len(rows):
                sixteenth, at = (d + 1337) // 16, np.fmod(d + 1337, 16)
                for c, (a, b) in enumerate(planes):
                    word = ((np.int64(a >> 32) * sixteenth + ((np.int64(a & 0xFFFFFFFF) * sixteenth + np.int64(b)) >> 32)) & 0xFFFFFFFF) >> 16
                    out[rows, c] = np.add.reduceat(np.where((word >> at) & 1 == 1, v, -v), bounds[rows]) > 0
            return np.packbits(out, axis=1, bitorder="little").view("<i8")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                for batch in batches:
                    bounds = batch.column(1).offsets.to_numpy().astype(np.int64)
                    d, v = (batch.column(c).values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] for c in (1, 2))
                    sig = sides(d.astype(np.int64), v.astype(np.float64), bounds - bounds[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * words), pa.array(sig.reshape(-1)))], names=[id_column, "sig"])
            finally:
                release()

        self_n = self.n
        known = F.filter(F.col(item_column), lambda e: e["dim"].isNotNull() & e["value"].isNotNull())
        rows = df.where(F.col(item_column).isNotNull()).select(id_column, F.transform(known, lambda e: e["dim"].cast("long")).alias("d"), F.transform(known, lambda e: e["value"].cast("double")).alias("v"))
        return rows.mapInArrow(run, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, sig array<long>")


@dataclass
class Projections(Sketcher):
    """Component i is the bucket, ``bucket`` wide, of the projection on random unit vector i. ``rounding``: floor, or trunc (bucket 0 is then twice as wide).
    ``with_cost`` adds the distances to the nearer border and the bucket beyond it."""

    n: int
    bucket: float
    dim: int
    rounding: str = "floor"
    uniform_cost = False

    @property
    def estimator(self) -> es.Estimator:
        return es.NoEstimator(self.n)

    def vectors(self) -> np.ndarray:
        rows = []
        for i in range(self.n):
            lcg = Lcg(i * 1000)
            v = np.array([lcg.next_gaussian() for _ in range(self.dim)])
            rows.append(v / np.sqrt((v * v).sum()))
        return np.array(rows)

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item", with_cost: bool = False) -> DataFrame:
        vectors, bucket, cut = self.vectors(), self.bucket, {"floor": np.floor, "trunc": np.trunc}[self.rounding]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                at = np.stack(batch[item_column].to_numpy()).astype(np.float64) @ vectors.T / bucket
                own = cut(at)
                within = at - np.floor(at)
                out = {id_column: batch[id_column], "sig": list(own.astype(np.int32))}
                if with_cost:
                    out |= {"cost": list(np.minimum(within, 1 - within)), "next": list((own + np.where(within < 0.5, -1, 1)).astype(np.int32))}
                yield pd.DataFrame(out)

        rows = df.where(F.col(item_column).isNotNull()).select(id_column, item_column)
        kind = df.schema[id_column].dataType.simpleString()
        return rows.mapInPandas(run, f"{id_column} {kind}, sig array<int>" + (", cost array<double>, next array<int>" if with_cost else ""))


@dataclass
class Hamming(Sketcher):
    """The item is the sketch: an array of 64-bit words."""

    n: int
    packed = True

    def __post_init__(self):
        if self.n % 64:
            raise ValueError("bit signatures have a multiple of 64 bits")

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        return df.where(F.col(item_column).isNotNull()).select(id_column, F.col(item_column).cast("array<long>").alias("sig"))

    def score(self, a: Column, b: Column) -> Column:
        return self.estimate(a, b)


def simhash_votes(h: Column, bit: int) -> Column:
    return F.sum(F.when(F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))


@dataclass
class SimHash(Sketcher):
    """64 majority votes over the 64-bit hashes of an array of strings; a tie is 0. ``compat32`` repeats the low half, with its two top bits set
    if any of bits 31 to 63 won."""

    compat32: bool = False
    n: int = 64
    packed = True

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        long = df.where(F.col(item_column).isNotNull()).select(F.col(id_column).alias("_id"), F.explode_outer(item_column).alias("e")).withColumn("h", string_hash64(F.col("e")))
        votes = long.groupBy("_id").agg(*(F.coalesce(simhash_votes(F.col("h"), b) > 0, F.lit(False)).alias(f"v{b}") for b in range(64)))
        if self.compat32:
            top = reduce(lambda x, y: x | y, (F.col(f"v{b}") for b in range(31, 64)))
            won = [F.col(f"v{b % 32}") | F.col(f"v{b % 32 + 32}") if b % 32 < 31 else top for b in range(64)]
        else:
            won = [F.col(f"v{b}") for b in range(64)]
        return votes.select(F.col("_id").alias(id_column), pack_bits(F.array(*(w.cast("int") for w in won))).alias("sig"))


@dataclass
class PHash(Sketcher):
    """Perceptual hash of square grey pixel arrays: the low corner of the cosine transform against its mean, the constant term left out."""

    size: int = 32
    small: int = 8
    packed = True

    def __post_init__(self):
        if self.small * self.small % 64:
            raise ValueError("bit signatures have a multiple of 64 bits")
        self.n = self.small * self.small

    def basis(self) -> np.ndarray:
        u, i = np.arange(self.size)[:, None], np.arange(self.size)[None, :]
        c = np.cos((2 * i + 1) * u * math.pi / (2 * self.size))
        return c * np.where(u == 0, 1 / math.sqrt(2), 1.0)

    def hash_of(self, pixels: np.ndarray) -> np.ndarray:
        corner = (self.basis() @ pixels @ self.basis().T / 4)[: self.small, : self.small].reshape(-1)
        mean = corner[1:].mean()
        bits = corner > mean
        bits[0] = False
        return (bits.reshape(-1, 64) * np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        ship(df.sparkSession)
        sketcher, size = self, self.size

        def resized(rows) -> np.ndarray:
            pixels = np.array([np.asarray(r, dtype=float) for r in rows])
            y = np.arange(size) * pixels.shape[0] // size
            x = np.arange(size) * pixels.shape[1] // size
            return pixels[np.ix_(y, x)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({id_column: batch[id_column], "sig": [sketcher.hash_of(resized(p)) for p in batch[item_column]]})

        kind = df.schema[id_column].dataType.simpleString()
        return df.where(F.col(item_column).isNotNull()).select(id_column, item_column).mapInPandas(run, f"{id_column} {kind}, sig array<long>")


@dataclass
class CustomSketcher(Sketcher):
    """A family from a factory: component number to a column expression of the item."""

    n: int
    component: Callable[[int], Callable[[Column], Column]]
    bits: bool = False

    def __post_init__(self):
        if self.bits and self.n % 64:
            raise ValueError("bit signatures have a multiple of 64 bits")
        self.packed = self.bits

    def transform(self, df: DataFrame, id_column: str = "id", item_column: str = "item") -> DataFrame:
        parts = F.array(*(self.component(i)(F.col(item_column)).cast("int") for i in range(self.n)))
        return df.where(F.col(item_column).isNotNull()).select(id_column, (pack_bits(parts) if self.bits else parts).alias("sig"))
