"""From equal components of two signatures to a similarity, and back; and the tuning of bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_components(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def same_bits(a: Column, b: Column, n_bits: int) -> Column:
    """Equal bits of two arrays of 64-bit words."""
    different = F.lit(0)
    for w in range(n_bits // 64):
        different = different + F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))))
    return F.lit(n_bits) - different


class Estimator:
    """``estimate`` maps a number of equal components to a similarity, ``least_same`` a similarity to the number wanted."""

    def __init__(self, n: int):
        self.n = n

    def estimate(self, same: Column) -> Column:
        return same / F.lit(float(self.n))

    def least_same(self, similarity: float) -> int:
        if not 0 <= similarity <= 1:
            raise ValueError("a similarity is between 0 and 1")
        return math.trunc(similarity * self.n)


class SingleBitEstimator(Estimator):
    """Half of the differing elements agree in one bit by chance."""

    def estimate(self, same: Column) -> Column:
        return F.lit(1.0) - F.lit(2.0 / self.n) * (F.lit(self.n) - same)

    def least_same(self, similarity: float) -> int:
        return self.n - math.trunc((1 - similarity) / (2.0 / self.n))


class CosineEstimator(Estimator):
    """Bits of random hyperplanes differ in proportion to the angle."""

    def estimate(self, same: Column) -> Column:
        return F.cos(F.lit(math.pi) * (F.lit(1.0) - same / F.lit(float(self.n))))

    def least_same(self, similarity: float) -> int:
        if not -1 <= similarity <= 1:
            raise ValueError("a cosine is between -1 and 1")
        return math.floor((1 - math.acos(similarity) / math.pi) * self.n)


class NoEstimator(Estimator):
    """Random projections tell nothing without an explicit distance."""

    def estimate(self, same: Column) -> Column:
        raise ValueError("random projections have no estimate; give a distance")

    def least_same(self, similarity: float) -> int:
        raise ValueError("random projections have no estimate; give a distance")


def pick_bands(threshold: float, n: int) -> int:
    """The smallest number of bands B with B ln B >= -n ln threshold. Where both sides are one number the last bit of the logarithm must not decide."""
    if threshold <= 0:
        raise ValueError("a threshold is above 0")
    wanted = -n * math.log(threshold)
    bands = 1
    while bands * math.log(bands) < wanted - 1e-9:
        bands += 1
    return bands


def pick_hashes_and_bands(threshold: float, most: int) -> tuple[int, int]:
    bands = pick_bands(threshold, most)
    return most // bands * bands, bands


def inclusion_probability(similarity: Column, n: int, bands: int) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - F.pow(similarity, F.lit(n // bands)), F.lit(bands))


def estimated_threshold(n: int, bands: int) -> float:
    return (1.0 / bands) ** (1.0 / (n // bands))
