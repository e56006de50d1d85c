"""Seeded hashes as column expressions, and the generator that draws their parameters.

The arithmetic is split so that no intermediate value leaves 63 bits: ANSI mode never throws, and the same expression runs in other SQL engines.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


class Lcg:
    """The 48-bit linear congruential generator of the Java platform."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
        self._spare: float | None = None

    def next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        value = self.state >> (48 - bits)
        return value - (1 << 32) if bits == 32 and value >> 31 else value

    def next_long(self) -> int:
        value = ((self.next(32) << 32) + self.next(32)) & ((1 << 64) - 1)
        return value - (1 << 64) if value >> 63 else value

    def next_double(self) -> float:
        return ((self.next(26) << 27) + self.next(27)) * 2.0**-53

    def next_gaussian(self) -> float:
        if self._spare is not None:
            value, self._spare = self._spare, None
            return value
        while True:
            a, b = 2 * self.next_double() - 1, 2 * self.next_double() - 1
            s = a * a + b * b
            if 0 < s < 1:
                scale = math.sqrt(-2 * math.log(s) / s)
                self._spare = b * scale
                return a * scale


class Xorshift128:
    """Marsaglia's 128-bit xorshift generator of 32-bit integers."""

    def __init__(self, x: int = 123456789, y: int = 362436069, z: int = 521288629, w: int = 88675123):
        self.words = [x, y, z, w]

    def next_int(self) -> int:
        x, y, z, w = self.words
        t = (x ^ (x << 11)) & MASK32
        new = (w ^ (w >> 19) ^ t ^ (t >> 8)) & MASK32
        self.words = [y, z, w, new]
        return new - (1 << 32) if new >> 31 else new


@lru_cache(maxsize=4096)
def seeded_parameters(seed: int, bits: int = 32) -> tuple[int, int]:
    """Odd multiplier and offset of the multiply-shift hash with ``bits`` bits."""
    lcg = Lcg(seed)
    a = (lcg.next_long() & ((1 << 62) - 1)) * 2 + 1
    return a, abs(lcg.next_long() & ((1 << (64 - bits)) - 1))


def seeded_hash_value(seed: int, x: int) -> int:
    a, b = seeded_parameters(seed)
    value = ((a * x + b) >> 32) & MASK32
    return value - (1 << 32) if value >> 31 else value


def seeded_hash(seed: int, x: Column) -> Column:
    """A signed 32-bit hash (as BIGINT) of a 32-bit signed integer."""
    a, b = seeded_parameters(seed)
    high, low = a >> 32, a & MASK32
    x = x.cast("long")
    word = (F.lit(high) * x + F.shiftright(F.lit(low) * x + F.lit(b), 32)).bitwiseAND(F.lit(MASK32))
    return word.bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)


def seeded_hash_sql(seed: int, x: str) -> str:
    a, b = seeded_parameters(seed)
    return f"(xor(({a >> 32} * {x} + (({a & MASK32} * {x} + {b}) >> 32)) & {MASK32}, {1 << 31}) - {1 << 31})"


def seeded_hash16(seed: int, x: Column) -> Column:
    """The 16-bit variant, for non-negative x below 2**30."""
    a, b = seeded_parameters(seed, 16)
    high, low = a >> 32, a & MASK32
    word = F.lit(high) * x.cast("long") + F.shiftright(F.lit(low) * x.cast("long") + F.lit(b), 32)
    return F.shiftright(word.bitwiseAND(F.lit(MASK32)), 16)


def seeded_hash16_sql(seed: int, x: str) -> str:
    a, b = seeded_parameters(seed, 16)
    return f"((({a >> 32} * {x} + (({a & MASK32} * {x} + {b}) >> 32)) & {MASK32}) >> 16)"


def element_code(text: Column) -> Column:
    """A non-negative 28-bit code of a string: the first seven hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def element_code_sql(text: str) -> str:
    return f"cast(('0x' || substr(md5({text}), 1, 7)) as bigint)"


def string_hash32(text: Column) -> Column:
    """The Java platform's hash of a string in the basic multilingual plane, as an unsigned value."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(MASK32)))


def string_hash64(text: Column) -> Column:
    """The first eight bytes of the MD5 of the UTF-8 text as a signed integer."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def bit_slice(words: Column, start: int, length: int) -> Column:
    """``length`` < 64 bits from bit ``start`` of bits packed in 64-bit words, lowest first."""
    if not 0 < length < 64:
        raise ValueError("a slice has 1 to 63 bits")
    word, bit = divmod(start, 64)
    low = F.shiftrightunsigned(F.get(words, F.lit(word)), bit)
    if bit + length > 64:
        low = low.bitwiseOR(F.shiftleft(F.get(words, F.lit(word + 1)), 64 - bit))
    return low.bitwiseAND(F.lit((1 << length) - 1))


def pack_bits(bits: Column) -> Column:
    """An array of 0/1 integers, its length a multiple of 64, as 64-bit words, lowest bit first."""
    words = F.sequence(F.lit(0), (F.size(bits) / 64).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.get(bits, w * 64 + i).cast("long"), i))))


def higher_power_of_two(x: Column) -> Column:
    """The least power of two that is not below ``x``; at least 1."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(x, F.lit(1))))).cast("long")


def pack_pair(high: Column, low: Column) -> Column:
    """Two signed 32-bit integers in one BIGINT that orders by (high, low as unsigned)."""
    return (high.cast("long") * (1 << 32)) + low.cast("long").bitwiseAND(F.lit(MASK32))


def unpack_high(packed: Column) -> Column:
    return F.shiftright(packed, 32)


def unpack_low(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(MASK32)).bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)
