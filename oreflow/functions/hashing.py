"""Seeded hash families and text-to-number folds as Column expressions.

Parameters are Python integers made at plan time from a seed, so a query and its SQL
oracle share them.
"""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_prime(x: int) -> int:
    """Smallest prime greater than x."""
    n = max(x + 1, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def linear_family(k: int, modulus: int, a_most: int, b_most: int, seed: int) -> list[tuple[int, int]]:
    """k pairs (a, b) of ``(a x + b) mod modulus`` with distinct a not divisible by the modulus."""
    rng = random.Random(seed)
    pool = [a for a in range(1, a_most + 1) if a % modulus]
    chosen = rng.sample(pool, min(k, len(pool)))
    return [(a, rng.randint(1, b_most)) for a in chosen]


def linear_hash(x: Column, a: int, b: int, modulus: int) -> Column:
    return F.pmod(x * F.lit(a) + F.lit(b), F.lit(modulus)).cast("bigint")


def bytes_mod(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of a text, read as one big-endian integer, modulo ``modulus``."""
    code = F.hex(F.encode(text, "UTF-8"))
    digits = F.sequence(F.lit(1), F.octet_length(text))
    byte = lambda i: F.conv(F.substring(code, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    fold = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, i: F.pmod(acc * 256 + byte(i), F.lit(modulus)).cast("bigint"))
    return F.when(F.octet_length(text) > 0, fold).otherwise(F.lit(0).cast("bigint"))


def string_hash(text: Column) -> Column:
    """The absolute value of the 32-bit hash that the JVM's strings have: base 31 over UTF-16 units."""
    code = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), (F.length(code) / 4).cast("int")), lambda i: F.conv(F.substring(code, i * 4 - 3, F.lit(4)), 16, 10).cast("bigint"))
    fold = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: F.pmod(h * 31 + u, F.lit(1 << 32)).cast("bigint"))
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(F.least(fold, F.lit(1 << 32) - fold))


def trailing_zeros(h: Column) -> Column:
    """Trailing zeros of the binary notation; 1 for 0, whose notation is a single ``0``."""
    b = F.bin(h)
    return F.length(b) - F.length(F.rtrim(b, F.lit("0")))


def bucket_of_pair(a: Column, b: Column, buckets: int = 300) -> Column:
    """Bucket of a pair of items by the sum of their code points."""
    total = lambda c: F.aggregate(F.transform(F.split(c, ""), lambda x: F.ascii(x)), F.lit(0), lambda s, x: s + x)
    return F.pmod(total(a) + total(b), F.lit(buckets))


def lcg(n: Column, a: int, b: int, c: int) -> Column:
    """An integer draw below 2**31 - 1 that depends on n alone."""
    m = F.lit(2147483647).cast("bigint")
    return F.pmod(F.pmod(n * n, m) * a + F.pmod(n, m) * b + c, m).cast("bigint")


LCG_ACCEPT = (48271, 69621, 12345)
LCG_SLOT = (16807, 40692, 54321)
