"""Sketches: Bloom filter, Flajolet-Martin distinct counts over sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.functions.hashing import bytes_mod, linear_family, linear_hash, next_prime, trailing_zeros
from oreflow.operators.relational import stripped


def bloom_params(bits: int = 10_000, hashes: int = 3, seed: int = 3) -> list[tuple[int, int]]:
    return linear_family(hashes, bits, 5000, 5000, seed)


def _bits(x: Column, params: list[tuple[int, int]], bits: int) -> Column:
    return F.array(*(linear_hash(x, a, b, bits) for a, b in params))


def bloom_bits(build: DataFrame, value: str, bits: int = 10_000, hashes: int = 3, seed: int = 3) -> DataFrame:
    """(bit): the distinct bits that are set, ``bits`` rows at most."""
    values = build.select(F.col(value).alias("v")).filter(F.col("v").isNotNull() & (stripped(F.col("v")) != "")).distinct()
    return values.select(F.explode(_bits(bytes_mod(F.col("v"), bits), bloom_params(bits, hashes, seed), bits)).alias("bit")).distinct()


def bloom_probe(build: DataFrame, probe: DataFrame, value: str, bits: int = 10_000, hashes: int = 3, seed: int = 3) -> DataFrame:
    """Adds flag to ``probe``: 1 if all the value's bits are set, 0 otherwise and for null or blank values.

    The filter is one row: a bitmap of ``bits`` bits in 64-bit words, which is broadcast, so probing costs
    no shuffle, and a bit is looked up by its position.
    """
    word = bloom_bits(build, value, bits, hashes, seed).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))).alias("x"))
    held = word.agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))
    bitmap = held.select(F.transform(F.sequence(F.lit(0), F.lit(-(-bits // 64) - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("bigint"))).alias("_map"))
    is_set = lambda b: F.getbit(F.get("_map", F.floor(b / 64).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1
    filled = F.col(value).isNotNull() & (stripped(F.col(value)) != "")
    hit = F.forall(_bits(bytes_mod(F.col(value), bits), bloom_params(bits, hashes, seed), bits), is_set)
    return probe.crossJoin(F.broadcast(bitmap)).withColumn("flag", F.coalesce(F.when(filled, hit), F.lit(False)).cast("int")).drop("_map")


def fm_params(hashes: int = 49, modulus: int | None = None, seed: int = 5) -> tuple[list[tuple[int, int]], int]:
    m = modulus or next_prime(10_000)
    return linear_family(hashes, m, m - 1, m - 1, seed), m


def fm_aggregates(value: Column, params: list[tuple[int, int]], modulus: int) -> list[Column]:
    """One max per hash function: the longest tail of zeros."""
    return [F.max(trailing_zeros(linear_hash(value, a, b, modulus))).alias(f"t{i}") for i, (a, b) in enumerate(params)]


def fm_estimate(tails: list[str], group: int, median_of_means: bool = False) -> Column:
    """Tails sorted, cut into groups, mean of 2**tail of each, the middle group's, truncated.

    With ``median_of_means`` the tails keep the order of their hash functions before they are grouped.
    """
    ordered = F.array(*tails) if median_of_means else F.sort_array(F.array(*tails))
    n = -(-len(tails) // group)
    means = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: F.aggregate(F.slice(ordered, g * group + 1, F.lit(group)), F.lit(0.0), lambda s, t: s + F.pow(F.lit(2.0), t)) / F.least(F.lit(group), F.lit(len(tails)) - g * group))
    return F.floor(F.sort_array(means)[n // 2]).cast("bigint")


def fm_windows(df: DataFrame, ts: str, value: str, length: str = "30 seconds", slide: str = "10 seconds", hashes: int = 49, group: int = 7, seed: int = 5, median_of_means: bool = False) -> DataFrame:
    """(window_start, truth, estimate) per sliding window of event time; null and blank values drop out.

    Hashing runs once per distinct value of a window and once per hash function, in one aggregation.
    """
    params, m = fm_params(hashes, None, seed)
    good = df.filter(F.col(value).isNotNull() & (stripped(F.col(value)) != ""))
    each = good.select(F.window(F.col(ts).cast("timestamp"), length, slide).alias("w"), F.col(value).alias("v")).select(F.col("w.start").alias("window_start"), "v").distinct()
    agg = each.withColumn("x", bytes_mod(F.col("v"), m)).groupBy("window_start").agg(F.count(F.lit(1)).alias("truth"), *fm_aggregates(F.col("x"), params, m))
    return agg.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "truth", fm_estimate([f"t{i}" for i in range(len(params))], group, median_of_means).alias("estimate"))


def distinct_windows(df: DataFrame, ts: str, value: str, length: str, slide: str, approximate: bool = False) -> DataFrame:
    """(window_start, n): distinct values per window, exact or by HyperLogLog."""
    n = F.approx_count_distinct(value) if approximate else F.count_distinct(value)
    out = df.groupBy(F.window(F.col(ts).cast("timestamp"), length, slide).alias("w")).agg(n.alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")
