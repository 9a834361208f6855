"""Baskets and frequent itemsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreflow.functions.hashing import bucket_of_pair
from oreflow.functions.storage import kept


def baskets(df: DataFrame, key: str, item: str, more_than: int = 0) -> DataFrame:
    """basket, items (sorted distinct array) of baskets with more than ``more_than`` items."""
    sets = df.groupBy(F.col(key).alias("basket")).agg(F.sort_array(F.collect_set(item)).alias("items"))
    return sets.filter(F.size("items") > more_than)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "itemset").agg(F.count(F.lit(1)).alias("freq"))


def _supports(candidates: DataFrame, rows: DataFrame, singles: DataFrame) -> DataFrame:
    """(part, itemset, freq) of candidates that some basket holds: baskets meet a candidate at its rarest item.

    ``rows``: (part, basket, items); ``singles``: (part, item, freq).
    """
    each = candidates.select("part", "itemset", F.explode("itemset").alias("item")).join(singles, ["part", "item"])
    rarest = each.groupBy("part", "itemset").agg(F.min(F.struct("freq", "item")).alias("m")).select("part", "itemset", F.col("m.item").alias("item"))
    held = rows.select("part", "items", F.explode("items").alias("item")).join(rarest, ["part", "item"])
    return _counted(held.filter(F.size(F.array_except("itemset", "items")) == 0))


def _levels(rows: DataFrame, frequent: Callable[[DataFrame], DataFrame], most: int | None, hot: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(part, itemset, freq) of the frequent itemsets of each part of the baskets, size by size.

    ``rows``: (part, basket, items); ``frequent`` keeps rows of (part, itemset, freq), ``hot`` occurrences of
    pairs that may be frequent.  A level's occurrences are the last level's, extended by a greater frequent item
    of the same basket, so only what contains a frequent itemset is formed.
    """
    long = rows.select("part", "basket", F.explode("items").alias("item"))
    last = kept(frequent(_counted(long.select("part", F.array("item").alias("itemset")))), "level")
    live = kept(long.join(last.select("part", F.col("itemset")[0].alias("item")), ["part", "item"], "left_semi"), "items")
    result, level, size = last, live.select("part", "basket", F.array("item").alias("itemset")), 1
    while most is None or size < most:
        grown = level.join(live, ["part", "basket"]).filter(F.col("item") > F.element_at("itemset", -1)).select("part", "basket", F.concat("itemset", F.array("item")).alias("itemset"))
        grown = kept(hot(grown) if size == 1 else grown, "grown")
        last = kept(frequent(_counted(grown)), "level")
        if last.isEmpty():
            break
        result, size = result.unionByName(last), size + 1
        level = grown.join(last.select("part", "itemset"), ["part", "itemset"], "left_semi")
    return result


def apriori(basket_rows: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """Itemsets, of up to ``most`` items if given, in at least ``support`` baskets: itemset (sorted array), size, freq.

    Level by level, until a level has no frequent itemset; each level is a table in the shared folder.
    """
    rows = basket_rows.select(F.lit(0).alias("part"), "basket", "items")
    found = _levels(rows, lambda counts: counts.filter(F.col("freq") >= support), most)
    return found.select("itemset", F.size("itemset").alias("size"), "freq")


def fp_growth(basket_rows: DataFrame, support: int) -> DataFrame:
    """The same itemsets by parallel FP-growth.

    The support is passed half a basket lower: as a fraction of the count it may round up past
    the integer it stands for, and would lose the itemsets of exactly that support.
    """
    n = max(basket_rows.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (support - 0.5) / n)), minConfidence=1.0).fit(basket_rows)
    out = model.freqItemsets.select(F.sort_array("items").alias("itemset"), F.col("freq"))
    return out.select("itemset", F.size("itemset").alias("size"), "freq")


def son_candidates(basket_rows: DataFrame, support: int, parts: int = 4, buckets: int = 300, part: Column | None = None, most: int | None = None) -> DataFrame:
    """Phase one of the partitioned scheme: (itemset, n_parts) of the itemsets that are frequent, in proportion,
    in some part of the baskets.

    ``part`` deals the baskets, by a hash if it isn't given.  Pairs are first counted by hash bucket in each
    part, and only those in frequent buckets one by one.
    """
    rows = basket_rows.select((F.pmod(F.xxhash64("basket"), F.lit(parts)) if part is None else part).alias("part"), "basket", "items")
    sizes = kept(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 1
    enough = lambda counts: counts.join(F.broadcast(sizes), "part").filter(F.col("freq") * F.lit(total) >= F.lit(support) * F.col("n")).drop("n")

    def hot(pairs: DataFrame) -> DataFrame:
        placed = pairs.withColumn("bucket", bucket_of_pair(F.col("itemset")[0].cast("string"), F.col("itemset")[1].cast("string"), buckets))
        counts = enough(placed.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("freq")))
        return placed.join(F.broadcast(counts.select("part", "bucket")), ["part", "bucket"], "left_semi").select("part", "basket", "itemset")

    return _levels(rows, enough, most, hot).groupBy("itemset").agg(F.count(F.lit(1)).alias("n_parts"))


def son(basket_rows: DataFrame, support: int, parts: int = 4, buckets: int = 300, most: int | None = None) -> DataFrame:
    """Both phases of the partitioned scheme: itemset, size, freq, as :func:`apriori` gives them.

    What is frequent is so in some part, so the exact counts of phase one's candidates are enough.
    """
    rows = basket_rows.select(F.lit(0).alias("part"), "basket", "items")
    candidates = kept(son_candidates(basket_rows, support, parts, buckets, most=most), "candidates").select(F.lit(0).alias("part"), "itemset")
    long = rows.select("part", F.explode("items").alias("item"))
    singles = kept(long.groupBy("part", "item").agg(F.count(F.lit(1)).alias("freq")), "singles")
    found = _supports(candidates, rows, singles).filter(F.col("freq") >= support)
    return found.select("itemset", F.size("itemset").alias("size"), "freq")


def compare_itemsets(a: DataFrame, b: DataFrame, labels: tuple[str, str] = ("Task2", "Task3")) -> DataFrame:
    """(label, n) for both sets and their intersection."""
    count = lambda df, label: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
    a, b = a.select("itemset").distinct(), b.select("itemset").distinct()
    return count(a, labels[0]).unionByName(count(b, labels[1])).unionByName(count(a.intersect(b), "Intersection"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """(size, line): all itemsets of a size, sorted as text; singletons as ``('x')``, larger as tuples."""
    text = F.concat(F.lit("('"), F.array_join("itemset", "', '"), F.lit("')"))
    return itemsets.groupBy("size").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("line"))
