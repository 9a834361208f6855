"""Exploration queries: counts, filters, category means, partition layouts, filtered joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
#: Tokens that are dropped as punctuation when they stand alone.
PUNCTUATION = ["", "(", "[", ",", ".", "!", "?", ":", ";", "]", ")"]
#: Signs that are taken out of a text, wherever they stand, where that is asked for.
SIGNS = r'[()|\[\]",.!:;?]'


def stripped(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_containing(reviews: DataFrame, part: str, column: str = "date") -> DataFrame:
    """Rows whose column contains ``part`` (stripped) anywhere."""
    return row_count(reviews.filter(F.col(column).contains(part.strip())))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; null counts as one."""
    return row_count(df.select(column).distinct())


def top_counts(df: DataFrame, column: str, m: int) -> DataFrame:
    """The m most frequent values, (n desc, value asc)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(m)


def word_counts(docs: DataFrame, stopwords: DataFrame, keys: tuple[str, ...] = (), text: str = "text", without_signs: bool = False) -> DataFrame:
    """(keys, word, n): lower-cased, stripped tokens of a split at single spaces, less stopwords (column word) and
    lone punctuation, which are left out after counting, as each word is then looked at once; ``without_signs``: all
    SIGNS are taken out before the split."""
    plain = F.regexp_replace(text, SIGNS, "") if without_signs else F.col(text)
    word = docs.select(*keys, F.explode(F.split(plain, " ")).alias("_raw")).select(*keys, stripped(F.lower("_raw")).alias("word"))
    counts = word.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(~F.col("word").isin(PUNCTUATION)).join(stopwords.select("word"), "word", "left_anti")


def top_words(docs: DataFrame, stopwords: DataFrame, n: int, text: str = "text") -> DataFrame:
    return word_counts(docs, stopwords, (), text).select("word", "n").orderBy(F.desc("n"), F.asc("word")).limit(n)


def category_avg_stars(reviews: DataFrame, businesses: DataFrame, n: int) -> DataFrame:
    """Mean stars per category over review rows, best first, ties by name.

    Null stars and null or blank categories drop out; a category that a business names twice
    counts twice.  Reviews are summed per business before the join, so the explode runs over
    businesses and not over reviews.
    """
    sums = reviews.filter(F.col("stars").isNotNull()).groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("stars").alias("c"))
    cats = businesses.filter(F.col("categories").isNotNull() & (stripped(F.col("categories")) != "")).select("business_id", "categories")
    each = cats.join(sums, "business_id").select(F.explode(F.split("categories", ",")).alias("category"), "s", "c")
    mean = each.groupBy(stripped(F.col("category")).alias("category")).agg((F.sum("s") / F.sum("c")).alias("avg_stars"))
    return mean.orderBy(F.desc("avg_stars"), F.asc("category")).limit(n)


def businesses_over(reviews: DataFrame, n: int) -> DataFrame:
    """Businesses with more than n reviews."""
    return reviews.groupBy("business_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > n)


def partition_layout(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows per partition after a hash partitioning by ``key``; empty partitions show 0."""
    sizes = df.repartition(partitions, key).groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("n_items"))
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    return every.join(sizes, "partition_id", "left").select("partition_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def user_business(businesses: DataFrame, reviews: DataFrame, state: str) -> DataFrame:
    """(user_id, business_id) of reviews of businesses in a state; repeats stay."""
    return reviews.join(businesses.filter(F.col("state") == state).select("business_id"), "business_id").select("user_id", "business_id")
