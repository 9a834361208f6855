"""The relations that the registered queries run on, as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, item: str = "l_partkey") -> DataFrame:
    """user_id, business_id, stars (1 to 5), date (string)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col(item).alias("business_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, categories (comma-separated)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("business_id"), F.concat_ws(", ", "p_brand", "p_type", "p_name").alias("categories"))


def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket (order), item (brand)."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))


#: The same relations for the oracle.
SQL = {
    "reviews": "SELECT o_custkey AS user_id, l_partkey AS business_id, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars, strftime(o_orderdate, '%Y-%m-%d') AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "businesses": "SELECT p_partkey AS business_id, concat_ws(', ', p_brand, p_type, p_name) AS categories FROM part",
    "brand_baskets": "SELECT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
}
SQL["supplier_reviews"] = SQL["reviews"].replace("l_partkey", "l_suppkey")
