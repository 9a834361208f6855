"""TF-IDF profiles and the set-cosine recommender on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oreflow.operators.relational import word_counts

#: Signs, digits with single underscores, fraction and exponent; nan and infinities; one numeric character.
NUMBER = r"^(?:[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|[+-]?(?:nan|inf|infinity)|\p{N})$"


def is_number(token: Column) -> Column:
    """Whether a lower-cased token reads as a number."""
    return token.rlike(NUMBER)


def tfidf_profiles(docs: DataFrame, stopwords: DataFrame, id_col: str = "business_id", rare: float = 1e-6, top: int = 200) -> DataFrame:
    """(business_id, word, tfidf, rank): each document's ``top`` words.

    tf is relative to the document's most frequent word, idf is log10(documents / df) over all
    documents, those left without words included; words under ``rare`` of all tokens are dropped;
    numbers are no words.  Ties are ordered by word.
    """
    n_docs = docs.agg(F.count_distinct(id_col).alias("n_docs"))
    counts = word_counts(docs.select(F.col(id_col).alias("id"), "text"), stopwords, ("id",))
    tf = counts.filter(~is_number(F.col("word"))).select("id", "word", F.col("n").alias("c"))
    total = tf.agg(F.sum("c").alias("total"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("cf")).crossJoin(F.broadcast(total)).filter(F.col("cf") >= rare * F.col("total"))
    scored = tf.join(df.select("word", "df"), "word").withColumn("most", F.max("c").over(W.partitionBy("id"))).crossJoin(F.broadcast(n_docs))
    scored = scored.withColumn("tfidf", F.col("c") / F.col("most") * F.log10(F.col("n_docs") / F.col("df")))
    # the rank is on rounded scores, so that equal scores tie in any engine
    ranked = scored.withColumn("tfidf", F.round("tfidf", 9)).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("tfidf"), F.asc("word"))))
    return ranked.filter(F.col("rank") <= top).select(F.col("id").alias(id_col), "word", "tfidf", "rank")


def user_profiles(profiles: DataFrame, visits: DataFrame) -> DataFrame:
    """(user_id, word): union of the profiles of what a user reviewed.  ``visits``: (user_id, business_id)."""
    return visits.select("user_id", "business_id").distinct().join(profiles.select("business_id", "word"), "business_id").select("user_id", "word").distinct()


def content_predict(profiles: DataFrame, users: DataFrame, pairs: DataFrame, min_sim: float = 0.01) -> DataFrame:
    """(user_id, business_id, sim): set cosine of both profiles for every pair; repeats of a pair stay,
    pairs with an unknown or empty profile drop out."""
    b = profiles.select("business_id", "word").distinct()
    nb, nu = b.groupBy("business_id").agg(F.count(F.lit(1)).alias("nb")), users.groupBy("user_id").agg(F.count(F.lit(1)).alias("nu"))
    wanted = pairs.select("user_id", "business_id").distinct()
    shared = wanted.join(b, "business_id").join(users.select("user_id", "word"), ["user_id", "word"]).groupBy("user_id", "business_id").agg(F.count(F.lit(1)).alias("shared"))
    sim = shared.join(nb, "business_id").join(nu, "user_id").withColumn("sim", F.col("shared") / (F.sqrt("nb") * F.sqrt("nu"))).filter(F.col("sim") >= min_sim)
    return pairs.select("user_id", "business_id").join(sim.select("user_id", "business_id", "sim"), ["user_id", "business_id"])
