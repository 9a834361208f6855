"""A corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  Stage by stage the result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import mixing
from oreflow.llm.decontaminate import clean
from oreflow.llm.ngram_join import one_of_each
from oreflow.llm.quality import quality
from oreflow.llm.scratch import kept
from oreflow.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MAX_EPOCHS = 3.0


def _with_text(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limits go, and so do documents that fail the base rules or are depleted.

    Null, empty and short texts fail, so they go; a null source is a host of its own; repeated rows are
    judged each, alike; no documents, no result; further columns are left out.
    """
    return _with_text(quality(docs, carry=("lang", "source")).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    Null and empty texts are like no other and stay; so do rows with a null doc_id, and all rows that
    repeat the doc_id that stays; no documents, no result; further columns are left out.
    """
    return one_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document holds go; so do documents of which nothing is left.

    Null and empty texts stay as they are; a null doc_id is later than all others; rows that repeat one
    doc_id don't cut each other; no documents, no result; further columns are left out.
    """
    cut = substring_dedup(docs, carry=("lang", "source"))
    return _with_text(cut.filter("n_removed = 0 OR n_removed < n_words"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go.

    Null and empty texts hold none and stay, as do rows with a null doc_id; of rows that repeat one doc_id
    all go if one does; no documents, no result, and no benchmark, all documents; further columns are left out.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy from 1.

    Null and empty texts are never taken; null is a source like any other; repeated rows are taken as often
    as the operator's draws say in sum; no documents, no result; further columns are left out.
    """
    sized = kept(mixing.sized(docs), "sizes")
    sources = kept(mixing.source_table(sized), "sources")
    draws = kept(mixing.drawn(sized, mixing.cyclic_weights(sources), sources, max_epochs=MAX_EPOCHS), "draws")
    rows = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    taken = mixing.with_copies(rows, draws.filter("whole > 0 OR taken > 0"))
    return taken.filter("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
]

#: Components of a graph and a water-filling loop are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
