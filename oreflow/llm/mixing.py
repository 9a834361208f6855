"""Mixing sources to target weights.

Method: capped water-filling.  Every source's target is its weight's share of the total,
but at most ``max_epochs`` times its size; what the clamped sources can't take is shared
among the others by weight, and again, until no target is above its cap.  A document is
then taken ``floor(target / size)`` whole times, and once more or not by a seeded draw
whose errors are carried from document to document, so that a source's words come within
about one small document of its target.

Only DataFrame functions.  A source's documents are dealt to strata of bounded size before
any of them meet in one row, so a source with a third of all rows is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATUM = 512
"""Documents that share one running total, about."""


def word_count(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds target (double) to ``sources``: (source, weight double, source_size long, ...).

    Targets sum to the total of all sizes unless all sources are clamped; a source without words, or of
    weight 0, has target 0.  A round needs one
    aggregate row; the level only rises, and each round clamps one source more or is the last.
    """
    cap = max_epochs * F.col("source_size")
    level = 0.0
    while True:
        free = cap > level * F.col("weight") if level else F.lit(True)
        r = sources.agg(
            F.sum(F.col("source_size").cast("double")).alias("total"),
            F.sum(F.when(free, F.col("weight")).otherwise(0.0)).alias("weight"),
            F.sum(F.when(free, 0.0).otherwise(cap)).alias("capped"),
        ).first()
        after = (r.total - r.capped) / r.weight if r.weight else level
        if after <= level * (1 + 1e-12):
            break
        level = after
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _uniform(seed: int, *columns: str) -> Column:
    """A draw in [0, 1) that depends on the seed and the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")) / F.lit(float(1 << 53))


def drawn(docs: DataFrame, weights: DataFrame, sources: DataFrame, max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """How often documents are taken: one row for all rows alike in doc_id, source and size.

    Takes what :func:`mixed` takes.  Returns doc_id, source, size, rows (how many are alike),
    source_size, target (the source's), whole (copies of each) and taken (of how many of the rows
    there is one copy more).
    """
    docs, sources, weights = docs.select("doc_id", "source", "size"), sources.select("source", "source_size", "n_documents"), weights.select("source", "weight")
    table = sources.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select("s.*", F.coalesce(F.col("w.weight").cast("double"), F.lit(0.0)).alias("weight"))
    table = water_filled(table, max_epochs).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    key = F.xxhash64(F.lit(seed), "d.doc_id", "d.source", "d.size")
    # rows alike in all that counts are one entry with a number, however many they are
    alike = docs.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    rows = alike.alias("d").join(table.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "size", "rows", "source_size", "target", "ratio", F.pmod(key, F.ceil(F.col("n_documents") / STRATUM)).alias("stratum"))
    # large documents first, so that small ones even out what is left; at random among those of about one size
    entry = F.struct((-F.floor(F.log2(F.col("size") + 1))).cast("int").alias("rank"), _uniform(seed + 1, "doc_id", "source", "size").alias("draw"), "doc_id", "size", "rows")
    strata = rows.groupBy("source", "stratum").agg(F.sort_array(F.collect_list(entry)).alias("docs"), F.first("ratio").alias("ratio"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    whole = F.floor("ratio")
    part = F.col("ratio") - whole

    def step(acc: Column, x: Column) -> Column:
        due = acc["due"] + part * x["size"] * x["rows"]
        take = F.when(x["size"] > 0, F.least(x["rows"], F.greatest(F.lit(0), F.ceil(due / x["size"] - x["draw"])))).otherwise(F.lit(0)).cast("long")
        return F.struct((due - take * x["size"]).alias("due"), F.concat(acc["taken"], F.array(take)).alias("taken"))

    start = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<bigint>").alias("taken"))
    done = strata.withColumn("taken", F.aggregate("docs", start, step)["taken"])
    one = done.select("source", "source_size", "target", whole.alias("whole"), F.explode(F.arrays_zip("docs", "taken")).alias("x"))
    return one.select("x.docs.doc_id", "source", "x.docs.size", "x.docs.rows", "source_size", "target", "whole", "x.taken")


def mixed(docs: DataFrame, weights: DataFrame, sources: DataFrame, max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """How often each document is taken.

    ``docs``: (doc_id, source, size long, ...); ``sources``: (source, source_size, n_documents, ...);
    ``weights``: (source, weight, ...).  Returns one row per input row: doc_id, source, size,
    source_size, target (its source's) and copies (at most ``max_epochs``).

    Null is a source like any other, and a null doc_id an id like any other.  Repeated rows are
    drawn each.  Sources without a weight, or without words, are not taken.  Reruns agree: the
    draw depends on seed, doc_id, source and size only, and rows alike in these are alike.  Empty
    tables give an empty result.
    """
    each = drawn(docs, weights, sources, max_epochs, seed).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("i") <= F.col("taken")).cast("long")).alias("copies"))


MAX_BROADCAST = 100_000
"""Kinds of repeated rows up to which their draws are sent to all tasks."""


def with_copies(docs: DataFrame, draws: DataFrame, seed: int = 0) -> DataFrame:
    """The documents, all columns, with copies (0 or more): what :func:`drawn` says of rows like them.

    ``docs``: (doc_id, source, size, ...), no column named copies; ``draws`` is a table, as it is read more than
    once.  Rows alike of which only some are taken once more are numbered, in groups of about STRATUM, and
    taken at even distances, so that their number is that of the draw (up to STRATUM rows exactly, beyond on
    average and within one a group).
    """
    some = (F.col("taken") > 0) & (F.col("taken") < F.col("rows"))
    key = ["doc_id", "source", "size"]

    def joined(side: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c in key:
            same = same & docs[c].eqNullSafe(side[c])
        return docs.join(side, same).select(*(docs[c] for c in docs.columns), *(side[c].alias(f"_{c}") for c in ("rows", "whole", "taken")))

    sure = joined(draws.filter(~some)).withColumn("copies", F.col("_whole") + (F.col("_taken") > 0).cast("long"))
    few = draws.filter(some)
    n = few.count()
    if n:
        part = joined(F.broadcast(few) if n <= MAX_BROADCAST else few)
        part = part.withColumn("_stratum", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("_rows") / STRATUM)))
        rest = [c for c in docs.columns if c not in key]
        place = F.row_number().over(Window.partitionBy(*key, "_stratum").orderBy(F.xxhash64(*rest) if rest else F.lit(0)))
        ahead = F.when(F.col("_rows") <= STRATUM, 0).otherwise(F.pmod(F.xxhash64(F.lit(seed + 2), *key, "_stratum"), F.col("_rows")))
        part = part.withColumn("_place", place).withColumn("_ahead", ahead)
        upto = lambda i: F.floor((i * F.col("_taken") + F.col("_ahead")) / F.col("_rows"))
        part = part.withColumn("copies", F.col("_whole") + upto(F.col("_place")) - upto(F.col("_place") - 1))
        sure = sure.unionByName(part.drop("_stratum", "_place", "_ahead"))
    return sure.drop("_rows", "_whole", "_taken")


def source_table(docs: DataFrame) -> DataFrame:
    """(source, source_size, n_documents) of (source, size, ...); null is a source; no rows, no sources."""
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_documents"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights by rank of the source (code points, null last), repeating the cycle.

    The rank needs all sources in one order; they are as many rows as there are sources.  ``sources``:
    (source, ...), a row for each.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picked = F.element_at(F.array(*(F.lit(float(x)) for x in cycle)), (rank % len(cycle) + 1).cast("int"))
    return sources.select("source", picked.alias("weight"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of (doc_id, source, text, ...), row by row; a null text has size 0."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
