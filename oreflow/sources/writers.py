"""Sinks: each takes a DataFrame and a folder, writes in parallel, and leaves formatting to expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_object(rows: dict[str, DataFrame], path: str) -> None:
    """One JSON object whose fields are arrays of the rows of small results, for example of top-n queries."""
    names = list(rows)
    one = rows[names[0]].sparkSession.range(1)
    for name in names:
        one = one.crossJoin(rows[name].agg(F.collect_list(F.struct("*")).alias(name)))
    one.select(F.to_json(F.struct(*names)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv_with_header(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def tuple_text(items: Column) -> Column:
    """A sorted array of strings as ``('a', 'b')``; one element as ``('a',)``."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.when(F.size(items) == 1, "',)").otherwise("')"))


def itemset_lines(itemsets: DataFrame, path: str) -> None:
    """One itemset per line."""
    itemsets.select(tuple_text(F.col("itemset")).alias("value")).write.mode("overwrite").text(path)


def community_lines(communities: DataFrame, path: str) -> None:
    """One community per line, quoted members joined by a comma, small ones first."""
    line = F.array_join(F.transform("members", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")
    communities.orderBy("size", F.col("members")[0]).select(line.alias("value")).write.mode("overwrite").text(path)


def betweenness_lines(load: DataFrame, path: str) -> None:
    """``('a', 'b'), v``, highest first."""
    ordered = load.orderBy(F.desc("betweenness"), "a", "b")
    ordered.select(F.format_string("('%s', '%s'), %s", F.col("a").cast("string"), F.col("b").cast("string"), F.col("betweenness").cast("string")).alias("value")).write.mode("overwrite").text(path)


def flags_line(flags: DataFrame, order: str, path: str) -> None:
    """All flags on one line, in order, separated by spaces: one value, as the format asks."""
    flags.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "flag"))), lambda x: x["flag"].cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def membership_object(membership: DataFrame, path: str) -> None:
    """``(id, cluster)``, ids distinct, as one JSON object in order of id: a member a line, so that the folder's files,
    one after the other, are the object, and no task holds it whole."""
    ends = membership.agg(F.min("id").alias("low"), F.max("id").alias("high"))
    line = F.concat(F.when(F.col("id") == F.col("low"), "{").otherwise(""), F.format_string('"%s": %s', F.col("id").cast("string"), F.col("cluster").cast("string")), F.when(F.col("id") == F.col("high"), "}").otherwise(","))
    membership.select("id", "cluster").crossJoin(F.broadcast(ends)).orderBy("id").select(line.alias("value")).write.mode("overwrite").text(path)


def itemset_report_lines(sections: dict[str, DataFrame], path: str) -> None:
    """For each title and its itemsets: the title, and a line for all itemsets of a size, each followed by an empty line."""
    from oreflow.operators.itemsets import itemset_report

    every = None
    for i, (title, sets) in enumerate(sections.items()):
        head = sets.sparkSession.createDataFrame([(0, title)], "size int, line string")
        part = head.unionByName(itemset_report(sets)).withColumn("section", F.lit(i))
        every = part if every is None else every.unionByName(part)
    ordered = every.agg(F.array_sort(F.collect_list(F.struct("section", "size", "line"))).alias("x"))
    ordered.select(F.explode(F.flatten(F.transform("x", lambda x: F.array(x["line"], F.lit(""))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_rounds(rounds: DataFrame, path: str) -> None:
    """The rows of clustering rounds in order, appended as CSV without a header."""
    rounds.orderBy("round_id").coalesce(1).write.mode("append").csv(path)


def triggered(every: str | None) -> dict:
    """A trigger that comes round in time, or one that takes what is there now and ends."""
    return {"processingTime": every} if every else {"availableNow": True}


def append_batches(df: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """A streaming query that appends every micro-batch's rows as CSV, ``every`` so often (such as ``5 seconds``) or until all is read."""
    return df.writeStream.outputMode("append").format("csv").option("path", path).option("checkpointLocation", checkpoint).trigger(**triggered(every)).start()


def append_level_blocks(tags: DataFrame, path: str, checkpoint: str, n: int = 3, every: str | None = None):
    """A streaming query over tags (column tag): after each micro-batch it appends a block: how many tags
    there were so far, lines ``tag:count`` for the n highest frequencies, most frequent first, and an empty line."""
    from oreflow.operators.sampling import top_levels

    def block(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "n")), "tag")
        lines = top_levels(rows, n).orderBy(F.desc("n"), "tag").agg(F.collect_list(F.concat_ws(":", "tag", F.col("n").cast("string"))).alias("x"))
        lines = lines.crossJoin(batch.agg(F.concat(F.lit("The number of tags from the beginning:"), F.coalesce(F.sum("n"), F.lit(0)).cast("string")).alias("head")))
        lines.select(F.explode(F.concat(F.array("head"), "x", F.array(F.lit("")))).alias("value")).coalesce(1).write.mode("append").text(path)

    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("complete").foreachBatch(block).option("checkpointLocation", checkpoint).trigger(**triggered(every)).start()
