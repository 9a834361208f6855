"""Streaming forms: sliding Flajolet-Martin windows and a reservoir, equal to their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oreflow.functions.hashing import bytes_mod
from oreflow.functions.storage import new_path
from oreflow.operators.relational import stripped
from oreflow.operators.sampling import numbered, slot_of
from oreflow.operators.sketch import fm_aggregates, fm_estimate, fm_params
from oreflow.sources.writers import triggered


def file_stream(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """A stream over Parquet files of a folder whose names fit ``file``, one file per micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", 1).parquet(folder)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, with their arrival time."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumn("ts", F.current_timestamp())


def fm_stream(events: DataFrame, ts: str, value: str, length: str, slide: str, hashes: int = 49, group: int = 7, late: str | None = None, seed: int = 5) -> DataFrame:
    """(window_start, truth, estimate); ``late`` sets a watermark, which append mode needs.

    The distinct values of a window are its state, as the exact count beside the estimate needs them.
    """
    params, m = fm_params(hashes, None, seed)
    good = events.withColumn("_ts", F.col(ts).cast("timestamp")).filter(F.col(value).isNotNull() & (stripped(F.col(value)) != ""))
    good = good.withWatermark("_ts", late) if late else good
    x = good.withColumn("_x", bytes_mod(F.col(value), m))
    agg = x.groupBy(F.window("_ts", length, slide).alias("w")).agg(F.size(F.collect_set(value)).cast("bigint").alias("truth"), *fm_aggregates(F.col("_x"), params, m))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "truth", fm_estimate([f"t{i}" for i in range(len(params))], group).alias("estimate"))


def reservoir_stream(events: DataFrame, number: str, size: int = 100) -> DataFrame:
    """The reservoir as a streaming aggregation: the latest writer of each slot is the whole state."""
    columns = events.columns
    rows = events.withColumn("slot", slot_of(F.col(number), size)).filter("slot IS NOT NULL")
    return rows.groupBy("slot").agg(F.max_by(F.struct(*columns), number).alias("r")).select("slot", "r.*")


def counted_reservoir(events: DataFrame, order: str, path: str, checkpoint: str, size: int = 100, every: str | None = None) -> StreamingQuery:
    """A reservoir over all events so far that numbers them itself, in order of arrival.

    Events of a micro-batch are numbered by ``order`` after all those before it.  Each micro-batch writes its
    state to a folder of its number below ``path``: the rows (slot, n, and r, the event), and slot 0 with the
    number of events so far; it is made from the batch and the state before alone, so a batch that runs twice
    gives the same.  ``every``: how often it runs (such as ``5 seconds``); else it takes what is there and ends.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/{epoch - 1}") if epoch else None
        seen = old.filter("slot = 0").first().n if epoch else 0
        fresh = numbered(batch, order, "_n").withColumn("_n", F.col("_n") + seen)
        rows = fresh.select(slot_of(F.col("_n"), size).alias("slot"), F.col("_n").alias("n"), F.struct(*batch.columns).alias("r")).filter("slot IS NOT NULL")
        rows = rows if old is None else rows.unionByName(old.filter("slot > 0"))
        held = rows.groupBy("slot").agg(F.max("n").alias("n"), F.max_by("r", "n").alias("r"))
        count = batch.agg((F.count(F.lit(1)) + seen).alias("n")).select(F.lit(0).cast("bigint").alias("slot"), "n", F.lit(None).cast(held.schema["r"].dataType).alias("r"))
        held.unionByName(count).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**triggered(every)).start()


def reservoir_state(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """(slot, n, the event's columns) after a micro-batch of :func:`counted_reservoir`."""
    return spark.read.parquet(f"{path}/{epoch}").filter("slot > 0").select("slot", "n", "r.*")


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, into a memory table; its content."""
    spark = df.sparkSession
    query: StreamingQuery = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
