"""The attempts log as a stream: totals, watermarked windows, and a resumable fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, sf_dir: str, max_files: int = 16) -> DataFrame:
    """(cid, tool, status, seconds, ts, seq) as files of events arrive."""
    # a pattern, for the source takes folders or patterns, and a table may be one file
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/events.parque[t]")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    tool = pick(("slither", "mythril", "securify", "osiris"), F.col("event_id") % 4)
    status = pick(("timeout", "crash", "no_output", "ok", "ok"), (F.col("event_id") * 7 + F.col("user_id")) % 5)
    return raw.select(F.col("user_id").alias("cid"), tool.alias("tool"), status.alias("status"), F.abs("value").alias("seconds"), "ts", F.col("event_id").alias("seq"))


def totals(log: DataFrame) -> DataFrame:
    """(tool, status, n, seconds) so far: state is a row a tool and status."""
    return log.groupBy("tool", "status").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def windowed(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, tool, n) of event time; windows close, and their state goes, once `late` has passed."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "tool").agg(F.count("*").alias("n"))


def to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result after all that is there now, by a query that stops by itself.

    Each batch replaces (complete) or adds to (append) a table in the shared folder;
    a batch that is run again writes the same rows to the same place.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def sync(log: DataFrame, folder: str) -> DataFrame:
    """Copies what has arrived since the last call to <folder>/rows, and returns all that is there. Calls may repeat at any time."""
    q = log.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/rows").start()
    q.awaitTermination()
    return log.sparkSession.read.schema(log.schema).parquet(f"{folder}/rows")
