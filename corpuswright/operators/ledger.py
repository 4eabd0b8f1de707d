"""A resumable task ledger: contracts x tools, an append-only log of attempts, and its fold."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRYABLE = ("timeout", "crash", "no_output")


def enrol(contracts: DataFrame, tools: list[str], existing: DataFrame | None = None) -> DataFrame:
    """New tasks (cid, tool, status pending, attempts 0): those of contract and tool that aren't there yet."""
    tasks = contracts.select("cid").distinct().select("cid", F.explode(F.array(*map(F.lit, tools))).alias("tool"))
    if existing is not None:
        tasks = tasks.join(existing.select("cid", "tool").distinct(), ["cid", "tool"], "left_anti")
    return tasks.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0).cast("long"))


def fold(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """(cid, tool, status, attempts, seconds, updated_at): tasks after all attempts of the log; the last status wins.

    log: (cid, tool, status, seconds, ts, seq); equal times go by seq.
    """
    last = log.groupBy("cid", "tool").agg(F.count("*").alias("n"), F.max_by(F.struct("status", "seconds", "ts"), F.struct("ts", "seq")).alias("x"))
    rows = tasks.select("cid", "tool").join(last, ["cid", "tool"], "left")
    return rows.select("cid", "tool", F.coalesce("x.status", F.lit("pending")).alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("attempts"), F.col("x.seconds").alias("seconds"), F.col("x.ts").alias("updated_at"))


def claim(state: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Tasks to run: pending ones, and retryable ones with attempts left."""
    return state.where((F.col("status") == "pending") | (F.col("status").isin(*RETRYABLE) & (F.col("attempts") < max_attempts)))


def outcome(timed_out: Column, exit_code: Column, fresh: Column) -> Column:
    """timeout, crash, no_output, or ok."""
    return F.when(timed_out, "timeout").when(exit_code != 0, "crash").when(~fresh, "no_output").otherwise("ok")


def is_fresh(modified: Column, since: Column, grace: int = 2) -> Column:
    """Whether a file's time (epoch seconds) is not before `since`, with two seconds of grace."""
    return modified >= since - grace


def summary(state: DataFrame) -> DataFrame:
    """(tool, status, n, mean_ok_seconds) for each tool and status, each tool, each status and all: one aggregation with grouping sets."""
    seconds = F.when(F.col("status") == "ok", F.col("seconds"))
    sets = [["tool", "status"], ["tool"], ["status"], []]
    rows = state.withColumn("ok_seconds", seconds).groupingSets([[F.col(c) for c in s] for s in sets], F.col("tool"), F.col("status"))
    out = rows.agg(F.count("*").alias("n"), F.round(F.avg("ok_seconds"), 6).alias("mean_ok_seconds"))
    return out.select(F.coalesce("tool", F.lit("all")).alias("tool"), F.coalesce("status", F.lit("all")).alias("status"), "n", "mean_ok_seconds")


def unlabellable(state: DataFrame) -> DataFrame:
    """(cid): contracts of which no task is ok, so that nothing can label them."""
    return state.groupBy("cid").agg(F.max((F.col("status") == "ok").cast("int")).alias("ok")).where("ok = 0").select("cid")


def totals(state: DataFrame) -> DataFrame:
    """One row: contracts, tasks_total, tasks_done (ok or skipped), unlabellable_contracts, tool_seconds_total."""
    done = F.count_if(F.col("status").isin("ok", "skipped"))
    each = state.groupBy("cid").agg(F.count("*").alias("n"), done.alias("done"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("seconds").alias("seconds"))
    zero = F.lit(0).cast("long")
    return each.agg(
        F.count("*").alias("contracts"),
        F.coalesce(F.sum("n"), zero).alias("tasks_total"),
        F.coalesce(F.sum("done"), zero).alias("tasks_done"),
        F.count_if(F.col("ok") == 0).alias("unlabellable_contracts"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("tool_seconds_total"),
    )


def suspicious_tools(state: DataFrame, exempt: tuple[str, ...] = ("slither",), least: int = 50, seconds: float = 10.0) -> DataFrame:
    """(tool, n_ok, mean_ok): tools whose many ok tasks took suspiciously little time."""
    ok = state.where("status = 'ok'").groupBy("tool").agg(F.count("*").alias("n_ok"), F.avg("seconds").alias("mean_ok"))
    return ok.where((F.col("n_ok") > least) & (F.col("mean_ok") < seconds) & ~F.col("tool").isin(*exempt))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys aren't done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def snapshot(state: DataFrame, folder: str) -> DataFrame:
    """A consistent copy of the state in a new folder: one job writes it, and its files appear whole or not at all."""
    path = f"{folder}/{uuid.uuid4().hex}"
    state.write.parquet(path)
    return state.sparkSession.read.parquet(path)


def archive(rows: DataFrame, batch_col: str, folder: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds the batches that the archive's ledger lacks, then the ledger: (batch, n, sums).

    Rows go to <folder>/rows by batch, the ledger to <folder>/ledger once they are there;
    a batch whose ledger row is missing after a failure is written again over itself.
    """
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(f"{folder}/ledger")
        rows = rows.join(known.select(batch_col), batch_col, "left_anti")
    except AnalysisException:  # the first batch of all
        pass
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).parquet(f"{folder}/rows")
    rows.groupBy(batch_col).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).write.mode("append").parquet(f"{folder}/ledger")
    return spark.read.parquet(f"{folder}/ledger")
