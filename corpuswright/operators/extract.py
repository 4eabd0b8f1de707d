"""Hooks for outside work: extraction a row, embeddings a distinct text, and the tables around them."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@contextmanager
def time_limit(seconds: int):
    """Raises TimeoutError in the main thread of a worker after so many seconds; 0 sets no limit."""
    if not seconds:
        yield
        return

    def late(*_):
        raise TimeoutError(f"more than {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def extract(df: DataFrame, set_up: Callable[[], Callable[[str], str]], id_col: str, text_col: str, seconds: int = 0) -> DataFrame:
    """(id, result, error): a function over each row's text, in Python workers.

    set_up runs once a task and returns the function. A failure or a timeout is the
    row's error, never the task's. Equal texts should be dropped first: the work is
    the costly part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = set_up()
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"], strict=True):
                try:
                    with time_limit(seconds):
                        rows.append((i, fn(text), None))
                except Exception as e:  # any failure of outside code is data here
                    rows.append((i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "result", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, result string, error string")
    return out.withColumnRenamed("id", id_col)


def embed(df: DataFrame, set_up: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str) -> DataFrame:
    """df with `embedding`: each distinct text is embedded once, in batches, and joined back by its SHA-1."""
    keyed = df.withColumn("_key", F.sha1(F.coalesce(F.col(text_col), F.lit(""))))
    distinct = keyed.groupBy("_key").agg(F.first(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = set_up()
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "embedding": fn([t or "" for t in b["text"]])})

    vectors = distinct.mapInPandas(run, "_key string, embedding array<double>")
    return keyed.join(vectors, "_key").drop("_key")


def outcomes(graphs: DataFrame) -> DataFrame:
    """(split, n, n_degraded, n_edges, n_data_flow) of (split, degraded, n_edges, n_data_flow) rows."""
    return graphs.groupBy("split").agg(F.count("*").alias("n"), F.count_if("degraded").alias("n_degraded"), F.sum("n_edges").cast("long").alias("n_edges"), F.sum("n_data_flow").cast("long").alias("n_data_flow"))


def training_rows(labels: DataFrame, sources: DataFrame, id_col: str = "contract_id") -> tuple[DataFrame, DataFrame]:
    """(rows, report): labels with their sources, and how many were wanted, found and missing. An empty split must stop the caller."""
    report = labels.select(id_col).join(sources.select(id_col).distinct().withColumn("_has", F.lit(1)), id_col, "left").agg(F.count("*").alias("wanted"), F.count("_has").alias("found"))
    return labels.join(sources, id_col), report.withColumn("missing", F.col("wanted") - F.col("found"))


def needed(tests: DataFrame, training: DataFrame) -> DataFrame:
    """(key, kind): what is to be found again: test rows by hash, training rows by id, each once."""
    return tests.select(F.col("chash").alias("key"), F.lit("hash").alias("kind")).unionByName(training.select(F.col("contract_id").alias("key"), F.lit("id").alias("kind"))).distinct()


def interleave(lines: DataFrame, k: int) -> DataFrame:
    """(contract, lines): lines of branches in turn, rank by rank, each once, the first k. lines: (contract, branch, rank, line)."""
    rows = lines.groupBy("contract").agg(F.array_sort(F.collect_list(F.struct("rank", "branch", "line"))).alias("r"))
    return rows.select("contract", F.slice(F.array_distinct(F.transform("r", lambda x: x["line"])), 1, k).alias("lines"))


def argmax_or_above(probs: DataFrame, least: float = 0.30, forced: tuple[str, ...] = ()) -> DataFrame:
    """Rows to explain: each contract's likeliest class (the first of equals), classes at `least` or more, forced ones."""
    top = probs.groupBy("contract").agg(F.min(F.struct((-F.col("prob")).alias("p"), F.col("class"))).alias("x")).select("contract", F.col("x.class").alias("_top"))
    return probs.join(top, "contract").where((F.col("class") == F.col("_top")) | (F.col("prob") >= least) | F.col("class").isin(list(forced))).drop("_top")


def cross_validate(rows: DataFrame, k: int, train_one_fold: Callable[[DataFrame, DataFrame], float]) -> list[tuple[int, float]]:
    """(fold, score) of outside training: train_one_fold gets the other folds' rows and its own. rows has a column fold, 0 .. k - 1."""
    return [(i, float(train_one_fold(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)))) for i in range(k)]
