"""The tables behind reports: projections of a long metric fact (model, split, scope, class, metric, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dual_benchmark(facts: DataFrame, model: str, splits: list[str]) -> DataFrame:
    """A row a class of one model: f1, low and high of each split, side by side."""
    rows = facts.where((F.col("model") == model) & F.col("metric").isin("f1", "low", "high")).withColumn("cell", F.concat_ws("_", "split", "metric"))
    return rows.groupBy("class").pivot("cell", [f"{s}_{m}" for s in splits for m in ("f1", "low", "high")]).agg(F.max("value"))


def model_matrix(facts: DataFrame, splits: list[str], metric: str = "macro_f1") -> DataFrame:
    """A row a model, the metric on each split."""
    return facts.where(F.col("metric") == metric).groupBy("model").pivot("split", splits).agg(F.max("value"))


def ensemble_against_single(facts: DataFrame, split: str, metric: str = "macro_f1") -> DataFrame:
    """(arm, best_single, single, ensemble, delta): each arm's ensemble against its best member; the least name of equals.

    facts: (model, arm, is_ensemble, split, metric, value).
    """
    rows = facts.where((F.col("split") == split) & (F.col("metric") == metric))
    single = F.min(F.when(~F.col("is_ensemble"), F.struct((-F.col("value")).alias("v"), F.col("model"))))
    both = rows.groupBy("arm").agg(single.alias("s"), F.max(F.when(F.col("is_ensemble"), F.col("value"))).alias("ensemble"))
    return both.select("arm", F.col("s.model").alias("best_single"), (-F.col("s.v")).alias("single"), "ensemble", (F.col("ensemble") + F.col("s.v")).alias("delta"))


def scale(tables: dict[str, DataFrame], summary: DataFrame) -> DataFrame:
    """(item, n): rows of each table, and of each tool the most contracts that it ran on for any class."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, t in sorted(tables.items())]
    ran = summary.groupBy("tool").agg(F.max("ran").alias("n")).select(F.concat(F.lit("ran_"), "tool").alias("item"), "n")
    for c in counts:
        ran = ran.unionByName(c)
    return ran


def before_after(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after, delta) of two facts; a side that lacks a row is null."""
    o, n = old.select(*keys, F.col("value").alias("before")), new.select(*keys, F.col("value").alias("after"))
    return o.join(n, keys, "full").withColumn("delta", F.col("after") - F.col("before"))


def gap(facts: DataFrame, first: str, second: str, metric: str = "macro_f1") -> DataFrame:
    """(model, gap): the first split's value less the second's, models with both."""
    m = model_matrix(facts, [first, second], metric)
    return m.select("model", (F.col(first) - F.col(second)).alias("gap")).where("gap IS NOT NULL")


def ladder(facts: DataFrame, split: str, metric: str = "macro_f1") -> DataFrame:
    """(place, model, value): models by rising value, then name. A row a model."""
    rows = facts.where((F.col("split") == split) & (F.col("metric") == metric)).select("model", "value")
    return rows.agg(F.array_sort(F.collect_list(F.struct("value", "model"))).alias("r")).select(F.posexplode("r").alias("place", "x")).select("place", "x.model", "x.value")


def lookup(facts: DataFrame, model: str, split: str, metric: str = "macro_f1") -> float | None:
    """One value of a fact, null-safe: None where there is none."""
    row = facts.where((F.col("model") == model) & (F.col("split") == split) & (F.col("metric") == metric)).select("value").first()
    return row.value if row else None


def emit(artifacts: dict[str, Callable[[], DataFrame]], folder: str | None = None, skip: tuple[str, ...] = ()) -> list[tuple[str, str, int | None]]:
    """(artifact, status, rows) of each report table, by name: written, skipped, or failed with the error's kind.

    Tables are written as Parquet below the folder, if one is given, else only counted.
    One that lacks its input never keeps the others from being made.
    """
    out: list[tuple[str, str, int | None]] = []
    for name in sorted(artifacts):
        if name in skip:
            out.append((name, "skipped", None))
            continue
        try:
            df = artifacts[name]()
            if folder:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
                df = df.sparkSession.read.parquet(f"{folder}/{name}")
            out.append((name, "written", df.count()))
        except Exception as e:  # any missing input is a note here
            out.append((name, f"failed: {type(e).__name__}", None))
    return out


def summary_lines(best: DataFrame, deltas: DataFrame, ensembles: DataFrame) -> DataFrame:
    """(place, line): the results in three sentences: the best model, what the arm adds on average, what ensembles add.

    best: (model, value); deltas: (delta); ensembles: (best_single, delta), of which the first by name counts.
    """
    three = lambda c: F.format_string("%.3f", c)
    one = best.agg(F.max(F.struct("value", "model")).alias("x")).select(F.lit(0).alias("place"), F.coalesce(F.concat(F.lit("best: "), "x.model", F.lit(" "), three(F.col("x.value"))), F.lit("best: n/a")).alias("line"))
    mean = F.avg("delta")
    two = deltas.agg(F.when(mean.isNull(), "ablation incomplete").when(mean > 0, F.concat(F.lit("the arm helped by "), three(mean))).otherwise(F.concat(F.lit("the arm did not help: "), three(mean))).alias("line")).select(F.lit(1).alias("place"), "line")
    x = F.min(F.struct("best_single", "delta")).alias("x")
    verdict = F.when(F.col("x").isNull(), "no ensemble").otherwise(F.concat(F.when(F.col("x.delta") > 0, "the ensemble beats ").otherwise("the ensemble does not beat "), F.col("x.best_single"), F.lit(" by "), three(F.col("x.delta"))))
    return one.unionByName(two).unionByName(ensembles.agg(x).select(F.lit(2).alias("place"), verdict.alias("line")))
