"""Line localisation: node scores to lines, merged ranks, top-k accuracy with tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalise(scores: DataFrame, by: tuple[str, ...] = ("contract", "branch"), col: str = "score") -> DataFrame:
    """Scores over their group's greatest; 0 if that isn't above 0."""
    tops = scores.groupBy(*by).agg(F.max(col).alias("_top"))
    rows = scores.join(tops, list(by))
    return rows.withColumn(col, F.when(F.col("_top") > 0, F.col(col) / F.col("_top")).otherwise(0.0)).drop("_top")


def line_scores(nodes: DataFrame) -> DataFrame:
    """(contract, branch, line, score): the greatest score of a line's nodes, above 0 only, from (contract, branch, nid, score, lines)."""
    rows = nodes.select("contract", "branch", "score", F.explode("lines").alias("line"))
    return rows.groupBy("contract", "branch", "line").agg(F.max("score").alias("score")).where("score > 0")


def merge_lines(scores: DataFrame, k: int = 5) -> DataFrame:
    """(contract, rank, line, score): lines of all branches by their greatest score, then by line; the first k."""
    merged = scores.where("score > 0").groupBy("contract", "line").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("contract").orderBy(F.desc("score"), "line"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("contract", "rank", "line", "score")


def nodes_to_lines(ranked: DataFrame) -> DataFrame:
    """(contract, lines, unmapped): lines of nodes in rank order, each once; nodes without lines.

    ranked: (contract, nid, rank, lines).
    """
    ordered = ranked.groupBy("contract").agg(F.array_sort(F.collect_list(F.struct("rank", "nid", "lines"))).alias("r"))
    no_lines = lambda x: F.coalesce(F.size(x["lines"]) == 0, F.lit(True))
    lines = F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["lines"], F.array().cast("array<int>")))))
    return ordered.select("contract", lines.alias("lines"), F.transform(F.filter("r", no_lines), lambda x: x["nid"]).alias("unmapped"))


def top_nodes(scores: DataFrame, n: int = 10) -> DataFrame:
    """scores with rank, the n greatest of each contract; equals by node."""
    rank = F.row_number().over(Window.partitionBy("contract").orderBy(F.desc("score"), "nid"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def attention_nodes(edges: DataFrame, k: int) -> DataFrame:
    """(contract, nodes): endpoints, each once, of the k edges of highest mean attention over heads.

    edges: (contract, eidx, src, dst, heads array).
    """
    mean = F.aggregate("heads", F.lit(0.0), lambda a, x: a + x) / F.size("heads")
    w = Window.partitionBy("contract").orderBy(F.desc("mean"), "eidx")
    top = edges.withColumn("mean", mean).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rows = top.groupBy("contract").agg(F.array_sort(F.collect_list(F.struct("rank", "src", "dst"))).alias("r"))
    return rows.select("contract", F.array_distinct(F.flatten(F.transform("r", lambda x: F.array(x["src"], x["dst"])))).alias("nodes"))


def hits(pred: DataFrame, gold: DataFrame, ks: list[int], tolerances: list[int]) -> DataFrame:
    """(contract, k, tolerance, hit) for each row of pred: whether one of its first k lines is within the tolerance of a gold line.

    pred: (contract, lines array, ranked); gold: (contract, lines array). Gold lines
    are widened to windows, so the meeting is of equal lines. No gold is a miss.
    """
    rows = pred.select("contract", F.col("lines").alias("pred")).join(gold.select("contract", F.col("lines").alias("gold")), "contract", "left")
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances))))
    wide = F.flatten(F.transform(F.coalesce("gold", F.array().cast("array<int>")), lambda g: F.sequence(g - F.col("tolerance"), g + F.col("tolerance"))))
    return rows.select("contract", "k", "tolerance", F.arrays_overlap(F.slice("pred", F.lit(1), F.col("k")), wide).cast("int").alias("hit"))


def top_k_accuracy(hit_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, tolerance, accuracy): over all rows."""
    return hit_rows.groupBy(*by, "k", "tolerance").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))


def accuracy_over_passes(hit_rows: DataFrame) -> DataFrame:
    """(k, tolerance, mean, sd) of passes' accuracies, 4 places; the sample deviation, 0 for one pass."""
    a = top_k_accuracy(hit_rows, ("pass",))
    return a.groupBy("k", "tolerance").agg(F.round(F.avg("accuracy"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)), 4).alias("sd"))


def hit_counts(hit_rows: DataFrame) -> DataFrame:
    """(contract, k, tolerance, hits): over passes."""
    return hit_rows.groupBy("contract", "k", "tolerance").agg(F.sum("hit").cast("long").alias("hits"))


def class_order_lines(ranked: DataFrame, k: int) -> DataFrame:
    """(contract, lines): lines in the order of class and rank, each once, the first k. ranked: (contract, class_idx, rank, line)."""
    rows = ranked.groupBy("contract").agg(F.array_sort(F.collect_list(F.struct("class_idx", "rank", "line"))).alias("r"))
    return rows.select("contract", F.slice(F.array_distinct(F.transform("r", lambda x: x["line"])), 1, k).alias("lines"))


def targets(indexed: DataFrame, gold: DataFrame) -> DataFrame:
    """(contract, lines): what accuracy is measured on: indexed contracts that have gold lines."""
    return gold.where(F.size("lines") > 0).join(indexed.select("contract").distinct(), "contract", "left_semi").select("contract", "lines")
