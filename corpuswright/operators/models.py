"""Models on votes and vectors: per-class regressions, principal components, a label model."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .votes import corroboration, label_union


def votes_model(train: DataFrame, rows: DataFrame, classes: list[str], kind: str = "logistic") -> DataFrame:
    """(contract, class, prob) for rows: one balanced model a class on `features` (an array); a constant class gives its constant.

    kind: logistic (ridge of 1 over the sum of weights) or tree (depth 4).
    """
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fit = train.withColumn("_x", array_to_vector("features")).cache()
    score = rows.withColumn("_x", array_to_vector("features"))
    totals = fit.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in classes]).first()
    out = []
    for c in classes:
        pos, n = totals[c] or 0.0, totals.n
        if pos in (0.0, float(n)):
            out.append(rows.select("contract", F.lit(c).alias("class"), F.lit(1.0 if pos else 0.0).alias("prob")))
            continue
        weight = F.when(F.col(c) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
        own = fit.select("_x", F.col(c).cast("double").alias("_y"), weight.alias("_w"))
        args = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w"}
        est = LogisticRegression(standardization=False, regParam=1.0 / n, maxIter=50, **args) if kind == "logistic" else DecisionTreeClassifier(maxDepth=4, seed=42, **args)
        p = vector_to_array("probability")[1]
        out.append(est.fit(own).transform(score).select("contract", F.lit(c).alias("class"), p.alias("prob")))
    fit.unpersist()
    return reduce(DataFrame.unionByName, out)


def pca(train: DataFrame, rows: DataFrame, col: str, k: int) -> DataFrame:
    """rows with `reduced`: min(k, n, d) components of centred vectors, fitted on train only."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = array_to_vector(F.col(col).cast("array<double>"))
    fit = train.select(vec.alias("_v"))
    shape = fit.select(F.size(vector_to_array("_v")).alias("d")).agg(F.count("*").alias("n"), F.max("d").alias("d")).first()
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(fit)
    model = PCA(k=min(k, shape.n, shape.d), inputCol="_c", outputCol="_p").fit(scaler.transform(fit))
    return model.transform(scaler.transform(rows.withColumn("_v", vec))).withColumn("reduced", vector_to_array("_p")).drop("_v", "_c", "_p")


def _posteriors(patterns: list[tuple[str, ...]], counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """P(positive) of each pattern of votes, by expectation maximisation with tools independent given the class.

    Abstaining says nothing. The start takes every tool as right nine times in ten.
    """
    v = np.array([[int(x) for x in p] for p in patterns])
    prior, right = 0.5, np.full((2, v.shape[1]), 0.9)
    post = np.full(len(v), 0.5)
    for _ in range(rounds):
        like = []
        for y in (0, 1):
            hit = np.where(v == y, right[y], 1 - right[y])
            like.append(np.where(v < 0, 1.0, hit).prod(axis=1) * (prior if y else 1 - prior))
        new = like[1] / np.maximum(like[0] + like[1], 1e-300)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        prior = min(max((counts * post).sum() / counts.sum(), 1e-3), 1 - 1e-3)
        for y, w in ((0, counts * (1 - post)), (1, counts * post)):
            voted = (v >= 0) * w[:, None]
            right[y] = np.clip(((v == y) * w[:, None]).sum(axis=0) / np.maximum(voted.sum(axis=0), 1e-12), 0.05, 0.95)
    return post


def label_model(votes: DataFrame, threshold: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """(labels, reliabilities): (contract, flaw, prob, label) and (flaw, tool, reliability), from (contract, tool, flaw, vote): a model a class over patterns of votes.

    The fit sees each distinct pattern and its count, at most 3 to the number of
    tools; rows get their pattern's posterior by a join. A tool without a row for a
    contract abstains. A tool's reliability is how often it is right when it votes,
    as fitted. With one tool active the label is its vote and it counts as reliable,
    with none the label is 0.
    """
    spark = votes.sparkSession
    tools = [r.tool for r in votes.select("tool").distinct().orderBy("tool").collect()]
    by_tool = [F.coalesce(F.max(F.when(F.col("tool") == t, F.col("vote").cast("int"))), F.lit(-1)).cast("string") for t in tools]
    pattern = F.concat_ws(",", *by_tool)
    rows = votes.groupBy("contract", "flaw").agg(pattern.alias("pattern"))
    counts: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("flaw", "pattern").agg(F.count("*").alias("n")).orderBy("flaw", "pattern").collect():
        counts.setdefault(r.flaw, {})[r.pattern] = r.n
    table, reliable = [], []
    for flaw, found in counts.items():
        patterns = [tuple(p.split(",")) for p in found]
        active = [i for i in range(len(patterns[0])) if any(p[i] != "-1" for p in patterns)]
        if len(active) < 2:
            probs = [float(bool(active) and p[active[0]] == "1") for p in patterns]
            reliable += [(flaw, tools[i], 1.0) for i in active]
        else:
            n = np.array(list(found.values()), float)
            post = _posteriors([tuple(p[i] for i in active) for p in patterns], n)
            probs = post.tolist()
            for i in active:
                vote = np.array([int(p[i]) for p in patterns])
                right = np.where(vote == 1, post, 1 - post)
                reliable.append((flaw, tools[i], float((right * n)[vote >= 0].sum() / n[vote >= 0].sum())))
        table += [(flaw, p, float(x)) for p, x in zip(found, probs, strict=True)]
    known = spark.createDataFrame(table, "flaw string, pattern string, prob double")
    labels = rows.join(known, ["flaw", "pattern"]).select("contract", "flaw", "prob", (F.col("prob") >= threshold).cast("int").alias("label"))
    return labels, spark.createDataFrame(reliable, "flaw string, tool string, reliability double")


def label_all(votes: DataFrame, method: str = "union", threshold: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """(labels, reliabilities) of all classes by one method: union (any tool) or model; another raises.

    labels: (contract, flaw, prob, label); reliabilities: (flaw, tool, reliability), for
    the union how often another tool fired too, null where none can.
    """
    if method == "union":
        labels = label_union(votes).select("contract", "flaw", F.col("label").cast("double").alias("prob"), "label")
        return labels, corroboration(votes).select("flaw", "tool", F.col("rate").alias("reliability"))
    if method == "model":
        return label_model(votes, threshold)
    raise ValueError(f"unknown method {method!r}: union or model")
