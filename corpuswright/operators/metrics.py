"""Metrics of multi-label predictions over long tables (model, contract, class, y_true, y_pred or prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The thresholds that are tried.
GRID = tuple(i * 0.05 for i in range(1, 20))


def resolve_mask(mask: list[str | int] | None, classes: list[str]) -> list[str]:
    """Class names of a mask of names or indices, in class order; an unknown or empty mask raises."""
    if mask is None:
        return list(classes)
    names = {classes[m] if isinstance(m, int) and 0 <= m < len(classes) else m for m in mask}
    if not names or not names <= set(classes):
        raise ValueError(f"bad mask {mask!r}")
    return [c for c in classes if c in names]


def predict(probs: DataFrame, thresholds: DataFrame | None = None, scalar: float | None = None) -> DataFrame:
    """probs with y_pred: prob at or above its class's threshold, or above the scalar if that is given."""
    if scalar is not None:
        return probs.withColumn("y_pred", (F.col("prob") >= scalar).cast("int"))
    return probs.join(thresholds, "class").withColumn("y_pred", (F.col("prob") >= F.col("threshold")).cast("int")).drop("threshold")


def confusion(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, class, tp, fp, fn, tn)."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return pred.groupBy(*by, "class").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def _rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 from counts; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def per_class(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion with precision, recall, f1, support and accuracy of each class."""
    df = _rates(confusion(pred, by))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return df.withColumn("support", F.col("tp") + F.col("fn")).withColumn("accuracy", (F.col("tp") + F.col("tn")) / total)


def summary(pred: DataFrame, by: tuple[str, ...] = (), mask: list[str] | None = None) -> DataFrame:
    """One row a group: macro means of the classes' rates, pooled micro f1, subset accuracy. Classes outside the mask don't count."""
    if mask is not None:
        pred = pred.where(F.col("class").isin(mask))
    macro = per_class(pred, by).groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    macro = macro.withColumn("micro_f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).drop("tp", "fp", "fn")
    exact = pred.groupBy(*by, "contract").agg(F.min((F.col("y_true") == F.col("y_pred")).cast("int")).alias("same")).groupBy(*by).agg(F.avg("same").alias("subset_accuracy"))
    return macro.join(exact, list(by)) if by else macro.join(F.broadcast(exact))


def bootstrap(pred: DataFrame, n: int, resamples: int = 2000, alpha: float = 0.05, seed: int = 42, classes: list[str] | None = None) -> DataFrame:
    """(class, low, high): percentile intervals of f1 by class and of macro f1 ('macro'), over resampled contracts.

    pred: (pos, class, y_true, y_pred), pos 0 .. n - 1 numbering the contracts. With
    `classes` only these are reported, and the macro is over them. With n = 0 each of
    the classes and the macro have 0 and 0 (without `classes`, the macro alone). Draw d of replicate b is the contract of number
    hash(seed:b:d) mod n. A replicate only needs how often each contract was drawn,
    so draws are counted before they meet the predictions.
    """
    spark = pred.sparkSession
    if not n:
        return spark.createDataFrame([(c, 0.0, 0.0) for c in [*(classes or []), "macro"]], "class string, low double, high double")
    if classes is not None:
        pred = pred.where(F.col("class").isin(classes))
    draws = spark.range(resamples * n).select(F.expr(f"int(id div {max(n, 1)})").alias("b"), F.expr(f"id % {max(n, 1)}").alias("d"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("d").cast("string"))), 1, 12), 16, 10).cast("long") % max(n, 1)
    times = draws.select("b", number.alias("pos")).groupBy("b", "pos").agg(F.count("*").alias("times"))
    t, p, w = F.col("y_true") == 1, F.col("y_pred") == 1, F.col("times")
    part = lambda cond: F.sum(F.when(cond, w).otherwise(0))
    each = times.join(pred, "pos").groupBy("b", "class").agg(part(t & p).alias("tp"), part(~t & p).alias("fp"), part(t & ~p).alias("fn"))
    f1 = _rates(each).select("b", "class", "f1")
    both = f1.unionByName(f1.groupBy("b").agg(F.avg("f1").alias("f1")).select("b", F.lit("macro").alias("class"), "f1"))
    q = F.percentile("f1", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return both.groupBy("class").agg(q.alias("q")).select("class", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _grid_counts(probs: DataFrame, by: list[str], grid: tuple[float, ...] = GRID) -> DataFrame:
    """(by, i, threshold, tp, fp, fn) at every threshold of the grid, without a row for each: a histogram summed from above."""
    at = F.array(*[F.lit(t) for t in grid])
    level = F.aggregate(at, F.lit(0), lambda a, t: a + F.when(F.col("prob") >= t, 1).otherwise(0))
    hist = probs.groupBy(*by, level.alias("level")).agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))
    cells = hist.select(*by, "pos", "neg", "level", F.posexplode(at).alias("i", "threshold"))
    above = F.col("level") > F.col("i")
    return cells.groupBy(*by, "i", "threshold").agg(F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"))


def tune_thresholds(probs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, class, threshold, f1): the threshold of best f1 of each class, the lowest of equals."""
    f = _rates(_grid_counts(probs, [*by, "class"]))
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("i")))
    return f.groupBy(*by, "class").agg(best.alias("x")).select(*by, "class", "x.threshold", "x.f1")


def tune_global(probs: DataFrame) -> DataFrame:
    """(threshold, macro_f1): the one threshold of best macro f1, the lowest of equals."""
    f = _rates(_grid_counts(probs, ["class"])).groupBy("i", "threshold").agg(F.avg("f1").alias("macro_f1"))
    return f.agg(F.max_by(F.struct("threshold", "macro_f1"), F.struct(F.round("macro_f1", 12), -F.col("i"))).alias("x")).select("x.*")


def ensemble(probs: DataFrame, policy: str = "mean", models: list[str] | None = None) -> DataFrame:
    """(contract, class, prob) over models by mean or max; another policy, or no models, raises."""
    if policy not in ("mean", "max") or models == []:
        raise ValueError(f"bad ensemble: {policy!r} of {models!r}")
    if models is not None:
        probs = probs.where(F.col("model").isin(models))
    return probs.groupBy("contract", "class").agg((F.avg if policy == "mean" else F.max)("prob").alias("prob"))


def detector_matrix(truth: DataFrame, detectors: DataFrame) -> DataFrame:
    """(detector, macro_f1, micro_f1, false_warning_rate) of all detectors and of the tools' union.

    detectors: (detector, kind, contract, class, y_pred), kind tool or model. The
    rate is the share of contracts without any class on which a detector predicts one.
    """
    union = detectors.where("kind = 'tool'").groupBy("contract", "class").agg(F.max("y_pred").alias("y_pred")).select(F.lit("union_of_tools").alias("detector"), "contract", "class", "y_pred")
    every = detectors.select("detector", "contract", "class", "y_pred").unionByName(union)
    pred = every.join(truth, ["contract", "class"])
    row = pred.groupBy("detector", "contract").agg(F.max("y_true").alias("any_true"), F.max("y_pred").alias("any_pred"))
    rate = row.groupBy("detector").agg(F.coalesce(F.try_divide(F.count_if((F.col("any_true") == 0) & (F.col("any_pred") == 1)), F.count_if(F.col("any_true") == 0)), F.lit(0.0)).alias("false_warning_rate"))
    s = summary(pred, ("detector",)).select("detector", "macro_f1", "micro_f1")
    return s.join(rate, "detector")


def aggregate_seeds(values: DataFrame) -> DataFrame:
    """(model, metric, mean, sd, n) over seeds; the sample deviation, 0 for one value."""
    return values.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("value").alias("n"))


def condition_summary(values: DataFrame) -> DataFrame:
    """(condition, mean, sd, best): population deviation over folds; best marks the highest mean, the first of equals."""
    s = values.groupBy("condition").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    top = s.agg(F.max_by("condition", F.struct("mean", F.lit(0))).alias("top"))
    return s.join(F.broadcast(top)).select("condition", "mean", "sd", (F.col("condition") == F.col("top")).alias("best"))


def positive_weights(truth: DataFrame, clip: float | None = None) -> DataFrame:
    """(class, weight): negatives over max(positives, 1); with clip both are 1 at least and the ratio clip at most."""
    c = truth.groupBy("class").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))
    one = F.lit(1).cast("long")
    if clip is None:
        return c.select("class", (F.col("neg") / F.greatest("pos", one)).alias("weight"))
    return c.select("class", F.least(F.greatest("neg", one) / F.greatest("pos", one), F.lit(float(clip))).alias("weight"))


def base_rates(truth: DataFrame) -> DataFrame:
    """(class, rate, majority)."""
    return truth.groupBy("class").agg(F.avg("y_true").alias("rate")).withColumn("majority", (F.col("rate") >= 0.5).cast("int"))


def trivial_predictions(truth: DataFrame, rates: DataFrame, kind: str, seed: int = 42, hard: bool = False) -> DataFrame:
    """(contract, class, prob) of a majority, stratified or all-positive baseline; hard draws stratified ones by hash."""
    rows = truth.select("contract", "class").join(rates, "class")
    if kind == "majority":
        prob = F.col("majority").cast("double")
    elif kind == "positive":
        prob = F.lit(1.0)
    elif kind == "stratified":
        prob = F.col("rate")
        if hard:
            u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "contract", "class")), 1, 8), 16, 10).cast("double") / float(1 << 32)
            prob = (u < F.col("rate")).cast("double")
    else:
        raise ValueError(f"unknown baseline {kind!r}")
    return rows.select("contract", "class", prob.alias("prob"))


def winner(facts: DataFrame, split: str, metric: str = "macro_f1") -> DataFrame:
    """(model, value) of the best model of a split; the least name of equals."""
    rows = facts.where((F.col("split") == split) & (F.col("metric") == metric))
    return rows.agg(F.min(F.struct((-F.col("value")).alias("v"), F.col("model"))).alias("x")).where("x IS NOT NULL").select("x.model", (-F.col("x.v")).alias("value"))


def arm_deltas(facts: DataFrame, suffix: str = "_df") -> DataFrame:
    """(base, split, metric, plain, arm, delta): each model with the suffix against its namesake without."""
    base = F.regexp_replace("model", f"{suffix}$", "")
    armed = F.col("model").endswith(suffix)
    rows = facts.groupBy(base.alias("base"), "split", "metric").agg(F.max(F.when(~armed, F.col("value"))).alias("plain"), F.max(F.when(armed, F.col("value"))).alias("arm"))
    return rows.where("plain IS NOT NULL AND arm IS NOT NULL").withColumn("delta", F.col("arm") - F.col("plain"))


def best_epoch(history: DataFrame, patience: int, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """(by, best_epoch, best, stop_epoch): the first epoch of the best value, and the first that is `patience` past the best so far."""
    w = Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = history.withColumn("top", F.max(F.struct(F.col("value"), (-F.col("epoch")).alias("e"))).over(w))
    run = run.withColumn("stop", F.when(F.col("epoch") + F.col("top.e") >= patience, F.col("epoch")))
    last = run.groupBy(*by).agg(F.min("stop").alias("stop_epoch"))
    until = run.join(last, list(by)).where("stop_epoch IS NULL OR epoch <= stop_epoch")
    return until.groupBy(*by).agg(F.max("top").alias("x"), F.first("stop_epoch").alias("stop_epoch")).select(*by, (-F.col("x.e")).alias("best_epoch"), F.col("x.value").alias("best"), "stop_epoch")


def max_pool(window_logits: DataFrame) -> DataFrame:
    """(doc, class, logit): the greatest over a document's windows."""
    return window_logits.groupBy("doc", "class").agg(F.max("logit").alias("logit"))


def truncation_rate(lengths: DataFrame, most: int, col: str = "n_tokens") -> DataFrame:
    """(rate): share of rows longer than `most`, 0 of none."""
    return lengths.agg(F.coalesce(F.avg((F.col(col) > most).cast("int")), F.lit(0.0)).alias("rate"))


def thresholds_for(tuned: DataFrame, classes: list[str], fallback: float = 0.5) -> DataFrame:
    """(class, threshold) of every class: the tuned one, or the fallback."""
    every = tuned.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    return every.join(tuned.select("class", "threshold"), "class", "left").select("class", F.coalesce("threshold", F.lit(fallback)).alias("threshold"))
