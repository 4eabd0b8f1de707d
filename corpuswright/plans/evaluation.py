"""Queries on metrics, thresholds, intervals and reports, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics
from . import fixtures as fx
from .fixtures import rounded, run, with_

QUERIES: dict[str, tuple] = {}
_CONF = "count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true <> 1 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred <> 1) AS fn, count_if(y_true <> 1 AND y_pred <> 1) AS tn"
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
_P = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
_R = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
_PRED = "SELECT model, contract, class, y_true, prob, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM p"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return add


def probs(spark, d):
    return run(spark, d, fx.PROBS)


def predicted(spark, d):
    return metrics.predict(probs(spark, d), scalar=0.5)


@query("metric_confusion", with_(f"SELECT class, {_CONF} FROM t GROUP BY class", t=fx.TEN))
def metric_confusion(spark, d):
    return metrics.confusion(run(spark, d, fx.TEN))


@query("metric_per_class", with_(f"SELECT model, class, tp, fp, fn, tn, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F1}, 6) AS f1, tp + fn AS support, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT model, class, {_CONF} FROM q GROUP BY ALL)", p=fx.PROBS, q=_PRED))
def metric_per_class(spark, d):
    return rounded(metrics.per_class(predicted(spark, d), ("model",)))


def _summary_sql(by: str, source: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN x USING ({by})" if by else ", x"
    return f"""SELECT {key}round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round({_F1}, 6) AS micro_f1, round(subset_accuracy, 6) AS subset_accuracy
    FROM (SELECT {key}avg({_P}) AS mp, avg({_R}) AS mr, avg({_F1}) AS mf, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT {key}class, {_CONF} FROM {source} GROUP BY ALL) {group}) m {join}"""


def _exact_sql(by: str, source: str) -> str:
    key = f"{by}, " if by else ""
    return f"SELECT {key}avg(same) AS subset_accuracy FROM (SELECT {key}contract, min(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS same FROM {source} GROUP BY ALL) {f'GROUP BY {by}' if by else ''}"


@query("metric_summary", with_(_summary_sql("", "t"), t=fx.TEN, x=_exact_sql("", "t")))
def metric_summary(spark, d):
    return rounded(metrics.summary(run(spark, d, fx.TEN)))


@query("metric_models", with_(_summary_sql("model", "q"), p=fx.PROBS, q=_PRED, x=_exact_sql("model", "q")))
def metric_models(spark, d):
    return rounded(metrics.summary(predicted(spark, d), ("model",)))


@query("metric_masked", with_(_summary_sql("", "m"), t=fx.TEN, m="SELECT * FROM t WHERE class IN ('k1', 'k4', 'k7')", x=_exact_sql("", "m")))
def metric_masked(spark, d):
    names = metrics.resolve_mask(["k7", 1, "k4"], [f"k{i}" for i in range(10)])
    return rounded(metrics.summary(run(spark, d, fx.TEN), mask=names))


_TUNED = f"SELECT model, class, threshold, f1 FROM (SELECT model, class, i, threshold, {_F1} AS f1 FROM (SELECT model, class, i, i * 0.05::DOUBLE AS threshold, count_if(y_true = 1 AND prob >= i * 0.05::DOUBLE) AS tp, count_if(y_true <> 1 AND prob >= i * 0.05::DOUBLE) AS fp, count_if(y_true = 1 AND prob < i * 0.05::DOUBLE) AS fn FROM p, range(1, 20) g(i) GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY model, class ORDER BY f1 DESC, i) = 1"


@query("tune_thresholds", with_("SELECT model, class, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM u", p=fx.PROBS, u=_TUNED))
def tune_thresholds(spark, d):
    return rounded(metrics.tune_thresholds(probs(spark, d), ("model",)))


@query("tune_global", with_(f"SELECT round(threshold, 6) AS threshold, round(macro, 6) AS macro_f1 FROM (SELECT i, threshold, round(avg({_F1}), 12) AS macro FROM (SELECT class, i, i * 0.05::DOUBLE AS threshold, count_if(y_true = 1 AND prob >= i * 0.05::DOUBLE) AS tp, count_if(y_true <> 1 AND prob >= i * 0.05::DOUBLE) AS fp, count_if(y_true = 1 AND prob < i * 0.05::DOUBLE) AS fn FROM p, range(1, 20) g(i) WHERE model = 'gcn' GROUP BY ALL) GROUP BY ALL) ORDER BY macro DESC, i LIMIT 1", p=fx.PROBS))
def tune_global(spark, d):
    return rounded(metrics.tune_global(probs(spark, d).where("model = 'gcn'")))


@query("metric_tuned", with_("SELECT model, class, sum(CASE WHEN prob >= threshold THEN 1 ELSE 0 END)::BIGINT AS predicted, sum(y_true)::BIGINT AS positives FROM p JOIN u USING (model, class) GROUP BY ALL", p=fx.PROBS, u=_TUNED))
def metric_tuned(spark, d):
    p = probs(spark, d)
    t = metrics.tune_thresholds(p, ("model",)).select(F.concat_ws("/", "model", "class").alias("class"), "threshold")
    keyed = metrics.predict(p.withColumn("class", F.concat_ws("/", "model", "class")), t)
    name = F.split("class", "/")
    return keyed.groupBy("model", F.get(name, F.lit(1)).alias("class")).agg(F.sum("y_pred").alias("predicted"), F.sum("y_true").cast("long").alias("positives"))


@query("ensemble_mean", with_("SELECT contract, class, round(avg(prob), 6) AS prob FROM p WHERE model IN ('gcn', 'sage') GROUP BY ALL", p=fx.PROBS))
def ensemble_mean(spark, d):
    return rounded(metrics.ensemble(probs(spark, d), "mean", ["gcn", "sage"]))


@query("ensemble_max", with_("SELECT contract, class, round(max(prob), 6) AS prob FROM p GROUP BY ALL", p=fx.PROBS))
def ensemble_max(spark, d):
    return rounded(metrics.ensemble(probs(spark, d), "max"))


@query("bootstrap_interval", with_(
    f"""SELECT class, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM (SELECT * FROM f UNION ALL SELECT b, 'macro' AS class, avg(f1) FROM f GROUP BY b) GROUP BY class""",
    t=fx.TEN, n="SELECT contract, row_number() OVER (ORDER BY contract::BIGINT) - 1 AS pos FROM (SELECT DISTINCT contract FROM t)",
    dr="SELECT b, ('0x' || substr(md5('42:' || b || ':' || d), 1, 12))::BIGINT % (SELECT count(*) FROM n) AS pos FROM range(200) x(b), (SELECT unnest(range((SELECT count(*) FROM n))) AS d)",
    f=f"SELECT b, class, {_F1} AS f1 FROM (SELECT b, class, {_CONF} FROM dr JOIN n USING (pos) JOIN t USING (contract) GROUP BY ALL)"))
def bootstrap_interval(spark, d):
    """200 replicates over the vectors as contracts; numbers come from ids, which here are 0 .. n - 1."""
    ten = run(spark, d, fx.TEN).withColumn("pos", F.col("contract").cast("long"))
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    return rounded(metrics.bootstrap(ten, n, resamples=200))


@query("bootstrap_interval_full", QUERIES["bootstrap_interval"][1].replace("range(200)", "range(2000)"))
def bootstrap_interval_full(spark, d):
    """The operator's own 2000 replicates; bootstrap_interval draws 200."""
    ten = run(spark, d, fx.TEN).withColumn("pos", F.col("contract").cast("long"))
    return rounded(metrics.bootstrap(ten, spark.read.parquet(f"{d}/embeddings.parquet").count()))


_DET = "SELECT concat('t', k) AS detector, CASE WHEN k < 2 THEN 'tool' ELSE 'model' END AS kind, contract, class, CASE WHEN (contract::BIGINT * 3 + k * 5 + length(class)) % 4 = 0 THEN 1 ELSE y_true END AS y_pred FROM (SELECT DISTINCT contract, class, y_true FROM p), range(3) r(k)"


@query("detector_matrix", with_(
    f"""SELECT detector, round(mf, 6) AS macro_f1, round({_F1}, 6) AS micro_f1, round(rate, 6) AS false_warning_rate
    FROM (SELECT detector, avg({_F1}) AS mf, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT detector, class, {_CONF} FROM z GROUP BY ALL) GROUP BY detector)
    JOIN (SELECT detector, count_if(a = 0 AND b = 1) / count_if(a = 0) AS rate FROM (SELECT detector, contract, max(y_true) AS a, max(y_pred) AS b FROM z GROUP BY ALL) GROUP BY detector) USING (detector)""",
    p=fx.PROBS, e=_DET, u="SELECT detector, contract, class, y_pred FROM e UNION ALL SELECT 'union_of_tools', contract, class, max(y_pred) FROM e WHERE kind = 'tool' GROUP BY contract, class",
    z="SELECT u.*, y_true FROM u JOIN (SELECT DISTINCT contract, class, y_true FROM p) USING (contract, class)"))
def detector_matrix(spark, d):
    truth = probs(spark, d).where("model = 'gcn'").select("contract", "class", "y_true")
    ks = truth.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    hit = (F.col("contract").cast("long") * 3 + F.col("k") * 5 + F.length("class")) % 4 == 0
    det = ks.select(F.concat(F.lit("t"), "k").alias("detector"), F.when(F.col("k") < 2, "tool").otherwise("model").alias("kind"), "contract", "class", F.when(hit, 1).otherwise(F.col("y_true")).alias("y_pred"))
    return rounded(metrics.detector_matrix(truth, det))


_FACTS = "SELECT model, split, 'macro_f1' AS metric, seed, CAST((length(model) * 37 + length(split) * 11 + seed * 29) % 100 AS DOUBLE) / 100 AS value FROM (VALUES ('gcn'), ('gcn_df'), ('sage'), ('sage_df'), ('gat')) m(model) CROSS JOIN (VALUES ('test_a'), ('test_bb')) s(split) CROSS JOIN (VALUES (1), (2), (3)) x(seed)"


def facts(spark, d):
    return run(spark, d, _FACTS)


@query("report_seeds", with_("SELECT model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(value) AS n FROM f GROUP BY ALL", f=_FACTS))
def report_seeds(spark, d):
    return rounded(metrics.aggregate_seeds(facts(spark, d)))


@query("report_conditions", with_("SELECT condition, round(mean, 6) AS mean, round(sd, 6) AS sd, condition = (SELECT arg_max(condition, mean) FROM s) AS best FROM s", f=_FACTS, s="SELECT model AS condition, avg(value) AS mean, stddev_pop(value) AS sd FROM f GROUP BY model"))
def report_conditions(spark, d):
    return rounded(metrics.condition_summary(facts(spark, d).withColumnRenamed("model", "condition")))


_ONE = "SELECT model, split, metric, value FROM f WHERE seed = 1"


@query("report_winner", with_("SELECT model, round(value, 6) AS value FROM o WHERE split = 'test_bb' ORDER BY value DESC, model LIMIT 1", f=_FACTS, o=_ONE))
def report_winner(spark, d):
    return rounded(metrics.winner(facts(spark, d).where("seed = 1"), "test_bb"))


@query("report_arm_deltas", with_("SELECT a.model AS base, a.split, a.metric, round(a.value, 6) AS plain, round(b.value, 6) AS arm, round(b.value - a.value, 6) AS delta FROM o a JOIN o b ON b.model = a.model || '_df' AND a.split = b.split", f=_FACTS, o=_ONE))
def report_arm_deltas(spark, d):
    return rounded(metrics.arm_deltas(facts(spark, d).where("seed = 1")))


@query("report_model_matrix", with_("SELECT model, round(max(value) FILTER (split = 'test_a'), 6) AS test_a, round(max(value) FILTER (split = 'test_bb'), 6) AS test_bb FROM o GROUP BY model", f=_FACTS, o=_ONE))
def report_model_matrix(spark, d):
    return rounded(facts(spark, d).where("seed = 1").groupBy("model").pivot("split", ["test_a", "test_bb"]).agg(F.max("value")))


@query("report_formatted", with_("SELECT replace(model, '_', '\\_') AS model, split, printf('%.3f', value) AS shown FROM o".replace("\\\\", "\\"), f=_FACTS, o=_ONE))
def report_formatted(spark, d):
    return facts(spark, d).where("seed = 1").select(X.tex_escape(F.col("model")).alias("model"), "split", X.shown(F.col("value")).alias("shown"))


@query("report_best_epoch", with_(
    """SELECT run, arg_min(epoch, struct_pack(a := -value, b := epoch)) AS best_epoch, round(max(value), 6) AS best, any_value(stop) AS stop_epoch FROM h JOIN
    (SELECT run, min(epoch) FILTER (epoch - be >= 3) AS stop FROM (SELECT h.run, h.epoch, (SELECT min(g.epoch) FROM h g WHERE g.run = h.run AND g.epoch <= h.epoch AND g.value = (SELECT max(k.value) FROM h k WHERE k.run = h.run AND k.epoch <= h.epoch)) AS be FROM h) GROUP BY run) s USING (run)
    WHERE stop IS NULL OR epoch <= stop GROUP BY run""",
    h="SELECT CAST(r.run AS INT) AS run, CAST(e.epoch AS INT) AS epoch, CAST((e.epoch * 17 + r.run * 5) % 23 AS DOUBLE) / 23 AS value FROM range(5) r(run), range(1, 20) e(epoch)"))
def report_best_epoch(spark, d):
    h = spark.range(5).select(F.col("id").cast("int").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(19))).alias("epoch"))
    h = h.withColumn("value", ((F.col("epoch") * 17 + F.col("run") * 5) % 23).cast("double") / 23)
    return rounded(metrics.best_epoch(h, 3))


@query("class_weights", with_("SELECT class, round(neg / greatest(pos, 1), 6) AS weight, round(least(greatest(neg, 1) / greatest(pos, 1), 50), 6) AS clipped FROM (SELECT class, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg FROM t GROUP BY class)", t=fx.TEN))
def class_weights(spark, d):
    ten = run(spark, d, fx.TEN)
    return rounded(metrics.positive_weights(ten).join(metrics.positive_weights(ten, 50).withColumnRenamed("weight", "clipped"), "class"))


@query("baseline_trivial", with_("SELECT class, round(avg(y_true), 6) AS rate, CASE WHEN avg(y_true) >= 0.5 THEN 1 ELSE 0 END AS majority FROM p WHERE model = 'gcn' GROUP BY class", p=fx.PROBS))
def baseline_trivial(spark, d):
    return rounded(metrics.base_rates(probs(spark, d).where("model = 'gcn'")))


@query("baseline_stratified", with_("SELECT contract, class, CASE WHEN ('0x' || substr(md5('42:' || contract || ':' || class), 1, 8))::BIGINT / 4294967296.0 < rate THEN 1.0 ELSE 0.0 END::DOUBLE AS prob FROM (SELECT * FROM p WHERE model = 'gcn') JOIN (SELECT class, avg(y_true) AS rate FROM p WHERE model = 'gcn' GROUP BY class) USING (class)", p=fx.PROBS))
def baseline_stratified(spark, d):
    truth = probs(spark, d).where("model = 'gcn'")
    return metrics.trivial_predictions(truth, metrics.base_rates(truth), "stratified", hard=True)


@query("window_max_pool", "SELECT doc_id AS doc, 'c' || (doc_id % 3) AS class, max((doc_id * 7 + w * 5) % 11)::DOUBLE AS logit FROM documents, range(4) x(w) GROUP BY ALL")
def window_max_pool(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("w"))
    return metrics.max_pool(docs.select(F.col("doc_id").alias("doc"), F.concat(F.lit("c"), F.col("doc_id") % 3).alias("class"), ((F.col("doc_id") * 7 + F.col("w") * 5) % 11).cast("double").alias("logit")))


@query("window_truncation_rate", "SELECT round(avg(CASE WHEN len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '')) > 512 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents".replace("\\\\", "\\"))
def window_truncation_rate(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda t: t != "")).alias("n_tokens"))
    return rounded(metrics.truncation_rate(docs, 512))
