"""Queries on report tables and on the tables around outside work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, graph, locate, metrics, reports
from . import corpus, evaluation, structure
from . import fixtures as fx
from .fixtures import rounded, run, with_

QUERIES: dict[str, tuple] = {}
_FACTS = evaluation._FACTS
_ONE = "SELECT model, split, metric, value FROM f WHERE seed = 1"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return add


def one_seed(spark, d):
    return run(spark, d, _FACTS).where("seed = 1")


@query("report_dual_benchmark", with_(
    "SELECT class, " + ", ".join(f"round(max(v) FILTER (model = '{m}') + {k}, 6) AS {m}_{n}" for m in ("gcn", "sage") for n, k in (("f1", 0), ("low", -0.1), ("high", 0.1))) + " FROM (SELECT model, class, avg(prob) AS v FROM p GROUP BY ALL) GROUP BY class", p=fx.PROBS))
def report_dual_benchmark(spark, d):
    """Two splits side by side; here the models stand for splits."""
    v = run(spark, d, fx.PROBS).where("model IN ('gcn', 'sage')").groupBy(F.col("model").alias("split"), "class").agg(F.avg("prob").alias("v"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col("v") + k).alias("value")) for m, k in (("f1", 0.0), ("low", -0.1), ("high", 0.1))])
    facts = v.select(F.lit("best").alias("model"), "split", "class", F.explode(cells).alias("x")).select("model", "split", "class", "x.*")
    return rounded(reports.dual_benchmark(facts, "best", ["gcn", "sage"]))


@query("report_ensemble", with_(
    "SELECT arm, arg_min(model, struct_pack(a := -value, b := model)) FILTER (NOT e) AS best_single, round(max(value) FILTER (NOT e), 6) AS single, round(max(value) FILTER (e), 6) AS ensemble, round(max(value) FILTER (e) - max(value) FILTER (NOT e), 6) AS delta FROM (SELECT *, CASE WHEN model LIKE '%_df' THEN 'df' ELSE 'plain' END AS arm, model LIKE 'sage%' AS e FROM o WHERE split = 'test_a') GROUP BY arm", f=_FACTS, o=_ONE))
def report_ensemble(spark, d):
    f = one_seed(spark, d).withColumn("arm", F.when(F.col("model").endswith("_df"), "df").otherwise("plain")).withColumn("is_ensemble", F.col("model").startswith("sage"))
    return rounded(reports.ensemble_against_single(f, "test_a"))


@query("report_scale", with_("SELECT 'ran_' || tool AS item, max(n) AS n FROM (SELECT tool, flaw, count_if(vote <> -1) AS n FROM v GROUP BY ALL) GROUP BY tool UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labels', count(*) FROM labels", v=fx.VOTES))
def report_scale(spark, d):
    return reports.scale({n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels")}, corpus.vote_summary(spark, d))


@query("report_before_after", with_("SELECT coalesce(a.model, b.model) AS model, coalesce(a.split, b.split) AS split, round(a.value, 6) AS before, round(b.value, 6) AS after, round(b.value - a.value, 6) AS delta FROM (SELECT * FROM f WHERE seed = 1 AND model <> 'gat') a FULL JOIN (SELECT * FROM f WHERE seed = 2 AND model <> 'gcn') b ON a.model = b.model AND a.split = b.split", f=_FACTS))
def report_before_after(spark, d):
    f = run(spark, d, _FACTS)
    return rounded(reports.before_after(f.where("seed = 1 AND model <> 'gat'"), f.where("seed = 2 AND model <> 'gcn'"), ["model", "split"]))


@query("report_gap", with_("SELECT a.model, round(a.value - b.value, 6) AS gap FROM o a JOIN o b ON a.model = b.model AND a.split = 'test_a' AND b.split = 'test_bb'", f=_FACTS, o=_ONE))
def report_gap(spark, d):
    return rounded(reports.gap(one_seed(spark, d), "test_a", "test_bb"))


@query("report_ladder", with_("SELECT (row_number() OVER (ORDER BY value, model) - 1)::INT AS place, model, round(value, 6) AS value FROM o WHERE split = 'test_a'", f=_FACTS, o=_ONE))
def report_ladder(spark, d):
    return rounded(reports.ladder(one_seed(spark, d), "test_a"))


@query("extract_outcomes", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 4 <> 0 THEN 'full' WHEN doc_id % 3 = 0 THEN 'degraded' ELSE 'placeholder' END AS outcome, count(*) AS n FROM documents GROUP BY ALL")
def extract_outcomes(spark, d):
    i = F.col("doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(graph.extraction_outcome(i % 10 != 0, i % 4 != 0, i % 3 == 0).alias("outcome")).agg(F.count("*").alias("n"))


@query("extract_totals", with_("SELECT CASE WHEN graph_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count_if(graph_id % 7 = 0) AS n_degraded, sum(k)::BIGINT AS n_edges, sum(f)::BIGINT AS n_data_flow FROM (SELECT graph_id, count(*) AS k, count_if(etype = 'data_flow') AS f FROM e GROUP BY graph_id) GROUP BY ALL", e=fx.ORDER_EDGES))
def extract_totals(spark, d):
    g = structure.graph_sizes(spark, d)
    return extract.outcomes(g.withColumn("split", F.when(F.col("graph_id") % 5 == 0, "test").otherwise("train")).withColumn("degraded", F.col("graph_id") % 7 == 0))


@query("extract_hook", "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN length(text)::VARCHAR END AS result, CASE WHEN doc_id % 9 = 0 THEN 'ValueError: refused' END AS error FROM documents")
def extract_hook(spark, d):
    """Outside code over each text, failures kept as data."""

    def set_up():
        def fn(text):
            if text.startswith("#"):
                raise ValueError("refused")
            return str(len(text))

        return fn

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("#"), "text")).otherwise(F.col("text")).alias("text"))
    return extract.extract(docs, set_up, "doc_id", "text", seconds=60)


@query("extract_embeddings", "SELECT doc_id, length(text)::DOUBLE AS x FROM documents")
def extract_embeddings(spark, d):
    """A stand-in embedder over distinct texts, joined back to every row."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return extract.embed(docs, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], "text").select("doc_id", F.col("embedding")[0].alias("x"))


@query("extract_training_rows", with_("SELECT count(*) AS wanted, count_if(contract_id IN (SELECT contract_id FROM c WHERE doc_id % 3 <> 0)) AS found, count_if(contract_id NOT IN (SELECT contract_id FROM c WHERE doc_id % 3 <> 0)) AS missing FROM w", c=fx.CONTRACTS, w=fx.WIDE))
def extract_training_rows(spark, d):
    sources = run(spark, d, fx.CONTRACTS).where("doc_id % 3 <> 0").select("contract_id", "source")
    return extract.training_rows(run(spark, d, fx.WIDE), sources)[1]


@query("extract_needed", with_("SELECT DISTINCT md5(source) AS key, 'hash' AS kind FROM c WHERE doc_id % 10 = 0 UNION SELECT contract_id, 'id' FROM c WHERE doc_id % 10 <> 0", c=fx.CONTRACTS))
def extract_needed(spark, d):
    c = run(spark, d, fx.CONTRACTS)
    return extract.needed(c.where("doc_id % 10 = 0").select(F.md5("source").alias("chash")), c.where("doc_id % 10 <> 0"))


@query("locate_interleaved", with_("SELECT contract, array_to_string(list(line ORDER BY p)[1:5], ',') AS lines FROM (SELECT contract, line, min(nid * 2 + CASE branch WHEN 'ast' THEN 0 ELSE 1 END) AS p FROM n GROUP BY ALL) GROUP BY contract", n=fx.NODES))
def locate_interleaved(spark, d):
    lines = run(spark, d, fx.NODES).select("contract", "branch", F.col("nid").alias("rank"), "line")
    return extract.interleave(lines, 5).select("contract", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("locate_models", with_("SELECT contract::BIGINT % 2 AS model, k::INT AS k, tolerance::INT AS tolerance, round(avg(hit), 6) AS accuracy FROM h GROUP BY ALL", n=fx.NODES, ls=structure._LS, m=structure._MERGED, pr=structure._PRED, g=fx.GOLD, h=structure._HITS))
def locate_models(spark, d):
    hits = structure.hits(spark, d).withColumn("model", F.col("contract").cast("long") % 2)
    return rounded(locate.top_k_accuracy(hits, ("model",)))


@query("explain_targets", with_("SELECT contract, class, round(prob, 6) AS prob FROM p WHERE model = 'gcn' AND (prob >= 0.3 OR class = (SELECT arg_min(class, struct_pack(a := -q.prob, b := class)) FROM p q WHERE q.model = 'gcn' AND q.contract = p.contract))", p=fx.PROBS))
def explain_targets(spark, d):
    return rounded(extract.argmax_or_above(run(spark, d, fx.PROBS).where("model = 'gcn'").select("contract", "class", "prob")))


@query("report_deltas_frozen", with_("SELECT class, round(a.f1, 6) AS before, round(b.f1, 6) AS after, round(b.f1 - a.f1, 6) AS delta FROM z a JOIN z b USING (class) WHERE a.model = 'gcn' AND b.model = 'gcn_df'", p=fx.PROBS, z=f"SELECT model, class, {evaluation._F1} AS f1 FROM (SELECT model, class, {evaluation._CONF} FROM (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM p) GROUP BY ALL)"))
def report_deltas_frozen(spark, d):
    """Two models' classes under one frozen threshold, before and after."""
    f = metrics.per_class(evaluation.predicted(spark, d), ("model",)).select("model", "class", F.col("f1").alias("value"))
    return rounded(reports.before_after(f.where("model = 'gcn'"), f.where("model = 'gcn_df'"), ["class"]))
