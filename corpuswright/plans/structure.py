"""Queries on localisation, graphs, ledgers and models, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, ledger, locate, models, trees
from ..schema import CLASSES, TOOLS
from ..sources import tables
from ..streaming import attempts
from . import corpus
from . import fixtures as fx
from .fixtures import rounded, run, with_

QUERIES: dict[str, tuple] = {}
_LS = "SELECT contract, branch, line, max(score) AS score FROM n GROUP BY ALL HAVING max(score) > 0"
_MERGED = "SELECT contract, row_number() OVER (PARTITION BY contract ORDER BY score DESC, line) AS rank, line, score FROM (SELECT contract, line, max(score) AS score FROM ls GROUP BY ALL)"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return add


def nodes(spark, d):
    return run(spark, d, fx.NODES).withColumn("lines", F.array("line"))


@query("locate_normalised", with_("SELECT contract, branch, nid, round(CASE WHEN max(score) OVER (PARTITION BY contract, branch) > 0 THEN score / max(score) OVER (PARTITION BY contract, branch) ELSE 0 END, 6) AS score FROM n", n=fx.NODES))
def locate_normalised(spark, d):
    return rounded(locate.normalise(run(spark, d, fx.NODES)).select("contract", "branch", "nid", "score"))


@query("locate_line_scores", with_(_LS, n=fx.NODES))
def locate_line_scores(spark, d):
    return locate.line_scores(nodes(spark, d))


@query("locate_merged", with_("SELECT contract, rank::INT AS rank, line, score FROM m WHERE rank <= 5", n=fx.NODES, ls=_LS, m=_MERGED))
def locate_merged(spark, d):
    return locate.merge_lines(locate_line_scores(spark, d), 5)


_PRED = "SELECT contract, list(line ORDER BY rank) AS pred FROM m WHERE rank <= 10 GROUP BY contract"
_HITS = "SELECT contract, k, tol AS tolerance, CASE WHEN len(list_filter(pred[1:k], lambda x: len(list_filter(coalesce(gold, []), lambda y: abs(x - y) <= tol)) > 0)) > 0 THEN 1 ELSE 0 END AS hit FROM pr LEFT JOIN (SELECT contract, list(line) AS gold FROM g GROUP BY contract) USING (contract), (VALUES (1), (3), (5), (10)) kk(k), (VALUES (0), (1), (2)) tt(tol)"


def hits(spark, d):
    merged = locate.merge_lines(locate_line_scores(spark, d), 10)
    pred = merged.groupBy("contract").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    gold = run(spark, d, fx.GOLD).groupBy("contract").agg(F.collect_list("line").alias("lines"))
    return locate.hits(pred, gold, [1, 3, 5, 10], [0, 1, 2])


@query("locate_hits", with_("SELECT contract, k::INT AS k, tolerance::INT AS tolerance, hit::INT AS hit FROM h", n=fx.NODES, ls=_LS, m=_MERGED, pr=_PRED, g=fx.GOLD, h=_HITS))
def locate_hits(spark, d):
    return hits(spark, d)


@query("locate_accuracy", with_("SELECT k::INT AS k, tolerance::INT AS tolerance, round(avg(hit), 6) AS accuracy FROM h GROUP BY ALL", n=fx.NODES, ls=_LS, m=_MERGED, pr=_PRED, g=fx.GOLD, h=_HITS))
def locate_accuracy(spark, d):
    return rounded(locate.top_k_accuracy(hits(spark, d)))


@query("locate_passes", with_("SELECT k::INT AS k, tolerance::INT AS tolerance, round(avg(a), 4) AS mean, round(coalesce(stddev_samp(a), 0), 4) AS sd FROM (SELECT contract::BIGINT % 3 AS p, k, tolerance, avg(hit) AS a FROM h GROUP BY ALL) GROUP BY ALL", n=fx.NODES, ls=_LS, m=_MERGED, pr=_PRED, g=fx.GOLD, h=_HITS))
def locate_passes(spark, d):
    return locate.accuracy_over_passes(hits(spark, d).withColumn("pass", F.col("contract").cast("long") % 3))


@query("locate_hit_counts", with_("SELECT contract, k::INT AS k, tolerance::INT AS tolerance, sum(hit)::BIGINT AS hits FROM h GROUP BY ALL", n=fx.NODES, ls=_LS, m=_MERGED, pr=_PRED, g=fx.GOLD, h=_HITS))
def locate_hit_counts(spark, d):
    return locate.hit_counts(hits(spark, d))


@query("locate_node_lines", with_("SELECT contract, array_to_string(list(line ORDER BY f), ',') AS lines FROM (SELECT contract, line, min(rank) AS f FROM (SELECT contract, line, row_number() OVER (PARTITION BY contract ORDER BY score DESC, nid) AS rank FROM n WHERE branch = 'ast' QUALIFY rank <= 4) GROUP BY ALL) GROUP BY contract", n=fx.NODES))
def locate_node_lines(spark, d):
    top = locate.top_nodes(nodes(spark, d).where("branch = 'ast'"), 4)
    return locate.nodes_to_lines(top).select("contract", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("locate_attention", with_("SELECT contract, array_to_string(list(x ORDER BY f), ',') AS nodes FROM (SELECT contract, x, min(f) AS f FROM (SELECT contract, unnest([nid, (nid + 1) % 4]) AS x, rank * 2 + unnest([0, 1]) AS f FROM (SELECT contract, nid, row_number() OVER (PARTITION BY contract ORDER BY (score + line) / 2 DESC, nid) AS rank FROM n WHERE branch = 'cfg' QUALIFY rank <= 3)) GROUP BY ALL) GROUP BY contract", n=fx.NODES))
def locate_attention(spark, d):
    e = run(spark, d, fx.NODES).where("branch = 'cfg'")
    e = e.select("contract", F.col("nid").alias("eidx"), F.col("nid").alias("src"), ((F.col("nid") + 1) % 4).alias("dst"), F.array(F.col("score"), F.col("line").cast("double")).alias("heads"))
    return locate.attention_nodes(e, 3).select("contract", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query("locate_class_order", with_("SELECT contract, array_to_string(list(line ORDER BY p)[1:4], ',') AS lines FROM (SELECT contract, line, min(nid) AS p FROM n WHERE branch = 'ast' GROUP BY ALL) GROUP BY contract", n=fx.NODES))
def locate_class_order(spark, d):
    r = run(spark, d, fx.NODES).where("branch = 'ast'").select("contract", F.expr("nid div 3").alias("class_idx"), (F.col("nid") % 3).alias("rank"), "line")
    return locate.class_order_lines(r, 4).select("contract", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("locate_expand", with_("SELECT contract, array_to_string(list_sort(list_distinct(flatten(list([line - 1, line, line + 1])))), ',') AS lines FROM g GROUP BY contract", g=fx.GOLD))
def locate_expand(spark, d):
    g = run(spark, d, fx.GOLD).groupBy("contract").agg(F.collect_list("line").alias("lines"))
    return g.select("contract", F.array_join(X.expand(F.col("lines"), 1).cast("array<string>"), ",").alias("lines"))


@query("parse_spans", "SELECT event_id, ((event_id * 7) % 100)::INT AS start, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 9)::INT END AS length, 0 AS file FROM events")
def parse_spans(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    src = F.concat((F.col("event_id") * 7 % 100).cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(":"), (F.col("event_id") % 9).cast("string"), F.lit(":x"))))
    return e.select("event_id", X.parse_span(src).alias("s")).select("event_id", "s.*")


def _order_graph(spark, d):
    e = run(spark, d, fx.ORDER_EDGES)
    n = e.select("graph_id", F.explode(F.array("src", "dst")).alias("nid")).distinct()
    return n, e


_N = "SELECT DISTINCT graph_id, unnest([src, dst]) AS nid FROM e"


@query("graph_degrees", with_("SELECT graph_id, nid, (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND dst = nid) AS in_degree, (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND src = nid) AS out_degree FROM n", e=fx.ORDER_EDGES, n=_N))
def graph_degrees(spark, d):
    return graph.degrees(*_order_graph(spark, d))


@query("graph_sizes", with_("SELECT graph_id, count(*) AS n_nodes, any_value(k) AS n_edges, any_value(f) AS n_data_flow FROM n JOIN (SELECT graph_id, count(*) AS k, count_if(etype = 'data_flow') AS f FROM e GROUP BY graph_id) USING (graph_id) GROUP BY graph_id", e=fx.ORDER_EDGES, n=_N))
def graph_sizes(spark, d):
    return graph.graph_sizes(*_order_graph(spark, d))


@query("graph_without_data_flow", with_("SELECT graph_id, src, dst, etype FROM e WHERE etype <> 'data_flow'", e=fx.ORDER_EDGES))
def graph_without_data_flow(spark, d):
    return graph.without_data_flow(_order_graph(spark, d)[1])


#: Each turn writes the first word of its text and reads all words.
_RW = "SELECT graph_id, nid, lower(split_part(text, ' ', 1)) AS w, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS r FROM t"
_DF = "SELECT DISTINCT a.graph_id, a.nid AS src, b.nid AS dst FROM rw a JOIN rw b ON a.graph_id = b.graph_id AND list_contains(b.r, a.w) AND a.nid < b.nid WHERE a.w <> ''"


def records(spark, d):
    t = run(spark, d, fx.TURNS)
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    first = F.get(F.split(F.lower("text"), " "), F.lit(0))
    last = t.groupBy("graph_id").agg(F.max("nid").alias("last"))
    t = t.join(last, "graph_id")
    sons = F.when(F.col("nid") < F.col("last"), F.array(F.col("nid") + 1)).otherwise(F.array().cast("array<int>"))
    return t.select("graph_id", "nid", "type", F.col("text").alias("snippet"), F.array("nid").alias("lines"), sons.alias("sons"), words.alias("reads"), F.filter(F.array(first), lambda x: x != "").alias("writes"), F.lit(0).alias("fn"))


@query("graph_data_flow", with_("SELECT graph_id, src, dst FROM df", t=fx.TURNS, rw=_RW, df=_DF))
def graph_data_flow(spark, d):
    r = records(spark, d)
    var = lambda c: r.select("graph_id", "fn", "nid", F.explode(c).alias("var"))
    return graph.data_flow_edges(var("writes"), var("reads"))


_ALL_EDGES = "SELECT graph_id, nid AS src, nid + 1 AS dst, 'control_flow' AS etype FROM t WHERE nid < (SELECT max(nid) FROM t s WHERE s.graph_id = t.graph_id) UNION ALL SELECT graph_id, src, dst, 'data_flow' FROM df"


@query("graph_flow_edges", with_("SELECT graph_id, src, dst, etype FROM ae", t=fx.TURNS, rw=_RW, df=_DF, ae=_ALL_EDGES))
def graph_flow_edges(spark, d):
    return graph.flow_graph(records(spark, d))[1]


@query("graph_encoded", with_("SELECT graph_id, nid, array_to_string(list_concat(list_transform(['assistant', 'user'], lambda x: CASE WHEN x = type THEN 1 ELSE 0 END), [0, CASE WHEN nid < mx THEN 1 ELSE 0 END, (SELECT count(*) FROM ae WHERE ae.graph_id = t.graph_id AND dst = nid), (SELECT count(*) FROM ae WHERE ae.graph_id = t.graph_id AND src = nid)]), ',') AS features FROM t JOIN (SELECT graph_id, max(nid) AS mx FROM t GROUP BY graph_id) USING (graph_id)", t=fx.TURNS, rw=_RW, df=_DF, ae=_ALL_EDGES))
def graph_encoded(spark, d):
    n, e = graph.flow_graph(records(spark, d))
    enc = graph.encode_nodes(n, graph.degrees(n, e), ["assistant", "user"])
    return enc.select("graph_id", "nid", F.array_join(F.col("features").cast("array<int>").cast("array<string>"), ",").alias("features"))


def _scored(spark, d):
    n, e = _order_graph(spark, d)
    return n.withColumn("x", (F.length("nid") * 3 % 7).cast("double")), e


@query("graph_mean_neighbours", with_("SELECT graph_id, nid, round(coalesce((SELECT avg((length(src) * 3 % 7)::DOUBLE) FROM e WHERE e.graph_id = n.graph_id AND dst = nid), 0), 6) AS mean FROM n", e=fx.ORDER_EDGES, n=_N))
def graph_mean_neighbours(spark, d):
    return rounded(graph.mean_neighbours(*_scored(spark, d)))


@query("graph_gcn", with_(
    "SELECT graph_id, ev.dst AS nid, round(sum((length(src) * 3 % 7)::DOUBLE / sqrt(a.k)) / sqrt(any_value(b.k)), 6) AS value FROM ev JOIN dg a USING (graph_id) JOIN dg b USING (graph_id) WHERE a.nid = src AND b.nid = ev.dst GROUP BY ALL",
    e=fx.ORDER_EDGES, n=_N, ev="SELECT graph_id, src, dst FROM e UNION ALL SELECT graph_id, nid, nid FROM n", dg="SELECT graph_id, dst AS nid, count(*) AS k FROM ev GROUP BY ALL"))
def graph_gcn(spark, d):
    return rounded(graph.gcn_aggregate(*_scored(spark, d)))


@query("graph_attention", with_("SELECT graph_id, src, dst, round(sum(exp(z)) / any_value(tot), 6) AS alpha FROM (SELECT *, (length(src) * 5 + length(dst)) % 9 / 3.0::DOUBLE AS z, sum(exp((length(src) * 5 + length(dst)) % 9 / 3.0::DOUBLE)) OVER (PARTITION BY graph_id, dst) AS tot FROM e) GROUP BY ALL", e=fx.ORDER_EDGES))
def graph_attention(spark, d):
    e = run(spark, d, fx.ORDER_EDGES).withColumn("e", ((F.length("src") * 5 + F.length("dst")) % 9).cast("double") / 3)
    return rounded(graph.attention_weights(e).groupBy("graph_id", "src", "dst").agg(F.sum("alpha").alias("alpha")))


@query("graph_mean_pool", with_("SELECT g AS graph_id, round(coalesce(avg((length(nid) * 3 % 7)::DOUBLE), 0), 6) AS x FROM range(60) r(g) LEFT JOIN n ON g = graph_id GROUP BY g", e=fx.ORDER_EDGES, n=_N))
def graph_mean_pool(spark, d):
    return rounded(graph.mean_pool(spark.range(60).withColumnRenamed("id", "graph_id"), _scored(spark, d)[0], ["x"]))


@query("graph_json", "SELECT conv_id AS graph_id, count(*) AS n_nodes, count(*) - 1 AS n_edges FROM conversations GROUP BY conv_id")
def graph_json(spark, d):
    """Graphs written as JSON without edge types, read back, laid out as tables, and counted."""
    t = run(spark, d, fx.TURNS).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("nid", "type"))).alias("r"))
    edges = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x, i: F.array(i, i + 1))
    value = F.to_json(F.struct(F.lit("cfg").alias("view"), F.transform("r", lambda x: x["type"]).alias("node_types"), edges.alias("edges")))
    n, e = tables.graph_tables(t.select("graph_id", tables.graph_from_json(value).alias("graph")))
    n = n.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    e = e.where("etype = 'control_flow'").groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return n.join(e, "graph_id", "left").select("graph_id", "n_nodes", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


def log(spark, d):
    return run(spark, d, fx.LOG)


def enrolled(spark, d):
    """The contracts that SQL enrols, attempted or not, and all others that the log has attempts of."""
    return spark.range(0, 200).withColumnRenamed("id", "cid").union(log(spark, d).select("cid").where("cid IS NOT NULL")).distinct()


def state(spark, d):
    tasks = ledger.enrol(enrolled(spark, d), list(TOOLS))
    return ledger.fold(tasks, log(spark, d))


_TASKS = "SELECT cid, tool FROM (SELECT cid FROM range(200) r(cid) UNION SELECT user_id FROM events WHERE user_id IS NOT NULL), (VALUES ('slither'), ('mythril'), ('securify'), ('osiris')) x(tool)"
_STATE = "SELECT cid, tool, coalesce(st, 'pending') AS status, coalesce(n, 0) AS attempts, sec AS seconds FROM k LEFT JOIN (SELECT cid, tool, count(*) AS n, arg_max(status, struct_pack(a := ts, b := seq)) AS st, arg_max(seconds, struct_pack(a := ts, b := seq)) AS sec FROM g GROUP BY ALL) USING (cid, tool)"


@query("ledger_enrol", with_("SELECT cid, tool, 'pending' AS status, 0::BIGINT AS attempts FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cid = k.cid AND g.tool = k.tool)", k=_TASKS, g=fx.LOG))
def ledger_enrol(spark, d):
    return ledger.enrol(enrolled(spark, d), list(TOOLS), log(spark, d))


@query("ledger_fold", with_("SELECT cid, tool, status, attempts, round(seconds, 6) AS seconds FROM s", k=_TASKS, g=fx.LOG, s=_STATE))
def ledger_fold(spark, d):
    return rounded(state(spark, d).drop("updated_at"))


@query("ledger_claim", with_("SELECT cid, tool, status FROM s WHERE status = 'pending' OR (status IN ('timeout', 'crash', 'no_output') AND attempts < 20)", k=_TASKS, g=fx.LOG, s=_STATE))
def ledger_claim(spark, d):
    return ledger.claim(state(spark, d), 20).select("cid", "tool", "status")


@query("ledger_summary", with_("SELECT coalesce(tool, 'all') AS tool, coalesce(status, 'all') AS status, count(*) AS n, round(avg(CASE WHEN ok THEN seconds END), 6) AS mean_ok_seconds FROM (SELECT *, status = 'ok' AS ok FROM s) GROUP BY GROUPING SETS ((tool, status), (tool), (status), ())", k=_TASKS, g=fx.LOG, s=_STATE))
def ledger_summary(spark, d):
    return ledger.summary(state(spark, d))


@query("ledger_suspicious", with_("SELECT tool, count(*) AS n_ok, round(avg(seconds), 6) AS mean_ok FROM s WHERE status = 'ok' AND tool <> 'slither' GROUP BY tool HAVING count(*) > 20 AND avg(seconds) < 1000", k=_TASKS, g=fx.LOG, s=_STATE))
def ledger_suspicious(spark, d):
    return rounded(ledger.suspicious_tools(state(spark, d), least=20, seconds=1000.0))


@query("ledger_outcomes", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 3 <> 0 THEN 'crash' WHEN event_id % 5 < 2 THEN 'no_output' ELSE 'ok' END AS status FROM events")
def ledger_outcomes(spark, d):
    e, i = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    return e.select("event_id", ledger.outcome(i % 7 == 0, i % 3, ledger.is_fresh(i % 5, F.lit(4))).alias("status"))


@query("ledger_remaining", with_("SELECT cid, tool FROM k WHERE (cid, tool) NOT IN (SELECT cid, tool FROM s WHERE status = 'ok')", k=_TASKS, g=fx.LOG, s=_STATE))
def ledger_remaining(spark, d):
    work = ledger.enrol(enrolled(spark, d), list(TOOLS)).select("cid", "tool")
    return ledger.remaining(work, state(spark, d).where("status = 'ok'"), ["cid", "tool"])


@query("stream_attempts", with_("SELECT tool, status, count(*) AS n, round(sum(seconds), 4) AS seconds FROM g GROUP BY ALL", g=fx.LOG))
def stream_attempts(spark, d):
    """The log as a stream of files, folded to its end."""
    events = attempts.read(spark, d)
    return attempts.to_end(attempts.totals(events)).select("tool", "status", "n", F.round("seconds", 4).alias("seconds"))


@query("tree_nodes")
def tree_nodes(spark, d):
    """Nested JSON of each part as pre-order nodes."""
    part = spark.read.parquet(f"{d}/part.parquet")
    leaf = lambda c, v: F.struct(F.lit(c).alias("nodeType"), v.alias("src"))
    doc = F.struct(F.lit("Part").alias("nodeType"), F.lit("0:9:0").alias("src"), leaf("Brand", F.col("p_brand")).alias("brand"), F.array(leaf("Name", F.col("p_name")), leaf("Type", F.col("p_type"))).alias("children"))
    return trees.flatten(part.select(F.col("p_partkey").alias("graph_id"), F.to_json(doc).alias("ast")))


@query("ml_votes_model")
def ml_votes_model(spark, d):
    """Class probabilities from the votes, a logistic regression a class."""
    v = corpus.vote_features(spark, d).withColumn("features", F.split("features", ",").cast("array<double>"))
    wide = run(spark, d, fx.WIDE).withColumnRenamed("contract_id", "contract")
    train = v.join(wide, "contract")
    return models.votes_model(train, train, list(CLASSES))


@query("ml_pca")
def ml_pca(spark, d):
    """Vectors reduced to 8 centred principal components."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return models.pca(e.where("vec_id % 10 <> 0"), e, "embedding", 8).select("vec_id", "reduced")


@query("ml_label_model")
def ml_label_model(spark, d):
    """Posteriors of the tools' votes by estimated accuracies."""
    return models.label_model(corpus.all_votes(spark, d))[0]


@query("ml_wire")
def ml_wire(spark, d):
    """Predictions as wire structs."""
    p = run(spark, d, fx.NODES).where("branch = 'ast'").select(F.col("contract").alias("source"), F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("nid") % 5 + 1).cast("int")).alias("type"), (F.abs("score") / 30).alias("confidence"), F.array("line").alias("lines"), F.lit(0.3).alias("threshold"))
    return tables.wire_result(p)


