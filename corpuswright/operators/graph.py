"""Property graphs as node and edge tables: degrees, def-use edges, message passing, pooling.

nodes: (graph_id, nid, ...); edges: (graph_id, src, dst, etype). Edges are a bag.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL, DATA = "control_flow", "data_flow"


def typed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("etype", F.coalesce("etype", F.lit(CONTROL)))


def without_data_flow(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("etype") != DATA)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, nid, in_degree, out_degree): parallel edges count, lone nodes have 0.

    One aggregation of both ends: a hub's edges are counted before they move.
    """
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("nid"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("nid"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    d = ends.groupBy("graph_id", "x.nid").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    return nodes.select("graph_id", "nid").join(d, ["graph_id", "nid"], "left").select("graph_id", "nid", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges, n_data_flow)."""
    e = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("etype") == DATA).alias("n_data_flow"))
    zero = F.lit(0).cast("long")
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(e, "graph_id", "left")
    return n.select("graph_id", "n_nodes", F.coalesce("n_edges", zero).alias("n_edges"), F.coalesce("n_data_flow", zero).alias("n_data_flow"))


def data_flow_edges(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """(graph_id, src, dst), distinct: from each write of a variable to each later read of it in the same function.

    writes, reads: (graph_id, fn, var, nid). The output is the relation itself: all
    earlier writers count.
    """
    w = writes.select("graph_id", "fn", "var", F.col("nid").alias("src")).distinct()
    r = reads.select("graph_id", "fn", "var", F.col("nid").alias("dst")).distinct()
    return w.join(r, ["graph_id", "fn", "var"]).where("src < dst").select("graph_id", "src", "dst").distinct()


def flow_graph(records: DataFrame, data_flow: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from (graph_id, nid, type, snippet, lines, sons, reads, writes, fn): the bag of both kinds of edges."""
    empty = F.array().cast("array<int>")
    nodes = records.select("graph_id", "nid", F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.lit(0).alias("depth"), F.coalesce(F.size("sons"), F.lit(0)).alias("n_children"), F.coalesce("lines", empty).alias("lines"))
    edges = records.select("graph_id", F.col("nid").alias("src"), F.explode("sons").alias("dst")).withColumn("etype", F.lit(CONTROL))
    if data_flow:
        var = lambda c: records.select("graph_id", "fn", "nid", F.explode(c).alias("var"))
        edges = edges.unionByName(data_flow_edges(var("writes"), var("reads")).withColumn("etype", F.lit(DATA)))
    return nodes, edges


def fallback_nodes(failed: DataFrame) -> DataFrame:
    """The placeholder node of a graph that could not be had: (graph_id, source) to one degraded entry node."""
    return failed.select("graph_id", F.lit(0).alias("nid"), F.lit("ENTRY_POINT").alias("type"), F.substring("source", 1, 2000).alias("snippet"), F.lit(0).alias("depth"), F.lit(0).alias("n_children"), F.array(F.lit(1)).alias("lines"), F.lit(True).alias("degraded"))


def extraction_outcome(ast_ok: Column, cfg_ok: Column, retry_ok: Column, fallback: bool = True) -> Column:
    """full, degraded (without data flow), placeholder, or failed."""
    return F.when(~ast_ok, "failed").when(cfg_ok, "full").when(retry_ok, "degraded").otherwise("placeholder" if fallback else "failed")


def fit_vocabulary(nodes: DataFrame) -> list[str]:
    """Sorted distinct node types: fit on the training split only. A row a type reaches the driver."""
    return [r.type for r in nodes.select("type").where("type IS NOT NULL").distinct().orderBy("type").collect()]


def config_json(vocabulary: list[str], embed_dim: int = 64, structural: tuple[str, ...] = ("depth", "n_children", "in_degree", "out_degree")) -> str:
    """A feature configuration as JSON."""
    return json.dumps({"node_types": vocabulary, "embed_dim": embed_dim, "structural": list(structural)})


def config_from_json(text: str) -> tuple[list[str], int, tuple[str, ...], int]:
    """(vocabulary, embed_dim, structural, width of a node's vector) of a configuration; a missing width of embeddings is 64."""
    d = json.loads(text)
    structural = tuple(d.get("structural", ("depth", "n_children", "in_degree", "out_degree")))
    dim = int(d.get("embed_dim", 64))
    return list(d["node_types"]), dim, structural, len(d["node_types"]) + len(structural) + dim


def encode_nodes(nodes: DataFrame, node_degrees: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(graph_id, nid, features, unknown): one-hot type (unknown: zeros), depth, children, in and out degree."""
    rows = nodes.join(node_degrees, ["graph_id", "nid"])
    one_hot = F.transform(F.array(*map(F.lit, vocabulary)), lambda t: (t == F.col("type")).cast("double"))
    rest = F.array(*[F.col(c).cast("double") for c in ("depth", "n_children", "in_degree", "out_degree")])
    return rows.select("graph_id", "nid", F.concat(one_hot, rest).alias("features"), (~F.col("type").isin(vocabulary)).alias("unknown"))


def mean_neighbours(nodes: DataFrame, edges: DataFrame, col: str = "x") -> DataFrame:
    """(graph_id, nid, mean): mean of a scalar over the sources of a node's incoming edges, 0 for none."""
    gathered = edges.join(nodes.select("graph_id", F.col("nid").alias("src"), col), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("nid")).agg(F.avg(col).alias("mean"))
    return nodes.select("graph_id", "nid").join(gathered, ["graph_id", "nid"], "left").select("graph_id", "nid", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def gcn_aggregate(nodes: DataFrame, edges: DataFrame, col: str = "x") -> DataFrame:
    """(graph_id, nid, value): sum over incoming edges and a self-loop of x / sqrt(degree x degree)."""
    loops = nodes.select("graph_id", F.col("nid").alias("src"), F.col("nid").alias("dst"))
    every = edges.select("graph_id", "src", "dst").unionByName(loops)
    deg = every.groupBy("graph_id", F.col("dst").alias("nid")).agg(F.count("*").alias("deg"))
    own = nodes.select("graph_id", "nid", col).join(deg, ["graph_id", "nid"])
    weighed = own.select("graph_id", F.col("nid").alias("src"), (F.col(col) / F.sqrt("deg")).alias("w"))
    total = every.join(weighed, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("nid")).agg(F.sum("w").alias("s"))
    return own.join(total, ["graph_id", "nid"]).select("graph_id", "nid", (F.col("s") / F.sqrt("deg")).alias("value"))


def attention_weights(scored_edges: DataFrame) -> DataFrame:
    """scored_edges with alpha: softmax of e over the edges that share a destination."""
    ends = ["graph_id", "dst"]
    tops = scored_edges.groupBy(*ends).agg(F.max("e").alias("_top"))
    shifted = scored_edges.join(tops, ends).withColumn("_x", F.exp(F.col("e") - F.col("_top"))).drop("_top")
    return shifted.join(shifted.groupBy(*ends).agg(F.sum("_x").alias("_all")), ends).withColumn("alpha", F.col("_x") / F.col("_all")).drop("_x", "_all")


def hybrid(nodes: DataFrame, edges: DataFrame, layers: int = 2, col: str = "x") -> DataFrame:
    """(graph_id, nid, value): layers - 1 steps of mean neighbours, each added to the node's own value, then one of attention.

    The attention scores an edge by the sum of its ends' values.
    """
    state = nodes.select("graph_id", "nid", F.col(col).alias("x"))
    for _ in range(layers - 1):
        state = state.join(mean_neighbours(state, edges), ["graph_id", "nid"]).select("graph_id", "nid", (F.col("x") + F.col("mean")).alias("x"))
    end = lambda name: state.select("graph_id", F.col("nid").alias(name), F.col("x").alias(f"x_{name}"))
    scored = edges.select("graph_id", "src", "dst").join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]).withColumn("e", F.col("x_src") + F.col("x_dst"))
    got = attention_weights(scored).groupBy("graph_id", F.col("dst").alias("nid")).agg(F.sum(F.col("alpha") * F.col("x_src")).alias("value"))
    return state.select("graph_id", "nid").join(got, ["graph_id", "nid"], "left").select("graph_id", "nid", F.coalesce("value", F.lit(0.0)).alias("value"))


def mean_pool(graphs: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """A row a graph with its nodes' means; an empty graph has zeros."""
    pooled = nodes.groupBy("graph_id").agg(*[F.avg(c).alias(c) for c in cols])
    return graphs.select("graph_id").join(pooled, "graph_id", "left").na.fill(0.0, cols)


def dual_head(ast: DataFrame, cfg: DataFrame, w1: list[list[float]], b1: list[float], w2: list[list[float]], b2: list[float], classes: list[str]) -> DataFrame:
    """(graph_id, class, prob): both views' pooled vectors side by side, a layer with a ramp, and a sigmoid a class.

    ast, cfg: (graph_id, v array). A graph that lacks a view has zeros there. w1 has a row
    a hidden unit, w2 a row a class.
    """
    half = len(w1[0]) // 2
    zeros = F.array(*[F.lit(0.0)] * half)
    rows = ast.select("graph_id", F.col("v").alias("a")).join(cfg.select("graph_id", F.col("v").alias("c")), "graph_id", "full")
    dot = lambda x, row, b: F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda p, q: p * q), F.lit(b), lambda s, p: s + p)
    rows = rows.select("graph_id", F.concat(F.coalesce("a", zeros), F.coalesce("c", zeros)).alias("x"))
    hidden = F.array(*[F.greatest(dot(F.col("x"), row, b), F.lit(0.0)) for row, b in zip(w1, b1, strict=True)])
    rows = rows.select("graph_id", hidden.alias("h"))
    probs = [F.struct(F.lit(c).alias("class"), (1 / (1 + F.exp(-dot(F.col("h"), row, b)))).alias("prob")) for c, row, b in zip(classes, w2, b2, strict=True)]
    return rows.select("graph_id", F.explode(F.array(*probs)).alias("x")).select("graph_id", "x.*")
