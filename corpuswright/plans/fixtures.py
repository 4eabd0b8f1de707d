"""Inputs of the registered queries: portable SQL over the tables, run by Spark here and by the oracle there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLASSES, TOOLS

CONTRACTS = """
SELECT concat('c', CAST(doc_id AS STRING)) AS contract_id, concat('dir', CAST(doc_id % 7 AS STRING), '/c', CAST(doc_id AS STRING), '.sol') AS path,
  concat(CASE doc_id % 5 WHEN 0 THEN 'pragma solidity ^0.4.24;' WHEN 1 THEN 'pragma solidity =0.4.25;' WHEN 2 THEN 'pragma solidity >=0.5.0 <0.6.0;' WHEN 3 THEN 'pragma solidity 0.8.19;' ELSE '' END,
    chr(10), '// ', source, chr(10), '/* ', lang, ' */ ',
    CASE doc_id % 6 WHEN 0 THEN 'x.call.value(1)("");' WHEN 1 THEN 'for (i; i < n; i++) a.transfer(1);' WHEN 2 THEN 'selfdestruct(o); s = "// kept";' WHEN 3 THEN 'require(a.send(1)); n += 2;' ELSE 'nop' END,
    chr(10), coalesce(text, '')) AS source, lang, doc_id
FROM {documents}"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = r"\{(" + "|".join(TABLES) + r")\}"
_TOOL_ROWS = ", ".join(f"('{t}', {i})" for i, t in enumerate(TOOLS))
_CLASS_ROWS = ", ".join(f"('{c}', {i})" for i, c in enumerate(CLASSES))
#: Four tools' findings on each document: a row a tool and class.
RUNS = f"""
SELECT concat('c', CAST(doc_id AS STRING)) AS contract, t.tool AS tool, f.flaw AS flaw,
  CASE WHEN (doc_id + t.i) % 6 <> 0 THEN 1 ELSE 0 END AS ran,
  CASE WHEN (doc_id * 31 + t.i * 17 + f.i * 7) % 10 < 3 OR (t.i = 1 AND text LIKE '%!!%') THEN 1 ELSE 0 END AS fired
FROM {{documents}} CROSS JOIN (VALUES {_TOOL_ROWS}) AS t(tool, i) CROSS JOIN (VALUES {_CLASS_ROWS}) AS f(flaw, i)"""
#: Dense votes by the rules, in plain SQL, for oracles.
VOTES = f"""
SELECT contract, tool, flaw, CASE WHEN ran = 0 OR (tool = 'osiris') <> (flaw = 'arithmetic') THEN -1 WHEN fired = 1 THEN 1 ELSE 0 END AS vote FROM ({RUNS}) r"""
#: Wide 0/1 labels of each document.
WIDE = """
SELECT concat('c', CAST(doc_id AS STRING)) AS contract_id, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS reentrancy, CASE WHEN doc_id % 14 < 2 THEN 1 ELSE 0 END AS access_control,
  CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS arithmetic, CASE WHEN doc_id % 11 = 3 THEN 1 ELSE 0 END AS unchecked_calls, CASE WHEN doc_id % 31 = 4 THEN 1 ELSE 0 END AS dos
FROM {documents}"""
#: Truth of two classes and three models' probabilities.
PROBS = """
SELECT m.model AS model, CAST(l.doc_id AS STRING) AS contract, c.class AS class, CASE WHEN c.i = 0 THEN l.quality ELSE l.toxic END AS y_true,
  CAST((l.doc_id * 7919 + c.i * 131 + m.i * 577) % 997 AS DOUBLE) / 1500 + CASE WHEN (c.i = 0 AND l.quality = 1) OR (c.i = 1 AND l.toxic = 1) THEN 0.25E0 ELSE 0E0 END AS prob
FROM {labels} l CROSS JOIN (VALUES ('quality', 0), ('toxic', 1)) AS c(class, i) CROSS JOIN (VALUES ('gcn', 0), ('gcn_df', 1), ('sage', 2)) AS m(model, i)"""
#: Ten classes: the label of each vector against a guess that is often right.
TEN = """
SELECT CAST(vec_id AS STRING) AS contract, concat('k', CAST(c.k AS STRING)) AS class, CASE WHEN label = c.k THEN 1 ELSE 0 END AS y_true, CASE WHEN (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 10 = c.k THEN 1 ELSE 0 END AS y_pred
FROM {embeddings} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS c(k)"""
#: Scored lines of two branches of each document.
NODES = """
SELECT CAST(doc_id AS STRING) AS contract, b.branch AS branch, n.nid AS nid, CAST((doc_id * 13 + n.nid * 7 + b.i * 5) % 23 AS DOUBLE) - 2 AS score, CAST((doc_id + n.nid * 3 + b.i) % 12 + 1 AS INT) AS line
FROM {documents} CROSS JOIN (VALUES ('ast', 0), ('cfg', 1)) AS b(branch, i) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS n(nid)"""
#: Lines that truly matter, none for some.
GOLD = """
SELECT CAST(doc_id AS STRING) AS contract, CAST((doc_id * 5 + g.i * 4) % 12 + 1 AS INT) AS line FROM {documents} CROSS JOIN (VALUES (0), (1)) AS g(i) WHERE doc_id % 4 <> 3"""
#: Conversations as flow graphs: a turn leads to the next.
TURNS = "SELECT conv_id AS graph_id, CAST(turn AS INT) AS nid, role AS type, text FROM {conversations}"
#: Orders, parts and suppliers as a graph.
ORDER_EDGES = """
SELECT CAST(l_orderkey % 50 AS BIGINT) AS graph_id, concat('o', CAST(l_orderkey AS STRING)) AS src, concat('p', CAST(l_partkey AS STRING)) AS dst, CASE WHEN l_returnflag = 'R' THEN 'data_flow' ELSE 'control_flow' END AS etype FROM {lineitem}"""
#: Attempts of tasks.
LOG = """
SELECT user_id AS cid, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'slither' WHEN 1 THEN 'mythril' WHEN 2 THEN 'securify' ELSE 'osiris' END AS tool,
  CASE CAST((event_id * 7 + user_id) % 5 AS INT) WHEN 0 THEN 'timeout' WHEN 1 THEN 'crash' WHEN 2 THEN 'no_output' ELSE 'ok' END AS status, abs(value) AS seconds, ts, event_id AS seq FROM {events}"""


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture as a DataFrame."""
    names = set(re.findall(_NAME, sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(sql: str) -> str:
    """A fixture as SQL text over the registered views."""
    return re.sub(_NAME, r"\1", sql)


def with_(body: str, **fixtures: str) -> str:
    """An oracle: fixtures as named subqueries, then the body."""
    return "WITH " + ", ".join(f"{k} AS ({plain(v)})" for k, v in fixtures.items()) + " " + body


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract, tool, flaws) of RUNS: a row a run."""
    runs = run(spark, sf_dir, RUNS).where("ran = 1")
    fired = F.array_sort(F.collect_list(F.when(F.col("fired") == 1, F.col("flaw"))))
    return runs.groupBy("contract", "tool").agg(fired.alias("flaws"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """df with its doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
