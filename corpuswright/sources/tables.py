"""Manifests, labels, reports, caches, predictions, graphs and configurations."""

from __future__ import annotations

import contextlib
import json
import os
import platform
from importlib import metadata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLASSES, MANIFEST_COLUMNS

MANIFEST = "contract_id string, path string, chash string, " + ", ".join(f"{c} int" for c in CLASSES)
GRAPH = "view string, node_types array<string>, snippets array<string>, depths array<int>, n_children array<int>, edges array<array<int>>, node_lines map<string,array<int>>, edge_types array<string>, degraded boolean"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True)


def write_manifest(rows: DataFrame, path: str, force: bool = False) -> None:
    """A CSV table of the manifest's columns, its files in the order of ids; an existing one stands unless forced."""
    rows.select(*MANIFEST_COLUMNS).orderBy("contract_id").write.mode("overwrite" if force else "errorifexists").csv(path, header=True)


def write_labels(labels: DataFrame, path: str) -> None:
    """Wide labels as bytes."""
    labels.select("contract", *[F.col(c).cast("tinyint").alias(c) for c in CLASSES]).write.mode("overwrite").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def report(df: DataFrame, most: int = 100_000) -> DataFrame:
    """(json): the rows as one JSON array, by their text. More than `most` rows raise: they would meet in one task."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are no report; at most {most}")
    return df.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns)))), ","), F.lit("]")).alias("json"))


def write_curve(history: DataFrame, path: str) -> None:
    """Training curves as a CSV table, columns by name."""
    history.select(*sorted(history.columns)).write.mode("overwrite").csv(path, header=True)


def cache_misses(needed: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose hash the cache lacks, one a hash: the work left to do."""
    return needed.dropDuplicates(["chash"]).join(cache.select("chash"), "chash", "left_anti")


def append_cache(rows: DataFrame, path: str) -> None:
    """Adds results by hash; the committer makes them appear whole or not at all."""
    rows.write.mode("append").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Encoded records, a folder a split, so that readers prune."""
    records.write.mode("overwrite").partitionBy("split").parquet(path)


def read_predictions(spark: SparkSession, path: str, ids: DataFrame, classes: list[str]) -> DataFrame:
    """Probabilities for exactly the given ids, from a CSV with an id column contract_id, id or contract.

    The last row of an id holds, other ids drop; a missing id or a value that is no
    number raises when the result is used.
    """
    raw = spark.read.csv(path, header=True)
    return align_predictions(raw.withColumn("_pos", F.monotonically_increasing_id()), ids, classes)


def align_predictions(raw: DataFrame, ids: DataFrame, classes: list[str]) -> DataFrame:
    """read_predictions of rows with their position _pos."""
    key = next((c for c in ("contract_id", "id", "contract") if c in raw.columns), None)
    if key is None:
        raise ValueError("predictions have no id column")
    last = raw.groupBy(F.col(key).alias("contract_id")).agg(F.max_by(F.struct(*classes), "_pos").alias("p"))
    rows = ids.select("contract_id").join(last, "contract_id", "left")
    number = lambda c: F.when(F.col("p").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), "contract_id")).cast("double")).otherwise(F.col(f"p.{c}").cast("double"))
    return rows.select("contract_id", *[number(c).alias(c) for c in classes])


def graph_from_json(value: Column) -> Column:
    """A graph struct from JSON: integer node keys, missing edge types all control flow, missing flag false."""
    g = F.from_json(value, GRAPH)
    types = F.when(F.size(g["edge_types"]) == F.size(g["edges"]), g["edge_types"]).otherwise(F.transform(g["edges"], lambda _: F.lit("control_flow")))
    lines = F.transform_keys(g["node_lines"], lambda k, _: k.cast("int"))
    return F.struct(*[g[c].alias(c) for c in ("view", "node_types", "snippets", "depths", "n_children", "edges")], lines.alias("node_lines"), types.alias("edge_types"), F.coalesce(g["degraded"], F.lit(False)).alias("degraded"))


def graph_to_json(graph: Column) -> Column:
    return F.to_json(graph)


def graph_tables(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (graph_id, graph)."""
    n = graphs.select("graph_id", "graph", F.posexplode("graph.node_types").alias("nid", "type"))
    at = lambda c: F.get(F.col(f"graph.{c}"), F.col("nid"))
    lines = F.coalesce(F.try_element_at("graph.node_lines", F.col("nid")), F.array().cast("array<int>"))
    nodes = n.select("graph_id", "nid", "type", at("snippets").alias("snippet"), at("depths").alias("depth"), at("n_children").alias("n_children"), lines.alias("lines"))
    e = graphs.select("graph_id", F.posexplode(F.arrays_zip("graph.edges", "graph.edge_types")).alias("eidx", "e"))
    return nodes, e.select("graph_id", "eidx", F.col("e.edges")[0].alias("src"), F.col("e.edges")[1].alias("dst"), F.col("e.edge_types").alias("etype"))


def wire_result(predictions: DataFrame) -> DataFrame:
    """(source, flaws array) from (source, type, confidence, lines, threshold): flaws at or above their thresholds.

    An unknown type, a confidence outside 0 to 1 or a line below 1 raises.
    """
    bad = ~F.col("type").isin(*CLASSES) | ~F.col("confidence").between(0, 1) | F.exists("lines", lambda x: x < 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad flaw of "), "source")).cast("double")).otherwise(F.round("confidence", 4))
    flaw = F.when(F.col("confidence") >= F.col("threshold"), F.struct("type", checked.alias("confidence"), F.array_distinct("lines").alias("lines")))
    rows = predictions.withColumn("confidence", F.when(bad, F.raise_error(F.lit("bad flaw")).cast("double")).otherwise(F.col("confidence")))
    return rows.groupBy("source").agg(F.array_sort(F.collect_list(flaw)).alias("flaws"))


def load_config(path: str, spark: SparkSession | None = None) -> dict:
    """A configuration file (JSON, or YAML if a parser is there), over the one it extends.

    The driver opens the path; with a session Spark reads it, from any store it reaches.
    """
    if spark is None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        text = spark.read.text(path, wholetext=True).first().value
    try:
        own = json.loads(text)
    except ValueError:
        own = _yaml(text)
    parent = own.pop("extends", None)
    return (load_config(os.path.join(os.path.dirname(path), parent), spark) if parent else {}) | own


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError:  # flat files of `key: value` lines need no parser
        rows = [line.split("#")[0].strip() for line in text.splitlines()]
        pairs = [r.split(":", 1) for r in rows if ":" in r]
        return {k.strip(): _scalar(v.strip()) for k, v in pairs}
    return yaml.safe_load(text) or {}


def _scalar(v: str):
    try:
        return json.loads(v)
    except ValueError:
        return v.strip("'\"")


def history_rows(value: Column) -> Column:
    """Rows of a training history given as a list of records or as a record of lists."""
    record = "array<struct<epoch:int,train_loss:double,val_macro_f1:double>>"
    lists = F.from_json(value, "epoch array<int>, train_loss array<double>, val_macro_f1 array<double>")
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, record)).otherwise(F.arrays_zip(lists["epoch"], lists["train_loss"], lists["val_macro_f1"]).cast(record))


def provenance(spark: SparkSession, packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> list[tuple[str, str]]:
    """(package, version) of what makes a result; packages that aren't there are left out."""
    found = [("python", platform.python_version()), ("spark", spark.version)]
    for p in packages:
        with contextlib.suppress(metadata.PackageNotFoundError):
            found.append((p, metadata.version(p)))
    return found
