"""Queries on readers and sinks, which write their input to the shared folder and read it back, and on the smaller operators."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract, graph, ledger, locate, metrics, models, reports, sampling, votes
from ..schema import CATEGORIES, CLASSES, DISPLAY_NAMES, coverage, display_name
from ..sources import files, tables
from ..storage import shared_folder
from ..streaming import attempts
from . import corpus, evaluation, structure
from . import fixtures as fx
from .fixtures import rounded, run, with_

QUERIES: dict[str, tuple] = {}
_C = list(CLASSES)


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return add


#: A line of text for each document, dealt to 40 files.
_LINES = "SELECT CAST(doc_id % 40 AS INT) AS folder, doc_id, concat(CAST(doc_id AS STRING), ' ', lang, ' ', source, ' ', CAST(n_chars AS STRING), chr(13)) AS line FROM {documents}"


def _line_files(spark, d):
    root = f"{shared_folder(spark)}/lines"
    rows = run(spark, d, _LINES).repartition("folder").sortWithinPartitions("folder", "doc_id")
    rows.select("folder", F.col("line").alias("value")).write.partitionBy("folder").text(root)
    return root


def _folder():
    return F.regexp_extract("path", r"folder=(\d+)", 1).cast("int").alias("folder")


@query("files_scan", with_("SELECT folder, sum(strlen(line) + 1)::BIGINT AS size FROM l GROUP BY folder", l=_LINES))
def files_scan(spark, d):
    """All files below a folder, with their sizes."""
    return files.scan(spark, _line_files(spark, d), "*.txt").select(_folder(), F.octet_length("content").cast("long").alias("size"))


@query("files_read", with_("SELECT folder, sha256(replace(string_agg(line, chr(10) ORDER BY doc_id) || chr(10), chr(13) || chr(10), chr(10))) AS digest FROM l GROUP BY folder", l=_LINES))
def files_read(spark, d):
    """Files as text with plain line ends."""
    return files.read_sources(spark, _line_files(spark, d), "*.txt").select(_folder(), F.sha2("source", 256).alias("digest"))


_CATEGORY = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " ELSE 'other' END"
#: Annotation records: flat ones, and nested ones of which one entry is out of scope.
_RECORDS = f"SELECT doc_id AS pos, concat('x/s', CAST(doc_id % 40 AS STRING), '.sol') AS name, concat(upper(substring({_CATEGORY}, 1, 1)), substring({_CATEGORY}, 2, 40)) AS category, CAST(doc_id % 30 + 1 AS INT) AS a, CAST(n_chars % 50 + 1 AS INT) AS b, doc_id % 4 = 0 AS nested FROM {{documents}}"
_GOLD = "SELECT stem, CASE WHEN nested THEN list_sort(list_distinct([1, b])) WHEN lower(category) = 'other' THEN [] ELSE list_sort(list_distinct([a, b])) END AS lines FROM (SELECT regexp_extract(name, 's[0-9]+') AS stem, * FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos DESC) = 1)"


def _gold(spark, d):
    entry = lambda c, *lines: F.struct(c.alias("category"), F.array(*lines).alias("lines"))
    r = run(spark, d, _RECORDS)
    nested = F.when(F.col("nested"), F.array(entry(F.lit("reentrancy"), F.lit(1), F.col("b")), entry(F.lit("time_manipulation"), F.lit(99), F.lit(98))))
    return files.parse_annotations(r.select("pos", "name", "category", F.array("a", "b").alias("lines"), nested.alias("vulnerabilities")))


@query("annotations_parse", with_("SELECT stem, array_to_string(lines, ',') AS lines FROM g", r=_RECORDS, g=_GOLD))
def annotations_parse(spark, d):
    return _gold(spark, d).select("stem", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


#: Labelled folders: three files a stem, of which two are equal.
_FILES = f"""SELECT concat('s', CAST(CAST(floor(a.doc_id / 3) AS INT) AS STRING)) AS contract_id, a.path AS path, b.text AS source
FROM (SELECT doc_id, concat('dataset/', {_CATEGORY}, '/s', CAST(CAST(floor(doc_id / 3) AS INT) AS STRING), '.sol') AS path, doc_id - CASE WHEN doc_id % 3 < 2 THEN doc_id % 3 ELSE 0 END AS other FROM {{documents}}) a
JOIN {{documents}} b ON a.other = b.doc_id"""
_MERGED = "SELECT contract_id AS stem, chash, min(path) AS path, " + ", ".join(f"max(CASE WHEN split_part(path, '/', 2) = '{k}' THEN 1 ELSE 0 END) AS {c}" for k, c in CATEGORIES.items()) + f" FROM (SELECT *, {corpus._HASH} AS chash FROM f) GROUP BY ALL"
_CURATED = f"SELECT CASE WHEN n = 1 THEN stem ELSE stem || '__' || split_part(path, '/', 2) END AS contract_id, path, chash, {', '.join(_C)}, array_to_string(coalesce(g.lines, []), ',') AS lines FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS n FROM m) LEFT JOIN g USING (stem)"


def _curated(spark, d):
    return files.curated(run(spark, d, _FILES), _gold(spark, d))


@query("files_curated", with_(f"SELECT contract_id, path, chash, array_to_string([{', '.join(_C)}], ',') AS y, lines FROM u", f=_FILES, r=_RECORDS, g=_GOLD, m=_MERGED, u=_CURATED))
def files_curated(spark, d):
    """Labelled folders merged by name and content, with their gold lines."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _curated(spark, d).select("contract_id", "path", "chash", text("y"), text("lines"))


@query("expert_set", with_(f"SELECT contract_id, path, chash, {', '.join(_C)} FROM u", f=_FILES, r=_RECORDS, g=_GOLD, m=_MERGED, u=_CURATED))
def expert_set(spark, d):
    return sampling.select_experts(_curated(spark, d), _C)[0]


@query("expert_report", with_(" UNION ALL ".join(f"SELECT count(*) AS contracts, '{c}' AS class, sum({c})::BIGINT AS positives FROM u" for c in _C), f=_FILES, r=_RECORDS, g=_GOLD, m=_MERGED, u=_CURATED))
def expert_report(spark, d):
    return sampling.select_experts(_curated(spark, d), _C)[1]


@query("legacy_results", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '.sol' WHEN 1 THEN source ELSE 'c' || doc_id END AS contract, CASE doc_id % 3 WHEN 0 THEN lower(source) WHEN 1 THEN lower(lang) ELSE '' END AS tool, CASE doc_id % 3 WHEN 0 THEN lang || '|' || source || '|plain' WHEN 1 THEN source ELSE '' END AS idents FROM documents")
def legacy_results(spark, d):
    """Older result files: other field names, empty fields, findings of several kinds."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lang, source = q(F.col("lang")), q(F.col("source"))
    first = F.concat(F.lit('{"contract": "'), F.col("lang"), F.lit('.sol", "tool": '), F.upper(source), F.lit(', "findings": [{"check": '), lang, F.lit('}, {"check": "", "name": '), source, F.lit('}, "plain"]}'))
    second = F.concat(F.lit('{"contract": "", "filename": '), source, F.lit(', "analysis": '), F.upper(lang), F.lit(', "errors": ['), source, F.lit("]}"))
    value = F.when(F.col("doc_id") % 3 == 0, first).when(F.col("doc_id") % 3 == 1, second).otherwise("{}")
    rows = docs.select("doc_id", F.concat(F.lit("old/c"), F.col("doc_id"), F.lit(".json")).alias("path"), value.alias("value"))
    parsed = files.parse_legacy_result(rows.select("path", "value", "doc_id"), "doc_id")
    return parsed.select("doc_id", "contract", "tool", F.array_join("idents", "|").alias("idents"))


_MANIFEST = f"SELECT contract_id, concat('data/', contract_id, '.sol') AS path, md5(contract_id) AS chash, {', '.join(_C)} FROM w"


@query("manifest_round_trip", with_(f"SELECT *, true AS refused FROM ({_MANIFEST})", w=fx.WIDE))
def manifest_round_trip(spark, d):
    """A frozen manifest written and read; writing it again is refused."""
    path = f"{shared_folder(spark)}/manifest"
    rows = run(spark, d, fx.WIDE).select("contract_id", F.concat(F.lit("data/"), "contract_id", F.lit(".sol")).alias("path"), F.md5("contract_id").alias("chash"), *_C)
    tables.write_manifest(rows, path)
    try:
        tables.write_manifest(rows, path)
        refused = False
    except AnalysisException:
        refused = True
    tables.write_manifest(rows, path, force=True)
    return tables.read_manifest(spark, path).withColumn("refused", F.lit(refused))


@query("labels_round_trip", with_(f"SELECT contract_id AS contract, {', '.join(_C)} FROM w", w=fx.WIDE))
def labels_round_trip(spark, d):
    path = f"{shared_folder(spark)}/labels"
    tables.write_labels(run(spark, d, fx.WIDE).withColumnRenamed("contract_id", "contract"), path)
    return tables.read_labels(spark, path).select("contract", *[F.col(c).cast("int") for c in _C])


@query("report_json", with_("""SELECT '[' || string_agg('{"flaw":"' || flaw || '","positives":' || n || '}', ',' ORDER BY flaw) || ']' AS json FROM (SELECT flaw, sum(label)::BIGINT AS n FROM l GROUP BY flaw)""", v=fx.VOTES, l=corpus._LABELS))
def report_json(spark, d):
    """A small table as one JSON array."""
    return tables.report(corpus.label_frequency(spark, d).select("flaw", "positives"))


@query("records_round_trip", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 13 = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def records_round_trip(spark, d):
    """Encoded records written by split and read back."""
    path = f"{shared_folder(spark)}/records"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 13 == 1, "val").otherwise("train")
    tables.write_records(docs.select("doc_id", "n_chars", split.alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


@query("predictions_aligned", "SELECT CAST(doc_id AS VARCHAR) AS contract_id, round(n_chars / 7.0, 6)::DOUBLE AS quality, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS toxic FROM documents WHERE doc_id % 3 = 0")
def predictions_aligned(spark, d):
    """Probabilities from a CSV file, for exactly the ids asked for; the last row of an id holds."""
    path = f"{shared_folder(spark)}/predictions"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = docs.select(F.col("doc_id").cast("string").alias("id"), F.round(F.col("n_chars") / 7, 6).alias("quality"), F.lit(0.25).alias("toxic"), F.lit(0).alias("_pos"))
    again = first.where("CAST(id AS BIGINT) % 2 = 0").withColumns({"toxic": F.lit(0.5), "_pos": F.lit(1)})
    first.unionByName(again).write.csv(path, header=True)
    raw = spark.read.csv(path, header=True).withColumn("_pos", F.col("_pos").cast("int"))
    ids = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("contract_id"))
    return tables.align_predictions(raw, ids, ["quality", "toxic"])


@query("config_inherited", "SELECT k, CAST(v AS VARCHAR) AS v FROM (SELECT 'batch' AS k, 32 AS v UNION ALL SELECT 'hidden', (SELECT count(*) FROM documents) UNION ALL SELECT 'epochs', (SELECT count(*) FROM labels))")
def config_inherited(spark, d):
    """A configuration over the one that it extends, read by Spark."""
    folder = shared_folder(spark)
    n = {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("documents", "labels")}
    for name, value in (("base", {"batch": 32, "hidden": 1, "epochs": n["labels"]}), ("own", {"extends": "base", "hidden": n["documents"]})):
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return spark.createDataFrame([(k, str(v)) for k, v in tables.load_config(f"{folder}/own", spark).items()], "k string, v string")


_HISTORY = "SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS epoch, abs(value) AS train_loss, CAST(event_id % 100 AS DOUBLE) / 100 AS val_macro_f1 FROM {events}"


@query("history_rows", with_("SELECT run, epoch, round(train_loss, 6) AS train_loss, val_macro_f1 FROM h", h=_HISTORY))
def history_rows(spark, d):
    """Training histories as JSON of either layout, a row an epoch."""
    each = run(spark, d, _HISTORY).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "val_macro_f1"))).alias("r"))
    lists = F.to_json(F.struct(F.col("r.epoch").alias("epoch"), F.col("r.train_loss").alias("train_loss"), F.col("r.val_macro_f1").alias("val_macro_f1")))
    value = F.when(F.col("run") % 2 == 0, F.to_json("r")).otherwise(lists)
    return rounded(each.select("run", F.explode(tables.history_rows(value)).alias("x")).select("run", "x.*"))


@query("curve_round_trip", with_("SELECT run, epoch, round(train_loss, 6) AS train_loss, val_macro_f1 FROM h", h=_HISTORY))
def curve_round_trip(spark, d):
    path = f"{shared_folder(spark)}/curve"
    tables.write_curve(run(spark, d, _HISTORY), path)
    return rounded(spark.read.schema("epoch int, run long, train_loss double, val_macro_f1 double").csv(path, header=True))


@query("collectable", with_(r"SELECT contract_id, regexp_extract(regexp_extract(source, 'pragma\s+solidity\s+([^;]+);', 1), '(\d+\.\d+)\.\d+', 1) <> '' AS collectable FROM c", c=fx.CONTRACTS))
def collectable(spark, d):
    return corpus.contracts(spark, d).select("contract_id", X.is_collectable(F.col("source")).alias("collectable"))


@query("graph_typed", with_("SELECT graph_id, CASE WHEN etype = 'data_flow' THEN etype ELSE 'control_flow' END AS etype, count(*) AS n FROM e GROUP BY ALL", e=fx.ORDER_EDGES))
def graph_typed(spark, d):
    """Edges added without a type are control flow."""
    e = run(spark, d, fx.ORDER_EDGES).withColumn("etype", F.nullif("etype", F.lit("control_flow")))
    return graph.typed(e).groupBy("graph_id", "etype").agg(F.count("*").alias("n"))


@query("graph_vocabulary", "SELECT (row_number() OVER (ORDER BY type) - 1)::INT AS place, type, (count(*) OVER () + 4 + 64)::INT AS width FROM (SELECT DISTINCT role AS type FROM conversations WHERE conv_id % 2 = 0)")
def graph_vocabulary(spark, d):
    """Node types of the training graphs, through the configuration's JSON, and the width of a node's vector."""
    vocabulary = graph.fit_vocabulary(run(spark, d, fx.TURNS).where("graph_id % 2 = 0"))
    types, _, _, width = graph.config_from_json(graph.config_json(vocabulary))
    return spark.createDataFrame([(i, t, width) for i, t in enumerate(types)], "place int, type string, width int")


@query("graph_fallback", with_("SELECT contract_id AS graph_id, 'ENTRY_POINT' AS type, sha256(substr(source, 1, 2000)) AS snippet, 1::INT AS n_lines, true AS degraded FROM c WHERE doc_id % 9 = 0", c=fx.CONTRACTS))
def graph_fallback(spark, d):
    n = graph.fallback_nodes(corpus.contracts(spark, d).where("doc_id % 9 = 0").withColumnRenamed("contract_id", "graph_id"))
    return n.select("graph_id", "type", F.sha2("snippet", 256).alias("snippet"), F.size("lines").alias("n_lines"), "degraded")


@query("graph_hybrid", with_(
    "SELECT n.graph_id, n.nid, round(coalesce(v, 0), 6) AS value FROM n LEFT JOIN (SELECT graph_id, dst AS nid, sum(exp(z - top) * xs) / sum(exp(z - top)) AS v FROM (SELECT *, max(z) OVER (PARTITION BY graph_id, dst) AS top FROM (SELECT e.graph_id, e.src, e.dst, a.x AS xs, a.x + b.x AS z FROM e JOIN s a ON a.graph_id = e.graph_id AND a.nid = src JOIN s b ON b.graph_id = e.graph_id AND b.nid = dst)) GROUP BY ALL) USING (graph_id, nid)",
    e=fx.ORDER_EDGES, n=structure._N, k="SELECT graph_id, dst AS nid, avg((length(src) * 3 % 7)::DOUBLE) AS m FROM e GROUP BY ALL", s="SELECT n.graph_id, n.nid, (length(n.nid) * 3 % 7)::DOUBLE + coalesce(m, 0) AS x FROM n LEFT JOIN k USING (graph_id, nid)"))
def graph_hybrid(spark, d):
    return rounded(graph.hybrid(*structure._scored(spark, d)))


@query("node_spans", "SELECT doc_id, (length(substr(t, 1, a)) - length(replace(substr(t, 1, a), chr(10), '')) + 1)::INT AS first, (length(substr(t, 1, b)) - length(replace(substr(t, 1, b), chr(10), '')) + 1)::INT AS last FROM (SELECT doc_id, t, doc_id % 300 AS a, doc_id % 300 + greatest(doc_id % 500 - 1, 0) AS b FROM (SELECT doc_id, regexp_replace(text, '[^ -~\\n]', '?', 'g') AS t FROM documents))".replace("\\\\", "\\"))
def node_spans(spark, d):
    """The lines that each node's span of the source covers."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    src = X.parse_span(F.concat_ws(":", (F.col("doc_id") % 300).cast("string"), (F.col("doc_id") % 500).cast("string"), F.lit("0")))
    rows = docs.select("doc_id", F.regexp_replace("text", r"[^ -~\n]", "?").alias("t"), src.alias("s"))
    lines = X.span_lines(F.col("t"), F.col("s.start"), F.col("s.length"))
    return rows.select("doc_id", lines.alias("l")).select("doc_id", F.col("l")[0].alias("first"), F.element_at("l", -1).alias("last"))


@query("locate_unmapped", with_("SELECT contract, coalesce(array_to_string(list(nid ORDER BY rank) FILTER (nid % 2 = 1), ','), '') AS unmapped FROM (SELECT contract, nid, row_number() OVER (PARTITION BY contract ORDER BY score DESC, nid) AS rank FROM n WHERE branch = 'ast' QUALIFY rank <= 4) GROUP BY contract", n=fx.NODES))
def locate_unmapped(spark, d):
    """Top nodes that no line stands for."""
    top = locate.top_nodes(structure.nodes(spark, d).where("branch = 'ast'"), 4)
    top = top.withColumn("lines", F.when(F.col("nid") % 2 == 1, F.array().cast("array<int>")).otherwise(F.col("lines")))
    return locate.nodes_to_lines(top).select("contract", F.array_join(F.col("unmapped").cast("array<string>"), ",").alias("unmapped"))


@query("locate_targets", with_("SELECT contract, count(*) AS n_gold FROM (SELECT DISTINCT contract, line FROM g) WHERE contract IN (SELECT contract FROM n) GROUP BY contract", n=fx.NODES, g=fx.GOLD))
def locate_targets(spark, d):
    """What localisation is measured on: indexed contracts with gold lines."""
    gold = run(spark, d, fx.GOLD).groupBy("contract").agg(F.collect_set("line").alias("lines"))
    indexed = run(spark, d, fx.NODES).select("contract").distinct()
    return locate.targets(indexed, gold).select("contract", F.size("lines").cast("long").alias("n_gold"))


@query("display_names", with_("SELECT CASE flaw " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY_NAMES.items()) + " END AS name, sum(label)::BIGINT AS positives FROM l GROUP BY flaw", v=fx.VOTES, l=corpus._LABELS))
def display_names(spark, d):
    names = F.create_map(*[F.lit(x) for c in CLASSES for x in (c, display_name(c))])
    return corpus.label_frequency(spark, d).select(F.element_at(names, F.col("flaw")).alias("name"), "positives")


@query("extract_time_limit", "SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'TimeoutError' WHEN length(lang) = 2 AND lang < 'f' THEN 'ValueError' END AS error, CASE WHEN doc_id > (SELECT min(doc_id) FROM documents) AND lang >= 'f' THEN upper(lang) END AS result FROM documents")
def extract_time_limit(spark, d):
    """A row's failure or timeout is that row's error."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    first = docs.agg(F.min("doc_id")).first()[0]
    late = docs.withColumn("t", F.when(F.col("doc_id") == first, "sleep").otherwise(F.col("lang")))
    out = extract.extract(late, lambda: _work, "doc_id", "t", seconds=1)
    return out.select("doc_id", F.get(F.split("error", ":"), F.lit(0)).alias("error"), "result")


def _work(text: str) -> str:
    if text == "sleep":
        import time

        time.sleep(30)
    if text < "f":
        raise ValueError(text)
    return text.upper()


@query("results_paths", "SELECT doc_id, 'results/' || source || '/run1/c' || doc_id || '.sol/result.json' AS path FROM documents")
def results_paths(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", files.results_path(F.lit("results"), F.col("source"), F.lit("run1"), F.concat(F.lit("c"), F.col("doc_id"), F.lit(".sol")), F.lit("result.json")).alias("path"))


@query("report_lookup", with_("SELECT k.model, (SELECT round(value, 6) FROM f WHERE f.model = k.model AND split = 'test_a' AND metric = 'macro_f1' AND seed = 1) AS value FROM (VALUES ('gcn'), ('sage'), ('nothing')) k(model)", f=evaluation._FACTS))
def report_lookup(spark, d):
    """Single values of the facts; null where there is none."""
    f = run(spark, d, evaluation._FACTS).where("seed = 1")
    return rounded(spark.createDataFrame([(m, reports.lookup(f, m, "test_a")) for m in ("gcn", "sage", "nothing")], "model string, value double"))


_PIVOT = "SELECT tool, " + ", ".join(f"max(rate) FILTER (flaw = '{c}') AS {c}" for c in _C)


@query("vote_reliability_matrix", corpus.QUERIES["vote_corroboration"][1].replace("SELECT flaw, tool, count_if(vote = 1) AS fired", _PIVOT + " FROM (SELECT flaw, tool, count_if(vote = 1) AS fired", 1) + ") GROUP BY tool")
def vote_reliability_matrix(spark, d):
    return votes.reliability_matrix(corpus.vote_corroboration(spark, d), _C)


@query("vote_observed_coverage", with_("SELECT DISTINCT tool, flaw, true AS declared, true AS voted FROM v WHERE vote <> -1", v=fx.VOTES))
def vote_observed_coverage(spark, d):
    """Declared and voted pairs of tool and class, which agree."""
    return votes.observed_coverage(corpus.all_votes(spark, d), coverage(spark))


@query("label_driver", with_("SELECT contract, flaw, label::DOUBLE AS prob, label FROM l", v=fx.VOTES, l=corpus._LABELS))
def label_driver(spark, d):
    return models.label_all(corpus.all_votes(spark, d))[0]


@query("label_reliabilities", corpus.QUERIES["vote_corroboration"][1].replace("SELECT flaw, tool, count_if(vote = 1) AS fired, round(", "SELECT flaw, tool, round(", 1).replace(" AS rate\n", " AS reliability\n", 1))
def label_reliabilities(spark, d):
    return rounded(models.label_all(corpus.all_votes(spark, d))[1])


@query("ml_label_reliabilities")
def ml_label_reliabilities(spark, d):
    """Each tool's fitted reliability by class."""
    return models.label_all(corpus.all_votes(spark, d), "model")[1]


@query("ledger_unlabellable", with_("SELECT cid FROM s GROUP BY cid HAVING count_if(status = 'ok') = 0", k=structure._TASKS, g=fx.LOG, s=structure._STATE))
def ledger_unlabellable(spark, d):
    return ledger.unlabellable(structure.state(spark, d))


@query("ledger_totals", with_("SELECT count(DISTINCT cid) AS contracts, count(*) AS tasks_total, count_if(status IN ('ok', 'skipped')) AS tasks_done, (SELECT count(*) FROM (SELECT cid FROM s GROUP BY cid HAVING count_if(status = 'ok') = 0)) AS unlabellable_contracts, round(coalesce(sum(seconds), 0), 4) AS tool_seconds_total FROM s", k=structure._TASKS, g=fx.LOG, s=structure._STATE))
def ledger_totals(spark, d):
    return rounded(ledger.totals(structure.state(spark, d)), 4)


@query("report_emit", with_("SELECT * FROM (SELECT 'frequency' AS artifact, 'written' AS status, (SELECT count(DISTINCT flaw) FROM v)::INT AS n UNION ALL SELECT 'ladder', 'skipped', NULL UNION ALL SELECT 'localisation', 'failed: AnalysisException', NULL UNION ALL SELECT 'matrix', 'written', (SELECT count(DISTINCT tool) FROM v)::INT)", v=fx.VOTES))
def report_emit(spark, d):
    """Report tables by name: one is skipped, one lacks its input, the others are written."""
    made = {
        "frequency": lambda: corpus.label_frequency(spark, d),
        "matrix": lambda: corpus.vote_coverage_matrix(spark, d),
        "ladder": lambda: reports.ladder(run(spark, d, evaluation._FACTS), "test_a"),
        "localisation": lambda: spark.read.parquet(f"{d}/no_such_table.parquet"),
    }
    return spark.createDataFrame(reports.emit(made, shared_folder(spark), skip=("ladder",)), "artifact string, status string, n int")


@query("report_summary", with_(
    "SELECT 0::INT AS place, 'best: ' || arg_max(model, struct_pack(a := value, b := model)) || ' ' || printf('%.3f', max(value)) AS line FROM o WHERE split = 'test_a' UNION ALL SELECT 1, CASE WHEN avg(b.value - a.value) > 0 THEN 'the arm helped by ' ELSE 'the arm did not help: ' END || printf('%.3f', avg(b.value - a.value)) FROM o a JOIN o b ON b.model = a.model || '_df' AND a.split = b.split AND a.split = 'test_a' UNION ALL SELECT 2, 'no ensemble'",
    f=evaluation._FACTS, o="SELECT model, split, metric, value FROM f WHERE seed = 1 AND metric = 'macro_f1'"))
def report_summary(spark, d):
    """The results in three sentences."""
    f = run(spark, d, evaluation._FACTS).where("seed = 1 AND metric = 'macro_f1'")
    best = f.where("split = 'test_a'").select("model", "value")
    deltas = metrics.arm_deltas(f).where("split = 'test_a'").select("delta")
    return reports.summary_lines(best, deltas, spark.createDataFrame([], "best_single string, delta double"))


@query("bootstrap_masked")
def bootstrap_masked(spark, d):
    """Intervals of two of ten classes and their macro."""
    pred = run(spark, d, fx.TEN)
    n = pred.select("contract").distinct().count()
    return rounded(metrics.bootstrap(pred.withColumn("pos", F.col("contract").cast("long")), n, resamples=200, classes=["k1", "k2"]))



_HEAD = {"w1": [[0.5, -0.25, 1.0, 0.125], [-1.0, 0.5, 0.25, 2.0], [0.0, 1.0, -0.5, -0.125]], "b1": [0.1, -0.2, 0.3], "w2": [[1.0, -0.5, 0.25], [-0.75, 0.5, 1.5]], "b2": [0.05, -0.1]}


def _dense(names: list[str], row: list[float], b: float) -> str:
    return " + ".join([f"({b}::DOUBLE)", *(f"{n} * ({x}::DOUBLE)" for n, x in zip(names, row, strict=True))])


_HIDDEN = ", ".join(f"greatest({_dense(['x0', 'x1', 'x2', 'x3'], row, b)}, 0.0::DOUBLE) AS h{i}" for i, (row, b) in enumerate(zip(_HEAD["w1"], _HEAD["b1"], strict=True)))


@query("graph_dual_head", with_(
    " UNION ALL ".join(f"SELECT graph_id, '{c}' AS class, round(1 / (1 + exp(-({_dense(['h0', 'h1', 'h2'], _HEAD['w2'][i], _HEAD['b2'][i])}))), 6) AS prob FROM h" for i, c in enumerate(("reentrancy", "dos"))),
    e=fx.ORDER_EDGES, n=structure._N, a="SELECT graph_id, avg((length(nid) * 3 % 7)::DOUBLE) AS x0, count(*) / 1000::DOUBLE AS x1 FROM n GROUP BY graph_id", k="SELECT graph_id, count(*) / 1000::DOUBLE AS x2, count_if(etype = 'data_flow') / 1000::DOUBLE AS x3 FROM e WHERE graph_id % 3 > 0 GROUP BY graph_id",
    x="SELECT graph_id, x0, x1, coalesce(x2, 0) AS x2, coalesce(x3, 0) AS x3 FROM a LEFT JOIN k USING (graph_id)", h=f"SELECT graph_id, {_HIDDEN} FROM x"))
def graph_dual_head(spark, d):
    """Pooled vectors of two views through the head; every third graph lacks the second view."""
    n, e = structure._scored(spark, d)
    ast = n.groupBy("graph_id").agg(F.array(F.avg("x"), F.count("*") / 1000).alias("v"))
    cfg = e.where("graph_id % 3 > 0").groupBy("graph_id").agg(F.array(F.count("*") / 1000, F.count_if(F.col("etype") == "data_flow") / 1000).alias("v"))
    return rounded(graph.dual_head(ast, cfg, **_HEAD, classes=["reentrancy", "dos"]))


@query("cv_folds", with_("SELECT fold, round(avg(CASE WHEN arithmetic = CASE WHEN (SELECT avg(o.arithmetic) FROM w o JOIN f g USING (contract_id) WHERE g.fold <> f.fold) >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS score FROM w JOIN f USING (contract_id) GROUP BY fold", w=fx.WIDE, f=corpus.QUERIES["fold_stratified"][1]))
def cv_folds(spark, d):
    """Outside training over stratified folds; here the majority of the other folds."""
    rows = run(spark, d, fx.WIDE).join(corpus.fold_stratified(spark, d).select("contract_id", "fold"), "contract_id")

    def train_one_fold(train, held):
        majority = int(train.agg(F.avg("arithmetic")).first()[0] >= 0.5)
        return held.agg(F.avg((F.col("arithmetic") == majority).cast("int"))).first()[0]

    return rounded(spark.createDataFrame(extract.cross_validate(rows, 5, train_one_fold), "fold int, score double"))


@query("ledger_snapshot", with_("SELECT status, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM s GROUP BY status", k=structure._TASKS, g=fx.LOG, s=structure._STATE))
def ledger_snapshot(spark, d):
    copy = ledger.snapshot(structure.state(spark, d), shared_folder(spark))
    return copy.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").cast("long").alias("attempts"))


@query("stream_sync", with_("SELECT tool, status, count(*) AS n FROM g GROUP BY ALL", g=fx.LOG))
def stream_sync(spark, d):
    """The log copied as it arrives; a second call finds nothing new."""
    folder = shared_folder(spark)
    attempts.sync(attempts.read(spark, d), folder)
    return attempts.sync(attempts.read(spark, d), folder).groupBy("tool", "status").agg(F.count("*").alias("n"))


@query("archive_batches", "SELECT (doc_id % 12)::INT AS batch, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL")
def archive_batches(spark, d):
    """An archive by batch with its ledger: half of the batches first, then all, of which only the others are added."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", (F.col("doc_id") % 12).cast("int").alias("batch"))
    ledger.archive(docs.where("batch < 6"), "batch", folder, ("n_chars",))
    ledger.archive(docs, "batch", folder, ("n_chars",))
    rows = spark.read.parquet(f"{folder}/rows").groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    return rows.join(spark.read.parquet(f"{folder}/ledger"), ["batch", "n", "n_chars"])


@query("release_manifest", with_("SELECT folder, CASE WHEN folder % 7 = 0 THEN 'changed' WHEN folder = 3 THEN 'extra' ELSE 'missing' END AS problem FROM (SELECT DISTINCT folder FROM l UNION SELECT 99) WHERE folder % 7 = 0 OR folder IN (3, 99)", l=_LINES))
def release_manifest(spark, d):
    """A release's files against a manifest: some changed, one extra, one missing."""
    now = files.file_manifest(spark, _line_files(spark, d), "*.txt").select(_folder(), "size", "sha256")
    was = now.where("folder <> 3").withColumn("sha256", F.when(F.col("folder") % 7 == 0, "0").otherwise(F.col("sha256")))
    was = was.select("folder", "sha256").unionByName(spark.createDataFrame([(99, "1")], "folder int, sha256 string"))
    return files.manifest_problems(was, now, "folder")


@query("thresholds_for_all", with_("SELECT class, CASE WHEN class = 'quality' THEN round(avg(prob), 6) ELSE 0.5 END AS threshold FROM p GROUP BY class", p=fx.PROBS))
def thresholds_for_all(spark, d):
    """Tuned thresholds, and the fallback of a class without."""
    tuned = run(spark, d, fx.PROBS).where("class = 'quality'").groupBy("class").agg(F.avg("prob").alias("threshold"))
    return rounded(metrics.thresholds_for(tuned, ["quality", "toxic"]))


_RESULT = " UNION ALL ".join(f"SELECT contract AS source, '{c}' AS type, ((contract::BIGINT * 7 + {i * 13}) % 100) / 100::DOUBLE AS confidence FROM t WHERE ((contract::BIGINT * 7 + {i * 13}) % 100) / 100::DOUBLE >= {0.3 + 0.1 * i:.1f}" for i, c in enumerate(CLASSES))


@query("analyse_sources", with_("SELECT source, type, confidence, lines FROM r JOIN t ON source = contract", n=fx.NODES, ls=structure._LS, m=structure._MERGED, t="SELECT contract, array_to_string(list(line ORDER BY rank), ',') AS lines FROM m WHERE rank <= 5 GROUP BY contract", r=_RESULT))
def analyse_sources(spark, d):
    """Probabilities, thresholds by class and localised lines as wire results."""
    top = locate.merge_lines(structure.locate_line_scores(spark, d), 5)
    lines = top.groupBy("contract").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    cells = [F.struct(F.lit(c).alias("type"), (((F.col("contract").cast("long") * 7 + i * 13) % 100) / 100).alias("confidence"), F.lit(round(0.3 + 0.1 * i, 1)).alias("threshold")) for i, c in enumerate(CLASSES)]
    rows = lines.select(F.col("contract").alias("source"), "lines", F.explode(F.array(*cells)).alias("x")).select("source", "lines", "x.*")
    flaws = tables.wire_result(rows).select("source", F.explode("flaws").alias("f")).select("source", "f.type", "f.confidence", "f.lines")
    return flaws.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query("provenance")
def provenance(spark, d):
    """Versions of what made a result."""
    return spark.createDataFrame(tables.provenance(spark), "package string, version string")
