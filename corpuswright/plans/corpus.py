"""Queries on sources, hashes, votes and selections, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import firewall, sampling, votes
from ..schema import CLASSES, TOOLS, coverage, finding_map
from ..sources import files, tables
from . import fixtures as fx
from .fixtures import rounded, run, with_

QUERIES: dict[str, tuple] = {}
_C = list(CLASSES)
_T = list(TOOLS)
_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TOKEN = r"""(?s)"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\z)|''[^''\\]*(?:\\.[^''\\]*)*(?:''|\\?\z)|//[^\n]*|/\*.*?(?:\*/|\z)|[^"''/]+|/"""
_STRIP = f"array_to_string(list_transform(regexp_extract_all(source, '{_TOKEN}'), lambda t: CASE WHEN t LIKE '//%' THEN '' WHEN t LIKE '/*%' THEN CASE WHEN t LIKE '%*/' AND length(t) >= 4 THEN ' ' ELSE '' END ELSE t END), '')"
_HASH = f"sha256(trim(regexp_replace({_STRIP}, '{_WS}', ' ', 'g')))"
_HASHED = f"SELECT contract_id, path, doc_id, {_HASH} AS chash FROM c"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return add


def contracts(spark, d):
    return run(spark, d, fx.CONTRACTS)


def hashed(spark, d):
    return firewall.with_hash(contracts(spark, d)).select("contract_id", "path", "doc_id", "chash")


@query("hash_contracts", with_(f"SELECT contract_id, chash FROM ({_HASHED})", c=fx.CONTRACTS))
def hash_contracts(spark, d):
    return hashed(spark, d).select("contract_id", "chash")


@query("hash_invariance", with_(f"SELECT count(*) AS n, count_if({_HASH} = sha256(trim(regexp_replace(body, '{_WS}', ' ', 'g')))) AS same FROM (SELECT concat('/* x */ ', text, ' // ', source) AS source, text AS body FROM documents)", c=fx.CONTRACTS))
def hash_invariance(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bare = F.sha2(F.trim(F.regexp_replace("text", X.WHITE, " ")), 256)
    return docs.agg(F.count("*").alias("n"), F.count_if(X.content_hash(F.concat(F.lit("/* x */ "), F.col("text"), F.lit(" // "), F.col("source"))) == bare).alias("same"))


@query("dedup_first_per_hash", with_("SELECT chash, contract_id, path FROM h QUALIFY row_number() OVER (PARTITION BY chash ORDER BY string_split(path, '/')) = 1", c=fx.CONTRACTS, h=_HASHED))
def dedup_first_per_hash(spark, d):
    return firewall.first_per_hash(hashed(spark, d).select("contract_id", "path", "chash")).select("chash", "contract_id", "path")


@query("dedup_stem_collisions", with_("SELECT stem, path, chash FROM (SELECT concat('s', doc_id % 100) AS stem, path, chash, first_value(chash) OVER (PARTITION BY doc_id % 100 ORDER BY string_split(path, '/')) AS f FROM h) WHERE chash = f", c=fx.CONTRACTS, h=_HASHED))
def dedup_stem_collisions(spark, d):
    h = hashed(spark, d).select(F.concat(F.lit("s"), F.col("doc_id") % 100).alias("stem"), "path", "chash")
    return firewall.drop_stem_collisions(h, "stem")


@query("dedup_cross_corpus", with_("SELECT contract_id, chash, chash IN (SELECT chash FROM h WHERE doc_id % 10 = 0) AS removed FROM h WHERE doc_id % 10 <> 0", c=fx.CONTRACTS, h=_HASHED))
def dedup_cross_corpus(spark, d):
    h = hashed(spark, d)
    kept, removed = firewall.split_by_reserved(h.where("doc_id % 10 <> 0"), h.where("doc_id % 10 = 0"))
    return kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True))).select("contract_id", "chash", "removed")


@query("leak_report", with_("SELECT count(*) AS n_leaks, min(chash) AS example FROM (SELECT chash FROM h WHERE doc_id % 5 < 2 INTERSECT SELECT chash FROM h WHERE doc_id % 5 >= 2)", c=fx.CONTRACTS, h=_HASHED))
def leak_report(spark, d):
    h = hashed(spark, d)
    return firewall.leaks(h.where("doc_id % 5 < 2"), h.where("doc_id % 5 >= 2"))


@query("leak_benchmark", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_benchmark(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return firewall.holders(docs, spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("item")))


@query("reserved_hashes", with_("SELECT DISTINCT chash FROM h WHERE doc_id % 7 = 0 OR doc_id % 11 = 0", c=fx.CONTRACTS, h=_HASHED))
def reserved_hashes(spark, d):
    h = hashed(spark, d)
    return firewall.reserved_hashes(h.where("doc_id % 7 = 0"), h.where("doc_id % 11 = 0"))


@query("split_plan", with_("SELECT chash, contract_id, CASE WHEN doc_id % 13 = 1 THEN 'val' ELSE 'train' END AS split FROM h WHERE doc_id % 10 <> 0 AND chash NOT IN (SELECT chash FROM h WHERE doc_id % 10 = 0) UNION ALL SELECT chash, contract_id, 'test' FROM h WHERE doc_id % 10 = 0", c=fx.CONTRACTS, h=_HASHED))
def split_plan(spark, d):
    h = hashed(spark, d)
    return firewall.plan_splits(h.where("doc_id % 10 <> 0"), h.where("doc_id % 10 = 0"), h.where("doc_id % 13 = 1"))


@query("record_mismatches", with_("SELECT contract_id FROM w WHERE CAST(substr(contract_id, 2) AS BIGINT) % 45 = 0", w=fx.WIDE))
def record_mismatches(spark, d):
    w = run(spark, d, fx.WIDE)
    wrong = w.withColumn("reentrancy", F.when(F.substring("contract_id", 2, 20).cast("long") % 45 == 0, 1 - F.col("reentrancy")).otherwise(F.col("reentrancy")))
    return firewall.mismatches(wrong, w, "contract_id", _C)


_RECOVERED = "SELECT n.contract_id, m.path FROM h n LEFT JOIN (SELECT chash, min(path) AS path FROM h WHERE doc_id % 3 = 0 GROUP BY chash) m USING (chash) WHERE doc_id % 4 = 0"


@query("recover_by_hash", with_(_RECOVERED, c=fx.CONTRACTS, h=_HASHED))
def recover_by_hash(spark, d):
    h = hashed(spark, d)
    return firewall.recover(h.where("doc_id % 4 = 0").select("contract_id", "chash"), h.where("doc_id % 3 = 0"), "chash").select("contract_id", "path")


@query("recovery_report", with_("SELECT count(*) AS needed, count(path) AS recovered, count(*) - count(path) AS missing, round(count(path) / greatest(count(*), 1), 4) AS ratio, list(contract_id ORDER BY contract_id) FILTER (path IS NULL)[1:20] AS first_missing FROM r", c=fx.CONTRACTS, h=_HASHED, r=_RECOVERED))
def recovery_report(spark, d):
    return firewall.coverage_report(recover_by_hash(spark, d), "contract_id")


@query("signal_detect", with_(
    """SELECT contract_id, n, array_to_string(list_filter([CASE WHEN regexp_matches(source, '(?i)\\.call\\.value\\s*\\(|\\.call\\s*\\{[^}]*value\\s*:|\\.call\\.gas') THEN 'reentrancy' END,
    CASE WHEN regexp_matches(source, '(?i)\\bselfdestruct\\b|\\bsuicide\\b|tx\\.origin|\\.?delegatecall\\s*\\(') THEN 'access_control' END,
    CASE WHEN doc_id % 5 < 3 AND regexp_matches(source, '(?i)\\+\\+|--|[+\\-*]=|\\bSafeMath\\b|\\w\\s*[+\\-*]\\s*\\w') THEN 'arithmetic' END,
    CASE WHEN regexp_matches(source, '(?i)\\.call\\s*[\\({]|\\.send\\s*\\(') THEN 'unchecked_calls' END,
    CASE WHEN regexp_matches(source, '(?i)\\bfor\\s*\\(|\\bwhile\\s*\\(') AND regexp_matches(source, '(?i)\\.send\\s*\\(|\\.transfer\\s*\\(|\\.call\\s*[\\({]') THEN 'dos' END], lambda x: x IS NOT NULL), ',') AS signals
    FROM (SELECT *, length(source) AS n FROM c)""".replace("\\\\", "\\"), c=fx.CONTRACTS))
def signal_detect(spark, d):
    return contracts(spark, d).select("contract_id", F.length("source").cast("long").alias("n"), F.array_join(X.detect_signals(F.col("source")), ",").alias("signals"))


_PIN = r"SELECT contract_id, nullif(regexp_extract(spec, '(\d+\.\d+)\.\d+', 1), '') AS minor, nullif(regexp_extract(trim(regexp_replace(spec, '\s', ' ', 'g')), '^=?\s*(\d+\.\d+\.\d+)$', 1), '') AS exact FROM (SELECT contract_id, regexp_extract(substr(source, 1, 4096), 'pragma\s+solidity\s+([^;]+);', 1) AS spec FROM c)"


@query("pragma_versions", with_("SELECT contract_id, minor, exact, CASE WHEN exact IS NOT NULL THEN CASE exact WHEN '0.4.25' THEN '/b/0.4.25' END ELSE CASE minor WHEN '0.4' THEN '/b/0.4.26' WHEN '0.5' THEN '/b/0.5.17' END END AS compiler FROM p", c=fx.CONTRACTS, p=_PIN))
def pragma_versions(spark, d):
    by_minor = F.create_map(F.lit("0.4"), F.lit("/b/0.4.26"), F.lit("0.5"), F.lit("/b/0.5.17"))
    exact = F.create_map(F.lit("0.4.25"), F.lit("/b/0.4.25"))
    s = X.head(F.col("source"))
    return contracts(spark, d).select("contract_id", X.pragma_minor(s).alias("minor"), X.pragma_exact(s).alias("exact"), X.choose_compiler(s, by_minor, exact).alias("compiler"))


@query("pragma_newest", "SELECT '0.' || m AS minor, '0.' || m || '.' || max(p) AS version, '/b/solc-0.' || m || '.' || max(p) AS path FROM (SELECT doc_id % 4 AS m, doc_id % 23 AS p FROM documents) GROUP BY m")
def pragma_newest(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("solc-0."), F.col("doc_id") % 4, F.lit("."), F.col("doc_id") % 23)
    installed = docs.select(name.alias("name"), F.concat(F.lit("/b/"), name).alias("path")).unionByName(spark.createDataFrame([("solc-nightly", "/b/x")], "name string, path string"))
    return files.newest_by_minor(installed)


@query("pin_counts", with_("SELECT exact AS pin, count(*) AS n FROM p WHERE exact IS NOT NULL AND exact <> '0.4.25' GROUP BY ALL", c=fx.CONTRACTS, p=_PIN))
def pin_counts(spark, d):
    """Pinned versions that aren't installed, and how many sources pin them."""
    installed = spark.createDataFrame([("0.4.25",)], "pin string")
    pins = contracts(spark, d).select(X.pragma_exact(F.col("source")).alias("pin")).where("pin IS NOT NULL")
    return pins.groupBy("pin").agg(F.count("*").alias("n")).join(F.broadcast(installed), "pin", "left_anti")


@query("source_heads", with_("SELECT contract_id, sha256(substr(source, 1, 64)) AS head, length(source) - length(replace(source, chr(10), '')) + 1 AS n_lines FROM c", c=fx.CONTRACTS))
def source_heads(spark, d):
    s = X.normalise_newlines(F.col("source"))
    return contracts(spark, d).select("contract_id", F.sha2(X.head(s, 64), 256).alias("head"), F.size(F.split(s, "\n")).cast("long").alias("n_lines"))


@query("offset_lines", with_("SELECT doc_id, (len(string_split(decode(encode(t)[1:least(greatest(o, 0), octet_length(encode(t)))]), chr(10))))::INT AS line FROM (SELECT doc_id, regexp_replace(text, '[^ -~\\n]', '?', 'g') AS t, doc_id % 700 - 5 AS o FROM documents)".replace("\\\\", "\\"), c=fx.CONTRACTS))
def offset_lines(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = F.regexp_replace("text", r"[^ -~\n]", "?")
    return docs.select("doc_id", X.byte_offset_to_line(t, (F.col("doc_id") % 700 - 5).cast("int")).alias("line"))


@query("finding_identifiers", "SELECT event_id, array_to_string(list_concat(list_filter([CASE event_id % 3 WHEN 0 THEN 'Call depth (SWC 0104)' WHEN 1 THEN 'reentrancy-eth' END, CASE event_id % 2 WHEN 0 THEN 'SWC-107' ELSE 'SWC-101' END], lambda x: x IS NOT NULL), CASE event_id % 3 WHEN 0 THEN ['SWC-104'] ELSE [] END), '|') AS idents FROM events")
def finding_identifiers(spark, d):
    name = F.when(F.col("event_id") % 3 == 0, "Call depth (SWC 0104)").when(F.col("event_id") % 3 == 1, "reentrancy-eth").otherwise("")
    swc = F.when(F.col("event_id") % 2 == 0, "SWC-107").otherwise("101")
    finding = F.struct(name.alias("name"), swc.alias("swc-id"), F.lit(None).cast("string").alias("swc_id"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.array_join(X.finding_identifiers(finding), "|").alias("idents"))


@query("parse_tool_results", with_("SELECT contract, tool, coalesce(array_to_string(list_sort(list(DISTINCT flaw) FILTER (flaw IS NOT NULL)), ','), '') AS flaws FROM (SELECT concat('c', doc_id) AS contract, 'slither' AS tool, unnest(CASE doc_id % 4 WHEN 0 THEN [NULL] WHEN 1 THEN ['dos', 'reentrancy'] ELSE ['access_control'] END) AS flaw FROM documents WHERE doc_id % 4 <> 3) GROUP BY ALL", c=fx.CONTRACTS))
def parse_tool_results(spark, d):
    """Result files, written out as JSON, through parsing and mapping: no findings abstains, empty findings are clean."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = {0: '{"findings": []}', 1: '{"findings": [{"name": "reentrancy-eth"}, {"name": "calls-loop"}, {"name": "nothing"}]}', 2: '{"findings": [{"name": "x", "swc-id": "9"}, {"name": "suicidal"}]}', 3: '{"errors": ["boom"]}'}
    value = F.element_at(F.create_map(*[F.lit(x) for kv in found.items() for x in kv]), (F.col("doc_id") % 4).cast("int"))
    raw = docs.select(F.concat(F.lit("results/slither-0.10/run1/c"), F.col("doc_id"), F.lit(".sol/result.json")).alias("path"), value.alias("value"))
    flaws = votes.tool_flaws(files.parse_tool_results(raw), finding_map(spark))
    return flaws.select("contract", "tool", F.array_join("flaws", ",").alias("flaws"))


@query("parse_event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def parse_event_props(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("parse_payloads", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'suicidal|tx-origin' WHEN 1 THEN '' END AS checks, CASE doc_id % 3 WHEN 0 THEN 'SWC-107|SWC-101' WHEN 1 THEN '' END AS issues FROM documents")
def parse_payloads(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    s = F.when(F.col("doc_id") % 4 == 0, '{"success": true, "results": {"detectors": [{"check": "suicidal"}, {"check": "tx-origin"}]}}').when(F.col("doc_id") % 4 == 1, '{"success": true, "results": null}').when(F.col("doc_id") % 4 == 2, '{"success": false}').otherwise("no json")
    m = F.when(F.col("doc_id") % 3 == 0, '{"success": true, "issues": [{"swc-id": "107"}, {"swc-id": "SWC-101"}]}').when(F.col("doc_id") % 3 == 1, '{"success": true}').otherwise('{"success": false, "error": "x"}')
    return docs.select("doc_id", F.array_join(files.parse_detectors(s), "|").alias("checks"), F.array_join(files.parse_issues(m), "|").alias("issues"))


def all_votes(spark, d):
    c = run(spark, d, fx.CONTRACTS).select(F.col("contract_id").alias("contract"))
    return votes.vote_matrix(c, fx.votes(spark, d), coverage(spark), _T, _C).withColumn("vote", F.col("vote").cast("int"))


@query("vote_matrix", with_("SELECT contract, tool, flaw, vote FROM v", v=fx.VOTES))
def vote_matrix(spark, d):
    return all_votes(spark, d)


@query("vote_wide", with_("SELECT contract, flaw, max(vote) FILTER (tool = 'slither') AS slither, max(vote) FILTER (tool = 'mythril') AS mythril, max(vote) FILTER (tool = 'securify') AS securify, max(vote) FILTER (tool = 'osiris') AS osiris FROM v GROUP BY ALL", v=fx.VOTES))
def vote_wide(spark, d):
    return votes.wide_votes(all_votes(spark, d), _T)


_LABELS = "SELECT contract, flaw, max(CASE WHEN vote = 1 THEN 1 ELSE 0 END) AS label FROM v GROUP BY ALL"


@query("label_union", with_(_LABELS, v=fx.VOTES))
def label_union(spark, d):
    return votes.label_union(all_votes(spark, d))


@query("label_wide", with_("SELECT contract, " + ", ".join(f"max(label) FILTER (flaw = '{c}') AS {c}" for c in _C) + " FROM l GROUP BY ALL", v=fx.VOTES, l=_LABELS))
def label_wide(spark, d):
    return votes.wide_labels(label_union(spark, d), _C)


@query("vote_corroboration", with_(
    """SELECT flaw, tool, count_if(vote = 1) AS fired, round(CASE WHEN any_value(n_active) >= 2 THEN avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) FILTER (vote = 1) END, 6) AS rate
    FROM (SELECT *, sum(CASE WHEN vote = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contract, flaw) AS n FROM v)
    JOIN (SELECT flaw, count(DISTINCT tool) AS n_active FROM v WHERE vote <> -1 GROUP BY flaw) USING (flaw) GROUP BY flaw, tool HAVING max(vote) > -1""", v=fx.VOTES))
def vote_corroboration(spark, d):
    return rounded(votes.corroboration(all_votes(spark, d)))


@query("vote_summary", with_("SELECT tool, flaw, count_if(vote = 1) AS positive, count_if(vote <> -1) AS ran FROM v GROUP BY ALL", v=fx.VOTES))
def vote_summary(spark, d):
    return votes.tool_summary(all_votes(spark, d))


@query("vote_coverage_matrix", with_("SELECT tool, " + ", ".join(f"count_if(vote = 1 AND flaw = '{c}') AS {c}" for c in _C) + " FROM v GROUP BY tool", v=fx.VOTES))
def vote_coverage_matrix(spark, d):
    return votes.coverage_matrix(vote_summary(spark, d), _C)


@query("label_frequency", with_("SELECT flaw, sum(label)::BIGINT AS positives FROM l GROUP BY flaw", v=fx.VOTES, l=_LABELS))
def label_frequency(spark, d):
    return votes.class_frequency(label_union(spark, d))


@query("label_cooccurrence", with_("SELECT a.flaw AS a, b.flaw AS b, count_if(a.label = 1 AND b.label = 1) AS n FROM l a JOIN l b USING (contract) GROUP BY ALL", v=fx.VOTES, l=_LABELS))
def label_cooccurrence(spark, d):
    return votes.cooccurrence(label_union(spark, d), _C)


@query("vote_features", with_("SELECT contract, array_to_string([" + ", ".join(f"(max(vote) FILTER (flaw = '{f}' AND tool = '{t}'))" for f in _C for t in _T) + "], ',') AS features FROM v GROUP BY contract", v=fx.VOTES))
def vote_features(spark, d):
    f = votes.feature_vector(all_votes(spark, d), _T, _C)
    return f.select("contract", F.array_join(F.col("features").cast("array<int>").cast("array<string>"), ",").alias("features"))


@query("tool_predictions_raw", with_("SELECT contract, tool, flaw, CASE WHEN ran = 1 AND fired = 1 THEN 1 ELSE 0 END AS y FROM r", r=fx.RUNS))
def tool_predictions_raw(spark, d):
    c = run(spark, d, fx.CONTRACTS).select(F.col("contract_id").alias("contract"))
    return votes.tool_predictions(c, fx.votes(spark, d), _T, _C)


_KEY = "md5('42:' || contract_id)"


@query("sample_shuffled", with_(f"SELECT contract_id FROM w ORDER BY {_KEY}, contract_id LIMIT 50", w=fx.WIDE))
def sample_shuffled(spark, d):
    return sampling.shuffled_limit(run(spark, d, fx.WIDE).select("contract_id"), "contract_id", 50)


@query("sample_sorted", with_("SELECT contract_id FROM w ORDER BY contract_id LIMIT 25", w=fx.WIDE))
def sample_sorted(spark, d):
    return sampling.sorted_limit(run(spark, d, fx.WIDE).select("contract_id"), "contract_id", 25)


def _passes(order: list[str], quota: dict[str, str], rest: str) -> str:
    """Oracle of a selection by passes: each class's quota among what is left, then the rest."""
    ctes, chosen = [], "SELECT NULL::VARCHAR AS contract_id WHERE false"
    for k, c in enumerate(order):
        ctes.append(f"p{k} AS (SELECT contract_id FROM w WHERE {c} = 1 AND contract_id NOT IN ({chosen}) ORDER BY {_KEY}, contract_id LIMIT {quota[c]})")
        chosen = " UNION ALL ".join(f"SELECT contract_id FROM p{i}" for i in range(k + 1))
    return "WITH w AS (" + fx.plain(fx.WIDE) + "), " + ", ".join(ctes) + f", ch AS ({chosen}), rs AS ({rest}) SELECT contract_id FROM ch UNION ALL SELECT contract_id FROM rs"


#: Scarcity of the fixture's classes: their residues' shares, 1/31 < 1/11 < 1/9 < 1/7 < 1/5.
_SCARCE = ["dos", "unchecked_calls", "reentrancy", "access_control", "arithmetic"]


@query("sample_quota", _passes(_SCARCE, {"dos": "22", "unchecked_calls": "24", "reentrancy": "24", "access_control": "22", "arithmetic": "34"}, f"SELECT contract_id FROM w WHERE contract_id NOT IN (SELECT contract_id FROM ch) ORDER BY {_KEY}, contract_id LIMIT (SELECT greatest(120 - count(*), 0) FROM ch)").replace("LIMIT 34", "LIMIT (SELECT least(34, 120 - (SELECT count(*) FROM p0) - (SELECT count(*) FROM p1) - (SELECT count(*) FROM p2) - (SELECT count(*) FROM p3)))"))
def sample_quota(spark, d):
    return sampling.quota_select(run(spark, d, fx.WIDE), _C, 120)


@query("sample_test_set", _passes(_SCARCE, dict.fromkeys(_C, "20"), f"SELECT contract_id FROM w WHERE greatest({', '.join(_C)}) = 0 AND contract_id NOT IN (SELECT contract_id FROM ch) ORDER BY {_KEY}, contract_id LIMIT (SELECT 2 * count(*) FROM ch)"))
def sample_test_set(spark, d):
    return sampling.select_test(run(spark, d, fx.WIDE), _C, target=20)


_SPLIT_REST = f"SELECT contract_id FROM w WHERE contract_id NOT IN (SELECT contract_id FROM ch) ORDER BY {_KEY}, contract_id LIMIT (SELECT greatest(round_even(0.3 * (SELECT count(*) FROM w), 0)::BIGINT - count(*), 0) FROM ch)"


@query("split_stratified", "WITH t AS (" + _passes(_SCARCE, {c: f"(SELECT ceil(0.3 * count(*))::BIGINT FROM w WHERE {c} = 1)" for c in _C}, _SPLIT_REST) + f") SELECT contract_id, CASE WHEN contract_id IN (SELECT contract_id FROM t) THEN 'test' ELSE 'train' END AS split FROM ({fx.plain(fx.WIDE)})")
def split_stratified(spark, d):
    return sampling.stratified_split(run(spark, d, fx.WIDE), _C)


@query("fold_stratified", with_(f"SELECT contract_id, key::INT AS key, ((row_number() OVER (PARTITION BY key ORDER BY {_KEY}, contract_id) - 1) % 5)::INT AS fold FROM (SELECT contract_id, CASE WHEN dos = 1 THEN 4 WHEN unchecked_calls = 1 THEN 3 WHEN reentrancy = 1 THEN 0 WHEN access_control = 1 THEN 1 WHEN arithmetic = 1 THEN 2 ELSE -1 END AS key FROM w)", w=fx.WIDE))
def fold_stratified(spark, d):
    return sampling.stratified_folds(run(spark, d, fx.WIDE), _C)


@query("sample_fit", "SELECT name FROM (SELECT DISTINCT lang || source AS name FROM documents) ORDER BY md5('42:' || name), name LIMIT 30")
def sample_fit(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat("lang", "source").alias("name"))
    return sampling.fit_sample(docs, "name", 30)


@query("split_positives", with_(" UNION ALL ".join(f"SELECT '{c}' AS class, sum({c})::BIGINT AS positives, sum({c}) < 60 AS short FROM w" for c in _C), w=fx.WIDE))
def split_positives(spark, d):
    return sampling.positives_summary(run(spark, d, fx.WIDE), _C)


@query("window_tokens", """SELECT doc_id, (i // 384)::INT AS window_idx, least(n - i, 512)::INT AS n_tokens, least(greatest(512 - (n - i), 0), 512)::INT AS padding, md5(array_to_string(w[i + 1:i + 512], ' ')) AS digest
FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, greatest(len(w), 1), 384)[1:8]) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}]+'), lambda x: x <> '') AS w FROM documents))""".replace("\\\\", "\\"))
def window_tokens(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.tokens(F.col("text")).alias("w"))
    w = docs.select("doc_id", F.posexplode(X.windows(F.col("w"))).alias("window_idx", "t"))
    return w.select("doc_id", "window_idx", F.size("t").alias("n_tokens"), (F.lit(512) - F.size("t")).alias("padding"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("cache_misses", with_("SELECT chash, count(*) AS n FROM h WHERE chash NOT IN (SELECT chash FROM h WHERE doc_id % 2 = 0) GROUP BY chash", c=fx.CONTRACTS, h=_HASHED))
def cache_misses(spark, d):
    h = hashed(spark, d)
    left = tables.cache_misses(h.select("chash"), h.where("doc_id % 2 = 0"))
    return left.join(h.select("chash"), "chash").groupBy("chash").agg(F.count("*").alias("n"))


@query("labelled_pool", with_("SELECT contract_id, path FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", c=fx.CONTRACTS))
def labelled_pool(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id")
    return contracts(spark, d).join(labels, "doc_id", "left_semi").select("contract_id", "path")
