"""Hand-computed cases of the operators."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright import schema
from corpuswright.functions import text as X
from corpuswright.operators import firewall, graph, ledger, locate, metrics, models, sampling, trees, votes
from corpuswright.plans import evaluation, structure
from corpuswright.plans.fixtures import TEN, run
from corpuswright.sources import files, tables

ALL = list(schema.CLASSES)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


def machine(source):
    """The comment rules as a plain state machine."""
    out, i, n = [], 0, len(source)
    while i < n:
        c = source[i]
        if c in "\"'":
            j = i + 1
            while j < n and source[j] != c:
                j += 2 if source[j] == "\\" else 1
            out.append(source[i : j + 1])
            i = j + 1
        elif source.startswith("//", i):
            j = source.find("\n", i)
            i = n if j < 0 else j
        elif source.startswith("/*", i):
            j = source.find("*/", i + 2)
            out.append(" " if j >= 0 else "")
            i = n if j < 0 else j + 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def test_strip_comments(spark):
    import random

    rng = random.Random(3)
    cases = ["".join(rng.choice("ab\"'/*\\ \n") for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    cases += ['"' + '\\"' * 60_000 + '" // gone', "/* open", "a /**/ b", "/*/ x */y", 's = "// kept"; // gone\nt', "'a\\", ""]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string").select("i", X.strip_comments(F.col("s")).alias("x")).collect()
    assert all(r.x == machine(cases[r.i]) for r in rows)


def test_content_hash(spark):
    h = lambda s: one(spark, X.content_hash, s)
    assert h("a  b // x\n c") == h("a b\n\n/* y */ c ") and h('a = "// b"') != h('a = "// c"')


def test_versions(spark):
    assert one(spark, X.pragma_minor, "pragma solidity >=0.4.22 <0.6.0;") == "0.4" and one(spark, X.pragma_minor, "none") is None
    assert one(spark, X.pragma_exact, "pragma solidity = 0.4.25;") == "0.4.25" and one(spark, X.pragma_exact, "pragma solidity ^0.4.24;") is None


def test_signals(spark):
    got = one(spark, X.detect_signals, "pragma solidity ^0.4.0; for (;;) a.call.value(1)(); x++; tx.origin")
    assert got == ["reentrancy", "access_control", "arithmetic"] and one(spark, X.detect_signals, "for (;;) a.send(1)") == ["unchecked_calls", "dos"]


def test_offsets_windows_and_spans(spark):
    off = lambda s, o: spark.createDataFrame([(s, o)], "s string, o int").select(X.byte_offset_to_line(F.col("s"), F.col("o")).alias("x")).first().x
    assert [off("é\nb\nc", o) for o in (-3, 0, 2, 3, 5, 99)] == [1, 1, 1, 2, 3, 3]
    assert [len(w) for w in spark.range(1).select(X.windows(F.array_repeat(F.lit("t"), 900)).alias("w")).first().w] == [512, 512, 132]
    assert one(spark, X.parse_span, "12:x") == (12, 0, 0)


def test_manifest_and_frozen(spark, tmp_path):
    row = [("c1", "p", "h", 1, 0, 0, 0, 1)]
    df = spark.createDataFrame(row, tables.MANIFEST)
    path = str(tmp_path / "m")
    tables.write_manifest(df, path)
    assert [tuple(r) for r in tables.read_manifest(spark, path).collect()] == row
    with pytest.raises(Exception, match="exist"):
        tables.write_manifest(df, path)
    tables.write_manifest(df, path, force=True)


def test_sources_curated_and_annotations(spark, tmp_path):
    for folder, name, body in (("reentrancy", "a.sol", b"x = 1;\r\n\xff"), ("arithmetic", "a.sol", b"x = 1; // same\n"), ("denial_of_service", "b.sol", b"y"), ("other", "b.sol", b"z")):
        p = tmp_path / "dataset" / folder
        p.mkdir(parents=True, exist_ok=True)
        (p / name).write_bytes(body)
    (tmp_path / "dataset" / "other" / "._b.sol").write_bytes(b"fork")
    note = [{"name": "a.sol", "category": None, "lines": None, "vulnerabilities": [{"category": "Reentrancy", "lines": [9, 9]}, {"category": "x", "lines": [1]}, {"category": "arithmetic", "lines": [5]}]}]
    raw = spark.createDataFrame([(0, json.dumps(note[0]))], "pos int, v string")
    raw = raw.select("pos", F.from_json("v", "name string, category string, lines array<int>, vulnerabilities array<struct<category:string,lines:array<int>>>").alias("r")).select("pos", "r.*")
    gold = files.parse_annotations(raw)
    assert [tuple(r) for r in gold.collect()] == [("a", [5, 9])]
    rows = {r.contract_id: r for r in files.curated(files.read_sources(spark, str(tmp_path)), gold).collect()}
    assert set(rows) == {"a", "b", "b__other"}
    assert rows["a"].y == [1, 0, 1, 0, 0] and rows["a"].lines == [5, 9] and rows["b"].y == [0, 0, 0, 0, 1] and rows["b__other"].lines == []


def test_tool_results_tree(spark, tmp_path):
    for run, body in (("r1", '{"findings": [{"name": "suicidal"}]}'), ("r2", '{"findings": []}')):
        p = tmp_path / "slither-0.1" / run / "c1.sol"
        p.mkdir(parents=True)
        (p / "result.json").write_text(body)
    bad = tmp_path / "mythril-0.2" / "r1" / "c1.sol"
    bad.mkdir(parents=True)
    (bad / "result.json").write_text("{broken")
    got = [(r.contract, r.tool, r.findings) for r in files.tool_results(spark, str(tmp_path)).collect()]
    assert got == [("c1", "slither", [])]
    legacy = spark.createDataFrame([("x/c9.json", '{"analysis": "Slither", "contract": "", "errors": [{"check": "", "name": "suicidal"}, "plain"]}')], "path string, value string")
    assert tuple(files.parse_legacy_result(legacy).first()) == ("c9", "slither", ["suicidal", "plain"])


def _votes(spark, rows):
    return spark.createDataFrame([(str(i), t, "reentrancy", v) for t, vs in rows.items() for i, v in enumerate(vs)], "contract string, tool string, flaw string, vote int")


def test_union_and_corroboration(spark):
    v = _votes(spark, {"slither": [1, 1, 1, 0, 0], "mythril": [0, 0, 1, 0, 0], "osiris": [-1] * 5})
    assert [r.label for r in votes.label_union(v).orderBy("contract").collect()] == [1, 1, 1, 0, 0]
    rate = {r.tool: r.rate for r in votes.corroboration(v).collect()}
    assert math.isclose(rate["slither"], 1 / 3) and rate["mythril"] == 1.0 and "osiris" not in rate
    assert votes.corroboration(_votes(spark, {"slither": [1, 0], "osiris": [-1, -1]})).first().rate is None


def test_abstaining_is_not_clean(spark):
    results = spark.createDataFrame([("c", "Slither", '[{"name": "reentrancy-eth"}]'), ("c", "Mythril", '[{"name": "(SWC 104)"}, {"name": "t", "swc-id": "101"}]'), ("c", "Securify", None)], "contract string, tool string, f string")
    results = results.select("contract", "tool", F.from_json("f", f"array<{files.FINDING}>").alias("findings"))
    v = votes.vote_matrix(spark.createDataFrame([("c",)], "contract string"), votes.tool_flaws(results, schema.finding_map(spark)), schema.coverage(spark), list(schema.TOOLS), ALL)
    got = {(r.flaw, r.tool): r.vote for r in v.collect()}
    row = lambda f: [got[f, t] for t in schema.TOOLS]
    assert (row("reentrancy"), row("unchecked_calls"), row("dos"), row("arithmetic")) == ([1, 0, -1, -1], [0, 1, -1, -1], [0, 0, -1, -1], [-1] * 4)


def test_metrics(spark):
    p = spark.createDataFrame([("c", f, int(f == "dos"), int(f == "dos")) for f in ALL], "contract string, class string, y_true int, y_pred int")
    s = metrics.summary(p).first()
    assert math.isclose(s.macro_f1, 0.2) and s.micro_f1 == 1.0 and s.subset_accuracy == 1.0
    assert metrics.summary(p, mask=["dos"]).first().macro_f1 == 1.0
    assert metrics.resolve_mask(["dos", 0], ALL) == ["reentrancy", "dos"]
    for bad in ([], ["x"], [9]):
        with pytest.raises(ValueError):
            metrics.resolve_mask(bad, ALL)
    with pytest.raises(ValueError):
        metrics.ensemble(p, "median")


def test_thresholds(spark):
    p = spark.createDataFrame([("a", 1, 0.62), ("a", 0, 0.31), ("b", 0, 0.5)], "class string, y_true int, prob double")
    t = {r["class"]: (round(r.threshold, 2), r.f1) for r in metrics.tune_thresholds(p).collect()}
    assert t == {"a": (0.35, 1.0), "b": (0.05, 0.0)}  # ties go low, and a class without positives too


def test_best_epoch(spark):
    h = spark.createDataFrame([(1, e, v) for e, v in enumerate([0.1, 0.5, 0.4, 0.5, 0.3, 0.9])], "run int, epoch int, value double")
    assert tuple(metrics.best_epoch(h, 3).first()) == (1, 1, 0.5, 4)


def test_lines(spark):
    s = spark.createDataFrame([("c", 44, 1.0), ("c", 9, 0.5), ("c", 10, 0.5), ("c", 11, 0.5), ("c", 12, 0.5), ("c", 13, 0.5), ("c", 1, 0.0), ("d", 3, 0.7), ("d", 1, 0.7)], "contract string, line int, score double")
    rows = locate.merge_lines(s, 5).orderBy("contract", "rank").collect()
    assert [r.line for r in rows if r.contract == "c"] == [44, 9, 10, 11, 12] and [r.line for r in rows if r.contract == "d"] == [1, 3]
    pred = spark.createDataFrame([("a", [5, 2]), ("b", [1, 9])], "contract string, lines array<int>")
    gold = spark.createDataFrame([("a", [5]), ("b", [9])], "contract string, lines array<int>")
    acc = {(r.k, r.tolerance): r.accuracy for r in locate.top_k_accuracy(locate.hits(pred, gold, [1, 3], [0])).collect()}
    assert acc == {(1, 0): 0.5, (3, 0): 1.0}


def test_graph(spark):
    n = spark.createDataFrame([(1, i) for i in range(3)], "graph_id int, nid int")
    e = spark.createDataFrame([(1, 0, 1, "control_flow"), (1, 0, 1, "data_flow")], "graph_id int, src int, dst int, etype string")
    assert [tuple(r)[2:] for r in graph.degrees(n, e).orderBy("nid").collect()] == [(0, 2), (2, 0), (0, 0)]
    full = n.withColumn("type", F.lit("Root")).withColumn("depth", F.lit(0)).withColumn("n_children", F.lit(2))
    enc = graph.encode_nodes(full, graph.degrees(n, e), ["Root"]).where("nid = 0").first()
    assert enc.features[1:] == [0.0, 2.0, 0.0, 2.0]
    w = spark.createDataFrame([(1, 0, "x", 0), (1, 0, "x", 1)], "graph_id int, fn int, var string, nid int")
    r = spark.createDataFrame([(1, 0, "x", 2), (1, 0, "x", 0), (1, 1, "x", 2)], "graph_id int, fn int, var string, nid int")
    assert [(x.src, x.dst) for x in graph.data_flow_edges(w, r).orderBy("src").collect()] == [(0, 2), (1, 2)]


def test_graph_json(spark):
    value = json.dumps({"view": "cfg", "node_types": ["A", "B"], "snippets": ["", ""], "depths": [0, 0], "n_children": [1, 0], "edges": [[0, 1]], "node_lines": {"0": [4, 5]}})
    df = spark.createDataFrame([(1, value)], "graph_id int, v string").select("graph_id", tables.graph_from_json(F.col("v")).alias("graph"))
    nodes, edges = tables.graph_tables(df)
    assert [r.lines for r in nodes.orderBy("nid").collect()] == [[4, 5], []] and edges.first().etype == "control_flow" and df.first().graph.degraded is False


def test_trees(spark):
    ast = {"nodeType": "A", "src": "0:9:0", "x": {"nodeType": "B", "kids": [{"nodeType": "C"}, 3, {"no": 1}]}, "y": {"nodeType": "D"}}
    rows = trees.flatten(spark.createDataFrame([(1, json.dumps(ast)), (2, "nothing")], "graph_id long, ast string")).orderBy("graph_id", "nid").collect()
    assert [(r.type, r.parent, r.depth, r.n_children) for r in rows[:4]] == [("A", -1, 0, 2), ("B", 0, 1, 1), ("C", 1, 2, 0), ("D", 0, 1, 0)]
    assert rows[4].error and rows[4].nid == -1


def test_predictions(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "contract_id string")
    raw = spark.createDataFrame([("a", "0.1", 0), ("a", "0.2", 1), ("b", "0.3", 2), ("z", "9", 3)], "id string, dos string, _pos long")
    assert {tuple(r) for r in tables.align_predictions(raw, ids, ["dos"]).collect()} == {("a", 0.2), ("b", 0.3)}
    with pytest.raises(Exception, match="no prediction for b"):
        tables.align_predictions(raw.where("id = 'a'"), ids, ["dos"]).collect()


def test_selection(spark):
    df = spark.createDataFrame([(f"c{i}", *[int(i % (k + 2) == 0) for k in range(5)]) for i in range(60)], "contract_id string, " + ", ".join(f"{c} int" for c in ALL))
    a, b = ({r[0] for r in sampling.quota_select(df, ALL, 20).collect()} for _ in range(2))
    assert a == b and len(a) == 20 and sampling.quota_select(df, ALL, 500).count() == 60
    split = {r[0]: r[1] for r in sampling.stratified_split(df, ALL).collect()}
    assert len(split) == 60 and sum(s == "test" for s in split.values()) >= 18
    folds = sampling.stratified_folds(df, ALL).groupBy("key").pivot("fold").count().na.fill(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in folds)


def test_leak_raises(spark):
    a, b = (spark.createDataFrame([(h,) for h in hs], "chash string") for hs in ("xy", "yz"))
    with pytest.raises(ValueError, match="such as y"):
        firewall.assert_no_leak(a, b)
    firewall.assert_no_leak(a, b.where("chash = 'z'"))


def test_ledger(spark):
    tasks = ledger.enrol(spark.createDataFrame([(1,), (2,)], "cid int"), ["slither", "mythril"])
    log = spark.createDataFrame([(1, "slither", "crash", 1.0, 5, 0), (1, "slither", "ok", 2.0, 9, 1), (2, "slither", "timeout", 3.0, 1, 2)], "cid int, tool string, status string, seconds double, ts int, seq int")
    state = ledger.fold(tasks, log)
    assert {(r.cid, r.tool) for r in ledger.claim(state).collect()} == {(1, "mythril"), (2, "mythril"), (2, "slither")}
    assert ledger.enrol(spark.createDataFrame([(1,)], "cid int"), ["slither"], tasks).count() == 0
    assert [r.cid for r in ledger.unlabellable(state).collect()] == [2]
    assert ledger.totals(state).first().asDict() == {"contracts": 2, "tasks_total": 4, "tasks_done": 1, "unlabellable_contracts": 1, "tool_seconds_total": 5.0}
    assert ledger.totals(state.limit(0)).first().tasks_total == 0
    assert {(r.tool, r.status): r.n for r in ledger.summary(state).collect()}["all", "all"] == 4


def test_label_model(spark):
    v = _votes(spark, {"a": [1, 1, 0, 0, 0, 1] * 5, "b": [1, 1, 0, 0, 0, 1] * 5, "c": [1, 0, 0, 0, 1, 1] * 5})
    got = {int(r.contract) % 6: r.label for r in models.label_model(v)[0].collect()}
    assert [got[i] for i in range(6)] == [1, 1, 0, 0, 0, 1]
    assert [r.label for r in models.label_model(_votes(spark, {"a": [1, 0], "b": [-1, -1]}))[0].orderBy("contract").collect()] == [1, 0]


def test_config_and_wire(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("a: 1\nb: x\n")
    (tmp_path / "child.yaml").write_text("extends: base.yaml\nb: y\n")
    assert tables.load_config(str(tmp_path / "child.yaml")) == {"a": 1, "b": "y"}
    rows = spark.createDataFrame([("s", "dos", 0.7, [3, 3, 1], 0.5), ("s", "arithmetic", 0.2, [1], 0.5)], "source string, type string, confidence double, lines array<int>, threshold double")
    assert tables.wire_result(rows).first().flaws == [("dos", 0.7, [3, 1])]
    with pytest.raises(Exception, match="bad flaw"):
        tables.wire_result(rows.withColumn("confidence", F.lit(1.5))).collect()


def test_history(spark):
    lists, records = '{"epoch": [1, 2], "train_loss": [0.5, 0.4], "val_macro_f1": [0.1, 0.2]}', '[{"epoch": 1, "train_loss": 0.5, "val_macro_f1": 0.1}, {"epoch": 2, "train_loss": 0.4, "val_macro_f1": 0.2}]'
    a, b = (one(spark, tables.history_rows, v) for v in (lists, records))
    assert a == b and a[1].epoch == 2


def test_ledger_queries_cover_the_whole_log(spark, tmp_path):
    events = spark.range(8000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 401 AS user_id", "1.0D AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert structure.ledger_fold(spark, str(tmp_path)).agg(F.sum("attempts")).first()[0] == 8000
    assert {r.status: r.n for r in structure.ledger_summary(spark, str(tmp_path)).where("tool = 'all'").collect()}["all"] == 401 * 4
    log = {(r.cid, r.tool): r.status for r in structure.log(spark, str(tmp_path)).orderBy("seq").collect()}
    done = {k for k, status in log.items() if status == "ok"}
    left = {(r.cid, r.tool) for r in structure.ledger_remaining(spark, str(tmp_path)).collect()}
    assert left == {(c, t) for c in range(401) for t in schema.TOOLS} - done


def test_gcn_query_over_all_graphs_against_brute_force(spark, tmp_path):
    pairs = [(o, p) for o in range(1, 60) for p in (o % 7, o % 11)]
    spark.createDataFrame([(o, p, "R") for o, p in pairs], "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [(o % 50, f"o{o}", f"p{p}") for o, p in pairs]
    every = edges + [(g, v, v) for g, v in {(g, v) for g, a, b in edges for v in (a, b)}]
    deg = Counter((g, b) for g, _, b in every)
    want = defaultdict(float)
    for g, a, b in every:
        want[g, b] += len(a) * 3 % 7 / math.sqrt(deg[g, a] * deg[g, b])
    got = {(r.graph_id, r.nid): r.value for r in structure.graph_gcn(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and {g for g, _ in got} == set(range(50))
    assert all(math.isclose(got[k], v, abs_tol=2e-6) for k, v in want.items())


def test_bootstrap_query_of_2000_replicates_against_brute_force(spark, tmp_path):
    n = 30
    spark.createDataFrame([(i, i * 7 % 10) for i in range(n)], "vec_id long, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = run(spark, str(tmp_path), TEN).collect()
    truth, pred = np.zeros((2, n, 10), int)
    for r in rows:
        truth[int(r.contract), int(r["class"][1:])], pred[int(r.contract), int(r["class"][1:])] = r.y_true, r.y_pred
    f1 = []
    for b in range(2000):
        at = [int(hashlib.md5(f"42:{b}:{d}".encode()).hexdigest()[:12], 16) % n for d in range(n)]
        t, p = truth[at], pred[at]
        both, any_ = (t & p).sum(axis=0), (t + p).sum(axis=0)
        f1.append(np.where(any_ > 0, 2 * both / np.maximum(any_, 1), 0.0))
    f1 = np.column_stack([f1, np.mean(f1, axis=1)])
    low, high = np.quantile(f1, [0.025, 0.975], axis=0)
    got = {r["class"]: (r.low, r.high) for r in evaluation.bootstrap_interval_full(spark, str(tmp_path)).collect()}
    assert len(got) == 11
    for k, name in enumerate([*(f"k{i}" for i in range(10)), "macro"]):
        assert np.allclose(got[name], (low[k], high[k]), atol=2e-6)


def test_holders_of_short_and_long_items(spark):
    docs = spark.createDataFrame([(1, "xone two three four fivey"), (2, "a red fox"), (3, "ared foxb"), (4, None), (5, "one two three four five")], "doc_id int, text string")
    items = spark.createDataFrame([(10, "one two three four five"), (11, "red fox"), (12, ""), (13, None), (14, "fox")], "item_id int, item string")
    got = {tuple(r) for r in firewall.holders(docs, items).collect()}
    assert got == {(1, 10), (5, 10), (2, 11), (3, 11), (2, 14), (3, 14)}
    assert firewall.holders(docs, items.limit(0)).count() == 0


def test_label_model_against_brute_force(spark):
    """Expectation maximisation over rows one by one, with a tool that lacks rows."""
    import random

    rng = random.Random(3)
    truth = [rng.random() < 0.4 for _ in range(120)]
    right = {"a": 0.9, "b": 0.8, "c": 0.7}
    cells = {(i, t): int(y if rng.random() < right[t] else not y) for i, y in enumerate(truth) for t in right if rng.random() < 0.8}
    rows = [(str(i), t, "dos", v) for (i, t), v in cells.items()]
    labels, reliable = models.label_model(spark.createDataFrame(rows, "contract string, tool string, flaw string, vote int"))
    ids = sorted({i for i, _ in cells})
    prior, acc, post = 0.5, {(t, y): 0.9 for t in right for y in (0, 1)}, {}
    for _ in range(200):
        for i in ids:
            like = {y: prior if y else 1 - prior for y in (0, 1)}
            for t in right:
                if (i, t) in cells:
                    for y in (0, 1):
                        like[y] *= acc[t, y] if cells[i, t] == y else 1 - acc[t, y]
            post[i] = like[1] / (like[0] + like[1])
        prior = min(max(sum(post.values()) / len(ids), 1e-3), 1 - 1e-3)
        for t in right:
            for y in (0, 1):
                w = {i: post[i] if y else 1 - post[i] for i in ids if (i, t) in cells}
                acc[t, y] = min(max(sum(x for i, x in w.items() if cells[i, t] == y) / sum(w.values()), 0.05), 0.95)
    for r in labels.collect():
        assert abs(r.prob - post[int(r.contract)]) < 1e-4 and r.label == (r.prob >= 0.7)
    for r in reliable.collect():
        own = [post[i] if v else 1 - post[i] for (i, t), v in cells.items() if t == r.tool]
        assert abs(r.reliability - sum(own) / len(own)) < 1e-4
    with pytest.raises(ValueError, match="unknown method"):
        models.label_all(labels, "vote")


def test_pca_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(40, 6)) * [5, 3, 2, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id int, v array<double>")
    got = np.array([r.reduced for r in models.pca(df, df, "v", 3).orderBy("vec_id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    want = (x - x.mean(axis=0)) @ vt[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], "pos long, class string, y_true int, y_pred int")
    assert sorted(map(tuple, metrics.bootstrap(none, 0, classes=["x"]).collect())) == [("macro", 0.0, 0.0), ("x", 0.0, 0.0)]
