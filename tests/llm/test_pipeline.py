"""The pipeline's stages on documents with planted cases, and the registered queries against their oracles."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuswright.llm import kneser_ney, mixing, queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's rows, from documents with a secret, a near copy and a clashing column."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("x"))
    secret = F.concat("text", F.lit(" password="), F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 18))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, secret).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_columns_and_sizes(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])
    n = [s.count() for s in stages]
    assert n[0] > n[1] > n[2] == n[3] and n[4] == n[5]
    assert stages[2].where("kept <> 'x' OR kept IS NULL").count() == 0


def test_near_dedup_leaves_no_equal_texts(stages):
    assert stages[2].count() == stages[2].select("text").distinct().count()


def test_secrets_are_gone(stages):
    assert stages[2].where(F.col("text").rlike("[0-9a-f]{24,}|password=[0-9a-f]{6,}")).count() > 0
    assert stages[3].where(F.col("text").rlike("[0-9a-f]{24,}|password=[0-9a-f]{6,}")).count() == 0
    assert stages[3].where("n_chars <> length(text)").count() == 0


def test_mix_repeats_twice_at_most(stages):
    assert stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix(stages[3]).exceptAll(mixing.mix(stages[3])).count() == 0


def test_tokens(stages):
    assert stages[5].where("n_tokens <> size(token_ids)").count() == 0


@pytest.mark.parametrize("rows", ["odd", "none"])
@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_odd_rows(spark, request, tmp_path, rows, labelled):
    """Nulls, empty and long texts, repeated rows, clashing names, empty documents and empty labels."""
    docs = request.getfixturevalue(rows)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 1, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    (labels if labelled else labels.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.count())
        assert k == 4 or now.columns == docs.columns
    if rows == "none":
        assert seen == [0] * 5
    elif not labelled:  # without labels there is no threshold: all stay
        assert seen[:3] == [10, 6, 6]


def test_the_quality_stage_by_hand(spark, sf):
    """What stays is what an own reading of the scores and thresholds keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = {r.doc_id: r for r in queries.op8_quality_classifier(spark, sf).collect()}
    trusted = kneser_ney.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet"))
    rest = {r.doc_id for r in trusted.where("NOT fit").collect()}
    want = set()
    for r in docs.select("doc_id", "lang").collect():
        own = sorted(x.perplexity for i, x in scored.items() if i in rest and x.lang == r.lang)
        limit = own[math.ceil(0.995 * len(own)) - 1] if own else None
        if limit is None or scored[r.doc_id].perplexity <= limit:
            want.add(r.doc_id)
    languages_without = {x.lang for x in scored.values()} - {x.lang for i, x in scored.items() if i in rest}
    assert not languages_without
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == want


def test_the_mixing_stage_by_hand(spark, stages):
    """Each document comes as often as the block with its first word is taken."""
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_run_leaves_only_its_rows(spark, sf):
    import pathlib

    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.glob("corpuswright-*"))
    out = corpus_pipeline.run(spark, sf)
    made = set(base.glob("corpuswright-*")) - before
    assert len(made) == 1 and [x.name for x in made.pop().iterdir() if x.is_dir()] == ["4"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, sf, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == cols
    rows = sorted(tuple(map(show, r)) for r in got.select(*cols).collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(show(r[i]) for i in at) for r in want.fetchall())
