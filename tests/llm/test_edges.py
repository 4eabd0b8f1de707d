"""Every operator on odd rows and on empty tables: a row for each row, defined results."""

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import bpe, kneser_ney, license_scan, lm_bloom, mih, mixing, quality_rules, secrets, simhash, url_filter
from corpuswright.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def ratios(spark):
    plain = spark.createDataFrame([("identifier",), ("ordinaryword",), ("another",)], "s string")
    return secrets.fit(secrets.random_samples(spark, 300).unionByName(plain.withColumn("random", F.lit(0))))


def operators(ratios):
    return {
        "lm": lambda d: lm_bloom.score(d, d, filter_bits=1 << 16),
        "license": license_scan.scan,
        "mix": mixing.mix,
        "simhash": simhash.near_duplicates,
        "rules": quality_rules.judge,
        "bpe": lambda d: bpe.encode(d, tokenizer_path(), digests=True),
        "secrets": lambda d: secrets.scan(d, ratios),
        "perplexity": lambda d: kneser_ney.with_perplexity(d, kneser_ney.fit(d)),
    }


@pytest.mark.parametrize("name", ["lm", "license", "mix", "simhash", "rules", "bpe", "secrets", "perplexity"])
def test_a_row_for_each_row(odd, none, ratios, name):
    op = operators(ratios)[name]
    rows = op(odd).collect()
    assert len(rows) == 10
    twice = [r for r in rows if r.doc_id == 1]
    drop = {"taken", "copies"}  # a mix may take one of two equal rows more often
    assert len(twice) == 2 and len({tuple((k, str(v)) for k, v in r.asDict().items() if k not in drop) for r in twice}) == 1
    assert sum(r.doc_id is None for r in rows) == 1
    assert op(none).collect() == []


def test_defined_results(odd, ratios):
    by = lambda rows: {r.doc_id: r for r in rows}
    lm = by(lm_bloom.score(odd, odd).collect())
    assert lm[2].n_tokens == lm[3].n_tokens == lm[4].n_tokens == 1 and lm[6].n_tokens == 30_001
    lic = by(license_scan.scan(odd).collect())
    assert (lic[5].n_base, lic[5].first_word, lic[5].base_labels, lic[5].labels, lic[5].score) == (1, 3, "mit", "mit", 1.0)
    assert (lic[2].n_words, lic[2].first_word, lic[2].labels, lic[2].score) == (0, None, "", 0.0)
    near = by(simhash.near_duplicates(odd).collect())
    assert near[2].fingerprint == "0" * 16 and near[2].component_id == near[3].component_id == near[4].component_id == 2
    assert near[8].component_id == 1
    rules = by(quality_rules.judge(odd).collect())
    assert rules[6].n_repeat_words == 30_000 and rules[6].base_failed and not rules[6].kept
    sec = by(secrets.scan(odd, ratios).collect())
    assert (sec[5].n_assign, sec[2].spans) == (1, "")
    mixed = by(mixing.mix(odd).collect())
    assert mixed[2].taken == 0 and all(r.taken <= 2 * r.size for r in mixed.values())


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "http://a.org/x", "x"), (3, "http://" + "a" * 50_000 + ".com/fr/", "x")], "page_id long, url string, host string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == 5 and {r.verdict for r in rows} <= {"allow", "block"}
    assert [r.rule for r in rows if r.page_id is None] == ["org/"] and [r.rule for r in rows if r.page_id == 3] == ["com/fr/"]
    assert url_filter.judge(pages.limit(0)).collect() == []
    v = spark.createDataFrame([(100, [1.0, -1.0], 1), (1, [1.0, -1.0], 1), (1, [1.0, -1.0], 1), (2, None, 1), (None, [1.0, 1.0], 1), (200, [-1.0, 1.0], 1), (300, [], 1)], "vec_id long, embedding array<float>, code int")
    got = [tuple(r) for r in mih.top_k(v, v.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(100, 1, 1, 0), (100, 2, 1, 0), (100, 3, 100, 0)] and got[3] == (200, 1, 200, 0) and len(got) == 9
    assert mih.top_k(v.limit(0), v.limit(0)).collect() == []


def test_near_copies_and_redaction_on_odd_rows(odd, none, ratios):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    # of 1, 1 and 8 one stays, of the texts without words (2, 3, 4) one, and all others
    assert sorted((r.doc_id or 0, r.fp0, r.node) for r in kept.collect()) == [(i, "x", "x") for i in (0, 1, 2, 5, 6, 7)]
    assert simhash.drop_near_copies(none).collect() == []
    out = secrets.redact(odd, ratios)
    assert out.columns == odd.columns and out.count() == 10 and secrets.redact(none, ratios).collect() == []
    assert {r.found for r in out.collect()} == {"x"} and [r.text for r in out.collect() if r.doc_id == 2] == [None]
    found = secrets.find(odd, ratios)
    assert found.columns.count("found") == 1 and found.where("doc_id = 5").first().found[0].kind == "assign"


def test_the_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 5, 6, 7)] + [(None, 1), (4, 0), (1, 1)], "doc_id long, quality int")
    for docs, n in ((odd, 10), (none, 0)):
        for table in (labels, labels.limit(0)):
            trusted = kneser_ney.trusted_ids(table)
            model = kneser_ney.fit(kneser_ney.fit_rows(docs, trusted))
            scored = kneser_ney.with_perplexity(docs.withColumn("perplexity", F.lit("x")), model)
            out = kneser_ney.judge(scored, kneser_ney.thresholds(scored, trusted)).collect()
            assert len(out) == n and all(r.kept is not None for r in out)


def test_decoding_keeps_other_columns(spark, odd):
    out = bpe.decode(bpe.encode(odd, tokenizer_path()).withColumn("_ids", F.lit("x")), tokenizer_path())
    assert {r._ids for r in out.collect()} == {"x"} and all(r.decoded == (r.text or "") for r in out.collect())
