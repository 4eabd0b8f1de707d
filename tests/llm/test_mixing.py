"""Mixing: targets are met in sources of any size, whatever the others."""

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import mixing


def _taken(spark, sizes, words_a_doc=7):
    rows, n = [], 0
    for source, size in sizes.items():
        while size > 0:
            rows.append((n, source, "w " * min(size, words_a_doc)))
            size, n = size - words_a_doc, n + 1
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(r.taken <= 2 * r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    return by


@pytest.mark.parametrize("sizes", [{"a": 20_000, "b": 20, "c": 24, "d": 12}, {"a": 5, "b": 50, "c": 17}, {"a": 9_000, "b": 3_000, "c": 11}, {"a": 1}])
def test_every_source_comes_near_its_target(spark, sizes):
    for source, (target, taken) in _taken(spark, sizes).items():
        assert abs(taken - target) <= max(0.05 * target, 1), source


def test_schedule_spreads_a_source_evenly(spark):
    plan = spark.createDataFrame([("=a", 300, 300, 300.0, 300.0, 400), ("=b", 100, 100, 100.0, 400.0, 400)], "key string, n_blocks long, quota long, share double, upto double, slots long")
    rows = sorted(mixing.schedule(plan).collect())
    assert [r.slot for r in rows if r.slot < 400] and {r.key: sum(x.key == r.key for x in rows) for r in rows} == {"=a": 300, "=b": 100}
    for start in range(0, 360, 40):  # a quarter of every stretch of the schedule
        assert 6 <= sum(r.key == "=b" for r in rows if start <= r.slot < start + 40) <= 14
    assert all(r.block == r["rank"] % (300 if r.key == "=a" else 100) for r in rows)


def test_repeated_runs_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert mixing.mix(docs).exceptAll(mixing.mix(docs.repartition(7, F.col("text")))).count() == 0
