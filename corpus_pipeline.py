"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Within a stage the columns have names of their own, so that no further column of
documents can clash with an operator's.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm import bpe, kneser_ney, mixing, secrets, simhash
from corpuswright.llm._common import drop_folder, give_back_heap, shared_folder, temporary
from corpuswright.llm.queries import tokenizer_path


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _lean(stage):
    """The stage, which gives back the driver's memory of what ran before it, and of its own steps before its rows are written."""

    @wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heap(spark)
        out = stage(spark, docs, sf_dir)
        give_back_heap(spark)
        return out

    return run_lean


@_lean
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose perplexity is within their language's threshold.

    A language without trusted documents, and a null one without, keeps all.
    """
    own, n = _renamed(docs)
    ident, text, lang = n["doc_id"], n["text"], n["lang"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(ident), "quality")
    trusted = kneser_ney.trusted_ids(labels, id_col=ident)
    model = kneser_ney.fit(kneser_ney.fit_rows(own, trusted, ident), text)
    # written whole, so that texts are scored once and never shuffled
    folder = f"{shared_folder(spark)}/scored"
    kneser_ney.with_perplexity(own, model, text).write.parquet(folder)
    model.release()
    scored = spark.read.parquet(folder)
    limits = kneser_ney.thresholds(scored.select(ident, lang, "perplexity"), trusted, id_col=ident, lang_col=lang)
    return kneser_ney.judge(scored, limits, lang).where("kept").select(*n.values()).toDF(*docs.columns)


@_lean
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of the smallest id."""
    return simhash.drop_near_copies(docs)


@_lean
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    own, n = _renamed(docs)
    text, chars = n["text"], n["n_chars"]
    ratios = secrets.fit(secrets.random_samples(spark).unionByName(secrets.identifier_samples(own, n["doc_id"], text)))
    out = secrets.redact(own.withColumn("before", F.col(text)), ratios, text)
    changed = ~F.col(text).eqNullSafe(F.col("before"))
    out = out.withColumn(chars, F.when(changed, F.length(text).cast("long")).otherwise(F.col(chars)))
    return out.select(*n.values()).toDF(*docs.columns)


@_lean
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix by source takes them.

    Rows equal in id, source and size share a decision: the most that any gets.
    """
    own, n = _renamed(docs)
    ident, text, source = n["doc_id"], n["text"], n["source"]
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    taken = mixing.mix(own, ident, text, source).where("copies > 0").select(key(ident).alias("k1"), key("source").alias("k2"), F.col("size").alias("k3"), F.col("copies").cast("int").alias("copies"))
    taken = taken.groupBy("k1", "k2", "k3").agg(F.max("copies").alias("copies"))
    keyed = own.withColumns({"k1": key(ident), "k2": key(source), "k3": mixing.word_count(F.col(text))})
    out = keyed.join(taken, ["k1", "k2", "k3"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*n.values()).toDF(*docs.columns)


@_lean
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents as token ids."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path()).drop("text")


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing", mix), ("bpe", tokens)]
#: SQL can't express stages 1, 2, 3 and 5; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one after another; what only a later stage reads goes once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):  # the folders that a stage makes are gone when its rows are written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
