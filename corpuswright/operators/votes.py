"""Weak labels from tools: dense three-valued votes, unions, corroboration, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ABSTAIN, CLEAN, FIRED = -1, 0, 1


def map_findings(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """(contract, tool, flaw), distinct, from (contract, tool, ident). Tools match in any case, identifiers exactly; others drop."""
    f = findings.withColumn("tool", F.lower("tool"))
    return f.join(mapping, ["tool", "ident"]).select("contract", "tool", "flaw").distinct()


def tool_flaws(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """(contract, tool, flaws) from (contract, tool, findings array): one row a run that has findings, empty ones too.

    A result without findings (null) didn't run: it gives no row, so it abstains.
    """
    ran = results.where("findings IS NOT NULL").withColumn("tool", F.lower("tool"))
    idents = ran.select("contract", "tool", F.explode("findings").alias("f")).select("contract", "tool", F.explode(X.finding_identifiers(F.col("f"))).alias("ident"))
    fired = map_findings(idents, mapping).groupBy("contract", "tool").agg(F.array_sort(F.collect_list("flaw")).alias("flaws"))
    out = ran.select("contract", "tool").distinct().join(fired, ["contract", "tool"], "left")
    return out.withColumn("flaws", F.coalesce("flaws", F.array().cast("array<string>")))


def vote_matrix(contracts: DataFrame, votes: DataFrame, coverage: DataFrame, tools: list[str], flaws: list[str], masked: bool = True) -> DataFrame:
    """(contract, tool, flaw, vote): 1 fired, 0 ran without firing, -1 did not run or (masked) does not cover the class.

    votes: (contract, tool, flaws). A contract's tools and classes are exploded from
    literal arrays, so the only shuffle is the join on (contract, tool).
    """
    covers = {t: [] for t in tools}
    for r in coverage.collect():  # a row a tool and class
        covers.setdefault(r.tool, []).append(r.flaw)
    cells = contracts.select("contract").distinct().select("contract", F.explode(F.array(*map(F.lit, tools))).alias("tool"))
    cells = cells.join(votes, ["contract", "tool"], "left")
    table = F.create_map(*[x for t in tools for x in (F.lit(t), F.array(*map(F.lit, covers[t])).cast("array<string>"))])
    covered = F.array_contains(F.element_at(table, F.col("tool")), F.col("flaw")) if masked else F.lit(True)
    vote = F.when(F.col("flaws").isNull() | ~covered, ABSTAIN).when(F.array_contains("flaws", F.col("flaw")), FIRED).otherwise(CLEAN)
    return cells.withColumn("flaw", F.explode(F.array(*map(F.lit, flaws)))).select("contract", "tool", "flaw", vote.cast("tinyint").alias("vote"))


def wide_votes(votes: DataFrame, tools: list[str]) -> DataFrame:
    """A row a contract and class, a column a tool."""
    return votes.groupBy("contract", "flaw").pivot("tool", tools).agg(F.max("vote"))


def label_union(votes: DataFrame) -> DataFrame:
    """(contract, flaw, label): 1 if any tool fired; all abstaining is 0."""
    return votes.groupBy("contract", "flaw").agg(F.max((F.col("vote") == FIRED).cast("int")).alias("label"))


def wide_labels(labels: DataFrame, flaws: list[str]) -> DataFrame:
    return labels.groupBy("contract").pivot("flaw", flaws).agg(F.max("label"))


def corroboration(votes: DataFrame) -> DataFrame:
    """(flaw, tool, fired, rate): how often another tool fired where this one did.

    Null without a firing, or if fewer than two tools voted on the class at all.
    """
    each = votes.groupBy("contract", "flaw").agg(F.sum((F.col("vote") == FIRED).cast("long")).alias("n"), F.collect_list(F.struct("tool", "vote")).alias("v"))
    rows = each.select("flaw", "n", F.explode("v").alias("v")).select("flaw", "n", "v.tool", "v.vote")
    fired = F.col("vote") == FIRED
    per = rows.groupBy("flaw", "tool").agg(
        F.max((F.col("vote") != ABSTAIN).cast("int")).alias("active"), F.count_if(fired).alias("fired"), F.count_if(fired & (F.col("n") > 1)).alias("backed")
    )
    active = per.groupBy("flaw").agg(F.sum("active").alias("n_active"))
    rate = F.when(F.col("n_active") >= 2, F.try_divide("backed", "fired"))
    return per.where("active = 1").join(active, "flaw").select("flaw", "tool", "fired", rate.alias("rate"))


def tool_summary(votes: DataFrame) -> DataFrame:
    """(tool, flaw, positive, ran)."""
    return votes.groupBy("tool", "flaw").agg(F.count_if(F.col("vote") == FIRED).alias("positive"), F.count_if(F.col("vote") != ABSTAIN).alias("ran"))


def class_frequency(labels: DataFrame) -> DataFrame:
    return labels.groupBy("flaw").agg(F.sum("label").cast("long").alias("positives"))


def cooccurrence(labels: DataFrame, flaws: list[str]) -> DataFrame:
    """(a, b, n) for all pairs of classes: rows positive in both; the diagonal has the totals.

    Pairs come from each row's own positives, so the result of a row is at most classes squared.
    """
    own = labels.where("label = 1").groupBy("contract").agg(F.collect_set("flaw").alias("s"))
    pairs = own.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    spark = labels.sparkSession
    dense = spark.createDataFrame([(a, b) for a in flaws for b in flaws], "a string, b string")
    return dense.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def coverage_matrix(summary: DataFrame, flaws: list[str]) -> DataFrame:
    """A row a tool, positives by class, 0 where there are none."""
    return summary.groupBy("tool").pivot("flaw", flaws).agg(F.max("positive")).na.fill(0)


def reliability_matrix(rates: DataFrame, flaws: list[str]) -> DataFrame:
    """A row a tool, rates by class, null where there are none."""
    return rates.groupBy("tool").pivot("flaw", flaws).agg(F.max("rate"))


def feature_vector(votes: DataFrame, tools: list[str], flaws: list[str]) -> DataFrame:
    """(contract, features): votes class by class, tools in order within, absent ones -1."""
    cells = votes.groupBy("contract").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "flaw", "tool"), F.col("vote").cast("double")))).alias("m"))
    return cells.select("contract", F.array(*[F.coalesce(F.try_element_at("m", F.lit(f"{f}/{t}")), F.lit(-1.0)) for f in flaws for t in tools]).alias("features"))


def tool_predictions(contracts: DataFrame, votes: DataFrame, tools: list[str], flaws: list[str]) -> DataFrame:
    """(contract, tool, flaw, y): every mapped finding counts, whatever the coverage; not run is 0."""
    raw = vote_matrix(contracts, votes, votes.sparkSession.createDataFrame([], "tool string, flaw string"), tools, flaws, masked=False)
    return raw.select("contract", "tool", "flaw", (F.col("vote") == FIRED).cast("int").alias("y"))


def observed_coverage(votes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(tool, flaw, declared, voted) for every pair that is declared or voted on: the two must agree."""
    seen = votes.where(F.col("vote") != ABSTAIN).select("tool", "flaw").distinct().withColumn("voted", F.lit(True))
    both = coverage.select("tool", "flaw").distinct().withColumn("declared", F.lit(True)).join(seen, ["tool", "flaw"], "full")
    return both.select("tool", "flaw", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("voted", F.lit(False)).alias("voted"))
