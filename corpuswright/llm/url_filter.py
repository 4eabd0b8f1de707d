"""URL filters: rules, and a logistic regression on hashed character n-grams of host and path.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable, let, lower_az

#: Fixed values: (host, path, verdict), from the query's contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BUCKETS = 2048


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, lower_az(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does. Equal lengths: the first given."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the character 3-grams and 4-grams of host and of path, ends marked."""

    def grams(chars: Column, tag: str, n: int) -> Column:
        last = F.greatest(F.size(chars) - n, F.lit(0))
        at = lambda i: F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n)])
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64(F.lit(tag), at(i)), F.lit(buckets)).cast("int"))

    # a text becomes an array of its characters once, so that grams are read by index
    both = lambda s, tag: let(F.split(F.concat(F.lit("^"), s, F.lit("$")), ""), lambda c: F.concat(grams(c, tag, 3), grams(c, tag, 4)))
    return F.array_distinct(F.concat(both(host, "host"), both(path, "path")))


def _margin(buckets: Column, weights: list[float]) -> Column:
    """Sum of the buckets' weights and of the bias, which stands last."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")  # folded to one literal
    return F.aggregate(F.concat(buckets, F.array(F.lit(len(weights) - 1))), F.lit(0.0), lambda acc, i: acc + F.get(table, i))


def fit(labelled: DataFrame, most: int = 2000, buckets: int = BUCKETS, steps: int = 16, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights of the regression, the bias last, from (host, path, allowed), a small labelled table.

    At most `most` distinct rows are used, those of least md5(host, path): the bound
    of the fit. Gradient descent with momentum, each step one aggregation of the sample;
    `buckets` + 1 sums at most reach the driver in a step. Without rows all weights are 0.
    """
    sample = labelled.distinct().orderBy(F.md5(F.concat_ws("\x00", "host", "path")), "host", "path", "allowed").limit(most)
    sample = durable(sample.select(F.col("allowed").cast("double").alias("y"), features(F.col("host"), F.col("path"), buckets).alias("x")).coalesce(1)).coalesce(1)
    n = sample.count()
    weights, speed = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    for _ in range(steps if n else 0):
        error = (F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(F.col("x"), weights))) - F.col("y")).alias("e")
        slopes = sample.select(error, F.explode(F.concat("x", F.array(F.lit(buckets)))).alias("i")).groupBy("i").agg(F.sum("e").alias("g"))
        slope = dict(slopes.collect())
        for i, w in enumerate(weights):
            speed[i] = 0.9 * speed[i] - rate * (slope.get(i, 0.0) / n + (ridge * w if i < buckets else 0.0))
            weights[i] = w + speed[i]
    return weights


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, most: int = 2000) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, probability (of allow).

    The longest fitting rule decides; else the regression does, trained on at most
    `most` addresses of the table that rules label. A null address, or one without
    ://, has an empty host and path and goes to the regression. Rows are judged
    where they are read, with no shuffle.
    """
    url = F.col(url_col).cast("string")
    df = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    df = df.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    weights = fit(df.where("_rule IS NOT NULL").select("host", "path", (F.col("_rule.verdict") == "allow").alias("allowed")), most)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(features(F.col("host"), F.col("path")), weights)))
    df = df.withColumn("probability", F.round(p, 9))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("probability") >= 0.5, "allow").otherwise("block"))
    return df.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "probability")
