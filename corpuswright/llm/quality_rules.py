"""Quality rules by host: text rules, failure rates shrunk by an empirical beta prior, verdicts joined back.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, durable, fresh, words_of

#: A host fails if its shrunk failure rate is above this.
HOST_LIMIT = 0.6


def _repeat_words(words: Column, n: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash. Only a text with an equal pair pays for
    the sort that finds the places; the places' windows, in order, each add the
    words that the one before left uncovered.
    """
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            twin = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        # transform over a one-element array binds a value that lambdas use many times
        return F.get(F.transform(F.transform(F.transform(F.array(in_order), repeated), total), lambda x: x), F.lit(0))

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.get(F.transform(F.array(hashes), of), F.lit(0)))


def text_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text counts as empty: no words, and failed. Lines are cut at \\n; a line
    counts if it has a word. Long texts cost n log n in their words. Columns of docs
    with these names are replaced, all others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, r = fresh(docs, "_words", "_lines")
    df = docs.withColumn(w, words_of(text)).withColumn(r, lines)
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size(r) - F.size(F.array_distinct(r))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(w), F.size(w)),
        }
    ).drop(w, r)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(judged: DataFrame, host_col: str, failed_col: str = "base_failed", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk_rate, host_ok), one row for each host, null among them.

    The beta prior is fitted to the hosts' rates by moments (mean and variance over
    hosts, weighted alike). With one host, or rates without variance, the prior is
    as strong as the mean host is large, so a host's rate is drawn half way.
    """
    host = judged.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed_col).cast("long")).alias("n_failed"))
    host = host.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = host.agg(F.avg("rate").alias("mu"), F.var_samp("rate").alias("var"), F.avg("n_docs").alias("size"))
    spread = F.try_divide(F.col("mu") * (1 - F.col("mu")), F.col("var")) - 1
    prior = prior.select("mu", F.when(F.col("var") > 0, F.greatest(spread, F.lit(0.0))).otherwise(F.col("size")).alias("strength"))
    # one row joins each host: a broadcast of two numbers
    host = host.join(F.broadcast(prior))
    shrunk = (F.col("n_failed") + F.col("mu") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return host.withColumn("shrunk_rate", shrunk).withColumn("host_ok", F.col("shrunk_rate") <= limit).select("host", "n_docs", "n_failed", "rate", "shrunk_rate", "host_ok")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each row of docs: id, the rules' figures, base_failed, kept.

    kept is false if base_failed, else whether the row's host passes. Null hosts
    form one host. The figures are written once, without the texts, and read for
    both the hosts' rates and the result; only failing hosts are joined back.
    """
    figures = durable(text_rules(docs.select(F.col(id_col), F.col(host_col).alias("_host"), F.col(text_col)), text_col).drop(text_col))
    bad = host_verdicts(figures, "_host", limit=limit).where(~F.col("host_ok")).select(F.col("host").alias("_bad"), F.lit(True).alias("_hit"))
    out = figures.join(bad, F.col("_host").eqNullSafe(F.col("_bad")), "left")
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("_hit").isNull()).alias("kept"))
