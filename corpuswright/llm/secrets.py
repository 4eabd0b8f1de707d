"""Secret scans: three patterns, and character Markov models that tell random strings from identifiers.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let

#: Fixed values, in the order of kinds: pattern, the group that is measured, its least length.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # the run's least length stands in the pattern: its matches are the runs that are long enough
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What the Markov models judge: runs of this class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_SIZE = 128
#: Characters of that class, in the order of the ratios' table in a plan.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Code points, then bytes: both ends exclusive.
_SPAN = "struct<start:int,end:int,first:int,last:int>"
#: Values joined one after another; longer arrays are cut, for an aggregate copies what it holds at each step.
_RUN = 64


def _running(values: Column, join) -> Column:
    """0, v1, join(v1, v2), ...: running joins of an array of ints, one more than there are values."""

    def short(x: Column, first: Column) -> Column:
        return F.aggregate(x, F.array(first), lambda acc, v: F.concat(acc, F.array(join(F.element_at(acc, -1), v))))

    def of(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / _RUN).cast("int")), lambda j: F.slice(v, j * _RUN + 1, F.lit(_RUN)))
        return let(parts, joined)

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), join))
        inside = lambda o: F.transform(parts, lambda x, j: F.slice(short(x, F.coalesce(F.get(o, j), F.lit(0))), F.lit(1), F.size(x)))
        return let(short(totals, F.lit(0)), lambda o: F.concat(F.flatten(inside(o)), F.array(F.element_at(o, -1))))

    return let(values, of)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(text: Column, pattern: str, group: int, least: int, score=None) -> Column:
    """Spans of the leftmost non-overlapping matches that pass, in code points and in bytes.

    The text splits at the matches, so the places are running sums of the lengths of
    gaps and matches. Texts without a match pay for one search only.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    measured = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), group)
    zipped = F.zip_with(F.zip_with(found, measured, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), F.split(text, pattern, -1), lambda x, g: F.struct(x["m"].alias("m"), x["v"].alias("v"), g.alias("g")))
    zipped = F.filter(zipped, lambda x: x["m"].isNotNull())
    passes = (lambda x: F.length(x["v"]) >= least) if score is None else (lambda x: score(x["v"]))

    def placed(z: Column) -> Column:
        ends = lambda size: _running(F.transform(z, lambda x: size(x["g"]) + size(x["m"])), _plus)
        span = lambda x, i, e, b: F.struct((F.get(e, i) + F.length(x["g"])).alias("start"), F.get(e, i + 1).alias("end"), (F.get(b, i) + F.octet_length(x["g"])).alias("first"), F.get(b, i + 1).alias("last"), passes(x).alias("ok"))
        spans = let(ends(F.length), lambda e: let(ends(F.octet_length), lambda b: F.transform(z, lambda x, i: span(x, i, e, b))))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(*(x[n].alias(n) for n in ("start", "end", "first", "last"))))

    return F.when(text.rlike(pattern), let(zipped, placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def random_samples(spark, n: int = 3000) -> DataFrame:
    """Labelled random strings: hexadecimal, base 64 and upper-case digests of 0 .. n - 1."""
    i = F.col("id").cast("string")
    kinds = F.array(F.sha1(i), F.base64(F.unhex(F.sha2(i, 256))), F.translate(F.upper(F.base64(F.unhex(F.sha2(i, 224)))), "+/=", ""))
    return spark.range(n).select(F.explode(kinds).alias("s"), F.lit(1).alias("random"))


def identifier_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1000) -> DataFrame:
    """Labelled ordinary identifiers: the words of letters in the `most` documents of least md5(id).

    The sample's bound is this parameter; it feeds the model's fit only.
    """
    picked = docs.select(F.col(id_col).cast("string").alias("_id")).where("_id IS NOT NULL").orderBy(F.md5("_id"), "_id").limit(most)
    sample = docs.join(F.broadcast(picked.distinct()), F.col(id_col).cast("string") == F.col("_id"), "left_semi")
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])"), 0)
    return sample.select(F.explode(words).alias("s"), F.lit(0).alias("random"))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of the 128 x 128 ASCII transitions, from (s, random).

    Add-one smoothing over the 66 characters of the candidates' class and the end.
    At most 2 x 128 x 128 counts reach the driver.
    """
    codes = F.transform(F.split("s", ""), lambda c: F.ascii(c))
    steps = let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = samples.where(F.length("s") > 1).select("random", F.explode(steps).alias("x")).select("random", "x.*")
    counts = {(r.random, r.a, r.b): r.n for r in pairs.where("a < 128 AND b < 128").groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    totals: dict[tuple[int, int], int] = {}
    for (kind, a, _), n in counts.items():
        totals[kind, a] = totals.get((kind, a), 0) + n
    p = lambda kind, a, b: (counts.get((kind, a, b), 0) + 1) / (totals.get((kind, a), 0) + 66)
    return [round(math.log(p(1, a, b) / p(0, a, b)), 6) for a in range(_SIZE) for b in range(_SIZE)]


def likely_random(s: Column, ratios: list[float], least: float = 0.5) -> Column:
    """Whether a string's mean log-likelihood ratio a transition is `least` or more.

    Transitions to or from characters outside the candidates' class count 0. Linear in the string's length.
    """
    n, at = len(_ALPHABET), [ord(c) for c in _ALPHABET]
    literal = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one literal
    table = literal([ratios[a * _SIZE + b] for a in at for b in at], "double")
    place = literal([_ALPHABET.find(chr(c)) for c in range(_SIZE)], "int")

    def step(acc, c):
        now = F.coalesce(F.get(place, F.ascii(c)), F.lit(-1))
        known = (acc["before"] >= 0) & (now >= 0)
        return F.struct(now.alias("before"), (acc["sum"] + F.when(known, F.get(table, acc["before"] * n + now)).otherwise(0.0)).alias("sum"))

    zero = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(s, ""), zero, step, lambda acc: acc["sum"]) >= least * (F.length(s) - 1)


def spans_of(text: Column, ratios: list[float]) -> Column:
    """Array of (start, order, kind, end, first, last), sorted by start, then kind; first and last are byte offsets.

    Kinds assign, access and hex are the patterns' spans; kind random is a run that
    the models judge random and that no such span overlaps. Null texts have none.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))

    def tag(spans: Column, kind: str, order: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["first"].alias("first"), x["last"].alias("last")))

    base = [tag(_spans(text, *PATTERNS[k]), k, n) for n, k in enumerate(PATTERNS)]
    random = tag(_spans(text, CANDIDATE, 0, 0, score=lambda s: likely_random(s, ratios)), "random", len(PATTERNS))
    def kept(s: Column) -> Column:
        # random spans overlap no other random one: what counts is how far the base spans before reach, and where the next span begins
        reach = _running(F.transform(s, lambda x: F.when(x["kind"] == "random", 0).otherwise(x["end"])), _most)
        free = lambda x, i, r: (F.get(r, i) <= x["start"]) & F.coalesce(F.get(s, i + 1)["start"] >= x["end"], F.lit(True))
        return let(reach, lambda r: F.filter(s, lambda x, i: (x["kind"] != "random") | free(x, i, r)))

    return let(F.array_sort(F.concat(*base, random)), kept)


def find(docs: DataFrame, ratios: list[float], text_col: str = "text", out_col: str = "found") -> DataFrame:
    """docs with spans_of(text) as out_col; a column of docs with that name is replaced."""
    return docs.withColumn(out_col, spans_of(F.col(text_col), ratios))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_sha256, spans."""
    df = docs.select(F.col(id_col), spans_of(F.col(text_col), ratios).alias("_found"))
    base = F.filter("_found", lambda x: x["kind"] != "random")
    n = lambda kind: F.size(F.filter("_found", lambda x: x["kind"] == kind)).cast("long")
    return df.select(id_col, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_found")).alias("spans"))


def redact(docs: DataFrame, ratios: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by `mark`; spans that overlap become one. Null stays null.

    All other columns stay as they are, whatever their names. The text is cut by byte
    offsets, once, so time is linear in it.
    """
    text = F.col(text_col).cast("string")

    def rebuilt(found: Column) -> Column:
        at = _running(F.transform(found, lambda x: x["last"]), _most)
        gap = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
        between = lambda r: F.concat(F.transform(found, lambda x, i: gap(F.get(r, i), x["first"])), F.array(gap(F.element_at(r, -1), F.octet_length(text))))
        gaps = F.filter(let(at, between), lambda g: g["first"] <= g["last"])
        cut = lambda b: F.transform(gaps, lambda g: F.substring(b, g["first"] + 1, g["last"] - g["first"]).cast("string"))
        return F.when(F.size(found) > 0, F.array_join(let(text.cast("binary"), cut), mark)).otherwise(text)

    return docs.withColumn(text_col, let(spans_of(text, ratios), rebuilt))
