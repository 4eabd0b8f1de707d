"""Source files, annotations and tool results as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.text import content_hash, normalise_newlines
from ..schema import CATEGORIES, CLASSES

FINDING = "struct<name:string,impact:string,line:int,`swc-id`:string,swc_id:string,check:string,id:string>"


@F.pandas_udf(StringType())
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-8 without the bytes that aren't: Spark's own decoding replaces or raises."""
    for s in batches:
        yield s.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


def scan(spark: SparkSession, root: str, glob: str = "*.sol", skip_resource_forks: bool = True) -> DataFrame:
    """(path, modified, content) of all files below root; without __MACOSX folders and ._ files if asked."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    df = df.select("path", F.col("modificationTime").alias("modified"), "content")
    if skip_resource_forks:
        df = df.where(~F.col("path").rlike(r"(^|/)__MACOSX(/|$)|/\._[^/]*$"))
    return df


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_sources(spark: SparkSession, root: str, glob: str = "*.sol") -> DataFrame:
    """(contract_id, path, source): decoded leniently, line ends as \\n."""
    df = scan(spark, root, glob)
    return df.select(stem(F.col("path")).alias("contract_id"), "path", normalise_newlines(_decoded("content")).alias("source"))


def parse_annotations(records: DataFrame) -> DataFrame:
    """(stem, lines): distinct sorted gold lines of entries in scope.

    records: (pos, name, category, vulnerability, lines, line, vulnerabilities), as
    annotation JSON has them; an entry is the record itself or each of its nested
    vulnerabilities. The last record of a stem holds.
    """
    last = records.withColumn("stem", stem(F.col("name"))).groupBy("stem").agg(F.max_by(F.struct("category", "lines", "vulnerabilities"), "pos").alias("r"))
    nested = F.coalesce(F.col("r.vulnerabilities"), F.array(F.struct(F.col("r.category").alias("category"), F.col("r.lines").alias("lines"))))
    in_scope = F.filter(nested, lambda e: F.lower(e["category"]).isin(list(CATEGORIES)))
    lines = F.flatten(F.transform(in_scope, lambda e: F.coalesce(e["lines"], F.array().cast("array<int>"))))
    return last.select("stem", F.array_sort(F.array_distinct(lines)).alias("lines"))


def curated(sources: DataFrame, gold: DataFrame) -> DataFrame:
    """(contract_id, path, chash, y, lines) from labelled folders: dataset/<category>/<stem>.sol.

    Files of one stem and hash merge, their labels or'ed; of one stem and several
    hashes, the first by path keeps the name, others are named stem__category. Gold
    lines go by the original stem.
    """
    rows = sources.withColumn("category", F.element_at(F.split("path", "/"), -2)).withColumn("chash", content_hash(F.col("source")))
    label = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    rows = rows.withColumn("flaw", F.try_element_at(label, F.col("category")))
    merged = rows.groupBy("contract_id", "chash").agg(F.min(F.struct("path", "category")).alias("f"), *[F.max((F.coalesce(F.col("flaw") == c, F.lit(False))).cast("int")).alias(c) for c in CLASSES])
    first = F.row_number().over(Window.partitionBy("contract_id").orderBy("f.path"))
    merged = merged.withColumn("_n", first).join(gold.withColumnRenamed("stem", "contract_id"), "contract_id", "left")
    name = F.when(F.col("_n") == 1, F.col("contract_id")).otherwise(F.concat_ws("__", "contract_id", "f.category"))
    return merged.select(name.alias("contract_id"), "f.path", "chash", F.array(*CLASSES).alias("y"), F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))


def tool_results(spark: SparkSession, root: str) -> DataFrame:
    """(contract, tool, findings) from <tool-id>/<run>/<contract>/result.json: the greatest run holds, unparseable files don't count."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").text(root, wholetext=True).withColumn("path", F.input_file_name())
    return parse_tool_results(raw.select("path", "value"))


def parse_tool_results(raw: DataFrame) -> DataFrame:
    """tool_results of (path, value) rows. A result without findings keeps a null: it abstains."""
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    data = F.from_json("value", f"errors array<string>, findings array<{FINDING}>", {"mode": "PERMISSIVE"})
    rows = raw.select(F.regexp_replace(part(2), r"\.[^.]*$", "").alias("contract"), F.lower(F.get(F.split(part(4), "-"), F.lit(0))).alias("tool"), part(3).alias("run"), data.alias("d"))
    rows = rows.where("d.findings IS NOT NULL")
    return rows.groupBy("contract", "tool").agg(F.max_by("d.findings", "run").alias("findings"))


def parse_legacy_result(raw: DataFrame, *carry: str) -> DataFrame:
    """(carry, contract, tool, idents) of (path, value): older field names; an empty field counts as missing."""
    field = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{n}"), F.lit("")) for n in names])
    entries = F.from_json(F.coalesce(F.get_json_object("value", "$.findings"), F.get_json_object("value", "$.errors"), F.lit("[]")), "array<string>")
    own = lambda x, n: F.nullif(F.get_json_object(x, n), F.lit(""))
    ident = lambda x: F.when(x.startswith("{"), F.coalesce(own(x, "$.check"), own(x, "$.name"), own(x, "$['swc-id']"), own(x, "$.id"), F.lit(""))).otherwise(x)
    return raw.select(*carry, F.coalesce(field("contract", "filename"), stem(F.col("path"))).alias("contract"), F.lower(F.coalesce(field("tool", "analysis"), F.lit(""))).alias("tool"), F.transform(entries, ident).alias("idents"))


def parse_detectors(value: Column) -> Column:
    """Detector names of a payload's results; null unless it reports success, empty for none."""
    d = F.from_json(value, "success boolean, results struct<detectors:array<struct<`check`:string>>>")
    checks = F.transform(d["results"]["detectors"], lambda x: x["check"])
    return F.when(d["success"], F.coalesce(checks, F.array().cast("array<string>")))


def parse_issues(value: Column) -> Column:
    """SWC- numbers of a payload's issues; null if it failed."""
    d = F.from_json(value, "success boolean, error string, issues array<struct<`swc-id`:string>>")
    number = lambda x: F.when(F.upper(x["swc-id"]).startswith("SWC-"), x["swc-id"]).otherwise(F.concat(F.lit("SWC-"), x["swc-id"]))
    return F.when(d["success"], F.transform(F.coalesce(d["issues"], F.array().cast("array<struct<`swc-id`:string>>")), number))


def newest_by_minor(installed: DataFrame) -> DataFrame:
    """(minor, version, path): the newest patch of each minor version, compared as numbers; names that are no version drop.

    installed: (name, path), names such as solc-0.4.25.
    """
    parts = F.split(F.regexp_extract("name", r"(\d+\.\d+\.\d+)$", 1), r"\.")
    rows = installed.select("path", F.transform(parts, lambda x: x.try_cast("int")).alias("v")).where("size(v) = 3")
    best = rows.groupBy(F.concat_ws(".", F.col("v")[0].cast("string"), F.col("v")[1].cast("string")).alias("minor")).agg(F.max(F.struct("v", "path")).alias("x"))
    return best.select("minor", F.array_join(F.col("x.v").cast("array<string>"), ".").alias("version"), "x.path")


def results_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def file_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of all files below a folder: what a release holds."""
    return scan(spark, root, glob, skip_resource_forks=False).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(manifest: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """(key, problem): missing, changed or extra files of a release against its manifest."""
    both = manifest.select(key, F.col("sha256").alias("was")).join(now.select(key, F.col("sha256").alias("is")), key, "full")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") != F.col("is"), "changed")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")
