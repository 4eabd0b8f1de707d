"""Duplicates and leaks: content hashes, reserved rows, splits that share nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def with_hash(df: DataFrame, source_col: str = "source") -> DataFrame:
    return df.withColumn("chash", X.content_hash(F.col(source_col)))


def first_per_hash(df: DataFrame, path_col: str = "path") -> DataFrame:
    """One row a hash: the first in path order, by path parts.

    A partial aggregation before the shuffle, so copies of one text don't meet as rows.
    """
    cols = [c for c in df.columns if c != "chash"]
    best = F.min(F.struct(F.split(path_col, "/").alias("_key"), *cols)).alias("x")
    return df.groupBy("chash").agg(best).select(*[F.col("x")[c].alias(c) for c in cols], "chash")


def drop_stem_collisions(df: DataFrame, stem_col: str = "contract_id", path_col: str = "path") -> DataFrame:
    """Of rows of one stem, those of the first row's hash.

    The first is found by an aggregation, partial before the shuffle, and joined back,
    so a common stem's rows meet in no window.
    """
    first = df.groupBy(F.col(stem_col).alias("_stem")).agg(F.min_by("chash", F.split(path_col, "/")).alias("_first"))
    return df.join(first, F.col(stem_col) == F.col("_stem")).where("chash = _first").drop("_stem", "_first")


def reserved_hashes(*manifests: DataFrame) -> DataFrame:
    """Distinct hashes of all manifests."""
    out = manifests[0].select("chash")
    for m in manifests[1:]:
        out = out.unionByName(m.select("chash"))
    return out.distinct()


def split_by_reserved(pool: DataFrame, reserved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows whose hash is free, and rows whose hash is reserved."""
    r = reserved.select("chash").distinct()
    return pool.join(r, "chash", "left_anti"), pool.join(r, "chash", "left_semi")


def leaks(train: DataFrame, test: DataFrame) -> DataFrame:
    """(n_leaks, example): hashes on both sides and the least of them."""
    both = train.select("chash").intersect(test.select("chash"))
    return both.agg(F.count("*").alias("n_leaks"), F.min("chash").alias("example"))


def assert_no_leak(train: DataFrame, test: DataFrame) -> None:
    """Raises if the two share a hash (an action: one row)."""
    row = leaks(train, test).first()
    if row.n_leaks:
        raise ValueError(f"{row.n_leaks} hashes are in both splits, such as {row.example}")


def mismatches(records: DataFrame, manifest: DataFrame, id_col: str, labels: list[str]) -> DataFrame:
    """Ids whose labels differ between two tables; nulls are compared as values."""
    differ = ~F.lit(True)
    for c in labels:
        differ = differ | ~F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
    return records.alias("r").join(manifest.alias("m"), id_col).where(differ).select(id_col)


def recover(needed: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """needed with the least path of the corpus of the same key, null if none has it."""
    best = corpus.groupBy(key).agg(F.min("path").alias("path"))
    return needed.join(best, key, "left")


def coverage_report(recovered: DataFrame, id_col: str, show: int = 20) -> DataFrame:
    """needed, recovered, missing, ratio (4 places) and the first missing ids, one row."""
    missing = F.col("path").isNull()
    ids = recovered.where(missing).orderBy(id_col).limit(show).agg(F.array_sort(F.collect_list(id_col)).alias("first_missing"))
    total = recovered.agg(F.count("*").alias("needed"), F.count("path").alias("recovered"))
    total = total.withColumn("missing", F.col("needed") - F.col("recovered")).withColumn("ratio", F.round(F.col("recovered") / F.greatest(F.col("needed"), F.lit(1)), 4))
    return total.join(F.broadcast(ids))


def plan_splits(pool: DataFrame, frozen: DataFrame, validation: DataFrame) -> DataFrame:
    """(chash, contract_id, split): frozen rows are test, chosen ids validation, the rest of the free pool train."""
    free, _ = split_by_reserved(pool, frozen)
    val = validation.select("contract_id").distinct().withColumn("_val", F.lit(True))
    rest = free.join(val, "contract_id", "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train"))
    return rest.select("chash", "contract_id", "split").unionByName(frozen.select("chash", "contract_id", F.lit("test").alias("split")))


#: Reserved items of at most so many bytes in all may travel to the texts as one literal.
MOST_ITEM_BYTES = 8 << 20
#: Keys of items that may stand in a plan, at most.
MOST_KEYS = 16_384


def holders(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_col: str = "item") -> DataFrame:
    """(id, item id) of the texts that hold a reserved item whole, as a run of characters.

    An item of five words or more is met at three words inside it, for its ends may lie
    within a text's words; the item then decides. Shorter items have no such words: they
    are looked for where the texts are read. Items are few as a rule: their keys and
    short items travel to the texts, once their size is checked. Larger sets of keys
    meet the texts' keys by shuffle; larger sets of short items raise.
    """
    probes = items.where(F.col(item_col).isNotNull() & (F.col(item_col) != "")).select(F.col(item_id).alias("_item_id"), F.col(item_col).alias("_item"), X.tokens(F.col(item_col)).alias("_words"))
    size = probes.agg(F.sum(F.when(F.size("_words") < 5, F.octet_length("_item"))).alias("short"), F.count_if(F.size("_words") >= 5).alias("keyed"), F.sum(F.octet_length("_item")).alias("all")).first()
    key = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(3)])
    keyed = probes.where(F.size("_words") >= 5).select("_item_id", "_item", key(F.col("_words"), F.lit(1)).alias("_key"))
    # three words a text, at every place, that might be an item's
    grams = docs.select(F.col(id_col), F.col(text_col), X.tokens(F.col(text_col)).alias("_w")).where(F.size("_w") > 2)
    every = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: key(F.col("_w"), i))
    if size.keyed <= MOST_KEYS and (size.all or 0) <= MOST_ITEM_BYTES:
        known = [r[0] for r in keyed.select("_key").distinct().collect()]
        literal = F.split(F.lit(",".join(map(str, known))), ",").cast("array<bigint>")
        met = grams.select(id_col, text_col, F.explode(F.array_intersect(every, literal)).alias("_key")) if known else grams.select(id_col, text_col, F.lit(0).cast("long").alias("_key")).limit(0)
        found = met.join(F.broadcast(keyed), "_key").where(F.contains(text_col, "_item")).select(id_col, F.col("_item_id").alias(item_id))
    else:
        pairs = grams.select(id_col, F.explode(F.array_distinct(every)).alias("_key")).join(keyed, "_key").distinct()
        found = pairs.join(docs.select(id_col, text_col), id_col).where(F.contains(text_col, "_item")).select(id_col, F.col("_item_id").alias(item_id))
    if not size.short:
        return found
    if size.short > MOST_ITEM_BYTES:
        raise ValueError(f"short items of {size.short} bytes; at most {MOST_ITEM_BYTES} can travel to the texts: look by parts of the table")
    short = F.broadcast(probes.where(F.size("_words") < 5).agg(F.collect_list(F.struct("_item_id", "_item")).alias("_short")))
    held = F.filter("_short", lambda x: F.contains(F.col(text_col), x["_item"]))
    return found.unionByName(docs.join(short).select(id_col, F.explode(held).alias("_x")).select(id_col, F.col("_x._item_id").alias(item_id)))
