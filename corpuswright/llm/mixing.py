"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Golden-ratio points, mapped through the cumulative weights, give each slot of the
schedule its source; a slot's rank within its source picks the block. Each
source's documents, in an order of hashes, form one stream of words that is cut
into equal blocks. DataFrame functions only.

Blocks have one nominal length at every size of the corpus, shorter only in sources
that would otherwise have few; a source takes the rounded number of blocks that its
target asks for, so it comes within half a block of it. Positions in a source's
stream are sums over 4096 hash buckets of it and then places within a bucket; slots
are ranked chunk by chunk. Plans have a row a source and are made in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, durable

GOLDEN = 0.6180339887498949
_BINS = 1024
_SLOT_CHUNK = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source, source_size, weight, target) from (key, source, source_size).

    Sources in code-point order, null last, get the weights in turn and share
    `share` times all words; no target is above `most` times its source's size, and
    what is cut goes to the others by weight. That is one water level L with
    target = least(cap, L * weight), found by cumulative sums in the order of
    cap / weight. This ranks the sources in one task: a row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0)).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all_words") * share - F.col("full")) / F.col("rest"))
    s = s.withColumn("reached", F.first(F.when(F.col("level") <= F.col("fill"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("key", "source", "source_size", "weight", F.least("cap", F.coalesce("reached", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _with_blocks(plan: DataFrame, block_words: int, least_blocks: int) -> DataFrame:
    """The plan with n_blocks, the short block's length, how many blocks are a word longer, the share of slots and the quota of blocks."""
    total = Window.partitionBy(F.lit(0)).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.greatest(F.lit(float(least_blocks)), F.round(F.col("source_size") / float(block_words))).cast("long")
    p = plan.withColumn("n_blocks", F.least("source_size", wanted))  # a block has a word at least
    p = p.withColumn("short", F.when(F.col("n_blocks") > 0, F.expr("source_size div greatest(n_blocks, 1)")).otherwise(0))
    p = p.withColumn("longer", F.col("source_size") - F.col("short") * F.col("n_blocks"))
    p = p.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    p = p.withColumn("quota", F.floor(F.col("share") + 0.5).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    p = p.withColumn("upto", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return p.withColumn("slots", F.ceil(F.sum("share").over(total)).cast("long"))


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, key, rank, epoch, block): the source and block of every slot.

    `plan` has a row a source: key, n_blocks, quota, share, upto, slots. Points and
    intervals meet by equal bins of the unit interval, then by the interval itself.
    A source's blocks come in order, again and again, until its quota is met. The
    points give each source its quota within a block or two: further ranks are not
    used, and missing ones follow at the end.
    """
    spark = plan.sparkSession
    slots = plan.agg(F.max("slots")).first()[0] or 0
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN))
    points = points.withColumn("bin", F.floor(F.col("x") * _BINS).cast("int"))
    whole = F.greatest(F.col("whole"), F.lit(1e-300))
    spans = plan.withColumn("whole", F.max("upto").over(Window.partitionBy(F.lit(0)).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    spans = spans.where("share > 0").withColumn("lo", (F.col("upto") - F.col("share")) / whole).withColumn("hi", F.when(F.col("upto") >= F.col("whole"), F.lit(2.0)).otherwise(F.col("upto") / whole))
    # an interval begins where the one before it ends, to the last bit
    prior = Window.orderBy("upto")
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(prior), F.lit(0.0)))
    last = F.least(F.lit(_BINS - 1), F.floor(F.col("hi") * _BINS)).cast("int")
    spans = spans.select("key", "n_blocks", "quota", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * _BINS).cast("int"), last)).alias("bin"))
    drawn = points.join(spans, "bin").where("x >= lo AND x < hi").select("slot", "key", "n_blocks", "quota", F.expr(f"slot div {_SLOT_CHUNK}").alias("chunk"))
    per = durable(drawn.groupBy("key", "chunk").agg(F.count("*").alias("n")))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(before, ["key", "chunk"]).withColumn("rank", F.col("before") + F.col("inside")).where(F.col("rank") < F.col("quota"))
    count = per.groupBy("key").agg(F.sum("n").alias("n"))
    late = plan.join(count, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < quota").select("key", "n_blocks", F.explode(F.sequence(F.col("n"), F.col("quota") - 1)).alias("rank"))
    every = ranked.select("slot", "key", "n_blocks", "rank").unionByName(late.select((F.lit(slots) + F.col("rank")).alias("slot"), "key", "n_blocks", "rank"))
    return every.select("slot", "key", "rank", F.expr("rank div n_blocks").alias("epoch"), (F.col("rank") % F.col("n_blocks")).alias("block"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
    block_words: int = 512,
    least_blocks: int = 256,
) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, taken, copies.

    size: words of the text, 0 for null; taken: words that the schedule takes of the
    row, repeats counted; copies: how often the block with its first word is taken.
    taken comes within half a block of each source's target; a block has `block_words`
    words, or fewer where a source would have less than `least_blocks` blocks.
    The order within a source is md5(seed:id), then id, then size; equal rows are
    interchangeable. Rows without words take nothing. Null sources form one source,
    the last; null ids sort by their hash of an empty string. Runs agree.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col), F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col).cast("string")).alias("size"))
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    rows = durable(rows).withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.substring("h", 1, 3))
    buckets = durable(rows.groupBy("key", "bucket").agg(F.min("source").alias("source"), F.sum("size").alias("n")))
    sizes = buckets.groupBy("key").agg(F.min("source").alias("source"), F.sum("n").alias("source_size"))
    plan = durable(_with_blocks(targets(sizes, weights, share, float(most)), block_words, least_blocks))
    uses = schedule(plan).groupBy("key", "block").agg(F.count("*").alias("uses"))
    along = Window.partitionBy("key").orderBy("bucket")
    offsets = buckets.withColumn("offset", F.sum("n").over(along) - F.col("n")).select("key", "bucket", "offset")
    offsets = offsets.join(plan.select("key", "source_size", "target", "n_blocks", "short", "longer"), "key")
    within = Window.partitionBy("key", "bucket").orderBy("h", F.col(id_col), "size")
    placed = rows.withColumn("at", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.join(offsets, ["key", "bucket"]).withColumn("at", F.col("at") + F.col("offset"))
    border = F.expr("longer * (short + 1)")
    block = lambda x: F.when(x < border, F.floor(x / (F.col("short") + 1))).otherwise(F.col("longer") + F.floor((x - border) / F.greatest(F.col("short"), F.lit(1)))).cast("long")
    first, last = block(F.col("at")), block(F.col("at") + F.col("size") - 1)
    pieces = placed.where("size > 0").select("row", "key", "at", "size", "short", "longer", first.alias("b0"), F.explode(F.sequence(first, last)).alias("block"))
    start = F.expr("block * short + least(block, longer)")
    end = F.expr("(block + 1) * short + least(block + 1, longer)")
    taken = (F.least(F.col("at") + F.col("size"), end) - F.greatest(F.col("at"), start)) * F.col("uses")
    took = pieces.join(uses, ["key", "block"]).groupBy("row").agg(F.sum(taken).alias("taken"), F.max(F.when(F.col("block") == F.col("b0"), F.col("uses"))).alias("copies"))
    zero = F.lit(0).cast("long")
    return placed.join(took, "row", "left").select(
        F.col(id_col), "source", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("copies", zero).alias("copies")
    )
