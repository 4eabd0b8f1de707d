"""Selections by quota and class, splits and folds. A seeded shuffle is the order of md5(seed:id)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import order_key
from ..schema import QUOTAS
from ..storage import durable


def shuffled_limit(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of a seeded shuffle: a top-n, not a sort of all."""
    return df.orderBy(order_key(seed, F.col(id_col)), id_col).limit(n)


def _scarcity(df: DataFrame, classes: list[str]) -> list[tuple[str, int]]:
    """Classes and their positives, scarcest first, equals in class order (one row reaches the driver)."""
    row = df.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in classes]).first()
    return sorted(((c, row[c] or 0) for c in classes), key=lambda x: x[1])


def _take(df: DataFrame, chosen: DataFrame | None, where, n: int, id_col: str, seed: int) -> DataFrame:
    """The first n not yet chosen ids of a condition, in seeded order."""
    pool = df.where(where).select(id_col)
    if chosen is not None:
        pool = pool.join(chosen, id_col, "left_anti")
    return shuffled_limit(pool, id_col, n, seed)


def quota_select(df: DataFrame, classes: list[str], n: int, id_col: str = "contract_id", quotas: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(id): n ids, or all there are: each class's quota, scarcest first, then any others.

    df has a 0/1 column a class. A quota is its share of n rounded half to even, 1 at
    least. Each class is a pass, for it depends on what the ones before chose. What a
    pass chooses is written to the shared folder, so no pass repeats another.
    """
    quotas = QUOTAS if quotas is None else quotas
    chosen, size = None, 0
    for c, _ in _scarcity(df, classes):
        take = min(max(1, round(quotas[c] * n)), n - size)
        if take <= 0:
            break
        new = durable(_take(df, chosen, F.col(c) == 1, take, id_col, seed))
        chosen = new if chosen is None else chosen.unionByName(new)
        size += new.count()
    if size < n:
        new = _take(df, chosen, F.lit(True), n - size, id_col, seed)
        chosen = new if chosen is None else chosen.unionByName(new)
    return chosen


def select_test(df: DataFrame, classes: list[str], target: int = 100, negative_ratio: float = 2.0, id_col: str = "contract_id", seed: int = 42) -> DataFrame:
    """(id): up to `target` new positives of each class, scarcest first, then negatives by ratio to the positives."""
    chosen = None
    for c, _ in _scarcity(df, classes):
        new = durable(_take(df, chosen, F.col(c) == 1, target, id_col, seed))
        chosen = new if chosen is None else chosen.unionByName(new)
    clean = ~F.greatest(*[F.col(c) for c in classes]).cast("boolean") if len(classes) > 1 else F.col(classes[0]) == 0
    return chosen.unionByName(_take(df, chosen, clean, round(negative_ratio * chosen.count()), id_col, seed))


def stratified_split(df: DataFrame, classes: list[str], test_share: float = 0.3, id_col: str = "contract_id", seed: int = 42) -> DataFrame:
    """(id, split): scarcest class first, ceil(share x positives) more rows each go to test; then any, up to the share of all.

    Classes with fewer than two positives are left out. Test may exceed its share.
    """
    target = max(1, round(test_share * df.count()))
    chosen = None
    for c, positives in _scarcity(df, classes):
        if positives < 2:
            continue
        new = durable(_take(df, chosen, F.col(c) == 1, max(1, math.ceil(test_share * positives)), id_col, seed))
        chosen = new if chosen is None else chosen.unionByName(new)
    size = chosen.count() if chosen is not None else 0
    if size < target:
        new = _take(df, chosen, F.lit(True), target - size, id_col, seed)
        chosen = new if chosen is None else chosen.unionByName(new)
    return df.select(id_col).join(chosen.withColumn("_t", F.lit(True)), id_col, "left").select(id_col, F.when(F.col("_t"), "test").otherwise("train").alias("split"))


def stratified_folds(df: DataFrame, classes: list[str], k: int = 5, id_col: str = "contract_id", seed: int = 42) -> DataFrame:
    """(id, key, fold): folds even within the key, a row's scarcest class (its index), -1 for none.

    A key's rows are ranked in buckets of their order's first digits and then within,
    so that a frequent key is no single sort.
    """
    rarity = {c: n for c, n in _scarcity(df, classes)}
    order = sorted(range(len(classes)), key=lambda i: (rarity[classes[i]], i))
    key = F.coalesce(*[F.when(F.col(classes[i]) == 1, F.lit(i)) for i in order], F.lit(-1))
    rows = df.select(id_col, key.alias("key"), order_key(seed, F.col(id_col)).alias("h")).withColumn("b", F.substring("h", 1, 2))
    sizes = rows.groupBy("key", "b").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("b")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("key", "b").orderBy("h", id_col)) - 1
    return rows.withColumn("inside", inside).join(sizes, ["key", "b"]).select(id_col, "key", ((F.col("before") + F.col("inside")) % k).cast("int").alias("fold"))


def sorted_limit(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first n rows by id."""
    return df.orderBy(id_col).limit(n)


def fit_sample(df: DataFrame, col: str, cap: int, seed: int = 42) -> DataFrame:
    """Distinct values for a fit, `cap` at most, by seeded order."""
    return shuffled_limit(df.select(col).where(F.col(col).isNotNull()).distinct(), col, cap, seed)


def positives_summary(df: DataFrame, classes: list[str], least: int = 60) -> DataFrame:
    """(class, positives, short): positives of each class, and whether they fall short of `least`."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("long").alias("y")) for c in classes])).alias("x")).select("x.*")
    return long.groupBy("class").agg(F.sum("y").alias("positives")).withColumn("short", F.col("positives") < least)


def select_experts(curated: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of the expert set: every curated contract with its labels as columns, and the positives of each class.

    curated: (contract_id, path, chash, y array). A contract without any class in scope
    stays, as a negative.
    """
    rows = curated.select("contract_id", "path", "chash", *[F.get("y", F.lit(i)).cast("int").alias(c) for i, c in enumerate(classes)])
    total = rows.agg(F.count("*").alias("contracts"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in classes])
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("positives")) for c in classes])
    return rows, total.select("contracts", F.explode(cells).alias("x")).select("contracts", "x.*")
