"""Connected components of a large link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, give_back_heap


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of `links`; component is the smallest node reachable.

    Large-star and small-star steps alternate until all links are stars. Each step is
    one aggregation of minima (partial before the shuffle, so a hub costs one row a
    task) and one join back, whose large partitions adaptive execution splits.
    The links never outnumber those given. Each round's links are written to the
    shared checkpoint folder. Links with a null end and self-links are dropped; an
    empty table gives no rows.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _chains(e):
        give_back_heap(e.sparkSession)  # each round has plans and shuffles of its own
        e = _star(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        e = durable(_star(e, large=False).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _chains(e: DataFrame) -> bool:
    """Whether links (u, v), u > v, are more than stars: a node has two lesser neighbours, or a lesser and a greater one."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    each = e.select(ends.alias("x")).groupBy("x.n").agg(F.sum("x.down").alias("down"), F.max("x.up").alias("up"))
    return bool(each.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0])


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v).

    Large: each neighbour v > u of u is linked to the least of u and its neighbours.
    Small: links run from greater u to lesser v; each u and its v link to their least.
    Rows may repeat.
    """
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select(F.col("u"), F.least("u", "m").alias("m"))
        out = e.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = e.join(least, "u").select("u", "v", "m")
        out = down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
    return out.where("u <> v")
