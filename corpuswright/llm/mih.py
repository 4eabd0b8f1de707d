"""Exact top-k search in Hamming space by incremental multi-index hashing.

The index is one global table: every distinct code stands in it once for each of
its segments, under the segment's value. In round r each query that is still open
asks for all segment values that differ from its own in r bits; Spark joins these
probes to the index by (segment, value), and the codes met are verified by their
full distance. A code that shares no segment within r bits lies at segments x (r + 1)
or further, so a query closes once its k-th verified distance is less than that.
Rounds of many probes go segment by segment: each covers one bit of distance more,
and most queries close before the last. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import durable


def sign_word(vector: Column, word: int) -> Column:
    """The signs (above zero) of a vector's entries 64 x word .. 64 x word + 63 as the bits of a long; 0 beyond its end."""
    bits = F.transform(F.slice(vector, 64 * word + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(dims: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of the segments: some dims / log2(codes), none across words, so a value has a code or so."""
    words, out = max(1, math.ceil(dims / 64)), []
    each = max(1, round(dims / max(math.log2(max(codes, 2)), 1) / words))
    for w in range(words):
        bits = min(64, max(dims, 1) - 64 * w)
        n = min(max(each, math.ceil(bits / 30)), bits)
        cuts = [bits * i // n for i in range(n + 1)]
        out += [(w, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


#: Probes of a segment beyond which a round goes segment by segment.
_MOST = 1024


def steps(parts: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[int], int]]:
    """(radius, segments probed together, the distance up to which all codes have been met then)."""
    for r in range(max(width for _, _, width in parts) + 1):
        own = [i for i, s in enumerate(parts) if r <= s[2]]
        for some in [[i] for i in own] if max(math.comb(parts[i][2], r) for i in own) > _MOST else [own]:
            yield r, some, len(parts) * (r + (some[-1] == own[-1])) + (-1 if some[-1] == own[-1] else some[-1])


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # folded to one literal


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): each query row's k nearest rows by Hamming distance of sign codes.

    All entries of the vectors count; a shorter vector's missing entries count as not
    above zero. Exact; ties go to the smaller id; a query that is among the vectors
    finds itself. Ids keep their type. Rows with a null id or vector are no
    neighbours, and such queries get no rows; repeated rows count each. Rows of one
    code beyond the k smallest ids can be in no answer and are dealt out by a salt
    before they are ranked, so a frequent vector meets in no task. Fewer than k rows
    give fewer neighbours.
    """
    sizes = [df.agg(F.max(F.size(vector_col))).first()[0] or 0 for df in (vectors, queries)]
    dims = max(*sizes, 1)
    c, q = ([f"{x}{w}" for w in range(math.ceil(dims / 64))] for x in "cq")
    coded = lambda df, ident, names: df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias(ident), *(sign_word(F.col(vector_col), w).alias(n) for w, n in enumerate(names)))
    salted = coded(vectors, "id", c).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy(*c, "salt").orderBy("id"))).where(F.col("n") <= k)
    few = durable(few.withColumn("n", F.row_number().over(Window.partitionBy(*c).orderBy("id", "salt"))).where(F.col("n") <= k).select(*c, "id"))
    codes = durable(few.groupBy(*c).agg(F.count("*").alias("weight"), F.min("id").alias("least")))
    asked = durable(coded(queries, "query_id", q))
    parts = segments(dims, codes.count())
    value = lambda names, s: F.shiftrightunsigned(F.col(names[s[0]]), s[1]).bitwiseAND(F.lit((1 << s[2]) - 1).cast("long"))
    index = codes.select(*c, "weight", "least", F.posexplode(F.array(*(value(c, s) for s in parts))).alias("s", "v"))
    open_ = asked.select(*q).distinct()
    best, closed = None, []
    nearest = Window.partitionBy(*q).orderBy("distance", "least")
    for r, some, covered in steps(parts):
        masks = {width: _longs([sum(1 << i for i in x) for x in combinations(range(width), r)]) for width in {parts[i][2] for i in some}}
        probe = lambda i, s: F.transform(masks[s[2]], lambda m: F.struct(F.lit(i).alias("s"), value(q, s).bitwiseXOR(m).alias("v")))
        probes = [probe(i, parts[i]) for i in some]
        met = open_.select(*q, F.explode(F.concat(*probes)).alias("p")).select(*q, "p.*").join(index, ["s", "v"])
        apart = [F.bit_count(value(q, s).bitwiseXOR(value(c, s))) for s in parts]
        # a code counts at the least radius of its segments, in the first segment that has it
        new = [F.when(F.col("s") > i, d > r).otherwise(d >= r) for i, d in enumerate(apart)]
        whole = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(q[1:], c[1:], strict=True)), F.bit_count(F.col(q[0]).bitwiseXOR(F.col(c[0]))))
        for cond in new:
            met = met.where(cond)
        found = met.select(*q, *c, "weight", "least", whole.alias("distance"))
        # k codes a query are enough: an answer has a row of each of its codes' least ids
        best = found if best is None else best.unionByName(found)
        best = durable(best.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n"))
        done = best.where(F.col("distance") <= covered).groupBy(*q).agg(F.sum("weight").alias("w")).where(F.col("w") >= k).select(*q)
        closed.append(best.join(done, q, "left_semi"))
        open_ = durable(open_.join(done, q, "left_anti"))
        best = best.join(done, q, "left_anti")
        if not open_.take(1):
            break
    for x in closed:
        best = best.unionByName(x)
    hits = best.join(few, c).select(*q, "distance", F.col("id").alias("neighbor_id"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*q).orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return asked.join(hits, q).select("query_id", "rank", "neighbor_id", "distance")
