"""SimHash fingerprints and their near-duplicate classes by bit-sliced comparison."""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import LOWER_BYTES, binary_column, durable, fresh, mix64
from .components import connected_components

_LANES = 64
#: Fingerprints of one key that a task compares; larger groups are cut into pairs of chunks.
CHUNK = 4096
#: Shingle sets of one class of candidates that are verified at a time; larger classes are cut likewise.
SET_CHUNK = 2048


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of the text's shingles, repeats included; none without words."""
    import xxhash

    tokens = (text or b"").translate(LOWER_BYTES).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    flat = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = xxhash.xxh64_intdigest
    return np.array([h(flat[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [h(flat, 42)], dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = 3, words: int = 1) -> list[int]:
    """SimHash of `words` x 64 bits over the text's shingles, repeats included.

    The first word comes from the shingles' XXH64 (seed 42), further ones from a
    mixing of it.
    """
    return _folded(shingles(text, shingle), words)


def _folded(hashes: np.ndarray, words: int) -> list[int]:
    if not len(hashes):
        return [0] * words
    out = []
    for w in range(words):
        with np.errstate(over="ignore"):
            own = mix64(hashes + np.uint64(w) * np.uint64(0x9E3779B97F4A7C15)) if w else hashes
        total = np.zeros(64, dtype=np.int64)
        for i in range(0, len(own), 65536):
            a = own[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(a, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(total * 2 > len(own)).tobytes(), "big"))
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, words: int = 1, node: bool = False) -> DataFrame:
    """The other columns of docs, with fp0 .. fpN: the words of each row's fingerprint as signed longs. No shuffle.

    With `node` also a hash of the text's set of shingles, as column node. Columns of these names are replaced.
    """
    import pyarrow as pa
    import xxhash

    from .bpe import _extended

    names = [*(["node"] if node else []), *(f"fp{w}" for w in range(words))]
    rest = [c for c in docs.columns if c != text_col and c not in names]
    docs = docs.select(*rest, F.col(text_col).cast("string").alias(text_col))
    schema = _extended(docs.drop(text_col).schema, **dict.fromkeys(names, "long"))

    def make(batches):
        for b in batches:
            out = []
            for t in binary_column(b, text_col):
                h = shingles(t, shingle)
                out.append([*([xxhash.xxh64_intdigest(np.unique(h).tobytes(), 42)] if node else []), *_folded(h, words)])
            wide = np.array(out, dtype=np.uint64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(wide[:, w]).view(np.int64)) for w in range(len(names)))], [f.name for f in schema])

    return docs.mapInArrow(make, schema)


def _sets(rows: DataFrame, shingle: int, asked) -> DataFrame:
    """(own, t, _set) of the rows (own, t, text) whose t passes the test `asked`: the sorted set of the text's shingles."""
    import pyarrow as pa

    def make(batches):
        for b in batches:
            some = b.filter(pa.array(asked(b.column(1).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array([np.unique(shingles(t, shingle)).tobytes() for t in binary_column(some, "text")], pa.binary())], ["own", "t", "_set"])

    return rows.select("own", "t", "text").mapInArrow(make, "own string, t long, _set binary")


def set_links(sets: list[np.ndarray], tenths: int = 8) -> list[tuple[int, int]]:
    """Links that span the classes of sets (sorted, distinct) whose Jaccard similarity is tenths / 10 or more.

    From each set found, all those not found yet are compared at once.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    uniq, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    own = np.split(col, np.cumsum(size)[:-1])
    open_, out = np.ones(n, bool), []
    for first in range(n):
        if not open_[first]:
            continue
        open_[first] = False
        todo = [first]
        while todo and open_.any():
            a = todo.pop()
            mark = np.zeros(len(uniq), bool)
            mark[own[a]] = True
            common = np.bincount(row[mark[col]], minlength=n)
            hit = np.flatnonzero(open_ & ((10 + tenths) * common >= tenths * (size + size[a])))
            open_[hit] = False
            out += [(a, int(b)) for b in hit]
            todo += hit.tolist()
            if 2 * open_.sum() < len(np.unique(row)) and len(row):
                live = open_[row]
                row, col = row[live], col[live]
    return out


def cross_links(sets: list[np.ndarray], label: np.ndarray, left: int, tenths: int = 8) -> list[tuple[int, int]]:
    """Links between the first `left` sets and the others, that span the classes which the labels and those links make."""
    size = np.array([len(x) for x in sets], np.int64)
    uniq, col = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(col, np.cumsum(size)[:-1])
    n, label, out = len(sets) - left, label.copy(), []
    row, col = np.repeat(np.arange(n), size[left:]), col[int(size[:left].sum()) :]
    for a in range(left):
        if not (label[left:] != label[a]).any():
            continue
        mark = np.zeros(len(uniq), bool)
        mark[own[a]] = True
        common = np.bincount(row[mark[col]], minlength=n)
        for b in left + np.flatnonzero((10 + tenths) * common >= tenths * (size[left:] + size[a])):
            if label[b] != label[a]:
                label[label == label[b]] = label[a]
                out.append((a, int(b)))
    return out


def verified_links(dealt: DataFrame) -> DataFrame:
    """Links (a, b) that span the classes of nodes of one root by their shingle sets, from (root, c, mine, node, _set).

    All pairs of a root's nodes count, and the sets decide alone. A root has c
    chunks; of more than one, each pair of chunks is compared for itself.
    """
    import pyarrow as pa

    other = F.when(F.col("c") > 1, F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda x: x != F.col("mine"))).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("o", F.explode(other)).select("root", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "c", "mine", "node", "_set")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "mine", "node")

    def compare(batches):
        key, rows = None, []

        def found():
            if len(rows) < 2:
                return [], []
            nodes, sets = [x[1] for x in rows], [np.frombuffer(x[2], np.uint64) for x in rows]
            (_, i, j, c), left = key, sum(x[0] == key[1] for x in rows)
            links, label = [], np.arange(len(rows))
            for start, end, told in ((0, left, j <= i + 1), (left, len(rows), i == c - 2)):  # each chunk's own links are told once
                inner = set_links(sets[start:end]) if end - start > 1 else []
                for x, y in inner:  # y is new to its class
                    label[start + y] = label[start + x]
                links += [(start + x, start + y) for x, y in inner if told]
            if 0 < left < len(rows):
                links += cross_links(sets, label, left)
            return [nodes[x] for x, _ in links], [nodes[y] for _, y in links]

        batch_of = lambda ab: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ab], ["a", "b"])
        for batch in batches:
            for root, i, j, c, mine, node, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (root, i, j, c) != key:
                    yield batch_of(found())
                    key, rows = (root, i, j, c), []
                if not rows or rows[-1][1] != node:  # equal rows come together
                    rows.append((mine, node, content))
        yield batch_of(found())

    return dealt.mapInArrow(compare, "a long, b long")


def _maybe(nodes: DataFrame, node: str, bits: int = 1 << 26):
    """A test (array of hashes -> mask) that holds for all the nodes and few others; `bits` are fixed, for it only saves a shuffle."""
    import pyarrow as pa

    width = bits // 1024

    def build(batches):
        now, own = -1, np.zeros(width, bool)
        for b in batches:
            for shard, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != now:
                    if now >= 0:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["shard", "bits"])
                    now, own = shard, np.zeros(width, bool)
                own[p] = True
        if now >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["shard", "bits"])

    at = F.col(node).bitwiseAND(F.lit(bits - 1))
    places = nodes.select(F.shiftright(at, (width - 1).bit_length()).cast("int").alias("shard"), at.bitwiseAND(F.lit(width - 1)).alias("p")).distinct()
    held = np.zeros(bits // 8, np.uint8)
    for r in places.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, bits binary").collect():
        held[r.shard * width // 8 : (r.shard + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    sent = nodes.sparkSession.sparkContext.broadcast(held)

    def test(hashes: np.ndarray) -> np.ndarray:
        p = hashes & np.uint64(bits - 1)
        return ((sent.value[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)

    return test


def _planes(fps: np.ndarray) -> np.ndarray:
    """Vertical store of fingerprints (rows, words): entry [bit, block] holds that bit of the block's 64 rows."""
    pad = -len(fps) % _LANES
    lanes = np.concatenate([fps, np.zeros((pad, fps.shape[1]), np.uint64)]).reshape(-1, _LANES, fps.shape[1])
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), _LANES, -1), axis=2, bitorder="little")  # block, lane, bit
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def near(queries: np.ndarray, blocks: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For pairs (query fingerprint, block number): a word whose bits mark the lanes within the radius.

    The distances of a block's 64 lanes are counted together: each bit plane,
    exclusive-or'ed with the query's bit, is added to binary counters by
    carry-save steps, and a sticky word marks lanes past the radius. Pairs whose
    lanes are all past it leave the comparison.
    """
    width = (radius + 1).bit_length()
    out = np.zeros(len(queries), dtype=np.uint64)
    live = np.arange(len(queries))
    q, blk = queries, blocks
    count = [np.zeros(len(q), np.uint64) for _ in range(width)]
    past = np.zeros(len(q), np.uint64)
    for bit in range(len(planes)):
        own = (q[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        carry = planes[bit][blk] ^ (np.uint64(0) - own)
        for c in range(width):
            count[c], carry = count[c] ^ carry, count[c] & carry
        past |= carry
        if bit < radius:
            continue
        # lanes at radius + 1 are past it for good
        at = ~np.uint64(0) ^ past
        for c in range(width):
            at &= count[c] if (radius + 1) >> c & 1 else ~count[c]
        past |= at
        if bit % 8 == 7:
            keep = past != ~np.uint64(0)
            if not keep.all():
                live, q, blk, past = live[keep], q[keep], blk[keep], past[keep]
                count = [x[keep] for x in count]
                if not len(live):
                    return out
    out[live] = ~past
    return out


def _links(fps: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the classes among rows `left` and `right` of fps: a forest over their labels."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    planes = _planes(fps[right])
    n = planes.shape[1]
    out: list[tuple[int, int]] = []
    step = max(1, 100_000 // n)
    for i in range(0, len(left), step):
        some = left[i : i + step]
        hit = near(np.repeat(fps[some], n, axis=0), np.tile(np.arange(n), len(some)), planes, radius)
        for p in np.flatnonzero(hit):
            a = int(some[p // n])
            word, base = int(hit[p]), int(p % n) * _LANES
            while word:
                lane = (word & -word).bit_length() - 1
                word &= word - 1
                if base + lane >= len(right):
                    break
                b = int(right[base + lane])
                x, y = root(int(label[a])), root(int(label[b]))
                if x != y:
                    parent[x] = y
                    out.append((a, b))
    return np.array([a for a, _ in out], np.int64), np.array([b for _, b in out], np.int64)


def _small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links (row numbers) within many groups of at most 64: each group is one block, compared together."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    lanes = np.zeros((len(starts), _LANES, fps.shape[1]), np.uint64)
    which = np.repeat(np.arange(len(starts)), sizes)
    lane = np.arange(len(fps)) - np.repeat(starts, sizes)
    lanes[which, lane] = fps
    hit = near(fps, which, _planes(lanes.reshape(-1, fps.shape[1])), radius)
    full = np.where(sizes >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1))
    later = ~((np.uint64(2) << np.minimum(lane, 62).astype(np.uint64)) - np.uint64(1))
    later[lane == 63] = 0
    hit &= full[which] & later
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    live = np.flatnonzero(hit)
    word = hit[live]
    while len(live):
        low = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        a.append(live)
        b.append(starts[which[live]] + low)
        word = word & (word - np.uint64(1))
        live, word = live[word != 0], word[word != 0]
    return np.concatenate(a), np.concatenate(b)


def _compared(keyed: DataFrame, words: int, radius: int) -> DataFrame:
    """Links (a, b) of the labels of nodes that share a key and lie within the radius, from (t, key, node, label, fp0 ..).

    Nodes of one label are known to belong together: a group of theirs alone is not
    compared, and no link is made of them. A key with more than CHUNK nodes is cut into chunks by hash, and every pair of
    chunks is a group of its own, so nothing is dropped and no group grows with the
    data. Groups are compared bit-sliced; each task returns links that span its classes.
    """
    import pyarrow as pa

    names = [f"fp{w}" for w in range(words)]
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1")
    dealt = keyed.join(sizes, ["t", "key"]).withColumn("c", F.ceil(F.col("m") / CHUNK).cast("int"))
    dealt = dealt.withColumn("mine", F.when(F.col("c") > 1, F.pmod(F.xxhash64("node"), F.col("c"))).otherwise(0).cast("int"))
    other = F.when(F.col("c") > 1, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("o", F.explode(other)).select("t", "key", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine", "node", "label", *names)
    dealt = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "mine", "node")

    def compare(batches):
        held: list[np.ndarray] = []
        forest: dict[int, int] = {}  # a task's links span its classes, whichever key they come from
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(b.num_columns)]))
            if not (held[-1][:4, -1] != held[0][:4, 0]).any():
                continue  # one group so far
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            yield from found(rows[:, : new[-1]], forest)
            held = [rows[:, new[-1] :]]
        if held:
            yield from found(np.concatenate(held, axis=1), forest)

    def root(parent, x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def found(rows, forest):
        """Links within whole groups, which come sorted."""
        cut = np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)])
        group = np.cumsum(cut) - 1
        size = np.bincount(group)
        fp, label = np.ascontiguousarray(rows[7:].T).view(np.uint64), rows[6]
        one = rows[2] == rows[3]
        starts = np.flatnonzero(cut)
        open_ = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        small = np.flatnonzero((size[group] <= _LANES) & one & open_[group])
        a, b = [], []
        g = group[small]
        borders = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, int)
        for k in range(0, len(borders) - 1, 2048):  # so many groups at a time, to bound memory
            some = small[borders[k] : borders[min(k + 2048, len(borders) - 1)]]
            x, y = _small_links(fp[some], group[some], radius)
            a.append(label[some[x]])
            b.append(label[some[y]])
        for g in np.flatnonzero(((size > _LANES) | ~one[starts]) & open_):
            at = np.arange(*np.searchsorted(group, [g, g + 1]))
            left = right = at
            if not one[at[0]]:
                first = rows[4, at] == rows[2, at]
                left, right = at[first], at[~first]
            if len(left) and len(right):
                x, y = _links(fp, label, left, right, radius)
                a.append(label[x])
                b.append(label[y])
        if a:
            links = []
            for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True):
                if (x := root(forest, x)) != (y := root(forest, y)):
                    forest[max(x, y)] = min(x, y)
                    links.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that span the classes of distinct 64-bit fingerprints fp0 within `radius` bits, all of them.

    Pigeonhole: the 64 bits are cut into radius + 2 segments, of which two at least
    are equal in any pair within the radius; each pair of segments is a key.
    """
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in pair) for pair in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select(F.posexplode(F.array(*[F.col("fp0").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"), F.col("fp0").alias("node"), F.col("fp0").alias("label"), "fp0")
    return _compared(keyed, 1, radius)


def keys_for(rows: int, similarity: float = 0.8, recall: float = 0.99) -> tuple[int, int]:
    """(bits a key, number of keys) for so many fingerprints: both follow the number of rows.

    Rows that have nothing in common share a key of b bits with chance 2^-b; b keeps
    those to some 64 a key. Two sets of equal size and Jaccard similarity s have a
    cosine of 2s / (1 + s), and their fingerprints' bits agree with chance
    p = 1 - acos(cosine) / pi, so 1 - (1 - p^b)^n of such pairs share one of n keys.
    """
    bits = max(16, math.ceil(math.log2(max(rows, 1) / 64)))
    p = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-(p**bits)))


def similar_classes(fps: DataFrame, rows: int, radius: int = 29, words: int = 2, similarity: float = 0.8, recall: float = 0.99, first: int = 4) -> DataFrame:
    """(node, root) of (node, fp0 .. ): classes of fingerprints within `radius` of 64 x words bits.

    A radius as wide as a similarity of 0.8 needs is beyond the pigeonhole. Keys are
    samples of the fingerprint's bits, dealt by a fixed seed; keys_for() says how
    many of how many bits. The `first` keys make classes; the others link only
    different ones, so a large group isn't linked anew by every key. All keys see
    all nodes.
    """
    key_bits, tables = keys_for(rows, similarity, recall)
    bits = np.random.default_rng(20240229)
    keys = []
    for _ in range(tables):
        chosen = bits.choice(64 * words, key_bits, replace=False)
        masks = [sum(1 << int(b % 64) for b in chosen if b // 64 == w) for w in range(words)]
        keys.append(F.xxhash64(*[F.col(f"fp{w}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for w, m in enumerate(masks)]))
    names = [f"fp{w}" for w in range(words)]
    classes = fps.select("node", *names, F.col("node").alias("label"))
    for some in (keys[:first], keys[first:]):
        keyed = classes.select(F.posexplode(F.array(*some)).alias("t", "key"), "node", "label", *names)
        found = connected_components(_compared(keyed, words, radius)).select(F.col("node").alias("label"), "component")
        classes = durable(classes.join(found, "label", "left").select("node", *names, F.coalesce("component", "label").alias("label")))
    return classes.select("node", F.col("label").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    Texts are lower-cased (A-Z), words are runs of other characters than space and
    U+0009 to U+000D, shingles are `shingle` consecutive words (all words, if fewer).
    A text without words, and a null text, has fingerprint zero and is linked like
    any other. Rows link at `radius` or fewer differing bits; component_id is the
    smallest id reachable. Equal fingerprints meet in an aggregation, never in a
    comparison. A null id takes part in no minimum: its row gets its class's
    smallest id, null if there is none. Repeated rows give repeated results.
    """
    rows = durable(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle))
    distinct = durable(rows.groupBy("fp0").agg(F.min("id").alias("least")))
    links = connected_components(fingerprint_links(distinct.select("fp0"), radius))
    # classes are named by a fingerprint first, then by their smallest id
    named = distinct.join(links.select(F.col("node").alias("fp0"), F.col("component").alias("root")), "fp0", "left").withColumn("root", F.coalesce("root", "fp0"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp0", "component_id")
    return rows.join(by_fp, "fp0").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 29) -> DataFrame:
    """The rows of docs that stay if each group of near copies keeps one: that of its smallest id.

    Near copies have a Jaccard similarity of 0.8 or more of their sets of 5-word
    shingles; groups are closed over such pairs. Fingerprints of 128 bits only
    propose: 0.8 makes 19 bits differ on average (4 is a standard deviation), and
    classes within `radius` bits are then split by the sets themselves. Rows
    without an id are a group's last choice. Equal rows count as copies: one
    stays. So do texts without words, null ones included: their sets are equal.
    Other columns may have any name. An empty table stays empty.

    Every text is cut into shingles once, those of proposed classes twice; the wide
    rows move once, in the join with the ids that stay.
    """
    words = 2
    fps = [f"fp{w}" for w in range(words)]
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("id"), named(id_col).alias("own"), F.xxhash64(text).alias("t"), text.alias("text"))
    rows = with_fingerprint(narrow, "text", shingle, words, node=True)
    choice = F.struct(F.col("id").isNull().alias("none"), "id", "own", "t")
    nodes = durable(rows.groupBy("node").agg(F.min(choice).alias("least"), F.min(F.struct(*fps)).alias("fp")).select("node", "least", "fp.*"))
    proposed = nodes.select("node", "least").join(similar_classes(nodes.select("node", *fps), nodes.count(), radius, words), "node")
    many = proposed.groupBy("root").agg(F.ceil(F.count("*") / SET_CHUNK).cast("int").alias("c"), F.count("*").alias("m")).where("m > 1")
    asked = durable(proposed.join(many, "root").select("root", "c", F.pmod(F.xxhash64("node"), F.col("c")).cast("int").alias("mine"), "least.own", "least.t", "node"))
    sets = _sets(narrow, shingle, _maybe(asked, "t"))
    linked = connected_components(verified_links(sets.join(asked, ["own", "t"])))
    # one node of each class stays: that of the smallest id, then of the smallest hash
    final = nodes.select("node", "least").join(linked, "node", "left").select("least", F.coalesce("component", "node").alias("root"))
    own, t, n = fresh(docs, "own", "t", "n")
    stays = final.groupBy("root").agg(F.min("least").alias("x")).select(F.col("x.own").alias(own), F.col("x.t").alias(t))
    once = Window.partitionBy(own, t).orderBy(F.lit(0))
    wide = docs.withColumns({own: named(id_col), t: F.xxhash64(text)})
    return wide.join(stays, [own, t]).withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(docs.columns)
