"""LM scoring with a log-frequency Bloom filter.

N-gram counts are gathered from all training rows, quantised to levels
1 + floor(log2(count)), and level j of an n-gram is held by the filter as the
events (n-gram, 1) .. (n-gram, j). A count is read back by probing levels
upwards until one is missing, and the smoothed probability of a word mixes the
orders' relative frequencies.

All probabilities come from one system of counts, the quantised ones: the
denominator after a word is the sum of its own pairs' quantised counts (held by the
filter too, in steps of a quarter of an octave, rounded up), and word
probabilities are over the sum of the words' quantised counts. So the words' own
probabilities sum to one, and those after any word to one at most (0.84 at least),
but for the filter's false positives.

How it scales. Counts move as sorted, pre-added blocks of 64-bit n-gram hashes,
one block for each shard, so a frequent n-gram costs one entry a task. A pair's
shard depends on both words, so a frequent word's pairs are dealt over 32 shards at
least. The filter grows with the counted events and holds all of them. A key's
bits lie in its shard's segment; runs of segments of `filter_bits` at most are
sent one by one, and a worker holds one run at a time. Exact word counts
never need a broadcast that grows: the `head_words` most frequent words travel
with the filter, the occurrences of all others are joined to their counts by
shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, SMALL_BATCHES, WordHashes, drop_folder, durable, frugal, give_back, mix64, settings, shared_folder, taken

#: Stands for the end of a text; no word hashes to it but by a 64-bit accident.
END = 0x656E642D6F662D74
#: Words counted together before their blocks go out: a worker's arrays for them take some 100 bytes a word.
_CHUNK = 1_500_000
#: Bytes of text cut into words at a time (a single text may hold more).
_SLICE = 4 << 20
_PROBES = 4
#: Keys probed together, which bounds what a probe's arrays take.
_PROBED = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bigrams(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of (previous word, word); `before` is 0 at the start of a text."""
    with np.errstate(over="ignore"):
        return mix64(before * _ODD + h)


def _tokens(texts: list[bytes | None], memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts with an end after each, the previous hash at each place, and tokens a text."""
    parts, sizes = [], []
    for t in texts:
        words = (t or b"").translate(LOWER_BYTES).split()
        parts.append(memo.of(words))
        sizes.append(len(words) + 1)
    n = np.array(sizes, dtype=np.int64)
    ends = np.cumsum(n) - 1
    h = np.empty(int(n.sum()), dtype=np.uint64)
    at = 0
    for p in parts:
        h[at : at + len(p)] = p
        at += len(p) + 1
    h[ends] = END
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)] = 0
    return h, before, n


def _some(batch, names: list[str], text: str, most: int = _SLICE) -> Iterator[tuple]:
    """Slices of a batch of about `most` bytes; texts leave Arrow a slice at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(text))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).tolist()):
        size += n
        if size > most or i == len(col) - 1:
            yield col.slice(start, i + 1 - start).to_pylist(), [c.slice(start, i + 1 - start) for c in cols]
            start, size = i + 1, 0


def _total_key(h: np.ndarray) -> np.ndarray:
    """The key under which the filter holds what all pairs that begin with a word count."""
    with np.errstate(over="ignore"):
        return mix64(h * _ODD + np.uint64(0x746F74616C))


def _key_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int32)


def _pair_shard(h: np.ndarray, before: np.ndarray, shards: int) -> np.ndarray:
    """Five bits of the second word, the others of the first."""
    rest = np.uint64(64 - (shards.bit_length() - 1 - 5))
    with np.errstate(over="ignore"):
        return ((mix64(before + _ODD) >> rest << np.uint64(5)) | (h >> np.uint64(59))).astype(np.int32)


_NO_KEYS = np.zeros(0, np.uint64)


def _blocks(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, kind: int, shards: int):
    """The distinct keys, their counts and first words, cut by shard and sorted by first word."""
    uniq, at, count = np.unique(keys, return_index=True, return_counts=True)
    del keys
    shard, first = shard[at], (first[at] if len(first) else first)
    del at
    order = np.lexsort((first, shard)) if len(first) else np.argsort(shard, kind="stable")
    uniq, count, shard, first = uniq[order], count[order].astype(np.uint32), shard[order], (first[order] if len(first) else first)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        i, j = edges[s], edges[s + 1]
        yield kind, int(s), uniq[i:j].tobytes(), count[i:j].tobytes(), first[i:j].tobytes()


def _counter(text: str, shards: int):
    import pyarrow as pa

    names, types = ["kind", "shard", "keys", "counts", "first"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def count(batches):
        memo = WordHashes()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            h, before = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()  # the parts go before the sorts
            for kind in (1, 2):
                rows = _blocks(h, _key_shard(h, shards), _NO_KEYS, 1, shards) if kind == 1 else _blocks(_bigrams(h, before), _pair_shard(h, before, shards), before, 2, shards)
                for some in batched(rows, 16):  # small batches: what crosses to the JVM is held there too
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

        for b in batches:
            for texts, _ in _some(b, [], text):
                h, before, _n = _tokens(texts, memo)
                held.append((h, before))
                size += len(h)
                if size >= _CHUNK:
                    yield from out()
                    give_back()
                    size = 0
        if held:
            yield from out()

    return count


def _level(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int32)  # 1 + floor(log2(n))


def _total_level(total: np.ndarray) -> np.ndarray:
    """Levels of a quarter of an octave, rounded up: the value that total_of() reads back is no less."""
    return 1 + np.ceil(4 * np.log2(total) - 1e-9).astype(np.int32)


def total_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** ((level.astype(np.float64) - 1) / 4), 0.0)


def _adder(batches):
    """Adds the blocks of whole shards, which come one after another; one shard is held at a time.

    Words (kind 1) keep exact counts, pairs (kind 2) their level. The pairs' quantised
    counts are summed by first word: partial sums, for a word has several shards (kind 3).
    """
    import pyarrow as pa

    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    now, parts, size = None, [], 0

    def added():
        k, c, f = (np.concatenate([x[i] for x in parts]) for i in range(3))
        uniq, at, where = np.unique(k, return_index=True, return_inverse=True)
        return uniq, np.bincount(where, weights=c, minlength=len(uniq)).astype(np.int64), (f[at] if len(f) else f)

    def done():
        kind, shard = now
        u, n, first = added()
        level = _level(n)
        rows = [(kind, shard, int(q), int((w := level == q).sum()), int(n[w].sum()), u[w].tobytes(), n[w].tobytes() if kind == 1 else b"") for q in np.unique(level)]
        if kind == 2:
            words, where = np.unique(first, return_inverse=True)
            twice = np.bincount(where, weights=2 * typical(level), minlength=len(words)).astype(np.int64)
            rows.append((3, shard, 0, len(words), 0, words.tobytes(), twice.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["kind", "shard", "level", "n", "total", "keys", "counts"])

    for b in batches:
        for kind, shard, k, c, f in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (kind, shard) != now:
                if parts:
                    yield done()
                now, parts, size = (kind, shard), [], 0
            parts.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64), np.frombuffer(f, np.uint64)))
            size += len(k)
            if size > 64 << 20:
                parts, size = [added()], 0
    if parts:
        yield done()


def _by_first(shards: int):
    """Partial sums of first words, dealt by the shard of the filter that is to hold them."""
    import pyarrow as pa

    def deal(batches):
        for b in batches:
            for words, twice in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k, t = _total_key(np.frombuffer(words, np.uint64)), np.frombuffer(twice, np.int64)
                order = np.argsort(shard := _key_shard(k, shards), kind="stable")
                k, t, shard = k[order], t[order], shard[order]
                edges = np.searchsorted(shard, np.arange(shards + 1))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([x[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary()) for x in (k, t))], ["shard", "keys", "counts"])

    return deal


def _totals(batches):
    """(3, shard, level, n, 0, keys, none): first words' totals of whole shards, which come one after another."""
    import pyarrow as pa

    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    now, parts = None, []

    def done():
        k, t = (np.concatenate([x[i] for x in parts]) for i in range(2))
        u, where = np.unique(k, return_inverse=True)
        level = _total_level(np.bincount(where, weights=t, minlength=len(u)) / 2)
        rows = [(3, now, int(q), int((w := level == q).sum()), 0, u[w].tobytes(), b"") for q in np.unique(level)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["kind", "shard", "level", "n", "total", "keys", "counts"])

    for b in batches:
        for shard, k, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if shard != now:
                if parts:
                    yield done()
                now, parts = shard, []
            parts.append((np.frombuffer(k, np.uint64), np.frombuffer(t, np.int64)))
    if parts:
        yield done()


_COUNTED = "kind int, shard int, level int, n long, total long, keys binary, counts binary"


def places(keys: np.ndarray, level: int, seg: int) -> Iterator[np.ndarray]:
    """The bits of event (n-gram, level) within the segment of its shard."""
    with np.errstate(over="ignore"):
        x = mix64(keys + np.uint64(level) * _ODD)
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(_PROBES):
            yield x & np.uint64(seg - 1)
            x = x + step


def _segments(seg: int):
    import pyarrow as pa

    def build(batches):
        """Rows come sorted by shard: one segment is held at a time."""
        now, own = -1, np.zeros(0, dtype=bool)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])

        for b in batches:
            for shard, level, keys in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    if now >= 0:
                        yield done()
                    now, own = shard, np.zeros(seg, dtype=bool)
                k = np.frombuffer(keys, np.uint64)
                for j in range(1, level + 1):
                    for p in places(k, j, seg):
                        own[p.astype(np.int64)] = True
        if now >= 0:
            yield done()

    return build


def levels(keys: np.ndarray, shard: np.ndarray, bits: np.ndarray, seg: int, first: int = 0) -> np.ndarray:
    """The quantised level of each key, 0 where it isn't held: probes go up until one fails.

    `bits` starts with the segment, of `seg` bits, of shard `first` and has those of all the keys.
    """
    out = np.zeros(len(keys), dtype=np.int16)
    for i in range(0, len(keys), _PROBED):
        out[i : i + _PROBED] = _levels(keys[i : i + _PROBED], shard[i : i + _PROBED], bits, seg, first)
    return out


def _levels(keys: np.ndarray, shard: np.ndarray, bits: np.ndarray, seg: int, first: int) -> np.ndarray:
    out = np.zeros(len(keys), dtype=np.int16)
    live, base = np.arange(len(keys)), (shard - first).astype(np.uint64) * np.uint64(seg)
    inside, seven = np.uint64(seg - 1), np.uint64(7)
    level = 0
    while len(live) and level < 512:
        level += 1
        with np.errstate(over="ignore"):
            x = mix64(keys + np.uint64(level) * _ODD)
            step = (x >> np.uint64(32)) | np.uint64(1)
            held = None  # those of live that no probe missed; None: all
            for _ in range(_PROBES):
                p = (x & inside) + base
                bit = bits.take((p >> np.uint64(3)).view(np.int64)) >> (p & seven).astype(np.uint8) & np.uint8(1)
                ok = np.flatnonzero(bit.view(bool))
                if len(ok) < len(p):
                    held = ok if held is None else held.take(ok)
                    x, step, base = x.take(ok), step.take(ok), base.take(ok)
                x += step
        if held is not None:
            live, keys = live.take(held), keys.take(held)
        out[live] = level
    return out


def levels_in_runs(keys: np.ndarray, shard: np.ndarray, runs: list, per: int, seg: int) -> np.ndarray:
    """levels() of keys of all shards; `runs` are broadcasts of the bits of `per` shards each.

    Keys go shard by shard, so that probes which follow each other stay within a segment.
    """
    out = np.zeros(len(keys), dtype=np.int16)
    order = np.argsort(shard.astype(np.min_scalar_type(int(shard.max(initial=0)))), kind="stable")
    edges = np.searchsorted(shard, np.arange(len(runs) + 1) * per, sorter=order)
    for i in np.flatnonzero(np.diff(edges)):
        bits = runs[0].value if len(runs) == 1 else taken(runs[i])
        for j in range(edges[i], edges[i + 1], _PROBED):
            own = order[j : min(j + _PROBED, edges[i + 1])]
            out[own] = _levels(keys[own], shard[own], bits, seg, int(i) * per)
    return out


def looked_up(h: np.ndarray, before: np.ndarray, starts: np.ndarray, shards: int, levels_of) -> tuple[np.ndarray, ...]:
    """The distinct hashes, each place's number among them, and the filter's counts at each place: of its hash, of its pair, and of all pairs with its first word.

    levels_of(keys, shards) is asked once for each distinct key. Frequent pairs have many levels, so a
    pair looked up at each of its places would cost the most.
    """
    u, where = np.unique(h, return_inverse=True)
    pairs, at, pair_at = np.unique(_bigrams(h, before), return_index=True, return_inverse=True)
    totals = _total_key(np.append(u, np.uint64(0)))
    shard = np.concatenate([_key_shard(u, shards), _pair_shard(h[at], before[at], shards), _key_shard(totals, shards)])
    level = levels_of(np.concatenate([u, pairs, totals]), shard)
    first = np.concatenate([where[-1:], where[:-1]])  # the word before is the hash at the place before, none (0) at a start
    first[starts] = len(u)
    n, m = len(u), len(u) + len(pairs)
    return u, where, typical(level[:n])[where], typical(level[n:m])[pair_at], total_of(level[m:])[first]


def typical(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2^(q-1) .. 2^q - 1, 0 for none."""
    q = level.astype(np.float64)
    return np.where(q > 0, (1.5 * 2.0 ** np.maximum(q - 1, 0)) - 0.5, 0.0)


def score(
    train: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    filter_bits: int = 1 << 28,
    head_words: int = 1 << 19,
    discount: float = 4.0,
    room: int = 1,
) -> DataFrame:
    """Scores every row of `docs` by a model of the rows of `train`.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z
    lower-cased; one end token follows each text. Returns id, `carry` columns,
    n_tokens, n_known, train_tokens, vocabulary, base_score and score, one row for
    each row of docs, repeated and null ids included.

    base_score is exact: sum of log10((c + 0.5) / (N + 0.5 (V + 1))). score is the
    model's log10 probability, with all counts read from the filter:
    p(w|v) = (pair(v, w) + discount * p(w)) / (total(v) + discount), where total(v) is
    the sum of pair(v, .), and p(w) = (word(w) + 0.5) / (M + 0.5 (V + 1)), where M is the
    sum of word(.). At a text's start v is no word. A pair's count is held to total(v).
    The filter holds every counted n-gram, with false positives of 1 in 16 (`room` times
    the bits make them fewer); `filter_bits` is what is sent of it at once.

    A null or empty text is one end token. With no training rows N and V are 0 and
    every token has probability 1. Other columns are not touched.
    """
    with settings(docs.sparkSession, SMALL_BATCHES):
        return _score(train, docs, id_col, text_col, carry, filter_bits, head_words, discount, room)


def _score(train: DataFrame, docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], filter_bits: int, head_words: int, discount: float, room: int) -> DataFrame:
    import pyarrow as pa

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << max(8, math.ceil(math.log2(2 * parts)))
    folder = shared_folder(spark)
    blocks = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(_counter("text", shards)), "kind int, shard int, keys binary, counts binary, first binary")
    blocks.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(frugal(_adder), _COUNTED).write.parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    sums = counted.where("kind = 3").select("keys", "counts").mapInArrow(frugal(_by_first(shards)), "shard int, keys binary, counts binary")
    sums.repartition("shard").sortWithinPartitions("shard").mapInArrow(frugal(_totals), _COUNTED).write.parquet(f"{folder}/totals")
    counted = counted.where("kind < 3")
    events = counted.unionByName(spark.read.parquet(f"{folder}/totals"))
    by_level = events.groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    total = sum(r.total for r in by_level if r.kind == 1)
    vocabulary = sum(r.n for r in by_level if r.kind == 1)
    top = max([r.level for r in by_level if r.kind == 1], default=0)
    need = max(room * sum(r.n * r.level for r in by_level) * _PROBES / math.log(2), 64 * shards)
    seg = (1 << math.ceil(math.log2(need))) // shards
    width = seg // 8
    held = min(shards, max(1, filter_bits // 8 // width))
    segments = events.select("shard", "level", "keys").repartition("shard").sortWithinPartitions("shard").mapInArrow(frugal(_segments(seg)), "shard int, bits binary")
    if held < shards:
        segments.write.parquet(f"{folder}/segments")
        segments = spark.read.parquet(f"{folder}/segments")
    runs = []
    for first in range(0, shards, held):  # filter_bits / 8 bytes at a time
        bits = np.zeros(width * min(held, shards - first), dtype=np.uint8)
        for r in segments.where(F.col("shard").between(first, first + held - 1)).collect():
            bits[(r.shard - first) * width : (r.shard - first + 1) * width] = np.frombuffer(r.bits, np.uint8)
        runs.append(spark.sparkContext.broadcast(bits))
    # the lowest level from which all words number head_words at most
    words = lambda q: sum(r.n for r in by_level if r.kind == 1 and r.level >= q)
    cut = next(q for q in range(1, top + 2) if words(q) <= head_words)
    head = counted.where((F.col("kind") == 1) & (F.col("level") >= cut)).select("keys", "counts").collect()
    known = np.frombuffer(b"".join(bytes(r.keys) for r in head), np.uint64)
    known_n = np.frombuffer(b"".join(bytes(r.counts) for r in head), np.int64)
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], known_n[order]))
    floor = total + 0.5 * (vocabulary + 1)
    quantised = sum(r.n * float(typical(np.array([r.level]))[0]) for r in by_level if r.kind == 1) + 0.5 * (vocabulary + 1)
    names = ["_row_id", *carry]

    def scorer(batches):
        known, known_n = sent.value
        memo = WordHashes()

        levels_of = lambda keys, shard: levels_in_runs(keys, shard, runs, held, seg)

        def facts(h, before, starts):
            """Exact count (-1: not in the head) of each hash; the filter's counts of each hash, of each pair, and of all pairs with its first word."""
            u, where, count, pair, total_v = looked_up(h, before, starts, shards, levels_of)
            at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
            exact = np.where(known[at] == u, known_n[at], -1) if len(known) else np.full(len(u), -1)
            return exact[where], count, pair, total_v

        for b in batches:
            if not b.num_rows:
                continue
            for texts, cols in _some(b, names, "_text"):
                h, before, n = _tokens(texts, memo)
                starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                exact, count, pair, total_v = facts(h, before, starts)
                sum_by = lambda x, starts=starts: np.add.reduceat(x, starts)
                in_head = exact >= 0
                base = sum_by(np.where(in_head, np.log10(np.where(in_head, exact, 0) + 0.5), 0.0) - math.log10(floor))
                p = (np.minimum(pair, total_v) + discount * (count + 0.5) / quantised) / (total_v + discount)
                tail = h[~in_head].view(np.int64)
                per = sum_by((~in_head).astype(np.int64))
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(tail, pa.int64()))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(sum_by((exact > 0).astype(np.int64))), pa.array(base), pa.array(sum_by(np.log10(p))), rest], [*names, "n_tokens", "n_head", "head_score", "score", "tail"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`_row_id` {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in carry)]) + ", n_tokens long, n_head long, head_score double, score double, tail array<long>"
    scored = docs.select(F.col(id_col).alias("_row_id"), *(F.col(c) for c in carry), F.col(text_col).cast("string").alias("_text")).mapInArrow(frugal(scorer), schema)
    # the ids of rows are dealt after the write, so they hold if a task runs again
    scored = durable(scored).withColumn("_row", F.monotonically_increasing_id())
    rare = counted.where((F.col("kind") == 1) & (F.col("level") < cut)).select("shard", "keys", "counts").mapInArrow(_unpacked, "key long, c long")
    tail = scored.select("_row", F.explode("tail").alias("key")).join(rare, "key", "left").groupBy("_row").agg(F.count("c").alias("n_rare"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rare_score"))
    out = scored.join(tail, "_row", "left").select(
        F.col("_row_id").alias(id_col),
        *carry,
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.lit(vocabulary).cast("long").alias("vocabulary"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
    out = durable(out)
    for x in (sent, *runs):
        x.destroy()
    drop_folder(spark, folder)
    return out


def _unpacked(batches):
    import pyarrow as pa

    for b in batches:
        for keys, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["key", "c"])
