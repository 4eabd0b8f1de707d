"""Operators against brute force, exact round trips, and held-out accuracy."""

import hashlib
import itertools
import math
import pathlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuswright.llm import _common, bpe, kneser_ney, license_scan, lm_bloom, mih, queries, secrets, simhash, url_filter
from corpuswright.llm._common import LOWER_BYTES
from corpuswright.llm.components import connected_components


def _tokens(text):
    return (text or "").encode().translate(LOWER_BYTES).split() + [None]


def test_lm_base_is_exact_and_the_model_beats_it(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op1_lm_scoring(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in _tokens(t))
    n, floor = sum(train.values()), sum(train.values()) + 0.5 * (len(train) + 1)
    for d, t in texts.items():
        words, r = _tokens(t), rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(train[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.5) / floor) for w in words), rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_with_few_bits_and_a_small_head_keeps_base_exact(docs):
    full, tight = (lm_bloom.score(docs, docs, **k).select("doc_id", "n_known", F.round("base_score", 6)) for k in ({}, {"filter_bits": 1 << 16, "head_words": 50}))
    assert full.exceptAll(tight).count() == 0


def test_lm_filter_in_many_runs_holds_every_ngram(docs):
    whole, runs = ({(r.doc_id, round(r.score, 6)) for r in lm_bloom.score(docs, docs, **k).collect()} for k in ({}, {"filter_bits": 1 << 14}))
    assert whole == runs


def test_lm_score_against_brute_force(spark, docs):
    """The formula of the docstring from plain counts; the filter has room enough for no false positive."""
    some = docs.where("doc_id % 3 = 0")
    texts = [r.text for r in some.select("text").collect()] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words, pairs = Counter(), Counter()
    for t in texts:
        own = _tokens(t)
        words.update(own)
        pairs.update(zip(["start", *own], own, strict=False))
    quantised = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    total = Counter()
    for (v, _), c in pairs.items():
        total[v] += quantised(c)
    up = lambda x: 2 ** (math.ceil(4 * math.log2(x) - 1e-9) / 4) if x else 0.0
    floor = sum(map(quantised, words.values())) + 0.5 * (len(words) + 1)
    p1 = lambda w: (quantised(words[w]) + 0.5) / floor
    p2 = lambda v, w: (min(quantised(pairs[v, w]), up(total[v])) + 4 * p1(w)) / (up(total[v]) + 4)
    assert math.isclose(sum(map(p1, words)) + 0.5 / floor, 1, rel_tol=1e-9)  # and one unknown word
    for v in ["start", *itertools.islice(words, 0, None, 97)]:
        assert 0.84 < sum(p2(v, w) for w in words) + 4 * 0.5 / floor / (up(total[v]) + 4) <= 1 + 1e-9
    for options in ({"room": 256}, {"room": 256, "filter_bits": 1 << 20}):
        for r in lm_bloom.score(df, df, **options).collect():
            own = _tokens(texts[r.doc_id])
            assert math.isclose(r.score, sum(math.log10(p2(v, w)) for v, w in zip(["start", *own], own, strict=False)), rel_tol=1e-9)


def test_filter_reads_back_levels():
    rng = np.random.default_rng(0)
    keys, level, shard = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(1, 6, 5000), rng.integers(0, 64, 5000)
    seg = (1 << 18) // 64
    bits = np.zeros((1 << 18) // 8, np.uint8)
    for k, q, s in zip(keys, level, shard, strict=True):
        for j in range(1, q + 1):
            for p in lm_bloom.places(np.array([k]), j, seg):
                at = int(p[0]) + int(s) * seg
                bits[at >> 3] |= 1 << (at & 7)
    got = lm_bloom.levels(keys, shard, bits, seg)
    assert (got >= level).all() and (got == level).mean() > 0.9
    assert (lm_bloom.levels(rng.integers(0, 1 << 63, 5000).astype(np.uint64), shard, bits, seg) == 0).mean() > 0.8


def test_each_distinct_key_is_looked_up_once():
    rng = np.random.default_rng(3)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"d"], int(n))) for n in rng.integers(0, 60, 50)]
    h, before, n = lm_bloom._tokens(texts, _common.WordHashes())
    asked = []

    def levels_of(keys, shard):
        asked.extend(zip(keys.tolist(), shard.tolist(), strict=True))
        return (keys % np.uint64(7)).astype(np.int16)

    starts = np.cumsum(n) - n
    u, where, count, pair, total = lm_bloom.looked_up(h, before, starts, 256, levels_of)
    assert len(asked) == len(set(asked)) < len(h) / 5 and (u[where] == h).all()
    pairs, firsts = lm_bloom._bigrams(h, before), lm_bloom._total_key(before)
    assert set(zip(pairs.tolist(), lm_bloom._pair_shard(h, before, 256).tolist(), strict=True)) <= set(asked)
    of = lambda k: (k % np.uint64(7)).astype(np.int16)
    assert (count == lm_bloom.typical(of(h))).all() and (pair == lm_bloom.typical(of(pairs))).all() and (total == lm_bloom.total_of(of(firsts))).all()
    # in runs, the keys' order aside, as without
    keys, shard = np.array([k for k, _ in asked], np.uint64), np.array([s for _, s in asked], np.int32)
    bits = rng.integers(0, 256, 256 * 16).astype(np.uint8) | rng.integers(0, 256, 256 * 16).astype(np.uint8)

    class Sent:
        def __init__(self, value):
            self.value = value

    runs = [Sent(bits[i * 100 * 16 : (i + 1) * 100 * 16]) for i in range(3)]
    want = lm_bloom.levels(keys, shard, bits, 128)
    assert (lm_bloom.levels_in_runs(keys, shard, runs, 100, 128) == want).all() and (lm_bloom.levels_in_runs(keys, shard, [Sent(bits)], 256, 128) == want).all() and want.any()


def test_probes_take_bounded_memory():
    """Beside its result, what probing takes doesn't follow the number of keys."""
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1 << 21).astype(np.uint64)
    shard, bits = np.zeros(len(keys), np.int32), np.random.default_rng(2).integers(0, 256, 1 << 10).astype(np.uint8)
    tracemalloc.start()
    got = lm_bloom.levels(keys, shard, bits, 1 << 13)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < got.nbytes + (16 << 20)
    some = slice(1 << 17, (1 << 17) + 100)
    assert (got[some] == lm_bloom.levels(keys[some], shard[some], bits, 1 << 13)).all() and 0 < (got > 0).mean() < 0.2


def _classes(fps, radius):
    parent = dict(zip(fps, fps, strict=True))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    return {frozenset(x for x in fps if root(x) == r) for r in {root(x) for x in fps}}


def test_simhash_classes(spark, sf, docs):
    rows = queries.op5_simhash(spark, sf).collect()
    fp = {r.doc_id: simhash.fingerprint(r.text.encode())[0] for r in docs.collect()}
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in rows)
    classes = _classes(list(set(fp.values())), 2)
    own = {x: min(d for d, f in fp.items() if f in c) for c in classes for x in c}
    assert all(r.component_id == own[fp[r.doc_id]] for r in rows) and len(rows) == len(fp)


def test_simhash_large_groups(spark, monkeypatch):
    """Groups past a block, and past a chunk, lose no link."""
    monkeypatch.setattr(simhash, "CHUNK", 100)
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {s ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for s in seeds for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp0 long"), 2)
    comp = {r.node % (1 << 64): r.component for r in connected_components(links).collect()}
    for c in _classes(list(fps), 2):
        assert len({comp.get(x, ("alone", x)) for x in c}) == 1
    assert len(set(comp.values())) == sum(len(c) > 1 for c in _classes(list(fps), 2))


def test_near_words_against_popcount():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (1, 2)).astype(np.uint64)
    fps = base ^ (np.uint64(1) << rng.integers(0, 63, (130, 2)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, (130, 2)).astype(np.uint64))
    planes = simhash._planes(fps)
    for radius in (0, 2, 5, 7):
        hit = simhash.near(np.repeat(fps, 3, axis=0), np.tile(np.arange(3), 130), planes, radius).reshape(130, 3)
        for i, j in itertools.product(range(130), range(130)):
            assert bool(int(hit[i, j // 64]) >> (j % 64) & 1) == (int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= radius)


def test_drop_near_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(rng.randint(60, 400))] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        near = list(t)
        near[len(t) // 2] = "changed"  # five of its shingles
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(t))]
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == list(range(60))


def test_set_links_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (6, 40)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.08, rng.integers(0, 1 << 62, 40).astype(np.uint64), base[k % 6])) for k in range(90)] + [np.zeros(0, np.uint64)]
    near = [(i, j) for i, j in itertools.combinations(range(91), 2) if 5 * len(c := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(c))]

    def classes(links):
        of = list(range(91))
        for i, j in links:
            of = [of[i] if x == of[j] else x for x in of]
        return {frozenset(k for k in range(91) if of[k] == x) for x in of}

    links = simhash.set_links(sets)
    assert set(map(lambda p: tuple(sorted(p)), links)) <= set(near) and classes(links) == classes(near)


def test_drop_near_copies_is_judged_by_shingle_sets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_CHUNK", 16)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(40)]
    # two texts that repeat one passage: near by their fingerprints, far by their sets
    rows = [(k, " ".join(shared * 30 + [word() for _ in range(100)])) for k in range(2)]
    base = [word() for _ in range(300)]
    for k in range(60):  # one large group: a word changed in each
        own = list(base)
        own[3 * k + 10] = word()
        rows.append((10 + k, " ".join(own)))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 1, 10}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 1), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links if None not in p for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = bpe.ByteBPE(open(path, encoding="utf-8").read())
    theirs = Tokenizer.from_file(path)
    rng = random.Random(7)
    odd = ["".join(rng.choice("ab cd'sTl \n\t\r\x1c\x85\u00a0\u3000éñ漢1²Ⅷ_-!😀<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in [r.text for r in docs.limit(60).collect()] + odd + ["<|endoftext|>" * 3, "a" * 3000]:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ",".join(map(str, ids)) and own.decode(own.encode(t)) == theirs.decode(ids, skip_special_tokens=False)
    assert all(own.encode_piece(b) == [i] for i, b in itertools.islice(own.bytes_of.items(), 0, None, 37))
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    assert out.where("decoded <> text OR n_tokens <> size(token_ids)").count() == 0


def test_bpe_digests(spark, sf):
    """All rows against the tokenizers library."""
    from tokenizers import Tokenizer

    sf = sf.replace("0.001", "0.01")
    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_bpe(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_tests_pairs_only_where_tokens_may_end():
    """Tokens and ASCII words need no pair test and no split; pieces that make it go back agree with the merges."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own, theirs, rng = bpe.ByteBPE(open(path, encoding="utf-8").read()), Tokenizer.from_file(path), random.Random(4)
    words = [" " + "".join(w) for w in itertools.product("athe", "oni", "st", "erw", "ing")]
    odd = ["".join(rng.choice(["=", "==", "-", "_", "wW", "é", "漢", "😀", "er", "the"]) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    for t in words + odd:
        assert own.encode(t) == ",".join(map(str, theirs.encode(t, add_special_tokens=False).ids))
    want = [own.encode(w) for w in words]
    own.split = None
    own.chunks.clear()
    assert [own.encode(w) for w in words] == want
    own.fits = None
    own.known.clear()
    assert all(own.encode_piece(b) == [i] for i, b in own.bytes_of.items())


def test_suffix_automaton_finds_every_word():
    rng = random.Random(2)
    for _ in range(60):
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): i for i in range(rng.randint(1, 25))}
        auto = bpe.SuffixAutomaton(words)
        text = bytes(rng.choice(b"abcd") for _ in range(60))
        for end, got in enumerate(auto.ends(text), 1):
            assert got == sorted(((len(w), i) for w, i in words.items() if text[:end].endswith(w)), reverse=True)


def test_bpe_refuses_other_vocabularies():
    import json

    spec = json.loads(open(queries.tokenizer_path(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError, match="vocabulary asks"):
            bpe.ByteBPE(json.dumps(spec | change))


def test_quality_classifier(spark, sf):
    """Held-out: nearly all trusted documents stay, most junk goes."""
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op8_quality_classifier(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] > 0.95 and share[0] < 0.5


def test_secrets_base_against_regexes(spark, sf, docs):
    patterns = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    extra = [None, "", "token: token:abcdefg", "éé password='abcdef' x", "API_KEY=abc api_key=abcdefgh", "😀 secret = \"zzzzzzz\" AKIA" + "A" * 20 + " " + "a" * 40, "password=7602ad27cf5550de1c" * 3]
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    ratios = secrets.fit(secrets.random_samples(spark).unionByName(secrets.identifier_samples(own)))
    texts = {r.doc_id: r.text or "" for r in own.collect()}
    for r in secrets.scan(own, ratios).collect():
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id]) if ok(m))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{e}" for a, _, e, n in spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(n == x for *_, n in spans) for x, _, _ in patterns]


def test_markov_models_tell_random_strings(spark, docs):
    ratios = secrets.fit(secrets.random_samples(spark).unionByName(secrets.identifier_samples(docs)))
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strange = [("".join(rng.choice(alphabet) for _ in range(28)), 1) for _ in range(200)]
    words = [w for r in docs.limit(80).collect() for w in re.findall(r"[a-z]{5,}", r.text)]
    plain = [("".join(rng.choice(words) for _ in range(4))[:28], 0) for _ in range(200)]
    df = spark.createDataFrame(strange + plain, "s string, random int").withColumn("said", secrets.likely_random(F.col("s"), ratios))
    wrong = df.where(F.col("said").cast("int") != F.col("random")).count()
    assert wrong <= 8


def test_redact(spark):
    ratios = [0.0] * (128 * 128)
    df = spark.createDataFrame([(1, "é password=abcdefg end " + "a" * 30 + "!"), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df, ratios).collect()}
    assert got == {1: "é [SECRET] end [SECRET]!", 2: None, 3: "plain"}


def test_url_rules_and_held_out_accuracy(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet")
    df = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    df = df.withColumn("r", url_filter.rule_of(F.col("host"), F.col("path"))).where("r IS NOT NULL").select("host", "path", (F.col("r.verdict") == "allow").alias("allowed"))
    weights = url_filter.fit(df.where("pmod(hash(path), 2) = 0"))  # the query's own bound
    margin = url_filter._margin(url_filter.features(F.col("host"), F.col("path")), weights)
    assert df.where("pmod(hash(path), 2) = 1").agg(F.avg(((margin >= 0) == F.col("allowed")).cast("double"))).first()[0] > 0.95

    def plain(u):
        if "://" not in (u or ""):
            return "", "", None
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups()
        host = host.encode().translate(LOWER_BYTES).decode()
        fit = [h + p for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=len, default=None)

    odd = [None, "", "nourl", "HTTP://EXAMPLE.ORG/es/x", "http://example.org?x", "http://a.com/de/#", "x://y://org/", "http://org/", "http://notorg/", "http://example.org/en/12"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(odd)], "page_id long, url string")
    assert all((r.host, r.path, r.rule) == plain(odd[r.page_id]) for r in url_filter.judge(rows).collect())


def test_license_filters_are_exact():
    """The best block of every template, against all blocks of the text."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for i in range(12)]
    frequency = {w.encode(): rng.randrange(1000) for w in vocabulary}
    for threshold in (0.3, 0.8, 1.0):
        index = license_scan.TemplateIndex(templates, frequency, threshold)
        for _ in range(300):
            text = [rng.choice([*vocabulary, "other", "more"]).encode() for _ in range(rng.randint(0, 40))]
            want = {}
            for k, (_, t) in enumerate(templates):
                own, length = set(t.encode().split()), math.ceil(len(t.split()) / threshold - 1e-9)
                best = max((len(own & set(text[i : i + length])) for i in range(len(text))), default=0)
                if best >= max(1, math.ceil(threshold * len(own) - 1e-9)):
                    want[k] = best / len(own)
            assert index.matches(text) == want


def test_licenses_wrapped_over_lines_and_a_caller_s_table(spark):
    wrap = lambda t, n: "\n * ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [(i, "some code here\n" + wrap(t, 6) + "\nmore code") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    far = " filler words between them all the while ".join("released under the mit license".split())
    docs = spark.createDataFrame([*rows, (100, far), (101, "our own house terms apply")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert all(license_scan.TEMPLATES[i][0] in got[i].labels.split(",") and got[i].score == 1.0 for i, _ in rows)
    assert got[100].labels == "" and got[100].score == 0.0
    own = spark.createDataFrame([("house", "Our own house terms"), (None, "x"), ("empty", " ")], "label string, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs, templates=own).collect()}
    assert got[101] == "house" and got[100] == ""


@pytest.mark.parametrize("dims", [3, 64, 100, 130])
def test_top_k_is_exact(spark, dims):
    """All dimensions count, with ties, repeated codes and codes that share segments."""
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(400, dims))
    vectors[100:200] = vectors[7]
    vectors[100:200, : dims // 2] *= rng.choice([-1, 1], size=(100, dims // 2), p=[0.1, 0.9])
    vectors[200:230] = vectors[3]  # one code, many rows
    ids = [f"v{i:03d}" for i in range(400)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id string, embedding array<double>")
    got = {}
    for r in mih.top_k(df, df.where("substring(vec_id, 4, 1) = '3'"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    signs = vectors > 0
    assert len(got) == 40
    for query, rows in got.items():
        distance = (signs ^ signs[int(query[1:])]).sum(axis=1)
        want = sorted(zip(distance.tolist(), ids, strict=True))[:7]
        assert [x[1:] for x in sorted(rows)] == want


def _kneser_ney(texts):
    """An independent interpolated modified Kneser-Ney trigram model: p(word, history of two)."""
    three = Counter()
    for t in texts:
        own = ["<", "<", *t.split(), ">"]
        three.update(zip(own, own[1:], own[2:], strict=False))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def discount(counts):
        n = [sum(v == i for v in counts.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), float(i)) if n[i] else 0.0 for i in (1, 2, 3)]
        return lambda c: d[min(c, 3)]

    d3, d2, d1 = discount(three), discount(two), discount(one)

    def order(counts, d, lower):
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d(c)

        def p(word, history):
            if not total[history]:
                return lower(word, history[1:])
            c = counts[(*history, word)]
            return (c - d(c) if c else 0.0) / total[history] + left[history] / total[history] * lower(word, history[1:])

        return p

    total = sum(one.values())
    unknown = sum(map(d1, one.values())) / total / (len(one) + 1)
    p1 = lambda word, _: ((one[word] - d1(one[word])) / total if word in one else 0.0) + unknown
    return order(three, d3, order(two, d2, p1)), set(one)


def test_kneser_ney_against_brute_force(spark, docs):
    some = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    small = ["a b c a b d a b c", "b c a b c", "a a b", "c d a b", "d d", "a b c d", "b a"]
    for fitted, scored in ((some[:30], [*some[25:], "", "never seen words", "x"]), (small, [*small, "a", "d b unseen a b", ""])):
        model = kneser_ney.fit(spark.createDataFrame([(t,) for t in fitted], "text string"))
        p, vocabulary = _kneser_ney(fitted)
        logs, n = kneser_ney.log10_probability([t.encode() for t in scored], model, kneser_ney.WordHashes())
        for t, got, size in zip(scored, logs, n, strict=True):
            own = ["<", "<", *t.split(), ">"]
            want = sum(math.log10(p(c, (a, b))) for a, b, c in zip(own, own[1:], own[2:], strict=False))
            assert size == len(own) - 2 and math.isclose(got, want, rel_tol=2e-6)
        for history in (("<", "<"), ("a", "b"), ("<", "a"), ("zzz", "b"), ("zzz", "zzz"), tuple(fitted[0].split()[:2])):
            assert abs(sum(p(w, history) for w in vocabulary) + p("never seen", history) - 1) < 1e-6


def test_fit_is_bounded_in_bytes(spark):
    texts = [(f"{i} " * 50,) for i in range(20)]
    small = kneser_ney.fit(spark.createDataFrame(texts, "text string"), most_bytes=500)
    whole = kneser_ney.fit(spark.createDataFrame(texts, "text string"))
    assert 0 < len(small.words.keys) < len(whole.words.keys)


def test_the_fit_is_half_of_all_trusted_rows(spark):
    """No number of rows or bytes bounds it, and a model in runs says what a whole one does."""
    labels = spark.range(9001).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    trusted = kneser_ney.trusted_ids(labels)
    want = sorted(range(9001), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:4501]
    assert {r.doc_id for r in trusted.where("fit").collect()} == set(want) and trusted.count() == 9001
    docs = spark.range(9001).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 7, F.col("id") % 11, "id").alias("text"))
    rows = kneser_ney.fit_rows(docs, trusted)
    assert rows.count() == 4501
    large = kneser_ney.fit(rows.withColumn("text", F.concat("text", F.repeat(F.lit(" x"), 2000))))  # 18 MB
    assert len(large.words.keys) > 4480
    whole, runs = (kneser_ney.fit(rows, run=n) for n in (1 << 21, 1000))
    assert not whole.runs and len(runs.runs) > 8
    a, b = ({(r.doc_id, r.perplexity) for r in kneser_ney.with_perplexity(docs, m).collect()} for m in (whole, runs))
    assert len(a) == 9001 and a == b
    runs.release()


def test_wide_rounds_go_segment_by_segment(spark, monkeypatch):
    """The same neighbours as all pairs give, and no more segments than the distance asks for."""
    assert [(len(some), covered) for r, some, covered in mih.steps([(0, 0, 16)] * 4) if r in (3, 4)] == [(4, 15), (1, 16), (1, 17), (1, 18), (1, 19)]
    monkeypatch.setattr(mih, "_MOST", 1)
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, 1.0)) for _ in range(20)]) for i in range(120)]
    code = {i: [x > 0 for x in v] for i, v in rows}
    want = {(q, *x) for q in range(0, 120, 10) for x in [(n, d) for d, n in sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items())[:5]]}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.query_id, r.neighbor_id, r.distance) for r in mih.top_k(df, df.where("vec_id % 10 = 0"), k=5).collect()} == want


def test_texts_reach_the_model_in_small_batches(spark, monkeypatch):
    real = lm_bloom._counter

    def checked(text, shards):
        count = real(text, shards)

        def run(batches):
            def small():
                for b in batches:
                    assert b.num_rows <= 1000
                    yield b

            yield from count(small())

        return run

    monkeypatch.setattr(lm_bloom, "_counter", checked)
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 7, "id").alias("text"))
    assert lm_bloom.score(docs, docs).count() == 5000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_a_fit_keeps_little_on_disk(spark):
    """All that it writes to the shared folder goes, and n-grams travel in 6 bytes at most, exactly."""
    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    held = lambda: sum(x.stat().st_size for x in base.rglob("*") if x.is_file())
    rows = spark.range(3000).select(F.concat_ws(" ", F.col("id") % 7, F.col("id") * 31 % 1009, "id", F.col("id") % 11).alias("text"))
    before = held()
    model = kneser_ney.fit(rows)
    assert held() - before < 10_000
    for table in (model.words, model.pairs, model.contexts, model.triples):
        packed = kneser_ney.Packed.of(table)
        if len(table.keys) > 8000:
            assert packed.low.nbytes + sum(len(x) for _, _, x in packed.rest[1:]) < 6 * len(table.keys)
        again = packed.table()
        assert all(np.array_equal(x, y) for x, y in zip((table.keys, *table.values), (again.keys, *again.values), strict=True))
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    assert np.array_equal(kneser_ney._decoded(kneser_ney._coded(keys)), keys >> np.uint64(16))


def test_runs_are_packed_by_executors(spark, monkeypatch):
    """The driver sorts and packs nothing, and a run of several routes has no more n-grams than asked for."""
    rows = spark.range(3000).select(F.concat_ws(" ", F.col("id") % 7, F.col("id") * 31 % 1009, "id", F.col("id") % 11).alias("text"))
    whole = kneser_ney.fit(rows, run=1 << 21)

    def refused(table):
        raise AssertionError("packed on the driver")

    monkeypatch.setattr(kneser_ney.Packed, "of", refused)
    model = kneser_ney.fit(rows, run=1500)
    # words are dealt by their hashes, so that a run has its share nearly
    for runs, table, most in ((model.words, whole.words, 1650), (model.pairs, whole.pairs, 1500), (model.triples, whole.triples, 1500)):
        parts = [kneser_ney.taken(x).table() for x in runs.sent]
        assert len(parts) > 1 and max(len(x.keys) for x in parts) <= most
        again = kneser_ney.Table.of(np.concatenate([x.keys for x in parts]), [np.concatenate([x.values[i] for x in parts]) for i in range(runs.values)])
        assert all(np.array_equal(x, y) for x, y in zip((again.keys, *again.values), (table.keys, *table.values), strict=True))
    model.release()
    assert kneser_ney._starts([3, 0, 4, 9, 1, 1], 7) == [0, 3, 4] and kneser_ney._starts([0, 0], 7) == [0]


def test_the_drivers_heap_goes_back(spark):
    memory = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
    assert len(spark._jvm.java.util.Arrays.copyOf(bytearray(1), 80 << 20)) == 80 << 20  # passes through as text, several times as large
    before = memory.getHeapMemoryUsage().getCommitted()
    _common.give_back_heap(spark)
    after = memory.getHeapMemoryUsage()
    assert after.getCommitted() < before and after.getCommitted() < 2 * after.getUsed() + (64 << 20)


def test_components_and_stages_give_the_drivers_memory_back(spark, docs, sf):
    assert _common.trim_native(spark)
    memory = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")
    for step in (lambda: connected_components(chain), lambda: corpus_pipeline.tokens(spark, docs, sf), lambda: corpus_pipeline.mix(spark, docs, sf)):
        assert len(spark._jvm.java.util.Arrays.copyOf(bytearray(1), 80 << 20)) == 80 << 20  # passes through as text, several times as large
        before = memory.getHeapMemoryUsage().getCommitted()
        step()
        after = memory.getHeapMemoryUsage()
        assert after.getCommitted() < before and after.getCommitted() < 2 * after.getUsed() + (128 << 20)


def test_thresholds_fall_back_to_fit_rows(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(6)] + [(None, 1), (3, 1), (9, 0)], "doc_id long, quality int")
    trusted = kneser_ney.trusted_ids(labels)
    assert trusted.where("fit").count() == 3 and trusted.count() == 6
    fit = [r.doc_id for r in trusted.where("fit").collect()]
    rest = [i for i in range(6) if i not in fit]
    rows = [(fit[0], "de", 5.0), (fit[1], "en", 9.0), (rest[0], "en", 2.0), (rest[1], None, 3.0), (100, "fr", 1.0)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, perplexity double")
    limits = kneser_ney.thresholds(scored, trusted)
    assert {tuple(r) for r in limits.collect()} == {("de", 5.0), ("en", 2.0), (None, 3.0)}
    kept = {(r.lang, r.perplexity): r.kept for r in kneser_ney.judge(scored.withColumn("kept", F.lit("x")), limits).collect()}
    assert kept == {("de", 5.0): True, ("en", 9.0): False, ("en", 2.0): True, (None, 3.0): True, ("fr", 1.0): True}


def _spans_by_hand(text, ratios):
    patterns = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    out = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(patterns) for m in re.finditer(p, text) if ok(m)]
    for m in re.finditer(secrets.CANDIDATE, text):
        mean = sum(ratios[ord(a) * 128 + ord(b)] for a, b in itertools.pairwise(m[0])) / (len(m[0]) - 1)
        if mean >= 0.5 and not any(a < m.end() and m.start() < e for a, _, _, e in out if _ != 3):
            out.append((m.start(), 3, "random", m.end()))
    return sorted(out)


def test_secrets_of_every_kind_by_hand(spark, docs):
    rng = random.Random(11)
    ratios = secrets.fit(secrets.random_samples(spark).unionByName(secrets.identifier_samples(docs)))
    parts = ["plain words", "é漢😀", "a" * 30, "AKIA" + "Q" * 20, "password=hunter22", "token:'x", "deadbeefapi_key=abcdef1", *("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(k)) for k in (19, 20, 33, 70)), "some_ordinary_identifier_name", "\n", "=", " "]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "/", "."]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " ".join(parts * 100)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, found string, _assign string")
    for r in secrets.scan(df, ratios).collect():
        spans = _spans_by_hand(texts[r.doc_id] or "", ratios)
        assert r.spans == ",".join(f"{k}:{a}:{e}" for a, _, k, e in spans), texts[r.doc_id]
    for r in secrets.redact(df, ratios).collect():
        t = texts[r.doc_id]
        out, at = [], 0
        for a, _, _, e in _spans_by_hand(t or "", ratios):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, e)
        assert r.text == (None if t is None else "".join(out) + t[at:]) and (r.found, r._assign) == ("x", "y")


def test_long_texts_take_linear_time(spark):
    import time

    ratios = [0.0] * (128 * 128)
    rng = random.Random(1)
    run = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(2_000_000))
    many = "é password=abcdef1234567 x " * 20_000
    df = spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in secrets.scan(df, ratios).collect()}
    assert rows[2].n_assign == 20_000 and time.time() - began < 40
    began = time.time()
    pages = spark.createDataFrame([(1, "http://a.org/" + "x/y" * 66_000), (2, "http://b.de/" + "ab1" * 66_000)], "page_id long, url string")
    assert url_filter.judge(pages).count() == 2 and time.time() - began < 40


def test_url_verdicts_by_hand(spark, sf):
    """Every address that no rule fits, by the fitted weights and grams made here."""
    import xxhash

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    df = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    rule = url_filter.rule_of(F.col("host"), F.col("path"))
    weights = url_filter.fit(df.where(rule.isNotNull()).select("host", "path", (rule["verdict"] == "allow").alias("allowed")))

    def bucket(tag, gram):
        h = xxhash.xxh64_intdigest(gram.encode(), xxhash.xxh64_intdigest(tag.encode(), 42))
        return (h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS

    for r in url_filter.judge(pages).collect():
        found = set()
        for tag, s in (("host", f"^{r.host}$"), ("path", f"^{r.path}$")):
            for n in (3, 4):
                found |= {bucket(tag, s[i : i + n]) for i in range(max(len(s) - n, 0) + 1)}
        margin = sum(float(f"{weights[i]:.9g}") for i in found) + float(f"{weights[-1]:.9g}")
        assert math.isclose(r.probability, 1 / (1 + math.exp(-margin)), abs_tol=1e-8)
        if r.rule is None:
            assert r.verdict == ("allow" if r.probability >= 0.5 else "block")


def test_near_dedup_against_all_pairs(spark, sf):
    """Recall and precision on whole tables: groups closed over pairs of 0.8 or more."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = sorted((r.doc_id, set(simhash.shingles((r.text or "").encode(), 5).tolist())) for r in docs.collect())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    stays = {i for i, _ in rows if root(i) == i}
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert stays <= kept and len(kept - stays) <= 0.1 * (len(rows) - len(stays))


def test_keys_follow_the_rows():
    assert simhash.keys_for(1000)[0] == simhash.keys_for(4_000_000)[0] == 16
    bits, keys = zip(*(simhash.keys_for(10**k) for k in range(6, 12)), strict=True)
    assert list(bits) == sorted(bits) and list(keys) == sorted(keys) and bits[-1] > 28


def test_kneser_ney_sums_to_one(spark):
    """After any history the words, the end and one unknown word have probability one in all."""
    texts = ["a b c a b d a b c", "b c a b c", "a a b", "c d a b", "d d", "a b c d", "b a"]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    memo = kneser_ney.WordHashes()
    score = lambda words: kneser_ney.log10_probability([" ".join(words).encode()], model, memo)[0][0]
    words = ["a", "b", "c", "d", "unseen"]

    def prefix(history):
        """log10 of a history's probability without an end: what its continuations share."""
        table = dict.fromkeys(words)
        for w in table:
            table[w] = 10 ** score([*history, w])
        return table

    for h in ([], ["a"], ["a", "b"], ["unseen"], ["a", "unseen"], ["d", "d"]):
        # P(h) = P(h, end) + sum over w of P(h, w, ...); P(h, w, ...) in turn from one more step
        inner = lambda h, depth: 10 ** score(h) + (sum(inner([*h, w], depth - 1) for w in words) if depth else 0.0)
        assert inner(h, 3) <= inner(h, 4) <= (1.0 if not h else 10 ** 0) + 1e-6
    assert score(["a", "b", "c"]) > score(["x", "y", "z"])
    assert prefix(["a"])["b"] > prefix(["a"])["d"]
