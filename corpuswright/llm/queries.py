"""The training-data queries: one opN_<name> an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kneser_ney, license_scan, lm_bloom, mih, mixing, quality_rules, secrets, simhash, url_filter
from ._common import durable, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a model of those whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1)
    return lm_bloom.score(docs.where(~F.col("held_out")), docs, carry=("held_out",))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the addresses of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by source, weighted 3, 1, 2 in turn, takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 64-bit SimHash of 3-word shingles, radius 2."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules and host verdicts (host: source) of all documents."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of all documents by a model of half of all trusted ones, thresholds by the other half."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = kneser_ney.trusted_ids(labels)
    model = kneser_ney.fit(kneser_ney.fit_rows(docs, trusted))
    scored = durable(kneser_ney.with_perplexity(docs.select("doc_id", "lang", "text"), model, keep_text=False))
    model.release()
    return kneser_ney.judge(scored, kneser_ney.thresholds(scored, trusted))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by sign codes, of each whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return mih.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; the models learn from 3,000 digests and 1,000 documents' words."""
    docs = table(spark, sf_dir, "documents")
    ratios = secrets.fit(secrets.random_samples(spark).unionByName(secrets.identifier_samples(docs)))
    return secrets.scan(docs, ratios)


def tokenizer_path() -> str:
    """The vocabulary file of the registered query; bpe.encode takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of their decoding, of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), ids=False, digests=True).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_secret_scan": op9_secret_scan,
    "op10_topk_search": op10_topk_search,
}
#: Words, and lines with a word, of each document, as the rules count them.
_OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), win AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY r
), f AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)
), g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS k, k / n AS rate FROM g GROUP BY source
), p AS (
  SELECT avg(rate) AS mu, CASE WHEN var_samp(rate) > 0 THEN greatest(avg(rate) * (1 - avg(rate)) / var_samp(rate) - 1, 0) ELSE avg(n) END AS m FROM h
), v AS (
  SELECT source, (k + mu * m) / (n + m) <= 0.6 AS ok FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.source
"""

_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_TEMPLATE_ROWS = ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(license_scan.TEMPLATES))
_PHRASE_ROWS = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.PHRASES.items())
#: Every block that begins at a word of a template, against every template of which the text has words enough.
_OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), phrase AS (
  SELECT string_split(p, ' ') AS p, label FROM (VALUES PHRASES) v(p, label)
), place AS (
  SELECT r, label, i - 1 AS i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN phrase ON w[i:i + len(p) - 1] = p
), base AS (
  SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, list_sort(list(DISTINCT label)) AS labels FROM place GROUP BY r
), tm AS (
  SELECT k, label, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM (VALUES TEMPLATES) v(k, label, t)
), tw AS (
  SELECT DISTINCT k, unnest(ws) AS word FROM tm
), tn AS (
  SELECT k, label, len(list_distinct(ws)) AS n, ceil(0.8 * len(list_distinct(ws)) - 1e-9) AS need, ceil(len(ws) / 0.8 - 1e-9) AS block FROM tm
), pos AS (
  SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w)
), enough AS (
  SELECT r, k FROM pos JOIN tw USING (word) JOIN tn USING (k) GROUP BY r, k HAVING count(DISTINCT word) >= any_value(need)
), occ AS (
  SELECT r, k, i, word FROM pos JOIN tw USING (word) JOIN enough USING (r, k)
), hit AS (
  SELECT a.r, a.k, count(DISTINCT b.word) AS n FROM occ a JOIN tn USING (k) JOIN occ b ON a.r = b.r AND a.k = b.k AND b.i >= a.i AND b.i < a.i + tn.block
  GROUP BY a.r, a.k, a.i
), best AS (
  SELECT r, max(hit.n / tn.n) AS c, list(DISTINCT label) AS labels FROM hit JOIN tn USING (k) WHERE hit.n >= need GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, best.labels))), ','), '') AS labels, coalesce(c, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r)
""".replace("PHRASES", _PHRASE_ROWS).replace("TEMPLATES", _TEMPLATE_ROWS)

_OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS ss, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), s1 AS (
  SELECT *, 2.0 * ss AS cap, 2.0 * ss / w AS fill, sum(ss) OVER ()::DOUBLE AS total FROM s0
), s2 AS (
  SELECT *, (total * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW o AS (ORDER BY fill, source NULLS LAST)
), lv AS (
  SELECT arg_min(level, fill) AS reached FROM s2 WHERE level <= fill
), s3 AS (
  SELECT source, ss, least(cap, coalesce(reached, 1e308) * w) AS target FROM s2 LEFT JOIN lv ON true
), s5 AS (
  SELECT *, least(ss, greatest(256, round(ss / 512.0)))::BIGINT AS nb FROM s3
), s6 AS (
  SELECT *, ss // greatest(nb, 1) AS short, CASE WHEN ss > 0 THEN target * nb / ss ELSE 0.0 END AS share FROM s5
), s7 AS (
  SELECT *, floor(share + 0.5)::BIGINT AS quota, ss - short * nb AS longer, sum(share) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto, ceil(sum(share) OVER ())::BIGINT AS slots FROM s6
), s8 AS (
  SELECT source, nb, CASE WHEN upto >= max(upto) OVER () THEN 2.0 ELSE upto / max(upto) OVER () END AS hi, upto, slots FROM s7 WHERE share > 0
), s9 AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY upto), 0.0) AS lo FROM s8
), pt AS (
  SELECT slot, slot * 0.6180339887498949 - floor(slot * 0.6180339887498949) AS x FROM (SELECT unnest(range(max(slots))) AS slot FROM s7)
), dr AS (
  SELECT source, nb, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM pt JOIN s9 ON x >= lo AND x < hi
), dn AS (
  SELECT source, count(*) AS n FROM dr GROUP BY source
), al AS (
  SELECT dr.source, dr.nb, rank FROM dr JOIN s7 ON dr.source IS NOT DISTINCT FROM s7.source WHERE rank < quota
  UNION ALL SELECT s7.source, nb, unnest(range(coalesce(n, 0), quota)) FROM s7 LEFT JOIN dn ON dn.source IS NOT DISTINCT FROM s7.source
), us AS (
  SELECT source, rank % nb AS b, count(*) AS uses FROM al GROUP BY ALL
), pl AS (
  SELECT d.*, ss, target, short, longer, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS p
  FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source
), bl AS (
  SELECT s7.source, b, b * short + least(b, longer) AS a, (b + 1) * short + least(b + 1, longer) AS z, uses FROM us JOIN s7 ON us.source IS NOT DISTINCT FROM s7.source
), tk AS (
  SELECT r, sum((least(p + size, z) - greatest(p, a)) * uses) AS taken FROM pl JOIN bl ON pl.source IS NOT DISTINCT FROM bl.source AND p < z AND a < p + size GROUP BY r
)
SELECT doc_id, size, ss::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM pl LEFT JOIN tk USING (r)
"""

#: Every query against every vector.
_OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS code FROM embeddings
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id, bit_count(xor(q.code, v.code))::INT AS distance FROM v q, v WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank, neighbor_id, distance FROM p
QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op10_topk_search": _OP10_SQL, "op3_license_scan": _OP3_SQL, "op4_mixing": _OP4_SQL, "op6_quality_rules": _OP6_SQL}
