"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, divergence, embedding_dedup, language_id, license_scan, lm_mixing, media_columns, ngram_join, packing, personal_data, resampling, token_shards, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(_read(spark, sf_dir, "documents"), width=4, percent=85)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_file_digest(_read(spark, sf_dir, "documents"), bpe.vocabulary_path("word_bpe_49k.json"), end_id=1)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score_texts(_read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), bpe.vocabulary_path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, _read(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.train(documents))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_read(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.text_media_digest(_read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"), least=3, top=200)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=10, least_words=20, n=1, buckets=10000, seed=2024).drop("n_words")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(_read(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13 that don't depend on its patterns."""
    return op13_personal_data(spark, sf_dir).drop("spans")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that don't depend on its rules."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that don't depend on its model; the score in millionths."""
    rows = op5_lm_scoring(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round(F.col("base_score") * 1000000).cast("long").alias("base_micro"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that digest what was stored and read back."""
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_jaccard_join, op2_token_binary, op3_embedding_dedup, op4_license_scan, op5_lm_scoring, op6_best_fit_packing, op7_toxicity, op8_language_id, op9_bpe_round_trip, op10_media_columns, op11_source_divergence, op12_importance_resampling, op13_personal_data, pii_base, license_base, lm_base, media_payloads)
    return {f.__name__: f for f in every}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(codes: str) -> str:
    """SQL for the CRC-32 of a list of byte values, bit by bit."""
    step = "lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295::BIGINT)"


_ID_CRC = _crc32("list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: ascii(x)::BIGINT)")

_OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) END AS s FROM w),
e AS (SELECT r, hash(x) AS x FROM (SELECT r, unnest(s) AS x FROM s)),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p JOIN s a ON a.r = p.a JOIN s b ON b.r = p.b WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n) AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(v, m) AS (SELECT doc_id, doc_id FROM s WHERE doc_id IS NOT NULL UNION SELECT g.b, t.m FROM t JOIN g ON g.a = t.v WHERE t.m < g.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m AS component_id FROM s LEFT JOIN (SELECT v, min(m) AS m FROM t GROUP BY 1) ON v = s.doc_id"""

_OP3 = """WITH RECURSIVE e AS (SELECT vec_id, label, CASE WHEN label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v, row_number() OVER () AS r FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b, a.r AS ra FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
t(v, m) AS (SELECT vec_id, vec_id FROM e WHERE vec_id IS NOT NULL UNION SELECT l.b, t.m FROM t JOIN l ON l.a = t.v WHERE t.m < l.b)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, m AS component_id, coalesce(e.vec_id = m, false) AS kept FROM e LEFT JOIN (SELECT ra, count(*) AS n FROM l GROUP BY 1) k ON k.ra = e.r LEFT JOIN (SELECT v, min(m) AS m FROM t GROUP BY 1) c ON c.v = e.vec_id"""

# Places of each phrase: (first word, further words, label).
_PLACES = " || ".join(f"list_transform(list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {x!r}' for k, x in enumerate(phrase.split()))}), lambda i: struct_pack(i := i, label := {label!r}))" for phrase, label in license_scan.BASE)
_BASE4 = f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda x: x.i)) AS first_word, list_max(list_transform(p, lambda x: x.i)) AS last_word,
array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels FROM (SELECT doc_id, w, {_PLACES} AS p FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents))"""

_BASE5 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ID_CRC} % 7 = 2 AS held_out, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') || [' '] AS w FROM documents),
t AS (SELECT r, held_out, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n.n + n.v + 1 AS DOUBLE))) AS s FROM t LEFT JOIN c ON c.x = t.x CROSS JOIN n GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, CAST(round(s * 1000000) AS BIGINT) AS base_micro FROM d JOIN s ON s.r = d.r CROSS JOIN n"""

# Stored are NPY files of up to 256 rows of 64 samples, each with a header of 128 bytes.
_MEDIA10 = f"""SELECT doc_id, octet_length(b) AS n_bytes, octet_length(p) AS payload_bytes, sha256(p) AS payload_sha256,
{_crc32("list_transform(range(64), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))")} AS tail_crc32, CAST(octet_length(p) + 128 * ceil(octet_length(p) / 64 / 256.0) AS BIGINT) AS media_bytes
FROM (SELECT doc_id, b, p, right(hex(p), 128) AS h FROM (SELECT doc_id, b, b || unhex(repeat('00', CAST(greatest(64, 64 * CAST(ceil(octet_length(b) / 64.0) AS BIGINT)) - octet_length(b) AS BIGINT))) AS p FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)))"""


_OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1), c AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY 1, 2, 3),
g AS (SELECT e.lang, e.source, coalesce(v, 0) AS v, coalesce(sum(c.n), 0) AS n, any_value(l.n) AS ln FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN c ON c.lang = e.lang AND c.source = e.source LEFT JOIN l ON l.lang = e.lang GROUP BY 1, 2, 3),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (g.ln + g.v) AS q
FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x) WHERE part = 'pair' OR rank <= 200"""

_WORDS12 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BYTES = "list_transform(range(octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
_OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS12} AS w FROM documents), o AS (SELECT r, unnest(w) AS x FROM d), b AS (SELECT unnest({_WORDS12}) AS x FROM benchmark),
h AS (SELECT x, {_crc32(_BYTES)} % 10000 AS k FROM (SELECT x FROM o UNION SELECT x FROM b)), s AS (SELECT k, count(*) AS n FROM o JOIN h ON h.x = o.x GROUP BY 1), t AS (SELECT k, count(*) AS n FROM b JOIN h ON h.x = b.x GROUP BY 1),
g AS (SELECT i AS k, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (ss + 10000) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain
FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i CROSS JOIN (SELECT coalesce(sum(n), 0) AS ss FROM s) CROSS JOIN (SELECT coalesce(sum(n), 0) AS tt FROM t)),
w AS (SELECT r, sum(gain) AS weight FROM o JOIN h ON h.x = o.x JOIN g ON g.k = h.k GROUP BY 1),
e AS (SELECT d.r, doc_id, CAST(len(d.w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON w.r = d.r),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM y LEFT JOIN z ON z.r = y.r"""


def _spans13(kind: str, form: str, check: str) -> str:
    """Array of (start, stop) of a kind; the text's parts between matches and the matches give the places."""
    parts = f"list_zip(string_split_regex(t, '{form}'), regexp_extract_all(t, '{form}'))"
    placed = f"list_transform({parts}, lambda x, i: struct_pack(a := CAST(coalesce(list_sum(list_transform(({parts})[1:i-1], lambda y: length(y[1]) + length(y[2]))), 0) + length(x[1]) AS BIGINT), x := x[2]))"
    kept = f"list_filter(list_filter({placed}, lambda s: s.x IS NOT NULL), lambda s: {check})"
    return f"list_transform({kept}, lambda s: '{kind}:' || s.a || ':' || (s.a + length(s.x)))"


_LUHN = "(list_sum(list_transform(string_split(reverse(regexp_replace(s.x, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0)"
_KINDS13 = [
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    ("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "list_max(list_transform(string_split(s.x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255"),
    ("card", "[0-9](?:[\\x20-]?[0-9])+", f"length(regexp_replace(s.x, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "length(regexp_replace(s.x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
]
_BASE13 = f"""SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k, _, _ in _KINDS13)}, sha256(array_to_string({" || ".join(k for k, _, _ in _KINDS13)}, ',')) AS base_sha256
FROM (SELECT doc_id, {", ".join(f"{_spans13(*x)} AS {x[0]}" for x in _KINDS13)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _OP1, "op3_embedding_dedup": _OP3, "op11_source_divergence": _OP11, "op12_importance_resampling": _OP12, "pii_base": _BASE13, "license_base": _BASE4, "lm_base": _BASE5, "media_payloads": _MEDIA10}
