"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import (
    audit_queries,
    backoff_lm,
    exact_dedup,
    fingerprints,
    language_id,
    mixing,
    packing,
    pii,
    simhash_dedup,
    url_filter,
    votes,
    warc,
)
from vacancia.llm.common import table

# Fixed values of the contract.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
URL_SETUP = url_filter.UrlFilter(rules=URL_RULES)


def url_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), setup=URL_SETUP)
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms")


def exact_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.first_seen(table(spark, sf_dir, "documents"))


def language_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.select("doc_id", "text", "lang").filter(~held))
    # Only the text goes in; the ids come along untouched.
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return language_id.predict_narrow(rows, model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def packing_setup() -> packing.Packing:
    import public_tokenizers

    return packing.Packing(vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing_setup())


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", votes.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.scores(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_pairs_seen", "n_triples_seen", F.round("mean_log_score", 6).alias("mean_log_score")
    )


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(pii.labelled_windows(docs)))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(spark)
    warc.write_archives(pages, folder)
    return warc.read_archives(spark, folder, with_payload=False).select(
        F.col("row_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
    )


def _url_sql() -> str:
    v = URL_SETUP.vocabulary
    edge = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
    # Terms may share the character between them, so each is put twice in the text.
    low = "regexp_replace(lowered, '([^a-z0-9])', '\\1\\1', 'g')"
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    strict = " + ".join(
        f"len(regexp_extract_all(t, '{edge.format(w)}'))" for w in v.strict
    )
    soft = " + ".join(f"(regexp_matches(t, '{edge.format(w)}'))::BIGINT" for w, _ in v.soft)
    weight = " + ".join(f"{n} * (regexp_matches(t, '{edge.format(w)}'))::BIGINT" for w, n in v.soft)
    rules = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    rule = " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.text}'" for r in rules)
    verdict = " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.verdict}'" for r in rules)
    return f"""
WITH parts AS (
  SELECT page_id, {fold.format("coalesce(url, '')")} AS lowered,
    {fold.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), doubled AS (SELECT *, {low} AS t FROM parts),
hits AS (SELECT *, {strict} AS strict_hits, {soft} AS soft_terms, {weight} AS weight FROM doubled)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN strict_hits > 0 OR weight >= {v.threshold} THEN 'block' ELSE 'allow' END
    AS verdict,
  strict_hits::BIGINT AS strict_hits, soft_terms::BIGINT AS soft_terms
FROM hits"""


EXACT_SQL = r"""
WITH clean AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents
), digests AS (SELECT doc_id, sha256(t) AS text_sha256 FROM clean)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM digests WINDOW w AS (PARTITION BY text_sha256)"""

# Base32 takes the SHA-1 twenty bits at a time: five hex digits, four letters.
WARC_SQL = """
WITH bodies AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h
  FROM pages
), encoded AS (
  SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1,
      1)), lambda a, b: a || b) AS payload_digest
  FROM bodies
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM encoded
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM grouped"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BACKOFF_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS (
  SELECT r, CASE WHEN p > 2 THEN w[p - 2] END AS u, CASE WHEN p > 1 THEN w[p - 1] END AS v, w[p] AS w
  FROM docs, unnest(range(1, len(w) + 1)) AS t(p)
), singles AS (SELECT w, count(*) AS n1 FROM tokens GROUP BY w),
pairs AS (SELECT v, w, count(*) AS n2 FROM tokens WHERE v IS NOT NULL GROUP BY v, w),
triples AS (SELECT u, v, w, count(*) AS n3 FROM tokens WHERE u IS NOT NULL GROUP BY u, v, w),
counted AS (
  SELECT r, t.v IS NOT NULL AS second, t.u IS NOT NULL AS third, s.n1, prev.n1 AS before1, p.n2, q.n2 AS before2, n3,
    count(*) OVER (PARTITION BY r, t.v, t.w) AS own2, count(*) OVER (PARTITION BY r, t.u, t.v, t.w) AS own3
  FROM tokens t JOIN singles s ON s.w = t.w LEFT JOIN singles prev ON prev.w = t.v
    LEFT JOIN pairs p ON p.v = t.v AND p.w = t.w LEFT JOIN pairs q ON q.v = t.u AND q.w = t.v
    LEFT JOIN triples x ON x.u = t.u AND x.v = t.v AND x.w = t.w
), used AS (
  SELECT *, CASE WHEN third AND n3 > own3 THEN 3 WHEN second AND n2 > own2 THEN 2 ELSE 1 END AS k FROM counted
), scored AS (
  SELECT r, k, ln({backoff_lm.Model().backoff}) * (second::INT + third::INT + 1 - k) + CASE k
    WHEN 3 THEN ln(n3 - own3) - ln(before2) WHEN 2 THEN ln(n2 - own2) - ln(before1)
    ELSE ln(n1) - ln((SELECT count(*) FROM tokens)) END AS score
  FROM used
), summed AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (k = 2) AS n_pairs_seen,
    count(*) FILTER (k = 3) AS n_triples_seen, sum(score) AS log_score
  FROM scored GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_pairs_seen, 0) AS n_pairs_seen,
  coalesce(n_triples_seen, 0) AS n_triples_seen, round(log_score / n_words, 6) AS mean_log_score
FROM docs LEFT JOIN summed USING (r)"""

QUERIES = {
    "op1_simhash_dedup": simhash_near_duplicates,
    "op2_url_filter": url_filtered,
    "op3_mixing": mixed,
    "op4_backoff_lm": backoff_scores,
    "op5_exact_dedup": exact_dedup_rows,
    "op6_packing": packed,
    "op7_pii": personal_data,
    "op8_warc": warc_round_trip,
    "op9_language_id": language_predicted,
    "op10_fingerprints": document_fingerprints,
    **audit_queries.QUERIES,
}

ORACLES = {
    "op2_url_filter": _url_sql(),
    "op4_backoff_lm": BACKOFF_SQL,
    "op5_exact_dedup": EXACT_SQL,
    "op8_warc": WARC_SQL,
    **audit_queries.ORACLES,
}
