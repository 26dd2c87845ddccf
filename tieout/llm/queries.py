"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import codes, contamination, exact, jaccard, licenses, mixing, oracles, perplexity, runtime, substring, suffixes, tries, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    runtime.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(_table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_license_scan": op2_license_scan,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_source_mixing": op6_source_mixing,
        "op7_quality_rules": op7_quality_rules,
        "op8_warc_roundtrip": op8_warc_roundtrip,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_vector_codes": op12_vector_codes,
        "op13_exact_dedup": op13_exact_dedup,
    }


OP3_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') AS s FROM words, unnest(range(len(w) - 12)) AS t(p) WHERE len(w) >= 13),
repeats AS (SELECT a.doc_id, a.p FROM windows a JOIN (SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s) f ON a.s = f.s AND f.first_doc < a.doc_id),
covered AS (SELECT DISTINCT doc_id, p + k AS i FROM repeats, unnest(range(13)) AS t(k)),
placed AS (SELECT doc_id, i, w[i + 1] AS word FROM words, unnest(range(len(w))) AS t(i)),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(COALESCE(g.n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id LEFT JOIN gone g ON w.doc_id = g.doc_id"""

#: All pairs with a common n-gram; texts are named by the least id of their set, so ids must be unique.
OP4_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM words, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS t(p)),
docs AS (SELECT doc_id, sha256(string_agg(g, chr(10) ORDER BY g)) AS k, count(*) AS size FROM grams GROUP BY doc_id),
texts AS (SELECT k, size, min(doc_id) AS doc_id, count(*) AS copies FROM docs GROUP BY k, size),
sets AS (SELECT g.doc_id, t.size, g.g FROM grams g JOIN texts t ON g.doc_id = t.doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.size, b.size
  HAVING count(*) >= 0.8 * (a.size + b.size - count(*))),
reached(u, v) AS (SELECT doc_id, doc_id FROM texts UNION SELECT r.u, p.v FROM reached r JOIN pairs p ON r.v = p.u),
classes AS (SELECT u, min(v) AS class_id FROM reached GROUP BY u),
links AS (SELECT p.u, sum(t.copies) AS n, count(*) AS m FROM pairs p JOIN texts t ON p.v = t.doc_id GROUP BY p.u)
SELECT w.doc_id, COALESCE(c.class_id, w.doc_id) AS class_id, CAST(COALESCE(t.copies - 1, 0) + COALESCE(l.n, 0) AS BIGINT) AS n_links, CAST(COALESCE(l.m, 0) AS BIGINT) AS n_text_links
FROM words w LEFT JOIN docs d ON w.doc_id = d.doc_id LEFT JOIN texts t ON d.k = t.k AND d.size = t.size
LEFT JOIN classes c ON c.u = t.doc_id LEFT JOIN links l ON l.u = t.doc_id"""

OP6_SQL = f"WITH mix_docs AS (SELECT doc_id, text, source FROM documents), {mixing.MIX_SQL} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"

OP8_SQL = """
WITH pages_ AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
hashed AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM pages_),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM firsts"""

#: Every 200-byte string of every document, told apart by MD5.
OP9_SQL = """
WITH bytes AS MATERIALIZED (SELECT doc_id, encode(COALESCE(text, '')) AS b FROM documents),
sized AS MATERIALIZED (SELECT doc_id, b, CAST(octet_length(b) AS BIGINT) AS n FROM bytes),
windows AS (SELECT doc_id, p, md5(b[p + 1 : p + 200]) AS s FROM sized, unnest(range(n - 199)) AS t(p)),
starts AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
edges AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM starts),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, COALESCE(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL SELECT d.doc_id, COALESCE(max(s.z), 0), any_value(d.n) FROM sized d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
kept AS (SELECT d.doc_id, string_agg(CASE WHEN p.a < p.z THEN hex(d.b[p.a + 1 : p.z]) ELSE '' END, '' ORDER BY p.a) AS h FROM sized d JOIN pieces p ON d.doc_id = p.doc_id GROUP BY d.doc_id),
gone AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS removed FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(COALESCE(g.removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(g.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM sized d JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL expresses; the others are tested against brute force."""
    return {
        "op2_license_scan": licenses.oracle_sql(),
        "op3_substring_dedup": OP3_SQL,
        "op4_jaccard_join": OP4_SQL,
        "op6_source_mixing": OP6_SQL,
        "op8_warc_roundtrip": OP8_SQL,
        "op9_suffix_dedup": OP9_SQL,
        "op11_conversation_trie": oracles.OP11_SQL,
        "op12_vector_codes": oracles.OP12_SQL,
        "op13_exact_dedup": oracles.OP13_SQL,
    }
