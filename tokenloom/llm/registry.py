"""The corpus operators as queries, and DuckDB SQL for those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, hostrules, htmltext, linededup, lshforest, packing, sharding, warc, wavelet

#: Token that ends a document in the shard files, and in packed sequences.
SHARD_END, PACK_END = 2, 0


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_report(_pages(spark, sf_dir))


def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_report(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_report(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2048, PACK_END)


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.balanced_shards(_documents(spark, sf_dir), 24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(_documents(spark, sf_dir))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_report(_pages(spark, sf_dir))


def op7_minhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(_documents(spark, sf_dir))


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.shard_report(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), SHARD_END)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.class_report(_documents(spark, sf_dir))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.quality_report(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_warc_transactions, op2_prefix_bpe, op3_best_fit_packing, op4_byte_shards, op5_line_dedup, op6_main_text, op7_minhash_fingerprint, op8_wavelet_shards, op9_jaccard_join, op10_host_rules)
    return {f.__name__: f for f in ops}


OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n < 100 OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, md5(coalesce(text, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT h, min(doc_id) AS rep, count(*) AS n_copies, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY h),
s AS (SELECT DISTINCT h, g FROM (SELECT h, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM t)),
n AS (SELECT h, count(*) AS n FROM s GROUP BY h),
c AS (SELECT a.h AS a, b.h AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.h < b.h GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.h = a JOIN n y ON y.h = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(h, o) AS (SELECT h, h FROM t UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.h),
k AS (SELECT r.h, min(t.rep) AS class_id FROM r JOIN t ON t.h = r.o GROUP BY r.h),
d AS (SELECT a AS h, count(*) AS n_links FROM e GROUP BY a)
SELECT w.doc_id, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(d.n_links, 0) AS n_links, coalesce(t.n_copies, 1) AS n_copies
FROM w LEFT JOIN t ON t.h = w.h LEFT JOIN k ON k.h = w.h LEFT JOIN d ON d.h = w.h
"""

MEASURED = r"""
w AS (SELECT doc_id, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) >= 5),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(5) r(k) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN ln ON ln.doc_id = w.doc_id),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, [n_words < 10, 100 * n_repeat_words > 20 * n_words, n_symbols * 10 > n_words, n_dup_lines * 10 > n_lines * 3] AS rules FROM j),
hosts AS (SELECT source, rule, count(*) AS n, sum(CAST(failed AS INT)) AS fails
  FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines', 'any']) AS rule, unnest(list_append(rules, list_bool_or(rules))) AS failed FROM f) GROUP BY source, rule),
p AS (SELECT rule, sum(fails) / sum(n) AS m, sum(fails * fails / n) / sum(n) - (sum(fails) / sum(n)) * (sum(fails) / sum(n)) AS v, count(*) / sum(n) AS k FROM hosts GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN v > m * (1 - m) * k AND m * (1 - m) > v THEN greatest(1.0, m * (1 - m) / (v - m * (1 - m) * k) - 1) ELSE 100.0 END AS weight FROM p),
bad AS (SELECT source, bool_or((fails + m * weight) / (n + weight) > 0.5) AS rejected FROM hosts JOIN q ON hosts.rule = q.rule GROUP BY source)
"""

OP10 = f"WITH {MEASURED} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad.rejected AS kept FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source"


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_transactions": OP1, "op9_jaccard_join": OP9, "op10_host_rules": OP10}
