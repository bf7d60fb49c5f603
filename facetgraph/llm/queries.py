"""The registered queries of the operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.llm.audio import text_audio_features
from facetgraph.llm.common import held_out, table
from facetgraph.llm.fingerprint import fingerprint_edits
from facetgraph.llm.language import predict_language, train_language_model
from facetgraph.llm.lm_score import score_documents
from facetgraph.llm.mixing import label_quality, mix_sources
from facetgraph.llm.near_dedup import near_duplicates
from facetgraph.llm.packing import pack_documents
from facetgraph.llm.token_counts import count_tokens
from facetgraph.llm.url_filter import UrlRule, filter_urls
from facetgraph.llm.warc import archive_pages

URL_RULES = [UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("block", "example.com/de/"), UrlRule("allow", "org/fr/")]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), held_out("doc_id", 7))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), quality=label_quality(table(spark, sf_dir, "labels")), plain_quality=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audio_features(table(spark, sf_dir, "documents"), keep_tensors=False)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs, ~held_out("doc_id", 4))
    predicted = predict_language(docs, model)
    return predicted.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score", "n_switches")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_range", "history_position")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_fingerprint": op2_fingerprint,
        "op3_packing": op3_packing,
        "op4_mixing": op4_mixing,
        "op5_near_dedup": op5_near_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_url_filter": op7_url_filter,
        "op8_audio": op8_audio,
        "op9_language": op9_language,
        "op10_warc": op10_warc,
    }


#: Hosts and paths by string functions, then the longest of the four rules.
URL_SQL = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, rule_host, rule_path, says) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT q.*, r.rule, r.says, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC, rule) AS k
  FROM q LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM f WHERE k = 1
"""

#: Targets by the level of water over sources sorted by ceiling over weight; draws by the same hashed keys.
MIX_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN avg(quality) = 1 THEN 4.0 WHEN avg(quality) = 0 THEN 1.0 ELSE 2.0 END AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(CAST(length(text) AS VARCHAR), ''))), 1, 12) AS BIGINT) + 0.5)
    / 281474976710656.0) / coalesce(weight, 2.0) AS mix_key
  FROM documents LEFT JOIN w USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS share FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / share AS ratio FROM n),
v AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(share) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
g AS (SELECT (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS level),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(most, share * coalesce(g.level, 0.0)) END AS target FROM v, g),
b AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS epochs FROM t),
c AS (SELECT *, CAST(floor(target - epochs * source_size) AS BIGINT) AS budget FROM b),
o AS (SELECT d.doc_id, d.source, d.size, c.source_size, c.target, c.epochs, c.budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mix_key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(budget - before, 0)) AS BIGINT) AS taken, source FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": MIX_SQL, "op7_url_filter": URL_SQL}
