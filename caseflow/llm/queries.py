"""Registered queries of the text-pipeline operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .ann import nearest
from .bpe import digest_tokens
from .collocations import collocations
from .decontaminate import contaminated_documents
from .html_text import extract_text
from .language import identify_languages
from .pii import DEMO_KEY, pseudonymise
from .quality import score_quality
from .simhash import simhash_components
from .spans import remove_repeats
from .toxicity import score_toxicity
from .warc import archive_round_trip

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_html_extraction": op11_html_extraction,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_collocations,
}

#: Queries that SQL can express.
ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_aggregate(list_transform(range(5), lambda j:
    ((strpos('0123456789abcdef', substr(hex, 1 + (k * 5 + j) // 4, 1)) - 1) >> (3 - (k * 5 + j) % 4) & 1) << (4 - j)), 'sum')::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM g
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 100),
inside AS (
  SELECT DISTINCT s.lang, s.k, s.g FROM (
    SELECT lang, a, k - 1 AS k, unnest([g[1:k - 1], g[2:k]]) AS g FROM f WHERE k > 2) AS s JOIN f ON f.lang = s.lang AND f.k = s.k AND f.g = s.g AND 100 * s.a >= 100 * f.a),
cuts AS (
  SELECT c.lang, c.g, c.a, c.cut, l.a AS l, r.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1) AS c
  JOIN f AS l ON l.lang = c.lang AND l.k = c.cut AND l.g = c.g[1:c.cut]
  JOIN f AS r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.g = c.g[c.cut + 1:c.k]
  JOIN totals AS t ON t.lang = c.lang
  ANTI JOIN inside AS x ON x.lang = c.lang AND x.k = c.k AND x.g = c.g),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM worst)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
""",
}
