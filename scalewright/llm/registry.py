"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, divergence_rules, dom_marginals, drift_clusters, fourier_quality, minimax_shards, mixing_coder, order_minhash, phrase_filters, quotient_dedup, source_mix, warc_chunks

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"

PHRASES_SQL = r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w) GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
    cuts AS (SELECT c.*, cut, array_to_string(w[:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM c, range(1, 3) t(cut) WHERE cut < k),
    scored AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, f1.f AS l, f2.f AS r, ((1000000::HUGEINT * a * a) // (f1.f::HUGEINT * f2.f))::BIGINT AS score
        FROM cuts JOIN f f1 ON f1.lang = cuts.lang AND f1.k = cut AND f1.phrase = p1 JOIN f f2 ON f2.lang = cuts.lang AND f2.k = cuts.k - cut AND f2.phrase = p2),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    longer AS (SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY lang, phrase)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
    FROM best b JOIN n USING (lang) LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a
    QUALIFY rank <= 2000"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_groups(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.assessed(_table(spark, sf_dir, "documents"))


def op4_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourier_quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_coder.stored_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FILE))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.sharded(_table(spark, sf_dir, "documents"))


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.archived(_table(spark, sf_dir, "pages"))


def op8_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_marginals.extracted(_table(spark, sf_dir, "pages"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(_table(spark, sf_dir, "documents"))


def op10_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_clusters.clustered(_table(spark, sf_dir, "embeddings"))


def op12_phrase_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_filters.collocations(_table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return chat_format.digests(turns, chat_format.probe(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_order_minhash, op2_byte_bpe, op3_divergence_rules, op4_fourier_quality, op5_mixing_coder, op6_minimax_shards, op7_warc_chunks, op8_dom_marginals, op9_source_mix, op10_quotient_dedup, op11_drift_clusters, op12_phrase_filters, op13_chat_format)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc_chunks": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN first_id <> page_id THEN first_id END AS refers_to
            FROM p LEFT JOIN f USING (payload_digest)""",
        "op10_quotient_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER w = doc_id AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id)""",
        "op11_drift_clusters": drift_clusters.oracle(),
        "op12_phrase_filters": PHRASES_SQL,
        "op13_chat_format": f"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum({len(chat_format.OPEN + chat_format.CLOSE + chat_format.END)} + length({chat_format.sql_escaped("role")}) + length({chat_format.sql_escaped("text")}))::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
    }
