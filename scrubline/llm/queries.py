"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are all vectors whose id is divisible by 20; each is searched among all others."""
    from .topk import exact_top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=10, leave_out_own=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), n_shards=64)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .token_counts import token_counts

    return pack(token_counts(_table(spark, sf_dir, "documents")), length_col="n_tokens")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of pages are texts, and given as such."""
    from .warc import archive, capture

    out = archive(capture(_table(spark, sf_dir, "pages")))
    rows = out.withColumn("payload", out["payload"].cast("string")).drop("http")
    rows.archives = out.archives
    return rows


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_sharding": op2_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash": op10_minhash,
}

ORACLES = {
    "op1_top_k": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, round(list_cosine_similarity(q.e, n.e), 6) AS score
              FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
        WHERE rank <= 10""",
    "op2_sharding": """
        WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
        s AS (SELECT doc_id, n_bytes, sum(n_bytes) OVER () AS total,
                     sum(n_bytes) OVER (ORDER BY doc_id NULLS LAST, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes AS byte_start FROM d)
        SELECT doc_id, n_bytes, CAST(byte_start AS BIGINT) AS byte_start,
               CAST(least(byte_start // greatest(1, (total + 63) // 64), 63) AS INTEGER) AS shard FROM s""",
    "op3_exact_dedup": """
        SELECT doc_id, kept_doc_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> kept_doc_id""",
    # a word goes with the white space after it; one is gone if a window of 50 words that it is in has an earlier one apart from it
    "op5_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, text, regexp_extract(text, '^[\t-\r\x1c-\x20]*') AS head, regexp_extract_all(text, '[^\t-\r\x1c-\x20]+[\t-\r\x1c-\x20]*') AS parts
                   FROM documents),
        w AS (SELECT doc_id, parts, list_transform(parts, lambda p: regexp_replace(p, '[\t-\r\x1c-\x20]+$', '')) AS words FROM t WHERE len(parts) >= 50),
        n AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w),
        h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM n),
        f AS (SELECT h, min({'d': doc_id, 'i': i}) AS f FROM h GROUP BY h HAVING count(*) > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (h) WHERE doc_id <> f.d OR i - f.i >= 50),
        p AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM t),
        k AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS kept FROM p ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE head || coalesce(kept, '') END AS text FROM t LEFT JOIN k USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT coalesce(CAST(page_id AS VARCHAR), 'null') AS p, coalesce(url, '') AS url, coalesce(html, '') AS payload,
                          'sha1:' || sha1(coalesce(html, '')) AS digest FROM pages),
        o AS (SELECT digest, min(p || '-1') AS original, arg_min(url, p || '-1') AS refers_url FROM p GROUP BY digest),
        r AS (SELECT p || '-1' AS record_id, 'response' AS was, * FROM p UNION ALL SELECT p || '-2', 'revisit', * FROM p),
        k AS (SELECT r.*, original, refers_url, CASE WHEN was = 'response' AND record_id = original THEN 'response' ELSE 'revisit' END AS warc_type
              FROM r JOIN o USING (digest)),
        n AS (SELECT *, CASE WHEN warc_type = 'response' THEN strlen(payload) ELSE 0 END AS n,
                     md5(warc_type || ' ' || record_id || ' ' || digest) AS a, md5('response ' || original || ' ' || digest) AS b FROM k)
        SELECT record_id, warc_type, url, digest, CASE WHEN warc_type = 'revisit' THEN original END AS refers_to,
               CAST(n AS BIGINT) AS payload_bytes,
               'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || warc_type || chr(13) || chr(10)
               || 'WARC-Record-ID: <urn:uuid:' || a[1:8] || '-' || a[9:12] || '-' || a[13:16] || '-' || a[17:20] || '-' || a[21:32] || '>' || chr(13) || chr(10)
               || 'WARC-Date: 2026-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
               || 'WARC-Payload-Digest: ' || digest || chr(13) || chr(10)
               || CASE WHEN warc_type = 'revisit' THEN
                    'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || chr(13) || chr(10)
                    || 'WARC-Refers-To: <urn:uuid:' || b[1:8] || '-' || b[9:12] || '-' || b[13:16] || '-' || b[17:20] || '-' || b[21:32] || '>' || chr(13) || chr(10)
                    || 'WARC-Refers-To-Target-URI: ' || refers_url || chr(13) || chr(10)
                    || 'WARC-Refers-To-Date: 2026-01-01T00:00:00Z' || chr(13) || chr(10) ELSE '' END
               || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
               || 'Content-Length: ' || CASE WHEN was = 'response'
                    THEN n + 77 + length(CAST(strlen(payload) AS VARCHAR)) ELSE 0 END || chr(13) || chr(10) || chr(13) || chr(10) AS header,
               CASE WHEN warc_type = 'response' THEN payload END AS payload
        FROM n""",
}
