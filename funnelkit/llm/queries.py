"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import read_table
from funnelkit.llm.curriculum import curriculum_mix
from funnelkit.llm.exact_dedup import exact_dedup
from funnelkit.llm.lexical import rank_documents
from funnelkit.llm.licenses import scan_licenses
from funnelkit.llm.mtree import top_k
from funnelkit.llm.packing import pack_documents
from funnelkit.llm.pii import pseudonymise_documents
from funnelkit.llm.quality import quality_scores
from funnelkit.llm.shingles import jaccard_join
from funnelkit.llm.simhash import near_duplicates
from funnelkit.llm.suffixes import remove_repeats
from funnelkit.llm.toxicity import toxicity_scores
from funnelkit.llm.whitening import whiten


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, read_table(spark, sf_dir, "documents")).drop("spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.withColumn("evidence", F.col("evidence.doc_id"))


#: Key of the registered query. A deployment passes its own secret.
PII_KEY = b"funnelkit example key"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise_documents(read_table(spark, sf_dir, "documents"), PII_KEY)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order: documents range-sorted by their first position."""
    return (
        curriculum_mix(spark, read_table(spark, sf_dir, "documents"))
        .select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
        .orderBy("position", "doc_id")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(spark, read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, read_table(spark, sf_dir, "embeddings"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_licenses": op2_licenses,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_source_mix": op7_source_mix,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_top_k": op10_top_k,
    "op11_whitening": op11_whitening,
    "op12_lexical": op12_lexical,
    "op13_jaccard": op13_jaccard,
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
          FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    "op7_source_mix": r"""
        WITH RECURSIVE sized AS (
          SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                 CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
          FROM documents
        ),
        src AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS k
          FROM sized GROUP BY source
        ),
        weighted AS (
          SELECT *, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                 CAST(2 * source_size AS DOUBLE) AS cap
          FROM src
        ),
        -- Reshare round by round: sources above their cap at the common rate are filled.
        rounds(n, rate) AS (
          SELECT 0, (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 / sum(w) FROM weighted)
          UNION ALL
          SELECT n + 1,
                 ((SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 FROM weighted)
                  - (SELECT coalesce(sum(cap), 0) FROM weighted WHERE rate * w > cap))
                 / (SELECT sum(w) FROM weighted WHERE rate * w <= cap)
          FROM rounds
          WHERE n < 100 AND EXISTS (SELECT 1 FROM weighted WHERE rate * w <= cap)
        ),
        targets AS (
          SELECT source, source_size, k, least(cap, coalesce((SELECT rate FROM rounds ORDER BY n DESC LIMIT 1), cap / w) * w) AS target
          FROM weighted
        ),
        placed AS (
          SELECT s.doc_id, s.size, t.source_size, t.target, t.k,
                 coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ),
        taken AS (
          SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - start)) AS first,
                 greatest(0, least(size, CAST(round(target) AS BIGINT) - start - source_size)) AS again
          FROM placed
        ),
        shared AS (
          SELECT *, least(1.0::DOUBLE, CAST(start AS DOUBLE) / target) AS u,
                 CASE k WHEN 0 THEN 7.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
                 CASE k WHEN 0 THEN -8.0::DOUBLE WHEN 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS slope2,
                 CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS area
          FROM taken
        )
        SELECT doc_id, size, source_size, target, CAST(first + again AS BIGINT) AS taken,
               CASE WHEN first > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE,
                 2.0::DOUBLE * (u * area) / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + slope2 * (u * area))))))
               END AS position
        FROM shared
    """,
    "op10_top_k": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
          FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op12_lexical": r"""
        WITH words AS (
          SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM documents
        ),
        asked AS (
          SELECT item_id, term, count(*) AS repeats
          FROM (
            SELECT item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
          ) GROUP BY item_id, term
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
        tfs AS (
          SELECT doc_id, term, count(*) AS tf FROM words
          WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
        ),
        weights AS (
          SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM tfs, totals GROUP BY term, docs
        ),
        scored AS (
          SELECT item_id, doc_id,
            CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
          FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
          GROUP BY item_id, doc_id
        ),
        ranked AS (
          SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
          FROM scored WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op13_jaccard": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents
        ),
        shingles AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
          FROM words WHERE len(w) > 0
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
          FROM shingles a JOIN shingles b USING (s) GROUP BY a.doc_id, b.doc_id
        ),
        links AS (
          SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
          WHERE 100 * i >= 85 * (a.n + b.n - i)
        ),
        reach AS (
          SELECT x, y FROM links
          UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
        )
        SELECT words.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, words.doc_id) AS component_id
        FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS component FROM reach GROUP BY x) USING (doc_id)
    """,
}
