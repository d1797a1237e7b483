"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.embeddings import near_embeddings
from pulsegrid.llm.exact import exact_duplicates, normalised
from pulsegrid.llm.minhash import near_duplicates
from pulsegrid.llm.ngrams import backoff_scores
from pulsegrid.llm.packing import pack
from pulsegrid.llm.pieces import round_trip
from pulsegrid.llm.quality import classify
from pulsegrid.llm.suffixes import repeated_passages
from pulsegrid.llm.tokens import token_counts
from pulsegrid.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, which every executor has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op2_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability and kept of every document."""
    scored = classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "expected_grade", "tail_probability", "kept")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark, table(spark, sf_dir, "embeddings"))


def op4_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(spark, table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, table(spark, sf_dir, "documents")).drop("mark")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents")).drop("text_hash")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def packing_items(docs: DataFrame) -> DataFrame:
    """doc_id, length in tokens, source, and the digest of the normalised text as duplicate cluster."""
    docs = docs.select("doc_id", "source", F.sha2(normalised("text"), 256).alias("cluster"), "text")
    counts = token_counts(docs, tokenizer("byte_bpe_50k.json"), keep=["doc_id", "source", "cluster"])
    return counts.select("doc_id", F.col("n_tokens").alias("length"), "source", "cluster")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, packing_items(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_ordinal": op2_quality_ordinal,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_sentencepiece_round_trip": op4_sentencepiece_round_trip,
    "op5_backoff_scores": op5_backoff_scores,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_best_fit_packing": op10_best_fit_packing,
}

SPACES = r"'[\x20\x09-\x0D]+'"
REACHED = """e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
             r AS (SELECT {0} AS a, {0} AS b FROM {1} UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
             c AS (SELECT a, min(b) AS c FROM r GROUP BY a)"""
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
                 ((instr('0123456789abcdef', substr(d, 1 + (5 * i) // 4, 1)) - 1) * 16 + instr('0123456789abcdef', substr(d || '0', 2 + (5 * i) // 4, 1)) - 1)
                 >> (3 - (5 * i) % 4)) & 31 AS INT), 1)), '')"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
             w AS (SELECT doc_id, list_filter(string_split_regex(x, {SPACES}), lambda y: y <> '') AS ws FROM t),
             s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k(i) WHERE len(ws) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
             link AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
             {REACHED.format("doc_id", "documents")}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op3_embedding_near_dedup": f"""
        WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
             y AS (SELECT * FROM x WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda k: k IS NULL OR NOT isfinite(k))) = 0 AND len(list_filter(v, lambda k: k <> 0)) > 0),
             link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM y a JOIN y b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
             {REACHED.format("vec_id", "embeddings")},
             n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
        FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.u = vec_id""",
    "op6_suffix_array_dedup": f"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, {SPACES}), lambda y: y <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
             g AS (SELECT doc_id, i - 1 AS s, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS k(i)),
             f AS (SELECT h, min(doc_id) AS a FROM g GROUP BY h),
             m AS (SELECT doc_id, a, s, s + 50 AS e FROM g JOIN f USING (h) WHERE doc_id > a),
             k AS (SELECT *, max(e) OVER (PARTITION BY doc_id, a ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM m),
             t AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, a ORDER BY s) AS stretch FROM k)
        SELECT doc_id, a AS earlier_doc_id, min(s) AS start_word, max(e) AS end_word FROM t GROUP BY doc_id, a, stretch""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), {SPACES}, ' ', 'g')) AS h FROM documents),
             g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
        SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256
        FROM d JOIN g USING (h)""",
    "op9_warc_round_trip": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
             g AS (SELECT d, max(page_id) AS m FROM p GROUP BY d)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
               CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
        FROM p JOIN g USING (d)""",
}
