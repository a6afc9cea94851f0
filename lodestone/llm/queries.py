"""The text-preparation queries, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact_dedup, html_text, jaccard, lm, packing, quality, token_counts, topk, warc
from lodestone.llm.common import new_folder
from lodestone.sources import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), F.length("text").cast("long").alias("n_chars"), "text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base32: of five digits of its hexadecimal form, 20 bits, come four letters.
OP3_SQL = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, MIN(page_id) OVER (PARTITION BY h) AS f,
    list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - k % 4 * 5 AS INTEGER)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM d
"""


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) AS r
WHERE rank <= 10
"""


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"), word_bpe()).withColumnRenamed("id", "doc_id")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
g AS (
  SELECT doc_id, list_distinct(list_transform(range(1, 1 + CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 4) END), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
  FROM d
),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))
),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, least(g.doc_id, COALESCE(MIN(r.b), g.doc_id)) AS component_id
FROM g LEFT JOIN reached AS r ON r.a = g.doc_id
GROUP BY g.doc_id, len(g.s)
"""


def word_bpe() -> str:
    """The 49k word vocabulary's file."""
    import public_tokenizers

    return bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = word_bpe()
    found = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), definition), definition)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"),
        F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(read_table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits made by rule (token_counts.sample_edits)."""
    import public_tokenizers

    ranks, pattern = token_counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").withColumn("edits", token_counts.sample_edits(F.col("doc_id"), F.col("text")))
    found = token_counts.apply_edits(token_counts.trees(docs, ranks, pattern, keep=("edits",)), ranks, pattern)
    return found.select(F.col("id").alias("doc_id"), "n_before", "n_tokens", "n_edits", "encoded_chars", F.char_length("text").cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), word_bpe())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP8_SQL = r"""
SELECT doc_id, MIN(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size, doc_id = MIN(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents) AS t
WINDOW w AS (PARTITION BY text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_html, op3_warc, op4_topk, op5_lm, op6_jaccard, op7_bpe, op8_exact_dedup, op9_token_counts, op10_packing, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_topk": OP4_SQL, "op6_jaccard": OP6_SQL, "op8_exact_dedup": OP8_SQL}
