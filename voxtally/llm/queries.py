"""Queries of the operators over their whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.bpe import bpe_encode
from voxtally.llm.exact import exact_duplicates
from voxtally.llm.negatives import hard_negatives
from voxtally.llm.packing import pack_documents
from voxtally.llm.pieces import encode_pieces
from voxtally.llm.resampling import resample
from voxtally.llm.runs import periodic_runs
from voxtally.llm.secrets import fit_network, scan_secrets
from voxtally.llm.sharding import shard_by_bytes
from voxtally.llm.simhash import simhash_components
from voxtally.llm.substrings import remove_repeats
from voxtally.llm.vectors import linked_vectors
from voxtally.llm.warc import archived_pages

SHARDS = 40


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return scan_secrets(docs, fit_network(docs))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_by_bytes(_table(spark, folder, "documents"), SHARDS)


def op3_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_encode(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linked_vectors(_table(spark, folder, "embeddings"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_table(spark, folder, "documents"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents"), with_text=False).drop("kept_text")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(spark, _table(spark, folder, "pages"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(_table(spark, folder, "documents"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text); the words of one text in ten repeat from some word on.

    h is the CRC-32 of the decimal id. If it is divisible by ten, the n words of the text
    repeat from word a = g % n on with period 1 + (n - a) / (3 + g % 8), where g = h / 10,
    all in whole numbers.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Out of a generator, so that the text is not split again for every word.
    staged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.floor(h / 10).alias("g"),
        F.explode(F.array(F.when(h % 10 == 0, words))).alias("words"),
    )
    n = F.size("words")
    a = F.col("g") % n
    placed = staged.withColumn("a", F.when(n > 0, a))
    placed = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    tailed = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", at(i))))
    return placed.select(
        "doc_id", F.when(F.col("a").isNotNull(), F.array_join(tailed, " ")).otherwise(F.col("text")).alias("text")
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(_table(spark, folder, "documents")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    # Runs are in the order that decides ties.
    higher = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | higher(r, best), r).otherwise(best))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = found.select("doc_id", "n_words", "runs", "collapsed_text", F.explode(F.array(best)).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(_table(spark, folder, "documents"), path, with_pieces=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_sharding,
        op3_importance_resampling,
        op4_byte_bpe,
        op5_vector_dedup,
        op6_exact_dedup,
        op7_substring_dedup,
        op8_warc,
        op9_best_fit_packing,
        op10_simhash,
        op11_periodic_runs,
        op12_hard_negatives,
        op13_piece_bpe,
    )
}

SQL = {
    "op5_vector_dedup": """
WITH RECURSIVE
v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
usable AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
),
reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
),
roots AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
""",
    "op6_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
""",
    "op7_substring_dedup": """
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS body
  FROM t, unnest(generate_series(1, len(words) - 49)) AS s(i)
),
f AS (SELECT body, min(doc_id) AS first_doc FROM w GROUP BY body HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w JOIN f USING (body) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(generate_series(0, 49)) AS s(k)),
p AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(
    CASE WHEN places IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM t LEFT JOIN p USING (doc_id)
""",
    "op8_warc": """
WITH t AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) || '0' AS h FROM pages),
f AS (SELECT payload, min(page_id) AS first_page FROM t GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || rpad(substr(h, (5 * i) // 4 + 1, 3), 3, '0'))::INTEGER >> (7 - (5 * i) % 4)::INTEGER) & 31) + 1)::INTEGER, 1)),
    '') AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM t JOIN f USING (payload)
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
),
n AS (
  SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
""",
}
