"""The contract queries ``opN_<name>`` and their SQL, where SQL can say the same.

Each query reads a whole table, calls its operator with production parameters
and derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cover_tree, exact_dedup, langid, line_dedup, near_dedup, packing, quality, toxicity, warc
from .shared import table

#: Scores at or above these count as label 1.
GOOD, TOXIC = 0.7, 0.5


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, remember=1_200_000)  # some 250 MB a worker
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_two_fit(pieces, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.language_fold())
    return langid.language_id(docs.select("doc_id", "text"), model).select("doc_id", langid.language_fold().alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the digest is taken before the operator's join, so that no text has to pass through it
    hashed = docs.withColumn("text_sha256", F.sha2(F.encode(exact_dedup.normalise(F.col("text")), "UTF-8"), 256))
    return exact_dedup.exact_dedup(hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_dedup(docs, width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    both = bpe.decode(ids, ranks, pattern)
    return both.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were removed, and the digest of what stays (null text: null)."""
    clean = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~quality.quality_fold())
    scores = quality.quality_scores(docs, model)
    return scores.select("doc_id", quality.quality_fold().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    pages = warc.revisits(pages.withColumn("digest", F.sha2("payload", 256)))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = pages.select(
        urn("page_id").alias("record_id"), "record_type", F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.when(F.col("record_type") == "revisit", urn("first_id")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"), "payload",
    )
    folder = warc.write_archives(records, compression="gzip")
    page = lambda c: F.regexp_extract(F.col(c), r"^urn:page:(.*)$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    # responses are measured by the payload itself; revisits have none, their header tells
    whole = warc.read_archives(spark, folder).where("record_type = 'response'").select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = warc.read_archives(spark, folder, payload=False).where("record_type = 'revisit'").select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return whole.unionByName(again)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.toxicity_fold())
    scores = toxicity.toxicity_scores(docs, machine)
    return scores.select("doc_id", toxicity.toxicity_fold().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_exact_dedup, op4_near_dedup, op5_byte_bpe, op6_line_dedup, op7_quality, op8_top_k, op9_warc, op10_toxicity)}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
    """,
    "op6_line_dedup": r"""
        WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, coalesce(source, '') AS source, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS raw FROM d),
             t AS (SELECT doc_id, source, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
             wide AS (SELECT line, min(doc_id) AS first_id FROM t WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT source) >= 5),
             gone AS (SELECT t.doc_id, list(DISTINCT pos) AS g FROM t JOIN wide ON t.line = wide.line WHERE t.doc_id <> first_id GROUP BY t.doc_id),
             kept AS (SELECT d.doc_id, d.text, d.lines, coalesce(gone.g, []) AS g FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id)
        SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(lines) END::INTEGER AS n_lines, len(g)::INTEGER AS n_removed,
               sha256(CASE WHEN len(g) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(g, i)), lambda i: lines[i]), chr(10)) END) AS text_sha256
        FROM kept
    """,
    "op8_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT q.page_id, payload_bytes, q.payload_digest, CASE WHEN first_id <> q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> q.page_id THEN first_id END AS refers_to
        FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest AND payload_bytes >= 100
    """,
}
