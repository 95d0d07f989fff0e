"""A corpus-cleaning pipeline of five stages, each one of the operators of ``loomstone.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``;
its result is written as Parquet and read again as the next stage's ``docs``.
A stage may be called by itself: each sends the package and bounds Arrow batches first.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import langid, line_dedup, near_dedup, packing, quality
from loomstone.llm.queries import GOOD
from loomstone.llm.shared import free_name, save, table
from loomstone.ship import ready


@ready
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least ``GOOD``; without usable labels all rows stay. Null and empty texts are scored like any other."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~quality.quality_fold())
    if model.means is None:
        return docs
    score = free_name(docs, "score")
    return quality.quality_scores(docs, model, tuple(docs.columns), score_col=score).where(F.col(score) >= GOOD).drop(score)


@ready
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language, by a model of the rows' own labels; texts without letters go. Without labels all rows stay."""
    model = langid.fit(docs, ~langid.language_fold())
    if not model.names:
        return docs
    names = tuple(free_name(docs, n) for n in ("lang_pred", "score", "mixture"))
    return langid.language_id(docs, model, tuple(docs.columns), names=names).where(F.col(names[0]) != langid.UNKNOWN).drop(*names)


@ready
def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows less their cross-site boilerplate lines, ``n_chars`` updated; a document of which nothing visible is left goes."""
    added = line_dedup.line_dedup(docs)
    left = added.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(*docs.columns)


@ready
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that with the smallest id. Null ids stay."""
    found = near_dedup.near_dedup(docs.select("doc_id", "text"), width=5, percent=80)
    gone = save(found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


@ready
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences: ``doc_id, piece, start, length, sequence_id, offset``."""
    pieces = packing.tokenise(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, ids=False, characters=500_000)
    return packing.best_two_fit(pieces, 1024)


STAGES = [
    ("quality classifier", keep_good),
    ("language id", keep_known_language),
    ("line dedup", drop_boilerplate),
    ("minhash near-dedup", keep_one_of_near_copies),
    ("best-fit packing", pack),
]

#: The classifiers, the n-gram model and the tokeniser have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
