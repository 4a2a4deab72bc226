"""The corpus pipeline: documents are filtered by quality, stripped of repeated lines, thinned to one of each group of near
duplicates, cleared of benchmark leaks and packed into token sequences.

Each stage works on all that the one before has kept. Stages but the last return the columns of their input. Rows with a null
id go through the filters: nothing names them, so nothing drops them but the quality score. Of rows that repeat an id and a
text, near-duplicate removal keeps one. Empty tables go through every stage; without usable labels the quality stage keeps all.
Null texts count as empty ones. Very long texts are worked on whole. Of documents that tie, near duplicates among them, the
smallest id stays, and where an id repeats the text of least hash. Further columns are carried along whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontamination, line_dedup, packing, quality, simhash
from lodestar.llm.common import free_name, table, written

#: Least score of documents that stay.
QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of those at hand, scores at QUALITY or more.

    Where the labels teach it nothing (none or only one value outside the held-out ids, or none to calibrate with), all documents stay.
    """
    stats, score = free_name(docs, "__stats"), free_name(docs, "__score")
    told = written(docs.withColumn(stats, quality.statistics_of(F.col("text"))))  # every text is looked at once
    model = quality.fit(told.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stats).alias("stats")), table(spark, sf_dir, "labels"))
    if not len(model.knots):
        return docs
    return told.withColumn(score, quality.score_of(F.col(stats), model)).where(F.col(score) >= QUALITY).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of a larger id holds; n_chars follows the text."""
    kept = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near duplicates: texts that are linked by similarities of 0.8 or more over five-word shingles.

    Links come from SimHash fingerprints through the byte-position index with shared bytes counted, each verified; as fingerprints guarantee
    two bits only, min-hashes complete them. Where the id repeats within the group, it is one of its rows, picked by the hash of its text.
    """
    return simhash.thin(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    own = free_name(docs, "__id")
    leaked = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaked, F.col("doc_id") == F.col(own), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier's score can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
