"""The test tables as this engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NUL, sha_hex


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread for each conversation; each turn answers the one before."""
    c = read(spark, sf_dir, "conversations")
    thread = F.concat(F.lit("t3_c"), F.col("conv_id").cast("string"))
    turn = lambda k: F.concat(F.lit("t1_c"), F.col("conv_id").cast("string"), F.lit("_"), k.cast("string"))
    t = F.col("turn")
    body = F.coalesce("text", F.lit(""))
    return c.select(
        F.when(t == 0, thread).otherwise(turn(t)).alias("fullname"), F.when(t == 0, "submission").otherwise("comment").alias("kind"), thread.alias("thread_fullname"),
        F.when(t == 1, thread).when(t > 1, turn(t - 1)).alias("parent_fullname"), F.lit("").alias("raw_title"), body.alias("raw_body"), F.col("role").alias("subreddit"),
        (F.col("conv_id") * 1000 + t).cast("bigint").alias("created_utc"), sha_hex(F.concat(F.lit(NUL), body)).alias("source_revision_id"), F.concat(F.lit("/c/"), "conv_id", F.lit("/"), "turn").alias("permalink"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission for each document."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("t3_d"), F.col("doc_id").cast("string"))
    body = F.coalesce("text", F.lit(""))
    return d.select(
        name.alias("fullname"), F.lit("submission").alias("kind"), name.alias("thread_fullname"), F.lit(None).cast("string").alias("parent_fullname"), F.lit("").alias("raw_title"), body.alias("raw_body"),
        F.col("source").alias("subreddit"), F.col("doc_id").cast("bigint").alias("created_utc"), sha_hex(F.concat(F.lit(NUL), body)).alias("source_revision_id"), F.concat(F.lit("/d/"), "doc_id").alias("permalink"),
    )


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents: those of even id in all revisions, the others in a revision that is not theirs, which blocks them as context only."""
    rows = read(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("t3_d"), F.col("doc_id").cast("string")).alias("message_fullname"), "doc_id")
    revision = F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("0" * 64))
    return rows.select("message_fullname", revision.alias("source_revision_id"), F.lit("toxic").alias("reason"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels: quality 1 is yes, 0 is no; every seventh is unknown."""
    fit = F.when(F.col("doc_id") % 7 == 0, "unknown").when(F.col("quality") == 1, "yes").otherwise("no")
    return read(spark, sf_dir, "labels").select(F.concat(F.lit("t3_d"), F.col("doc_id").cast("string")).alias("candidate_id"), F.lit(None).cast("string").alias("scenario_id"), fit.alias("topic_fit"), F.lit("human").alias("evaluator_kind"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("evaluator_version"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


#: SQL of the same tables, for the checks by another engine.
MESSAGES_SQL = """
cm AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 't3_c' || conv_id ELSE 't1_c' || conv_id || '_' || turn END AS fullname, CASE WHEN turn = 0 THEN 'submission' ELSE 'comment' END AS kind,
  't3_c' || conv_id AS thread_fullname, CASE WHEN turn = 1 THEN 't3_c' || conv_id WHEN turn > 1 THEN 't1_c' || conv_id || '_' || (turn - 1) END AS parent_fullname, coalesce(text, '') AS raw_body, role AS subreddit,
  (conv_id * 1000 + turn)::BIGINT AS created_utc, sha256(chr(0) || coalesce(text, '')) AS source_revision_id, '/c/' || conv_id || '/' || turn AS permalink FROM conversations),
dm AS (SELECT doc_id, 't3_d' || doc_id AS fullname, 'submission' AS kind, 't3_d' || doc_id AS thread_fullname, coalesce(text, '') AS raw_body, source AS subreddit, doc_id AS created_utc, sha256(chr(0) || coalesce(text, '')) AS source_revision_id FROM documents),
ts AS (SELECT 't3_d' || doc_id AS message_fullname, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE repeat('0', 64) END AS source_revision_id, 'toxic' AS reason FROM labels WHERE toxic = 1),
jd AS (SELECT 't3_d' || doc_id AS candidate_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS topic_fit, 'v' || (doc_id % 2) AS evaluator_version, doc_id FROM labels)"""
