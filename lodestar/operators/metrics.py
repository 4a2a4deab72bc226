"""Retrieval metrics against pooled human judgements, coverage of judgements, and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .review import resolved_tasks

SLOTS = 20


def judgements(labels: DataFrame, pool: DataFrame) -> DataFrame:
    """(candidate_id, scenario_id, verdict) of human yes or no labels on pool tasks; verdicts that contradict each other are an error."""
    human = resolved_tasks(labels.where("evaluator_kind = 'human'"), pool).where(F.col("topic_fit").isin("yes", "no"))
    one = human.groupBy("candidate_id", "scenario_id").agg(F.collect_set("topic_fit").alias("v"))
    clash = F.raise_error(F.concat(F.lit("contradicting labels for "), F.col("candidate_id"))).cast("string")
    tasks = pool.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s")).distinct()
    return one.select("candidate_id", "scenario_id", F.when(F.size("v") > 1, clash).otherwise(F.col("v")[0]).alias("verdict")).join(tasks, F.col("candidate_id").eqNullSafe(F.col("__c")) & F.col("scenario_id").eqNullSafe(F.col("__s")), "left_semi")


def coverage(labels: DataFrame, pool: DataFrame) -> DataFrame:
    """(topic_fit, tasks, evaluator_versions) of human labels on pool tasks."""
    human = resolved_tasks(labels.where("evaluator_kind = 'human'"), pool)
    tasks = pool.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s")).distinct()
    inside = human.join(tasks, F.col("candidate_id").eqNullSafe(F.col("__c")) & F.col("scenario_id").eqNullSafe(F.col("__s")), "left_semi")
    return inside.groupBy("topic_fit").agg(F.countDistinct("candidate_id", F.coalesce("scenario_id", F.lit(""))).alias("tasks"), F.array_join(F.sort_array(F.collect_set("evaluator_version")), ",").alias("evaluator_versions"))


def in_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows whose task, or whose candidate without a scenario, is in the split."""
    s = split.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s")).distinct()
    return rows.join(s, (F.col("candidate_id") == F.col("__c")) & (F.col("__s").isNull() | (F.col("__s") == F.col("scenario_id"))), "left_semi")


def scenario_metrics(run: DataFrame, verdicts: DataFrame, pool: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """A row of metrics for each scenario of run (candidate_id, scenario_id, rank, position, context_complete).

    What nobody judged is unjudged, not wrong: precision over all returned rows is known only if all are judged, precision
    at 20 slots only if 20 are filled, and recall is over the pool's relevant tasks. A rank that isn't positive gives way to the position.
    """
    rows = in_split(run, split) if split is not None else run
    tasks = pool.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s"), F.col("stratum").alias("__stratum") if "stratum" in pool.columns else F.lit("adjacent").alias("__stratum")).distinct()
    v = verdicts.select(F.col("candidate_id").alias("__vc"), F.col("scenario_id").alias("__vs"), "verdict")
    joined = rows.join(tasks, F.col("candidate_id").eqNullSafe(F.col("__c")) & F.col("scenario_id").eqNullSafe(F.col("__s")), "left").join(v, F.col("candidate_id").eqNullSafe(F.col("__vc")) & F.col("scenario_id").eqNullSafe(F.col("__vs")), "left")
    rank = F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.col("position"))
    yes, inside = F.col("verdict") == "yes", F.col("__c").isNotNull()
    found = joined.groupBy("scenario_id").agg(
        F.count("*").alias("returned"), F.count("verdict").alias("judged"), F.count_if(yes).alias("relevant"), F.count_if(F.col("verdict").isNull()).alias("unjudged"), F.count_if(~inside).alias("outside_pool"),
        F.count_if(yes & (rank <= SLOTS)).alias("slots_relevant"), F.count_if(rank <= SLOTS).alias("slots"), F.min_by(rank, F.when(yes, F.col("position"))).alias("first_relevant"),
        F.count_if(F.col("__stratum") == "unknown").alias("context_missing"), F.count_if(~F.col("context_complete")).alias("context_truncated"),
    )
    wanted = verdicts.where("verdict = 'yes'").groupBy("scenario_id").agg(F.count("*").alias("pool_relevant"))
    out = found.join(wanted, "scenario_id", "left").withColumn("pool_relevant", F.coalesce("pool_relevant", F.lit(0).cast("bigint")))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.select(
        "scenario_id", "returned", "judged", "relevant", "unjudged", "outside_pool", share("relevant", "judged").alias("precision_judged"), F.when(F.col("judged") == F.col("returned"), share("relevant", "returned")).alias("precision_returned"),
        share("judged", "returned").alias("judgement_coverage"), F.when(F.col("slots") >= SLOTS, F.col("slots_relevant") / SLOTS).alias("precision_slots"), "pool_relevant", share("relevant", "pool_relevant").alias("pool_recall"),
        F.when(F.col("relevant") > 0, F.lit(1.0) / F.col("first_relevant")).alias("reciprocal_rank"), "context_missing", "context_truncated",
    )


def totals(metrics: DataFrame) -> DataFrame:
    names = ("returned", "judged", "relevant", "unjudged", "outside_pool", "pool_relevant", "context_missing", "context_truncated")
    return metrics.agg(F.count("*").alias("scenarios"), *[F.sum(n).alias(n) for n in names])


def positions(run: DataFrame) -> DataFrame:
    """run with the 1-based position of each row within its scenario."""
    return run.withColumn("position", F.row_number().over(Window.partitionBy("scenario_id").orderBy("rank", "candidate_id")))


def findings(labels: DataFrame, card_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, counts): valid yes labels with their card's source; a label without a card, or a card without identity, is an error."""
    c = card_rows.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s"), "source", F.lit(True).alias("__card"))
    joined = labels.join(c, F.col("candidate_id").eqNullSafe(F.col("__c")) & F.col("scenario_id").eqNullSafe(F.col("__s")), "left")
    alone = F.raise_error(F.concat(F.lit("no card for "), F.col("candidate_id"))).cast("string")
    state = F.when(F.col("__card").isNull(), alone).when(~F.coalesce(F.col("validation_status") == "valid", F.lit(False)), "skipped_invalid").when(F.col("topic_fit") != "yes", "skipped_uncertain").otherwise("finding")
    told = joined.withColumn("state", state)
    nameless = F.raise_error(F.concat(F.lit("no message identity for "), F.col("candidate_id"))).cast("string")
    rows = told.where("state = 'finding'").select("candidate_id", "scenario_id", F.coalesce("source.message_fullname", nameless).alias("message_fullname"), F.coalesce("source.thread_fullname", nameless).alias("thread_fullname"), "source.text", "topic_fit")
    return rows, told.groupBy("state").count()
