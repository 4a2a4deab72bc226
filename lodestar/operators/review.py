"""Review: cards, a queue balanced over rules, worksheets, checks of drafts, and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_ratio
from ..plans.publish import written
from .ordering import numbered


def cards(units: DataFrame, order: Column | None = None, scenario: Column | None = None) -> DataFrame:
    """(candidate_id, scenario_id, selection_order, matched_rule_ids, source, context) of units or selected messages, numbered in one order; ties go by candidate."""
    have = set(units.columns)
    col = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    source = F.struct(
        F.coalesce(col("message_fullname"), col("fullname")).alias("message_fullname"), col("thread_fullname").alias("thread_fullname"), col("source_revision_id").alias("source_revision_id"),
        F.coalesce(col("focus_field"), F.lit("body")).alias("field"), col("raw_title").alias("title"), F.coalesce(col("focus_text"), col("raw_body")).alias("text"), col("subreddit").alias("subreddit"), col("created_utc", "bigint").alias("created_utc"), col("permalink").alias("permalink"),
    )
    context = F.struct(col("context_text").alias("text"), col("context_complete", "boolean").alias("context_complete"), col("context_message_refs", "array<string>").alias("message_fullnames"))
    candidate = F.coalesce(col("unit_id"), col("fullname"))
    told = units.select(
        candidate.alias("candidate_id"), (scenario if scenario is not None else F.lit(None).cast("string")).alias("scenario_id"), (order if order is not None else candidate).alias("__order"),
        col("matched_rule_ids", "array<string>").alias("matched_rule_ids"), source.alias("source"), context.alias("context"),
    )
    placed = numbered(told, ["__order", "candidate_id"], "selection_order")
    return placed.select("candidate_id", "scenario_id", "selection_order", "matched_rule_ids", "source", "context")


def balanced_queue(rows: DataFrame, limit: int) -> DataFrame:
    """(candidate_id, scenario_id, queue_order, rule_id): rules in the order of how few cards they have take their quota in selection order; what is left is filled in selection order.

    A rule's quota is limit / rules, one more for the first of them as the remainder asks. A card counts for the first rule that takes it.
    Rules are configuration, so the loop over them is short; each step is an anti-join and a bounded top-N.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    by_rule = rows.select("candidate_id", "scenario_id", "selection_order", F.explode("matched_rule_ids").alias("rule")).distinct()
    counts = by_rule.groupBy("rule").count().orderBy("count", "rule").collect()  # one row for each rule
    base, more = divmod(limit, max(1, len(counts)))
    task = lambda a, b: a["candidate_id"].eqNullSafe(b["c"]) & a["scenario_id"].eqNullSafe(b["s"])
    taken: DataFrame | None = None
    for k, r in enumerate(counts):
        free = by_rule.where(F.col("rule") == r["rule"])
        if taken is not None:
            free = free.join(taken.select(F.col("candidate_id").alias("c"), F.col("scenario_id").alias("s")), task(by_rule, {"c": F.col("c"), "s": F.col("s")}), "left_anti")
        quota = base + (k < more)
        mine = free.orderBy("selection_order", "candidate_id", "scenario_id").limit(quota).withColumn("__step", F.lit(k)).withColumnRenamed("rule", "rule_id")
        taken = written(mine if taken is None else taken.unionByName(mine))
    done = taken if taken is not None else rows.limit(0).select("candidate_id", "scenario_id", "selection_order", F.lit("").alias("rule_id"), F.lit(0).alias("__step"))
    missing = limit - done.count()
    rest = rows.select("candidate_id", "scenario_id", "selection_order").join(done.select(F.col("candidate_id").alias("c"), F.col("scenario_id").alias("s")), F.col("candidate_id").eqNullSafe(F.col("c")) & F.col("scenario_id").eqNullSafe(F.col("s")), "left_anti")
    fill = rest.orderBy("selection_order", "candidate_id", "scenario_id").limit(max(0, missing)).withColumn("rule_id", F.lit(None).cast("string")).withColumn("__step", F.lit(len(counts)))
    both = done.unionByName(fill)
    w = Window.orderBy("__step", "selection_order", "candidate_id", "scenario_id")
    return both.select("candidate_id", "scenario_id", F.row_number().over(w).cast("bigint").alias("queue_order"), "rule_id")


def worksheet(queue: DataFrame) -> DataFrame:
    """A pending annotation for each queued card; queue orders must differ."""
    w = Window.partitionBy("queue_order")
    twice = F.when(F.count("*").over(w) > 1, F.raise_error(F.lit("a queue order stands twice")).cast("string"))
    return queue.withColumn("review_status", F.coalesce(twice, F.lit("pending"))).withColumn("topic_fit", F.lit(None).cast("string")).withColumn("need_clarity", F.lit(None).cast("string")).withColumn("note", F.lit(""))


def evidence_failure(item: Column, source: Column) -> Column:
    """What is wrong with a piece of evidence first, or null: message, revision, field, offsets, quote."""
    text = F.when(item["field"] == "title", source["title"]).when(item["field"] == source["field"], source["text"])
    return (
        F.when(~item["message_fullname"].eqNullSafe(source["message_fullname"]), "message").when(~item["source_revision_id"].eqNullSafe(source["source_revision_id"]), "revision")
        .when((item["field"] != "title") & (item["field"] != source["field"]), "field").when(text.isNull(), "unavailable")
        .when((item["start"] < 0) | (item["end"] <= item["start"]), "offsets").when(item["end"] > F.length(text), "end")
        .when(F.substring(text, (item["start"] + 1).cast("int"), (item["end"] - item["start"]).cast("int")) != item["quote"], "quote")
    )


def resolved_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """rows with the scenario resolved: a null scenario means the candidate's only task; with several it stays null."""
    only = tasks.select("candidate_id", "scenario_id").distinct().groupBy("candidate_id").agg(F.count("*").alias("__n"), F.first("scenario_id").alias("__s"))
    joined = rows.join(only, "candidate_id", "left")
    return joined.withColumn("scenario_id", F.coalesce("scenario_id", F.when(F.col("__n") == 1, F.col("__s")))).select(*rows.columns)


def _same_task(a: str = "candidate_id", b: str = "scenario_id") -> Column:
    return F.col(a).eqNullSafe(F.col("__c")) & F.col(b).eqNullSafe(F.col("__s"))


def validate_drafts(card_rows: DataFrame, drafts: DataFrame, complete: bool = True) -> DataFrame:
    """(candidate_id, scenario_id, validation_status, failures) of drafts (candidate_id, scenario_id, topic_fit, evidence); with `complete`, cards without a draft are failures too."""
    sources = card_rows.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s"), "source")
    w = Window.partitionBy("candidate_id", "scenario_id").orderBy("row")
    numbered = drafts.withColumn("__dup", F.row_number().over(w) > 1)
    joined = numbered.join(sources, _same_task(), "left")
    known = F.col("source").isNotNull()
    failures = F.array_compact(F.concat(
        F.array(F.when(F.col("__dup"), "duplicate"), F.when(~known, "unknown"), F.when(known & (F.col("topic_fit") == "relevant") & (F.size(F.coalesce("evidence", F.array())) == 0), "no_evidence")),
        F.when(known, F.transform("evidence", lambda e: evidence_failure(e, F.col("source")))).otherwise(F.array().cast("array<string>")),
    ))
    rows = joined.select("candidate_id", "scenario_id", failures.alias("failures"))
    if complete:
        d = drafts.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s")).distinct()
        missing = card_rows.select("candidate_id", "scenario_id").distinct().join(d, _same_task(), "left_anti")
        rows = rows.union(missing.select("candidate_id", "scenario_id", F.array(F.lit("missing"))))
    return rows.select("candidate_id", "scenario_id", F.when(F.size("failures") > 0, "invalid").otherwise("valid").alias("validation_status"), "failures")


def triage(card_rows: DataFrame, drafts: DataFrame, validations: DataFrame, seed: int, rate: float) -> DataFrame:
    """(candidate_id, scenario_id, triage_status, reason, model_topic_fit): what goes to a human, to the audit of negatives, or nowhere."""
    tasks = card_rows.select("candidate_id", "scenario_id").distinct()
    d = resolved_tasks(drafts.select("candidate_id", "scenario_id", "topic_fit"), tasks).select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s"), "topic_fit", F.lit(True).alias("__d"))
    v = resolved_tasks(validations.select("candidate_id", "scenario_id", "validation_status"), tasks).select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s"), "validation_status")
    joined = tasks.join(d, _same_task(), "left").drop("__c", "__s").join(v, _same_task(), "left").drop("__c", "__s")
    audited = seeded_ratio(seed, F.col("candidate_id"), F.coalesce("scenario_id", F.lit(""))) < rate
    fit = F.col("topic_fit")
    reason = (
        F.when(F.col("__d").isNull(), "missing_draft").when(F.col("validation_status").isNull(), "missing_validation").when(F.col("validation_status") != "valid", "invalid_evidence")
        .when(fit.isin("relevant", "uncertain"), F.concat(F.lit("model_"), fit)).when((fit == "not_relevant") & audited, "seeded_negative_audit").when(fit == "not_relevant", "validated_negative").otherwise("invalid_topic_fit")
    )
    status = F.when(F.col("reason") == "seeded_negative_audit", "negative_audit").when(F.col("reason") == "validated_negative", "not_selected").otherwise("human_review")
    return joined.withColumn("reason", reason).select("candidate_id", "scenario_id", status.alias("triage_status"), "reason", fit.alias("model_topic_fit"))


def session_problems(sessions: DataFrame) -> DataFrame:
    """Sessions (session_id, started_at, updated_at, completed_at as ISO texts) with what is wrong with their times, or null."""
    t = {c: F.try_to_timestamp(F.col(c)) for c in ("started_at", "updated_at", "completed_at")}
    problem = F.when(t["started_at"].isNull(), "bad_start").when(t["updated_at"].isNull() | (t["updated_at"] < t["started_at"]), "bad_update").when(F.col("completed_at").isNotNull() & (t["completed_at"].isNull() | (t["completed_at"] < t["updated_at"])), "bad_completion")
    return sessions.withColumn("problem", problem)
