"""Blinded pools: one task of each (candidate, scenario), a slice of controls, and a key kept apart from what reviewers see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_rank
from .ordering import numbered

#: Ranks up to this are a strong match.
STRONG = 3

#: Columns that would tell a reviewer how a row was found.
HIDDEN = ("rank", "score", "retrieval", "matched_rule_ids", "selection_channels", "selection_order", "archive_score", "stratum")


def tasks(runs: DataFrame) -> DataFrame:
    """One row of each (candidate_id, scenario_id): the best (rank, run); a missing rank comes last."""
    w = Window.partitionBy("candidate_id", "scenario_id").orderBy(F.coalesce("rank", F.lit(2**31)), "run")
    return runs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def blinded_pool(ranked: DataFrame, controls: DataFrame, target: int, seed: int) -> DataFrame:
    """(pool_id, pool_order, candidate_id, scenario_id, stratum, is_control, rank, score) of at most `target` rows.

    ranked: candidate_id, scenario_id, rank, score, run. controls: candidate_id. Ranked tasks come in the order of their seeded
    digest and leave room for a third of controls; controls fill up. Controls that are ranked candidates are left out.
    """
    if target < 1:
        raise ValueError("the target must be positive")
    best = tasks(ranked).withColumn("__key", stable_rank(seed, "ranked", F.col("candidate_id"), F.col("scenario_id")))
    free = controls.select("candidate_id").distinct().join(ranked.select("candidate_id").distinct(), "candidate_id", "left_anti").withColumn("__key", stable_rank(seed, "control", F.col("candidate_id")))
    some = free.orderBy("__key", "candidate_id").limit(target)
    reserved = some.limit(target // 3).agg((F.lit(target) - F.count("*")).alias("room"))
    place = Window.orderBy("__key", "candidate_id", "scenario_id")
    chosen = best.orderBy("__key", "candidate_id", "scenario_id").limit(target).withColumn("__n", F.row_number().over(place)).join(reserved, F.col("__n") <= F.col("room")).drop("room")
    taken = chosen.agg(F.count("*").alias("taken"))
    fill = some.withColumn("__n", F.row_number().over(Window.orderBy("__key", "candidate_id"))).join(taken, F.col("__n") <= F.lit(target) - F.col("taken"))
    stratum = F.when(F.col("rank") <= STRONG, "strong").otherwise("adjacent")
    left = chosen.select("candidate_id", "scenario_id", stratum.alias("stratum"), F.lit(False).alias("is_control"), F.col("rank").cast("bigint").alias("rank"), F.col("score").cast("double").alias("score"), "__n")
    right = fill.select("candidate_id", F.lit(None).cast("string").alias("scenario_id"), F.lit("unknown").alias("stratum"), F.lit(True).alias("is_control"), F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("double").alias("score"), "__n")
    both = left.union(right).withColumn("pool_order", F.row_number().over(Window.orderBy("is_control", "__n")))
    return both.select(F.format_string("pool-%04d", "pool_order").alias("pool_id"), "pool_order", "candidate_id", "scenario_id", "stratum", "is_control", "rank", "score")


def reviewer_rows(pool: DataFrame) -> DataFrame:
    """What a reviewer may see."""
    return pool.drop(*HIDDEN, "is_control")


def pool_key(pool: DataFrame) -> DataFrame:
    return pool.select("pool_id", "candidate_id", "scenario_id", "stratum", F.when(F.col("is_control"), "control").otherwise("ranked").alias("source_kind"), "rank", "score")


def source_text(rows: DataFrame) -> DataFrame:
    """rows with a full text: a ranked row's focus text, a control's body or, if that is empty, its title; an error where neither is at hand."""
    control = F.when(F.coalesce(F.col("raw_body"), F.lit("")) != "", F.col("raw_body")).otherwise(F.col("raw_title"))
    text = F.when(F.col("is_control"), control).otherwise(F.col("focus_text"))
    return rows.withColumn("source_text", F.coalesce(F.when(text != "", text), F.raise_error(F.concat(F.lit("no full text for "), F.col("candidate_id"))).cast("string")))


def context_complete(unit_complete, row_complete, truncated, missing):
    """A unit's own flag, or the row's where there is no unit; never complete with truncated or missing ancestors."""
    return F.when(F.coalesce(truncated, F.lit(False)) | (F.size(F.coalesce(missing, F.array().cast("array<string>"))) > 0), F.lit(False)).otherwise(F.coalesce(unit_complete, row_complete))


def retained_sources(pool: DataFrame, units: DataFrame, retained: DataFrame) -> DataFrame:
    """pool with the message that a candidate stands for: the unit's, or the retained source's, or the candidate itself."""
    u = units.select(F.col("unit_id").alias("__u"), F.col("message_fullname").alias("__m"))
    r = retained.select(F.col("candidate_id").alias("__c"), F.col("message_fullname").alias("__rm"))
    joined = pool.join(u, F.col("candidate_id") == F.col("__u"), "left").join(r, F.col("candidate_id") == F.col("__c"), "left")
    return joined.select(*pool.columns, F.coalesce("__m", "__rm", F.col("candidate_id")).alias("message_fullname"))


def interleaved(pool: DataFrame, seed: int | None = None) -> DataFrame:
    """pool in the order ranked 1, control 1, ranked 2, control 2, ..., and then what is left of the longer side. With a seed, each side is ordered by its digest first."""
    key = stable_rank(seed, F.col("pool_id")) if seed is not None else F.col("pool_order")
    rows = numbered(pool.withColumn("__key", key), ["is_control", "__key", "pool_id"], "__place")
    sides = {r[0]: r[1] for r in pool.groupBy("is_control").count().collect()}
    ranked, controls = F.lit(sides.get(False, 0)), F.lit(sides.get(True, 0))
    turn = F.when(F.col("is_control"), F.col("__place") - ranked).otherwise(F.col("__place"))
    earlier = F.least(turn - 1, ranked) + F.least(turn - 1, controls) + F.when(F.col("is_control") & (turn <= ranked), 1).otherwise(0)
    return rows.withColumn("card_order", (earlier + 1).cast("int")).select(*pool.columns, "card_order")
