"""Merging of rankings: query variants, reciprocal rank fusion, reranking with a cache, and feedback unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def _within(partition: tuple[str, ...]):
    return Window.partitionBy(*(partition or (F.lit(0),)))


def _ranked(rows: DataFrame, order: list[Column | str], limit: int, partition: tuple[str, ...]) -> DataFrame:
    """The first `limit` rows of each partition in an order, with their rank. Where there is no partition, tasks keep their first `limit` rows and only those meet."""
    first = rows if partition else rows.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(_within(partition).orderBy(*order))).where(F.col("rank") <= limit)


def variant_merge(hits: DataFrame, limit: int, partition: tuple[str, ...] = ()) -> DataFrame:
    """One ranking of (candidate_id, variant, rank, score): each candidate at its best (rank, variant), ranked anew by (rank, variant, id)."""
    best = hits.groupBy(*partition, "candidate_id").agg(F.min_by(F.struct("variant", "score", "rank"), F.struct("rank", "variant")).alias("b"))
    return _ranked(best, ["b.rank", "b.variant", "candidate_id"], limit, partition).select(*partition, "candidate_id", "rank", F.col("b.score").alias("score"), F.col("b.variant").alias("variant"))


def rrf(branches: DataFrame, k: float = 60.0, weights: dict[str, float] | None = None, limit: int = 100, partition: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of (candidate_id, branch, rank, score): one vote of each branch at the candidate's best rank.

    Votes are added in the branches' name order, so that sums don't depend on the plan. Order: fused score, then id.
    """
    if k <= 0 or any(w <= 0 for w in (weights or {}).values()):
        raise ValueError("k and weights must be positive")
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("branch") == name, F.lit(float(w))).otherwise(weight)
    votes = branches.groupBy(*partition, "candidate_id", "branch").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    fused = votes.groupBy(*partition, "candidate_id").agg(F.sort_array(F.collect_list(F.struct("branch", (weight / (F.lit(k) + F.col("rank"))).alias("vote"), "rank", "score"))).alias("v"))
    total = F.aggregate(F.transform("v", lambda x: x["vote"]), F.lit(0.0), lambda a, b: a + b)
    rows = fused.select(*partition, "candidate_id", total.alias("rrf_score"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["branch"], x["rank"]))).alias("branch_ranks"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["branch"], x["score"]))).alias("branch_scores"))
    return _ranked(rows, [F.desc("rrf_score"), "candidate_id"], limit, partition)


def overlap_score(query: str, text: Column) -> Column:
    """How many different tokens of the query a text has; a stand-in for a reranking model."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    return F.size(F.array_intersect(wanted, F.array_distinct(tokens(text)))).cast("double")


def rerank(candidates: DataFrame, score: Column, limit: int, cache: DataFrame | None = None, key: Column | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """The first `limit` candidates by rank, scored and ordered anew by (score, id). Scores found in the cache (key, score) are not worked out."""
    head = candidates.where(F.col("rank") <= limit)
    if cache is None:
        scored = head.withColumn("rerank_score", score).withColumn("cached", F.lit(False))
    else:
        known = cache.select(F.col("key").alias("__key"), F.col("score").alias("__score"))
        joined = head.withColumn("__k", key).join(known, F.col("__k") == F.col("__key"), "left")
        scored = joined.withColumn("cached", F.col("__key").isNotNull()).withColumn("rerank_score", F.when(F.col("cached"), F.col("__score")).otherwise(score)).drop("__k", "__key", "__score")
    finite = F.when(F.isnan("rerank_score") | (F.abs("rerank_score") == F.lit(float("inf"))), F.raise_error(F.lit("a rerank score isn't finite")).cast("double")).otherwise(F.col("rerank_score"))
    w = _within(partition).orderBy(F.desc("rerank_score"), "candidate_id")
    return scored.withColumn("rerank_score", finite).withColumn("rerank_rank", F.row_number().over(w))


def feedback_union(original: DataFrame, feedback: DataFrame, limit: int, partition: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of the original ranking, then those new in the feedback ranking, in their order; origin: original, already_seen or new."""
    a = original.groupBy(*partition, "candidate_id").agg(F.min("rank").alias("a"))
    b = feedback.groupBy(*partition, "candidate_id").agg(F.min("rank").alias("b"))
    both = a.join(b, [*partition, "candidate_id"], "full_outer")
    origin = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "original").otherwise("already_seen")
    return _ranked(both, [F.col("a").isNull(), F.coalesce("a", "b"), "candidate_id"], limit, partition).select(*partition, "candidate_id", "rank", origin.alias("origin"))
