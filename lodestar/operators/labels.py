"""Labels: stubs, checks on import, collection from worksheets, legacy rows, and reuse between pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nul_joined, sha_hex
from ..schemas import ATTRIBUTION, PRODUCT_FIT, RESOLUTION, SPEAKER_INTENT, SUPPORTS, TOPIC_FIT
from .review import evidence_failure, resolved_tasks

#: The fields that identify what a row was made from.
IDENTITY = ("snapshot_id", "app_id", "app_profile_version", "app_profile_sha256", "message_fullname", "source_revision_id", "context_recipe_version", "chunking_version", "rubric_version", "content_hash")


def stubs(pool: DataFrame, rubric_version: str = "topic-fit-v1") -> DataFrame:
    """An empty label for each pool task."""
    return pool.select(
        "candidate_id", "scenario_id", F.lit("unknown").alias("topic_fit"), F.lit("unknown").alias("speaker_intent"), F.lit("not_evaluated").alias("product_fit"), F.lit("unknown").alias("resolution_in_available_context"),
        F.lit("human").alias("evaluator_kind"), F.lit(rubric_version).alias("rubric_version"), F.lit("unknown").alias("validation_status"),
    )


def schema_failures(label: DataFrame) -> Column:
    """What the label itself has wrong, as an array of names."""
    evidence = F.coalesce("evidence", F.array()) if "evidence" in label.columns else F.array()
    claims = F.coalesce("supported_claim_ids", F.array().cast("array<string>"))
    checks = {
        "candidate_id": F.coalesce(F.col("candidate_id"), F.lit("")) == "",
        "topic_fit": ~F.coalesce(F.col("topic_fit").isin(*TOPIC_FIT), F.lit(False)),
        "speaker_intent": ~F.coalesce(F.col("speaker_intent").isin(*SPEAKER_INTENT), F.lit(False)),
        "product_fit": ~F.coalesce(F.col("product_fit").isin(*PRODUCT_FIT), F.lit(False)),
        "resolution": ~F.coalesce(F.col("resolution_in_available_context").isin(*RESOLUTION), F.lit(False)),
        "evaluator_kind": ~F.coalesce(F.col("evaluator_kind").isin("human", "model"), F.lit(False)),
        "compatible_without_claims": (F.col("product_fit") == "compatible") & (F.size(claims) == 0),
    }
    if "evidence" in label.columns:
        bad = lambda e: (e["end"] <= e["start"]) | ~e["attribution"].isin(*ATTRIBUTION) | ~e["supports"].isin(*SUPPORTS) | ((e["supports"] == "author_requirement") & (e["attribution"] != "focal_author"))
        checks["evidence"] = F.exists(evidence, lambda e: F.coalesce(bad(e), F.lit(True)))
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))


def identity_coverage(rows: DataFrame) -> DataFrame:
    """(field, known): how many rows know each identity field."""
    have = [f for f in IDENTITY if f in rows.columns]
    counts = rows.agg(*[F.count(f).alias(f) for f in have], F.count("*").alias("rows"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) if f in have else F.lit(0).cast("bigint")).alias("known")) for f in IDENTITY])).alias("x")).select("x.*")


def identity_digest(*fields: str) -> Column:
    return sha_hex(nul_joined(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))


def import_labels(pool: DataFrame, labels: DataFrame, verified_claims: list[str], tombstoned: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """(candidate_id, scenario_id, failures) of labels and, with `complete`, of pool tasks without one; a label without failures is valid.

    labels: the fields of a label and row, a number that orders duplicates. pool: candidate_id, scenario_id, source, and identity fields to compare.
    """
    shared = [f for f in IDENTITY if f in pool.columns and f in labels.columns]
    p = pool.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s"), F.lit(True).alias("__in"), *(["source"] if "source" in pool.columns else []), *[F.col(f).alias(f"__{f}") for f in shared])
    w = Window.partitionBy("candidate_id", "scenario_id").orderBy("row")
    same = F.col("candidate_id").eqNullSafe(F.col("__c")) & F.col("scenario_id").eqNullSafe(F.col("__s"))
    joined = labels.withColumn("__dup", F.row_number().over(w) > 1).withColumn("__schema", schema_failures(labels)).join(p, same, "left")
    if tombstoned is not None:
        joined = joined.join(tombstoned.select(F.col("candidate_id").alias("__t")).distinct(), F.col("candidate_id") == F.col("__t"), "left")
    sound = F.size("__schema") == 0
    claims = F.coalesce("supported_claim_ids", F.array().cast("array<string>"))
    unverified = (F.col("product_fit") == "compatible") & (F.size(F.array_except(claims, F.array(*map(F.lit, verified_claims)).cast("array<string>"))) > 0)
    parts = [
        F.when(sound & F.col("__dup"), "duplicate"), F.when(sound & unverified, "unverified_claim"), F.when(sound & F.col("__t").isNotNull(), "invalidated") if tombstoned is not None else F.lit(None).cast("string"),
        F.when(sound & F.col("__in").isNull(), "not_in_pool"), *[F.when(sound & F.col("__in") & F.col(f).isNotNull() & (F.col(f) != F.col(f"__{f}")), f"{f} differs") for f in shared],
    ]
    grounded = F.transform(F.coalesce("evidence", F.array()), lambda e: evidence_failure(e, F.col("source"))) if "source" in pool.columns and "evidence" in labels.columns else F.array().cast("array<string>")
    failures = F.array_compact(F.concat("__schema", F.array(*parts), F.when(sound & F.col("__in"), grounded).otherwise(F.array().cast("array<string>"))))
    rows = joined.select("candidate_id", "scenario_id", failures.alias("failures"))
    if complete:
        seen = labels.select(F.col("candidate_id").alias("__c"), F.col("scenario_id").alias("__s")).distinct()
        rows = rows.union(pool.select("candidate_id", "scenario_id").join(seen, same, "left_anti").select("candidate_id", "scenario_id", F.array(F.lit("missing"))))
    return rows


#: What a worksheet's answers mean as labels.
FIT_OF = {"relevant": "yes", "not_relevant": "no", "uncertain": "unknown"}
RESOLUTION_OF = {"clear": "clear", "unclear": "needs_clarification"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def from_worksheet(rows: DataFrame) -> DataFrame:
    """(candidate_id, scenario_id, topic_fit, need_clarity) of the rows that aren't pending; an unknown answer is an error."""
    done = rows.where(F.col("review_status") != "pending")
    fit = _mapped(F.col("topic_fit"), FIT_OF)
    known = F.when(fit.isNull(), F.raise_error(F.concat(F.lit("unknown answer for "), F.col("candidate_id"))).cast("string")).otherwise(fit)
    return done.select("candidate_id", "scenario_id", known.alias("topic_fit"), _mapped(F.col("need_clarity"), RESOLUTION_OF).alias("need_clarity"))


def from_legacy(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, sidecar, duplicate links) of older rows (candidate_id, label, status, note, duplicate_of); answers that aren't known become unknown."""
    fit = F.coalesce(_mapped(F.lower("label"), FIT_OF | {"yes": "yes", "no": "no", "maybe": "unknown"}), F.lit("unknown"))
    done = rows.where(F.coalesce("status", F.lit("done")) != "pending")
    links = done.where("duplicate_of IS NOT NULL AND duplicate_of <> candidate_id").select("candidate_id", "duplicate_of", F.lit("legacy").alias("relation"))
    return done.select("candidate_id", F.lit(None).cast("string").alias("scenario_id"), fit.alias("topic_fit")), done.select("candidate_id", "label", "note"), links


def with_scenario(labels: DataFrame, pool: DataFrame) -> DataFrame:
    """Labels with their pool task: a null scenario means the candidate's only task."""
    return resolved_tasks(labels, pool)


def reuse(source_pool: DataFrame, labels: DataFrame, target_pool: DataFrame, rubric_version: str, tombstoned: DataFrame | None = None) -> DataFrame:
    """Labels (with row) and skip_reason: null where source and target task have the same context identity and fingerprint.

    Pools: candidate_id, scenario_id, context_identity, fingerprint. The first reason that applies is given.
    """
    own = resolved_tasks(labels, source_pool)
    pick = lambda pool, p: pool.select(F.col("candidate_id").alias(f"{p}c"), F.col("scenario_id").alias(f"{p}s"), F.col("context_identity").alias(f"{p}x"), F.col("fingerprint").alias(f"{p}f"), F.lit(True).alias(f"{p}in"))
    joined = own
    for p, pool in (("a", source_pool), ("b", target_pool)):
        joined = joined.join(pick(pool, p), F.col("candidate_id").eqNullSafe(F.col(f"{p}c")) & F.col("scenario_id").eqNullSafe(F.col(f"{p}s")), "left")
    gone = F.lit(False)
    if tombstoned is not None:
        joined = joined.join(tombstoned.select(F.col("candidate_id").alias("__t")).distinct(), F.col("candidate_id") == F.col("__t"), "left")
        gone = F.col("__t").isNotNull()
    human = F.col("evaluator_kind") == "human"
    w = Window.partitionBy("candidate_id", "scenario_id", human).orderBy("row")
    reason = (
        F.when(~F.coalesce(human, F.lit(False)), "non_human_label").when(F.row_number().over(w) > 1, "duplicate_label_task").when(F.col("ain").isNull(), "source_task_missing").when(F.col("bin").isNull(), "target_task_missing")
        .when(F.col("rubric_version") != rubric_version, "rubric_mismatch").when(gone, "invalidated_source_or_context").when(~F.col("ax").eqNullSafe(F.col("bx")), "context_dependency_identity_mismatch").when(~F.col("af").eqNullSafe(F.col("bf")), "source_fingerprint_mismatch")
    )
    return joined.withColumn("skip_reason", reason).select(*labels.columns, "skip_reason")
