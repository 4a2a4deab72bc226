"""State tables as generations: reconciliation of snapshots, the outbox of deletions, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "in_progress", "applied", "failed")


def reconcile(previous: DataFrame, current: DataFrame, blocked: DataFrame | None = None, key: str = "unit_id", identity: str = "content_hash") -> DataFrame:
    """(key, state): added, removed, changed, same, or blocked for units that a tombstone names."""
    a, b = previous.select(F.col(key), F.col(identity).alias("__a"), F.lit(True).alias("__was")), current.select(F.col(key), F.col(identity).alias("__b"), F.lit(True).alias("__is"))
    both = a.join(b, key, "full_outer")
    if blocked is not None:
        both = both.join(blocked.select(key).distinct().withColumn("__x", F.lit(True)), key, "left")
    else:
        both = both.withColumn("__x", F.lit(None).cast("boolean"))
    state = F.when(F.col("__x") & F.col("__is"), "blocked").when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed").otherwise("same")
    return both.select(key, state.alias("state"))


def status_counts(rows: DataFrame, column: str = "status", statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """(status, n), with 0 for statuses that no row has; a status that isn't listed is an error."""
    every = rows.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("__n"), F.lit(True).alias("__have"))
    joined = every.withColumn("__known", F.lit(True)).join(counts, column, "full_outer")
    bad = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown status "), F.col(column))).cast("string"))
    return joined.select(F.coalesce(bad, F.col(column)).alias(column), F.coalesce("__n", F.lit(0).cast("bigint")).alias("n"))


def register(outbox: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """outbox with rows (identity, scope, records) that it doesn't have yet, as pending; registering again changes nothing."""
    fresh = new.dropDuplicates(["identity"]).join(outbox.select("identity"), "identity", "left_anti")
    rows = fresh.select("identity", "scope", "records", F.lit("pending").alias("status"), F.lit(None).cast("bigint").alias("observed"), F.lit(None).cast("bigint").alias("deleted"), F.lit(0).cast("bigint").alias("attempts"), F.lit(None).cast("string").alias("claimed_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("string").alias("error"))
    return outbox.unionByName(rows)


def claim(outbox: DataFrame, limit: int, now: str) -> DataFrame:
    """outbox with the `limit` first pending rows (by update time and identity) in progress."""
    first = outbox.where("status = 'pending'").orderBy("updated_at", "identity").limit(limit).select("identity").withColumn("__mine", F.lit(True))
    return _changed(outbox.join(first, "identity", "left"), F.col("__mine"), {"status": F.lit("in_progress"), "attempts": F.col("attempts") + 1, "claimed_at": F.lit(now), "updated_at": F.lit(now)}).select(*outbox.columns)


def complete(outbox: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """outbox after results (identity, observed, deleted, error) of rows in progress: applied, or failed where there is an error."""
    r = results.select("identity", F.col("observed").alias("__o"), F.col("deleted").alias("__d"), F.col("error").alias("__e"), F.lit(True).alias("__mine"))
    joined = outbox.join(r, "identity", "left")
    mine = F.col("__mine") & (F.col("status") == "in_progress")
    set_to = {"status": F.when(F.col("__e").isNull(), "applied").otherwise("failed"), "observed": F.col("__o"), "deleted": F.col("__d"), "error": F.col("__e"), "updated_at": F.lit(now)}
    return _changed(joined, mine, set_to).select(*outbox.columns)


def recover_stale(outbox: DataFrame, before: str) -> DataFrame:
    """Rows in progress that were claimed before a time are pending again."""
    return _changed(outbox, (F.col("status") == "in_progress") & (F.col("claimed_at") < before), {"status": F.lit("pending"), "claimed_at": F.lit(None).cast("string")})


def replay(outbox: DataFrame, now: str) -> DataFrame:
    """Failed rows are pending again."""
    return _changed(outbox, F.col("status") == "failed", {"status": F.lit("pending"), "error": F.lit(None).cast("string"), "updated_at": F.lit(now)})


def _changed(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    holds = F.coalesce(where, F.lit(False))
    return rows.select(*[F.when(holds, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def inventory(outbox: DataFrame) -> DataFrame:
    """Rows of the outbox with the problem of any that can't be: a bad status, more deleted than observed, an applied row without counts."""
    problem = (
        F.when(~F.col("status").isin(*STATUSES), "status").when(F.col("records") < 0, "records").when(F.col("deleted") > F.col("observed"), "deleted_more_than_observed")
        .when((F.col("status") == "applied") & F.col("observed").isNull(), "applied_without_counts").when((F.col("status") == "failed") & F.col("error").isNull(), "failed_without_error")
    )
    return outbox.select("identity", "scope", "status", "records", F.when(F.col("status") == "applied", F.col("deleted")).alias("deleted"), problem.alias("problem"))


def topic_report(labels: DataFrame) -> DataFrame:
    return labels.groupBy("topic_fit", "review_status").agg(F.count("*").alias("n"))


def operational_report(messages: DataFrame, units: DataFrame) -> DataFrame:
    """One row: messages, threads, first and last time, units, units with complete context and without."""
    m = messages.agg(F.count("*").alias("messages"), F.countDistinct("thread_fullname").alias("threads"), F.min("created_utc").alias("first_utc"), F.max("created_utc").alias("last_utc"))
    u = units.agg(F.count("*").alias("units"), F.count_if("context_complete").alias("context_complete"), F.count_if(~F.col("context_complete")).alias("context_incomplete"))
    return m.join(u)


def source_status(stats: DataFrame) -> DataFrame:
    """(status): failed before partial before complete_with_errors before complete, of per-source rows."""
    order = F.when(F.col("status") == "failed", 3).when(F.col("status") == "partial", 2).when(F.col("status") == "complete_with_errors", 1).otherwise(0)
    return stats.agg(F.max(order).alias("n")).select(F.element_at(F.array(*map(F.lit, ("complete", "complete_with_errors", "partial", "failed"))), F.coalesce("n", F.lit(2)) + 1).alias("status"))


def missing_claim_evidence(claims: DataFrame) -> DataFrame:
    """(app_id, claim_ids): claims that aren't verified or have no reference, sorted."""
    return claims.where(~F.coalesce("verified", F.lit(False)) | F.col("evidence_ref").isNull()).groupBy("app_id").agg(F.array_join(F.sort_array(F.collect_list("claim_id")), ",").alias("claim_ids"))


def refuse_synthetic(claims: DataFrame) -> DataFrame:
    """claims, or an error if one is marked as synthetic."""
    bad = F.when(F.coalesce("synthetic", F.lit(False)), F.raise_error(F.concat(F.lit("synthetic claim "), F.col("claim_id"))).cast("string"))
    return claims.withColumn("claim_id", F.coalesce(bad, F.col("claim_id")))


def preflight(checks: dict[str, Column], facts: DataFrame) -> DataFrame:
    """(check, status) of named conditions over one row of facts: ok, fail, or missing where a fact is unknown."""
    one = lambda c: F.when(c.isNull(), "missing").when(c, "ok").otherwise("fail")
    return facts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), one(c).alias("status")) for n, c in checks.items()])).alias("x")).select("x.*")
