"""Parent chains, hydration of selected threads, and the merge of context with selected messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .messages import one_per_name, top_by_hash


def ancestor_chains(messages: DataFrame, focus: DataFrame | None = None, max_parents: int = 4) -> DataFrame:
    """For each focus message: ancestors (root first), missing_parent_ids, context_complete, parent_cycle_detected, ancestors_truncated.

    The walk is unrolled: one join for each level of the bounded chain, so that neither a recursion limit nor a row limit applies.
    A walk ends at a message seen before (a cycle), at an absent parent, or at the limit with a parent left. The thread's root is
    put first if it is at hand and not among the ancestors; the root of a comment that is absent is the first one missing.
    """
    if max_parents < 0:
        raise ValueError("max_parents must not be negative")
    nodes = messages.select(F.col("fullname").alias("__name"), F.col("parent_fullname").alias("__up"))
    found = (focus if focus is not None else messages).select("fullname", "kind", "thread_fullname", F.col("parent_fullname").alias("next"))
    state = found.withColumn("chain", F.array().cast("array<string>")).withColumn("missing", F.array().cast("array<string>")).withColumn("cycle", F.lit(False)).withColumn("truncated", F.lit(False))
    for _ in range(max_parents):
        joined = state.join(nodes, state["next"] == nodes["__name"], "left")
        walking = F.col("next").isNotNull() & (F.col("next") != "")
        seen = F.coalesce((F.col("next") == F.col("fullname")) | F.array_contains("chain", F.col("next")), F.lit(False))
        absent = F.col("__name").isNull()
        step = walking & ~seen & ~absent
        chain = F.when(step, F.concat("chain", F.array("next"))).otherwise(F.col("chain"))
        cut = step & F.col("__up").isNotNull() & (F.col("__up") != "") & (F.size(chain) >= max_parents)
        state = joined.select(
            "fullname", "kind", "thread_fullname", F.when(step & ~cut, F.col("__up")).alias("next"), chain.alias("chain"),
            F.when(walking & (seen | absent), F.concat("missing", F.array("next"))).otherwise(F.col("missing")).alias("missing"),
            (F.col("cycle") | (walking & seen)).alias("cycle"), (F.col("truncated") | cut).alias("truncated"),
        )
    roots = nodes.select(F.col("__name").alias("__root"))
    rooted = state.join(roots, state["thread_fullname"] == roots["__root"], "left")
    upward = F.reverse("chain")
    add = F.col("__root").isNotNull() & (F.col("__root") != F.col("fullname")) & ~F.array_contains("chain", F.col("__root"))
    lost = F.col("__root").isNull() & (F.col("kind") == "comment") & ~F.coalesce(F.array_contains("missing", F.col("thread_fullname")), F.lit(False))
    missing = F.when(lost, F.concat(F.array("thread_fullname"), "missing")).otherwise(F.col("missing"))
    return rooted.select(
        "fullname", F.when(add, F.concat(F.array("__root"), upward)).otherwise(upward).alias("ancestors"), missing.alias("missing_parent_ids"),
        ((F.size(missing) == 0) & ~F.col("cycle") & ~F.col("truncated")).alias("context_complete"), F.col("cycle").alias("parent_cycle_detected"), F.col("truncated").alias("ancestors_truncated"),
    )


def with_tombstoned(rows: DataFrame, tombstones: DataFrame, name: str) -> DataFrame:
    """rows with a column that says whether a tombstone names them, in all revisions or in theirs."""
    t = tombstones.groupBy(F.col("message_fullname").alias("__t")).agg(F.count_if(F.col("source_revision_id").isNull()).alias("__any"), F.collect_set("source_revision_id").alias("__revisions"))
    gone = F.col("__t").isNotNull() & ((F.col("__any") > 0) | F.coalesce(F.array_contains("__revisions", F.col("source_revision_id")), F.lit(False)))
    return rows.join(t, F.col("fullname") == F.col("__t"), "left").withColumn(name, gone).drop("__t", "__any", "__revisions")


def hydration_classes(archive: DataFrame, selected: DataFrame, tombstones: DataFrame) -> DataFrame:
    """archive with a column class: tombstoned, selected, context or control; the tests apply in this order."""
    names = selected.select(F.col("fullname").alias("__s")).distinct()
    threads = selected.select(F.col("thread_fullname").alias("__h")).distinct()
    joined = with_tombstoned(archive, tombstones, "__gone").join(names, F.col("fullname") == F.col("__s"), "left").join(threads, F.col("thread_fullname") == F.col("__h"), "left")
    kind = F.when(F.col("__gone"), "tombstoned").when(F.col("__s").isNotNull(), "selected").when(F.col("__h").isNotNull(), "context").otherwise("control")
    return joined.withColumn("class", kind).select(*archive.columns, "class")


def archive_order(rows: DataFrame) -> list[Column]:
    """The order of archive rows: by source and line where the provenance is told, then by revision."""
    place = [F.col("provenance")[0]["source_id"], F.col("provenance")[0]["line_number"]] if "provenance" in rows.columns else []
    return [*place, F.col("source_revision_id")]


def hydrate(archive: DataFrame, selected: DataFrame, tombstones: DataFrame, context_target: int, control_target: int, seed: int, order: list[Column] | None = None) -> DataFrame:
    """Context and control messages to keep, with the column class: the least by seeded digest (controls by seed + 1). A target of 0 keeps none.

    Of rows that repeat a name within a class, the first in `order` (archive_order by default) counts.
    """
    classes = hydration_classes(archive, selected, tombstones)
    first = lambda kind: one_per_name(classes.where(F.col("class") == kind), order or archive_order(archive))
    context = top_by_hash(first("context"), context_target, seed)
    return context.unionByName(top_by_hash(first("control"), control_target, seed + 1))


def merged_messages(selected: DataFrame, context: DataFrame) -> DataFrame:
    """One message of each name; the context's copy wins, also as a focus."""
    both = selected.withColumn("__from", F.lit(0)).unionByName(context.withColumn("__from", F.lit(1)))
    columns = [c for c in selected.columns if c != "fullname"]
    best = both.groupBy("fullname").agg(F.max_by(F.struct(*columns), "__from").alias("m"))
    return best.select("fullname", "m.*").select(*selected.columns)
