"""Deletion: ledgers of removed messages and what they block, remove or scrub."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import nul_joined, sha_hex

#: Marks of the blocks of a unit's context, a message's block and the unit's own text.
_CONTRIBUTOR = re.compile(r"\[(?:SUBMISSION|COMMENT) (t[13]_[^ \]\n]+)\]")
_FOCUS = re.compile(r"\[FOCUS (?:SUBMISSION|COMMENT) (t[13]_[^ \]\n]+)(?: \d+:\d+)?\]")


def checked_ledger(rows: DataFrame) -> DataFrame:
    """Ledger rows with a column problem: bad_name, bad_revision, no_reason, duplicate or null."""
    w = Window.partitionBy("message_fullname", F.coalesce("source_revision_id", F.lit("")))
    problem = (
        F.when(~F.coalesce(F.col("message_fullname").rlike("^t[13]_.+"), F.lit(False)), "bad_name").when(F.trim("source_revision_id") == "", "bad_revision")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no_reason").when(F.count("*").over(w) > 1, "duplicate")
    )
    return rows.withColumn("problem", problem)


def ledger_digest(ledger: DataFrame) -> DataFrame:
    """(records, digest): of the rows in the order of name and revision, null revisions first. A ledger is of control size."""
    line = nul_joined(F.col("message_fullname"), F.coalesce("source_revision_id", F.lit("")), F.coalesce("reason", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("message_fullname", "source_revision_id", line.alias("line"))))
    return ledger.agg(F.count("*").alias("records"), sha_hex(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("digest"))


def _keys(tombstones: DataFrame) -> DataFrame:
    return tombstones.select(F.col("message_fullname").alias("__t"), F.col("source_revision_id").alias("__r")).distinct()


def blocks_message(name: str = "fullname", revision: str = "source_revision_id") -> Column:
    """Join condition: all revisions of a name, or exactly one."""
    return (F.col(name) == F.col("__t")) & (F.col("__r").isNull() | (F.col("__r") == F.col(revision)))


def without_tombstoned(messages: DataFrame, tombstones: DataFrame, name: str = "fullname", revision: str = "source_revision_id") -> DataFrame:
    return messages.join(_keys(tombstones), blocks_message(name, revision), "left_anti")


def suppressed(messages: DataFrame, tombstones: DataFrame, name: str = "fullname", revision: str = "source_revision_id") -> DataFrame:
    return messages.join(_keys(tombstones), blocks_message(name, revision), "left_semi")


def context_blocked(rows: DataFrame, tombstones: DataFrame, refs: str = "context_message_refs", key: str = "unit_id") -> DataFrame:
    """Rows of which any reference names a tombstoned message, whatever its revision: one equi-join on single references."""
    names = tombstones.select(F.col("message_fullname").alias("__t")).distinct()
    hit = rows.select(key, F.explode(refs).alias("__ref")).join(names, F.col("__ref") == F.col("__t"), "left_semi").select(key).distinct()
    return rows.join(hit, key, "left_semi")


def blocked_rows(rows: DataFrame, tombstones: DataFrame, key: str = "unit_id", name: str = "message_fullname", revision: str = "source_revision_id", refs: str = "context_message_refs") -> DataFrame:
    """rows with a column blocked: direct (name and revision), context (a reference) or null."""
    direct = suppressed(rows, tombstones, name, revision).select(key).distinct().withColumn("__direct", F.lit(True))
    context = context_blocked(rows, tombstones, refs, key).select(key).distinct().withColumn("__context", F.lit(True))
    joined = rows.join(direct, key, "left").join(context, key, "left")
    return joined.withColumn("blocked", F.when(F.col("__direct"), "direct").when(F.col("__context"), "context")).drop("__direct", "__context")


def row_references(row: Column, source: Column) -> Column:
    """All message names that a row and its source bundle refer to."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c["context_message_refs"], empty) for c in (row, source)] + [F.coalesce(c["context"]["message_fullnames"], empty) for c in (row, source)]
    return F.array_distinct(F.concat(*lists))


def has_structured_context(row: Column, source: Column) -> Column:
    return row["context_message_refs"].isNotNull() | source["context_message_refs"].isNotNull() | row["context"]["message_fullnames"].isNotNull() | source["context"]["message_fullnames"].isNotNull()


def scrub(text: str, gone: set[str], keep_focus: bool, focus: str) -> str:
    """A context text without the blocks of the messages in `gone`.

    Blank lines separate pieces. A piece with a contributor's mark begins its block and unmarked ones continue it. The unit's own
    text is the first piece whose focus mark names the unit's message; another focus mark is what a user wrote. Pieces that
    belong to nobody, before the first mark or after the unit's own text, are dropped.
    """
    blocks: list[tuple[str, list[str]]] = []
    own: list[str] = []
    owner: str | None = None
    pieces = text.split("\n\n") if text else []
    for piece in pieces:
        mark, focal = _CONTRIBUTOR.match(piece), _FOCUS.match(piece)
        if own:
            break
        if mark:
            owner = mark[1]
            blocks.append((owner, [piece]))
        elif focal and focal[1] == focus:
            own = [piece]
        elif owner is not None:
            blocks[-1][1].append(piece)
    return "\n\n".join([p for name, kept in blocks if name not in gone for p in kept] + (own if keep_focus else []))


def _scrubber(keep_focus: bool):
    def run(text: pd.Series, gone: pd.Series, focus: pd.Series) -> pd.Series:
        return pd.Series([t if g is None or not len(g) else scrub(t or "", set(g), keep_focus, f) for t, g, f in zip(text, gone, focus, strict=True)], dtype=object)

    return F.pandas_udf(run, returnType=StringType())


def apply_tombstones(units: DataFrame, tombstones: DataFrame, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """(units after deletion, counts): direct units go; units that only refer to a removed message stay without its text.

    tombstones: message_fullname, source_revision_id, and optionally unit_id, which restricts direct deletion only. The result is
    a new generation; nothing is changed in place, and applying it again changes nothing.
    """
    scoped = tombstones if "unit_id" in tombstones.columns else tombstones.withColumn("unit_id", F.lit(None).cast("string"))
    t = scoped.select(F.col("message_fullname").alias("__t"), F.col("source_revision_id").alias("__r"), F.col("unit_id").alias("__u")).distinct()
    here = F.col("snapshot_id") == snapshot_id
    direct = here & (F.col("message_fullname") == F.col("__t")) & (F.col("__r").isNull() | (F.col("__r") == F.col("source_revision_id"))) & (F.col("__u").isNull() | (F.col("__u") == F.col("unit_id")))
    kept = units.join(t, direct, "left_anti")
    names = t.select("__t").distinct()
    hits = kept.where(here).select("unit_id", F.explode("context_message_refs").alias("__ref")).join(names, F.col("__ref") == F.col("__t"), "left_semi").groupBy("unit_id").agg(F.sort_array(F.collect_set("__ref")).alias("__gone"))
    joined = kept.join(hits, "unit_id", "left")
    gone = F.col("__gone")
    empty = F.array().cast("array<string>")
    after = (
        joined.withColumn("context_only_text", F.when(gone.isNull(), F.col("context_only_text")).otherwise(_scrubber(False)("context_only_text", "__gone", "message_fullname")))
        .withColumn("context_text", F.when(gone.isNull(), F.col("context_text")).otherwise(_scrubber(True)("context_text", "__gone", "message_fullname")))
        .withColumn("missing_context_ids", F.concat("missing_context_ids", F.array_except(F.coalesce(gone, empty), "missing_context_ids")))
        .withColumn("context_message_refs", F.filter("context_message_refs", lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False))))
        .select(*units.columns)
    )
    deleted = units.join(t, direct, "left_semi")
    counts = deleted.agg(F.count("*").alias("deleted")).join(hits.agg(F.count("*").alias("scrubbed"))).select((F.col("deleted") + F.col("scrubbed")).alias("matched"), "deleted", "scrubbed", (F.col("deleted") == 0).alias("idempotent"))
    return after, counts


def artifact_audit(references: DataFrame, tombstones: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(artifact, status, matched): stale if a row of the artifact (artifact, message_fullname, source_revision_id) is tombstoned, clean if none is, missing if an expected one has no row."""
    hits = suppressed(references, tombstones, "message_fullname").groupBy("artifact").agg(F.countDistinct("message_fullname", F.coalesce("source_revision_id", F.lit(""))).alias("matched"))
    seen = references.select("artifact").distinct().withColumn("__seen", F.lit(True))
    every = (expected.select("artifact").distinct() if expected is not None else seen.select("artifact")).join(seen, "artifact", "full_outer").join(hits, "artifact", "left")
    status = F.when(F.col("__seen").isNull(), "missing").when(F.col("matched") > 0, "stale").otherwise("clean")
    return every.select("artifact", status.alias("status"), F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched"))


def projection(ledger: DataFrame) -> DataFrame:
    """Identity-only rows of a ledger, duplicates refused."""
    rows = ledger.select("message_fullname", "source_revision_id")
    w = Window.partitionBy("message_fullname", F.coalesce("source_revision_id", F.lit("")))
    twice = F.when(F.count("*").over(w) > 1, F.raise_error(F.lit("duplicate tombstone")).cast("string"))
    return rows.withColumn("message_fullname", F.coalesce(twice, F.col("message_fullname")))


def precheck(ledger: DataFrame, applied: DataFrame) -> DataFrame:
    """Ledger rows with already_applied: whether the store has that very tombstone."""
    known = applied.select(F.col("message_fullname").alias("__t"), F.col("source_revision_id").alias("__r")).distinct().withColumn("__known", F.lit(True))
    return ledger.join(known, F.col("message_fullname").eqNullSafe(F.col("__t")) & F.col("source_revision_id").eqNullSafe(F.col("__r")), "left").select(*ledger.columns, F.coalesce("__known", F.lit(False)).alias("already_applied"))
