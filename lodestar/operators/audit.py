"""Archive audits: exact identities of exposures and corpus units in the archive, coverage, collisions, diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: The four fields that name an archive record exactly.
KEYS = ("fullname", "revision", "thread", "text")


def identities(rows: DataFrame, fullname: str = "fullname", revision: str = "source_revision_id", thread: str = "thread_fullname", text: str = "focus_text", unicode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., fullname, revision, thread, text): folded identity fields; a missing one is empty."""
    return rows.select(*keep, *[fold(F.col(c), unicode).alias(k) for k, c in zip(KEYS, (fullname, revision, thread, text), strict=True)])


def resolve_exposures(exposures: DataFrame, corpus: DataFrame, unicode: bool = True) -> DataFrame:
    """(exposure_id, status fields...): identities of an exposure: those of the unit that its candidate names, else its own four fields if all are there."""
    by_unit = corpus.select(F.col("unit_id").alias("__u"), *[F.col(k).alias(f"__{k}") for k in KEYS])
    joined = exposures.join(by_unit, F.col("candidate_id") == F.col("__u"), "left")
    own = identities(joined, "message_fullname", "source_revision_id", "thread_fullname", "focus_text", unicode, ("exposure_id", "__u", *[f"__{k}" for k in KEYS], "message_fullname", "source_revision_id", "thread_fullname", "focus_text"))
    whole = F.col("message_fullname").isNotNull() & F.col("source_revision_id").isNotNull() & F.col("thread_fullname").isNotNull() & F.col("focus_text").isNotNull()
    known = F.col("__u").isNotNull()
    return own.select("exposure_id", *[F.when(known, F.col(f"__{k}")).when(whole, F.col(k)).alias(k) for k in KEYS], (known | whole).alias("identified"))


def match_exposures(resolved: DataFrame, archive: DataFrame) -> DataFrame:
    """(exposure_id, status, archive_matches): matched where an archive record (source_id, line, four fields) has the very identity."""
    return matched(resolved, resolved.where("identified").join(archive, list(KEYS)).select("exposure_id", "source_id", "line"))


def matched(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """(exposure_id, status, archive_matches) of all exposures, from the archive records (exposure_id, source_id, line) found for them."""
    hits = found.groupBy("exposure_id").agg(F.countDistinct("source_id", "line").alias("archive_matches"))
    every = resolved.select("exposure_id").distinct().join(hits, "exposure_id", "left")
    return every.select("exposure_id", F.when(F.col("archive_matches").isNull(), "unresolved").otherwise("matched").alias("status"), F.coalesce("archive_matches", F.lit(0).cast("bigint")).alias("archive_matches"))


def coverage(archive: DataFrame, corpus: DataFrame) -> DataFrame:
    """(source_id, records, matched_records): archive records whose identity stands in the corpus."""
    known = corpus.select(*KEYS).distinct().withColumn("__m", F.lit(1))
    return archive.join(known, list(KEYS), "left").groupBy("source_id").agg(F.count("*").alias("records"), F.count("__m").alias("matched_records"))


def collisions(archive: DataFrame, corpus: DataFrame, archive_only: bool = False) -> DataFrame:
    """(four fields, archive_count, corpus_count) of identities that stand more than once on either side; with archive_only, those of the archive alone."""
    a = archive.groupBy(*KEYS).agg(F.count("*").alias("archive_count"))
    c = corpus.groupBy(*KEYS).agg(F.count("*").alias("corpus_count"))
    both = a.join(c, list(KEYS), "left" if archive_only else "full_outer").na.fill(0, ["archive_count", "corpus_count"])
    return both.where("archive_count > 1 OR corpus_count > 1")


def targeted(archive: DataFrame, resolved: DataFrame) -> DataFrame:
    """The archive records that any exposure could match: what a partitioned audit has to index."""
    return archive.join(resolved.where("identified").select(*KEYS).distinct(), list(KEYS), "left_semi")


def derived_coverage(matches: DataFrame) -> DataFrame:
    """(status, exposures, archive_matches) with the invariant that unresolved rows have no match."""
    sound = F.when((F.col("status") == "unresolved") & (F.col("archive_matches") > 0), F.raise_error(F.lit("an unresolved row has matches")).cast("string")).otherwise(F.col("status"))
    return matches.withColumn("status", sound).groupBy("status").agg(F.count("*").alias("exposures"), F.sum("archive_matches").alias("archive_matches"))


def unresolved_diagnosis(unresolved: DataFrame, units: DataFrame, snapshot_id: str) -> DataFrame:
    """(source_kind, corpus_present, n) of unresolved rows (message_fullname, source_revision_id)."""
    u = units.where(F.col("snapshot_id") == snapshot_id).select(F.col("message_fullname").alias("__m"), F.col("source_revision_id").alias("__r")).distinct().withColumn("__in", F.lit(True))
    joined = unresolved.join(u, (F.col("message_fullname") == F.col("__m")) & (F.col("source_revision_id") == F.col("__r")), "left")
    name = F.lower("message_fullname")
    kind = F.when(name.startswith("t3_"), "submission").when(name.startswith("t1_"), "comment").otherwise("unknown")
    return joined.groupBy(kind.alias("source_kind"), F.coalesce("__in", F.lit(False)).alias("corpus_present")).agg(F.count("*").alias("n"))
