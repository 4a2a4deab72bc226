"""Scans of archives that keep a bounded part of what they read, and that go on where they stopped.

The units of all files (ranges, or frames) are listed once and written as files of a number of units each. A file stream reads
these with ``availableNow``, one file to a batch; its checkpoint knows which are done. A batch reads its units' lines once, works out
a class for each, and writes a narrow row for each line and the message itself only for lines that can still be kept. From that table come the
counts of the batch and the new state: for each bounded class the rows of least seeded digest among those kept so far and the batch's, one
row a name, the first by file, unit and place. Such states merge in any order to the same rows, so a batch that is done again, or a scan that is
killed and started anew, ends with the rows of one undisturbed run. The state of each batch is a folder of its own, made from the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_rank
from ..operators.messages import one_per_name
from ..plans import publish
from ..sources import archive
from ..sources import units as archive_units


@dataclass(frozen=True)
class Kept:
    """How many rows of a class are kept, and the seed of the digest by which they are the least."""

    target: int
    seed: int


class ScanCap(Exception):
    """More lines than a scan may take."""


@dataclass
class Scan:
    """A finished or stopped scan: state (class, source_id, unit, place, line_number, m), counts (source_id, class, n) and whether every unit was read."""

    state: DataFrame
    counts: DataFrame
    complete: bool
    batches: int


def _place() -> list[Column]:
    return [F.col("source_id"), F.col("unit"), F.col("place")]


def least(rows: DataFrame, kept: dict[str, Kept]) -> DataFrame:
    """Of rows (class, source_id, unit, place, rank, m) those that the classes keep: one of each name, the least by rank."""
    out = rows.limit(0)
    for name, k in kept.items():
        first = one_per_name(rows.where(F.col("class") == name).withColumn("__name", F.col("m.fullname")), _place(), "__name")
        out = out.unionByName(first.orderBy("rank", "__name").limit(k.target).drop("__name"))
    return out


def _bounds(state: DataFrame | None, kept: dict[str, Kept]) -> dict[str, str | None]:
    """Per class the digest that a new row must be below: that of the last kept row once the class is full; null where any may enter."""
    told = {} if state is None else {r["class"]: r for r in state.groupBy("class").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()}
    return {name: told[name]["last"] if name in told and told[name]["n"] >= k.target else None for name, k in kept.items()}


def bounded_scan(
    spark: SparkSession, sources: DataFrame, classify: Callable[[DataFrame], DataFrame], kept: dict[str, Kept], folder: str,
    units_at_once: int = 1000, unit_bytes: int | None = None, max_records: int | None = None, each_batch: Callable[[int], None] | None = None,
) -> Scan:
    """Reads sources and keeps the bounded classes.

    classify: rows (source_id, source_kind, source_role, unit, place, raw_line) -> (source_id, unit, place, class, m), a row for each, m a struct with a
    fullname. folder belongs to this scan, and to the next attempt of the same one. With max_records, a scan of which more lines are
    seen stops and isn't complete. each_batch is told the number of every batch before it is committed.
    """
    listed, work = f"{folder}/units", f"{folder}/batches"
    known = [r.asDict() for r in sources.orderBy("source_id").collect()]
    if not known:
        raise ValueError("there are no sources to scan")
    if publish.read_manifest(spark, listed) is None:
        units = publish.written(archive_units.list_units(spark, known, unit_bytes))
        n = units.count()
        dealt = units.repartitionByRange(max(1, -(-n // units_at_once)), "source_id", "unit")
        publish.publish(dealt, listed, {"units": n, "at_once": units_at_once}, {"files": max(1, -(-n // units_at_once))})
    numbered = {name: k for name, k in kept.items() if k.target > 0}

    def done(number: int) -> str | None:
        """The last batch before `number`."""
        earlier = [k for k in publish.listed(spark, work, "batch=") if k < number and publish.read_manifest(spark, f"{work}/batch={k}/state") is not None]
        return max(earlier, default=None)

    def checked(number: int) -> None:
        if max_records is not None and number_of_lines(spark, work) > max_records:
            raise ScanCap
        if each_batch is not None:
            each_batch(number)

    def put(batch: DataFrame, number: int) -> None:
        here = f"{work}/batch={number}"
        before = done(number)
        state = None if before is None else publish.published(spark, f"{work}/batch={before}/state")
        units = batch.select(*[f.split()[0] for f in archive_units.UNITS.split(", ")])
        many = units.count()
        if not many or publish.read_manifest(spark, f"{here}/state") is not None:  # done before, but the stream hadn't noted it
            return checked(number)
        lines = archive_units.lines_in(units.repartition(many, "source_id", "unit")).withColumn("raw_line", F.col("value").cast("string")).drop("value")
        roles = F.broadcast(units.select("source_id", "source_role").distinct())  # at most units_at_once
        told = classify(lines.join(roles, "source_id"))
        rank = F.lit(None).cast("string")
        for name, k in numbered.items():
            rank = F.when(F.col("class") == name, stable_rank(k.seed, F.col("m.fullname"))).otherwise(rank)
        may = F.lit(False)
        for name, last in _bounds(state, numbered).items():
            may = may | (F.col("class").eqNullSafe(name) & (F.lit(last is None) | (F.col("rank") <= F.lit(last))))
        narrow = told.withColumn("rank", rank).withColumn("m", F.when(may, F.col("m"))).withColumn("rank", F.when(may, F.col("rank")))
        read = publish.overwritten(narrow, f"{here}/lines")
        publish.overwritten(read.groupBy("source_id", "unit", "class").agg(F.count("*").alias("n")), f"{here}/counts")
        rows = read.where("m IS NOT NULL")
        merged = least(rows if state is None else rows.unionByName(state.select(*rows.columns)), numbered)
        publish.publish(merged, f"{here}/state", {"batch": number})
        publish.delete(spark, f"{here}/lines")
        checked(number)

    stream = spark.readStream.schema(archive_units.UNITS).option("maxFilesPerTrigger", 1).parquet(f"{listed}/data")
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).start()
    capped = False
    try:
        query.awaitTermination()
    except Exception as error:
        if "ScanCap" not in str(error):
            raise
        capped = True
    finally:
        query.stop()
    batches = publish.listed(spark, work, "batch=")
    counts = _counts(spark, work)
    by_unit = publish.written(counts.groupBy("source_id", "unit").agg(F.sum("n").alias("lines")))
    last = done(max(batches, default=-1) + 1)
    if last is None:
        raise ValueError("nothing was read")
    told = archive.numbered(publish.published(spark, f"{work}/batch={last}/state"), by_unit)
    return Scan(told, counts.groupBy("source_id", "class").agg(F.sum("n").alias("n")), not capped, len(batches))


def _counts(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.schema("source_id string, unit int, class string, n bigint").parquet(*[f"{work}/batch={k}/counts" for k in publish.listed(spark, work, "batch=")])


def number_of_lines(spark: SparkSession, work: str) -> int:
    """Lines that the batches so far have seen, without quarantined ones."""
    return _counts(spark, work).where("class <> 'quarantined'").agg(F.sum("n")).first()[0] or 0
