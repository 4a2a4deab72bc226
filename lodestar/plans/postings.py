"""A lexical index that follows its units: a base and deltas under a log of generations, merged when read, compacted when asked.

A delta holds the postings and lengths of new units, and the keys that it takes away: those of its units, which may be newer
forms of older ones, and those that were deleted. Reading leaves out of each part what a later one takes away. The number of units and of
their tokens, which scores need, are kept in the log: a delta is counted against the lengths in force, so postings aren't read for it.
Each state is an entry of the log that lists its parts. A writer that builds on a state that is no longer the last gets
publish.Conflict, and nothing of its work is seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical
from . import publish

KEYS = ("snapshot_id", "unit_id")


def _lengths(units: DataFrame) -> DataFrame:
    """(snapshot_id, unit_id, tokens) of units."""
    tokens = sum(F.size(lexical.tokens(F.coalesce(F.col(c), F.lit("")))) for c in ("focus_text", "context_only_text"))
    return units.select(*KEYS, tokens.cast("bigint").alias("tokens"))


def _write(root: str, units: DataFrame, gone: DataFrame) -> str:
    """A part: its postings, lengths and the keys that it takes away."""
    part = f"{root}/part-{uuid.uuid4().hex}"
    publish.publish(lexical.postings(units, KEYS).repartitionByRange("term"), f"{part}/postings", {"part": part})
    publish.publish(_lengths(units), f"{part}/lengths", {"part": part})
    publish.publish(gone, f"{part}/gone", {"part": part})
    return part


def _merged(spark: SparkSession, parts: list[str], name: str) -> DataFrame:
    """The rows of a table of all parts that no later part takes away."""
    found = gone = None
    for part in reversed(parts):
        rows = publish.published(spark, f"{part}/{name}")
        mine = rows if gone is None else rows.join(gone, list(KEYS), "left_anti")
        found = mine if found is None else found.unionByName(mine)
        more = publish.published(spark, f"{part}/gone")
        gone = more if gone is None else gone.union(more).distinct()
    return found


def _keys(units: DataFrame) -> DataFrame:
    """The keys of units; an error where one stands twice."""
    keys = units.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return keys.select(F.when(F.col("n") > 1, F.raise_error(F.lit("a unit stands twice")).cast("string")).otherwise(F.col("snapshot_id")).alias("snapshot_id"), "unit_id")


def build(spark: SparkSession, root: str, units: DataFrame) -> dict:
    """The first state of an index, or a new one in the place of all parts."""
    number, _ = publish.head(spark, root)
    part = _write(root, units, _keys(units).limit(0))
    return _put(spark, root, number, [part])


def update(spark: SparkSession, root: str, units: DataFrame, deleted: DataFrame | None = None) -> dict:
    """Adds units, in the place of older ones of their keys, and takes away deleted keys (which units of this update may not have)."""
    number, now = publish.head(spark, root)
    if now is None:
        raise ValueError(f"there is no index under {root}")
    new = publish.written(_keys(units))
    gone = new if deleted is None else new.union(deleted.select(*KEYS)).distinct()
    if deleted is not None and not new.join(deleted.select(*KEYS), list(KEYS), "left_semi").isEmpty():
        raise ValueError("a unit is added and deleted at once")
    return _put(spark, root, number, [*now["parts"], _write(root, units, gone)], now)


def _put(spark: SparkSession, root: str, after: int, parts: list[str], before: dict | None = None) -> dict:
    """The log's next entry: parts, units and tokens. Only the newest part and what it takes away are counted."""
    n, tokens = publish.published(spark, f"{parts[-1]}/lengths").agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if before is not None and len(parts) > 1:
        lost = _merged(spark, parts[:-1], "lengths").join(publish.published(spark, f"{parts[-1]}/gone"), list(KEYS), "left_semi")
        m, less = lost.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        n, tokens = before["units"] + n - m, before["tokens"] + tokens - less
    value = {"parts": parts, "units": n, "tokens": tokens}
    publish.commit(spark, root, value, after)
    return value


def read(spark: SparkSession, root: str) -> tuple[DataFrame, int, float]:
    """(postings, number of units, mean length) in force, as lexical.bm25 and lexical.search take them."""
    _, now = publish.head(spark, root)
    if now is None:
        raise ValueError(f"there is no index under {root}")
    return _merged(spark, now["parts"], "postings"), now["units"], now["tokens"] / now["units"] if now["units"] else 0.0


def compact(spark: SparkSession, root: str) -> dict:
    """One part in the place of all; the old ones stay for readers that have begun."""
    number, now = publish.head(spark, root)
    part = f"{root}/part-{uuid.uuid4().hex}"
    for name in ("postings", "lengths"):
        rows = _merged(spark, now["parts"], name)
        publish.publish(rows.repartitionByRange("term") if name == "postings" else rows, f"{part}/{name}", {"part": part})
    publish.publish(publish.published(spark, f"{part}/lengths").select(*KEYS).limit(0), f"{part}/gone", {"part": part})
    value = {"parts": [part], "units": now["units"], "tokens": now["tokens"]}
    publish.commit(spark, root, value, number)
    return value
