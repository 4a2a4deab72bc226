"""Dense retrieval: exact cosine search, feedback centroids, and the ledger of what is indexed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import nul_joined, sha_hex
from ..functions.vectors import centroid, invalid_vector


def check_vectors(points: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """points with a column problem: dimension, not_finite, zero_norm, missing or null."""
    return points.withColumn("problem", invalid_vector(F.col(vector), dimension))


#: Queries of a block at most, their numbers in all, and the scores that a task works out at a time.
BLOCK, BLOCK_NUMBERS, SCORES = 10_000, 1 << 22, 1 << 22


def search(queries: DataFrame, points: DataFrame, k: int, where: dict[str, object] | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best points of each query (query_id, query) by cosine; ties by id. Exact.

    The queries are a stated set; blocks of at most BLOCK of them and BLOCK_NUMBERS numbers are broadcast, and the points are read
    once for each block. A task multiplies points and queries as matrices, works out the scores of those that could be among the k
    best again, each by itself, and passes on the k best of each query; there is no row for a pair. `where` filters points by equality
    first. A point whose vector is null, has null in it or another dimension, or has no direction, has no score and no rank; queries must have one.
    """
    for key, value in (where or {}).items():
        points = points.where(F.col(key) == F.lit(value))
    spark = queries.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", points.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    size = queries.agg(F.max(F.size("query")).alias("d"), F.count("*").alias("n")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-size["n"] * (size["d"] or 0) // BLOCK_NUMBERS))
    found = spark.createDataFrame([], schema)
    for n in range(blocks):
        mine = [(r["query_id"], r["query"]) for r in queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).select("query_id", "query").collect()]  # bounded as above
        if mine:
            found = found.unionByName(_best(spark, mine, points.select("id", "vector"), k, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(spark: SparkSession, queries: list[tuple], points: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """(query_id, id, score): of each task's points the k best of each query."""
    sent = spark.sparkContext.broadcast((pa.array([q for q, _ in queries], to_arrow_type(schema["query_id"].dataType)), np.array([v for _, v in queries], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        length = np.sqrt((q * q).sum(axis=1))
        if not (length > 0).all():
            raise ValueError("a query has no direction")
        unit = np.ascontiguousarray((q / length[:, None]).T)
        least = np.full(len(q), -np.inf)  # the k-th best score so far
        pool: list[pa.Table] = []
        held = 0

        def settle() -> None:
            """Keeps the k best of each query."""
            nonlocal pool, held
            every = pa.concat_tables(pool)
            every = every.take(pc.sort_indices(every, [("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
            of = every["q"].to_numpy()
            place = np.arange(len(of)) - np.searchsorted(of, of)
            last = np.flatnonzero(place == k - 1)
            least[of[last]] = every["score"].to_numpy()[last]
            kept = every.take(pa.array(np.flatnonzero(place < k)))
            pool, held = [kept], 0

        for batch in batches:
            for at in range(0, batch.num_rows, max(1, SCORES // max(len(q), q.shape[1]))):
                part = batch.slice(at, max(1, SCORES // max(len(q), q.shape[1])))
                vectors = part.column(1)
                whole = np.flatnonzero(pc.equal(pc.list_value_length(vectors), q.shape[1]).fill_null(False).to_numpy(zero_copy_only=False))
                p = vectors.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), q.shape[1])
                norm = np.sqrt((p * p).sum(axis=1))
                good = norm > 0  # a null in a vector is NaN here
                p, norm, ids = p[good], norm[good], part.column(0).take(pa.array(whole[good]))
                if not len(p):
                    continue
                near = (p @ unit) / norm[:, None]
                bound = np.maximum(least, np.partition(near, len(p) - k, axis=0)[len(p) - k] if len(p) > k else -np.inf) - 1e-9
                i, j = np.nonzero(near >= bound)
                for first in range(0, len(i), step := max(1, SCORES // q.shape[1])):
                    a, b = i[first : first + step], j[first : first + step]
                    score = (p[a] * q[b]).sum(axis=1) / (norm[a] * length[b])  # the same for equal vectors, wherever they stand
                    pool.append(pa.table({"q": pa.array(b, pa.int64()), "id": ids.take(pa.array(a)), "score": pa.array(score)}))
                    held += len(a)
                if held > max(SCORES, 4 * k * len(q)):
                    settle()
        if pool:
            settle()
            for part in pool[0].to_batches():
                yield pa.RecordBatch.from_arrays([names.take(part.column(0)), part.column(1), part.column(2)], names=schema.names)

    return points.mapInArrow(run, schema)


def feedback_centroids(seeds: DataFrame, dimension: int, most: int = 5) -> DataFrame:
    """(scenario_id, query, positives, negatives) of seeds (scenario_id, id, vector, positive): the mean of the positive vectors.

    Negatives are named and never move the mean. More than `most` positives are an error, not cut off.
    """
    positive = F.col("positive")
    v = F.when(positive, F.col("vector"))
    found = seeds.groupBy("scenario_id").agg(
        centroid(v, dimension).alias("query"), F.sort_array(F.collect_list(F.when(positive, F.col("id")))).alias("positives"), F.sort_array(F.collect_list(F.when(~positive, F.col("id")))).alias("negatives"),
    )
    found = found.where(F.size("positives") > 0)
    many = F.raise_error(F.concat(F.lit("too many positive examples for "), F.col("scenario_id").cast("string")))
    return found.withColumn("positives", F.when(F.size("positives") > most, many.cast("array<string>")).otherwise(F.col("positives").cast("array<string>")))


def recipe_hash(model: str, revision: str, dimension: int, instruction: str, field: str, version: str) -> Column:
    return sha_hex(nul_joined(model, revision, dimension, instruction, field, version))


def pending(units: DataFrame, jobs: DataFrame, snapshot_id: str, recipe: str) -> DataFrame:
    """Units to index: those without a job, with another content or not indexed yet."""
    done = jobs.where((F.col("snapshot_id") == snapshot_id) & (F.col("recipe_hash") == recipe)).select("unit_id", F.col("content_hash").alias("__old"), F.col("status").alias("__status"))
    joined = units.where(F.col("snapshot_id") == snapshot_id).join(done, "unit_id", "left")
    reason = F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col("content_hash"), "changed").when(F.col("__status") != "indexed", F.col("__status"))
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("unit_id", "content_hash", "reason")


def mark(jobs: DataFrame, batch: DataFrame, snapshot_id: str, recipe: str, status: str) -> DataFrame:
    """The job ledger after a batch (unit_id, content_hash) got a status; written as a new generation by the caller."""
    new = batch.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(recipe).alias("recipe_hash"), "unit_id", "content_hash", F.lit(status).alias("status"))
    return jobs.join(new.select("snapshot_id", "recipe_hash", "unit_id"), ["snapshot_id", "recipe_hash", "unit_id"], "left_anti").unionByName(new)


def migrated(points: DataFrame, units: DataFrame) -> DataFrame:
    """points with the context references of their units; a point without a unit is an error."""
    refs = units.select(F.col("unit_id").alias("id"), "context_message_refs").withColumn("__found", F.lit(True))
    joined = points.join(refs, "id", "left")
    gone = F.raise_error(F.concat(F.lit("no unit for vector "), F.col("id").cast("string"))).cast("array<string>")
    return joined.withColumn("context_message_refs", F.when(F.col("__found"), F.col("context_message_refs")).otherwise(gone)).drop("__found")


def relabelled(points: DataFrame, old: str, new: str) -> DataFrame:
    """points of snapshot `old` under the name `new`; others stay."""
    return points.withColumn("snapshot_id", F.when(F.col("snapshot_id") == old, F.lit(new)).otherwise(F.col("snapshot_id")))


def delete_points(points: DataFrame, identities: DataFrame, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """(points that stay, counts) after deletion by identity and by context reference within a snapshot.

    identities: message_fullname, source_revision_id (null: any), unit_id (null or no such column: any). A point goes directly if
    one of them names it, and as a context contributor if its context_message_refs hold one of their names; one that goes
    directly is not counted again. Points without references can't be judged: a table without that column is an error, and so
    is a null in it. counts: requested, deleted, context_deleted, before, after.
    """
    if not snapshot_id.strip():
        raise ValueError("a deletion needs a snapshot")
    if "context_message_refs" not in points.columns:
        raise ValueError("the points don't have context references; index them anew")
    given = identities if "unit_id" in identities.columns else identities.withColumn("unit_id", F.lit(None).cast("string"))
    empty = (F.coalesce("message_fullname", F.lit("")) == "") | (F.col("source_revision_id") == "") | (F.col("unit_id") == "")
    name = F.when(F.coalesce(empty, F.lit(False)), F.raise_error(F.lit("an identity has an empty field")).cast("string")).otherwise(F.col("message_fullname"))
    wanted = given.select(name.alias("__m"), F.col("source_revision_id").alias("__r"), F.col("unit_id").alias("__u")).distinct()
    here = points.where(F.col("snapshot_id") == snapshot_id)
    named = (F.col("message_fullname") == F.col("__m")) & (F.col("__r").isNull() | (F.col("__r") == F.col("source_revision_id"))) & (F.col("__u").isNull() | (F.col("__u") == F.col("id")))
    direct = here.join(wanted, named, "left_semi").select("id", F.lit("direct").alias("__how"))
    unknown = F.raise_error(F.concat(F.lit("no context references at point "), F.col("id").cast("string"))).cast("array<string>")
    refs = here.select("id", F.explode(F.coalesce("context_message_refs", unknown)).alias("__m"))
    context = refs.join(wanted.select("__m").distinct(), "__m", "left_semi").select("id", F.lit("context").alias("__how"))
    gone = direct.union(context).groupBy("id").agg(F.max("__how").alias("__how"))  # direct goes before context
    marked = points.join(gone.withColumn("snapshot_id", F.lit(snapshot_id)), ["id", "snapshot_id"], "left")
    told = marked.agg(F.count_if(F.col("__how") == "direct").alias("deleted"), F.count_if(F.col("__how") == "context").alias("context_deleted"), F.count("*").alias("before"), F.count_if(F.col("__how").isNull()).alias("after"))
    counts = wanted.agg(F.count("*").alias("requested")).join(told)
    return marked.where("__how IS NULL").select(*points.columns), counts


def deletion_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many points there were, are and went; an error if a point is new."""
    kept = after.join(before, "id", "left_anti").agg(F.count("*").alias("foreign"))
    return before.agg(F.count("*").alias("before")).join(after.agg(F.count("*").alias("after"))).join(kept).select("before", "after", (F.col("before") - F.col("after")).alias("deleted"), F.assert_true(F.col("foreign") == 0, F.lit("points appeared while deleting")).isNull().alias("consistent"))
