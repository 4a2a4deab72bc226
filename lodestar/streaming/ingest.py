"""Incremental ingestion: new archive files are read once, quarantined, normalised and appended; restarts go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.messages import normalize
from ..sources.archive import line_problem


def lines(spark: SparkSession, folder: str, source_kind: str, files_at_once: int = 100) -> DataFrame:
    """A stream of (source_id, source_kind, line_number, raw_line); source_id is the file's name, line numbers aren't known to a stream."""
    read = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_at_once).text(folder)
    return read.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_id"), F.lit(source_kind).alias("source_kind"), F.lit(None).cast("bigint").alias("line_number"), F.col("value").alias("raw_line"))


def ingest_available(spark: SparkSession, folder: str, source_kind: str, target: str, checkpoint: str) -> StreamingQuery:
    """Normalises what is new in folder into target/messages and target/rejected, then stops. The checkpoint makes each file count once."""

    def put(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where("norm_error IS NULL").drop("norm_error").write.mode("overwrite").parquet(f"{target}/messages/batch={number}")
        kept.where("norm_error IS NOT NULL").select("provenance", "norm_error").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
        kept.unpersist()

    normal = normalize(lines(spark, folder, source_kind).where(line_problem(F.col("raw_line")).isNull()))
    return normal.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
