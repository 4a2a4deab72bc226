"""One order over a whole table without one task for it: range partitions, sorted each, and the totals of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.publish import written


#: Rows that one task may put in order.
SMALL = 100_000


def running_total(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to each, in the order of columns that leave no ties.

    More than SMALL rows are written by ranges of the order; only a sum for each range meets in one task then.
    """
    kept = written(rows.withColumn("__value", value))
    up_to_here = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if kept.count() <= SMALL:
        return kept.withColumn("__total", F.sum("__value").over(up_to_here)).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__total").alias(name))
    ranged = written(kept.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))
    within = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("__within", within).join(before, "__range").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__within") + F.col("__before")).alias(name))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered from 1 in the order of columns that leave no ties."""
    return running_total(rows, order, F.lit(1).cast("bigint"), name)
