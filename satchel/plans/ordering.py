"""Global numbering and running sums without a single sorting task.

Rows are range-partitioned and sorted; each partition numbers its own rows, and one row per
partition carries what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.plans.staging import stage


def number_rows(df: DataFrame, *order: Column, name: str = "ord", start: int = 0) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given order, which should be total."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = stage(sorted_.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    marked = marked.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = before_each(marked.groupBy("__part").agg(F.count("*").alias("__n")), "__n", "__before")
    return marked.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + start).drop("__id", "__part", "__at", "__before")


def before_each(parts: DataFrame, value: str, name: str) -> DataFrame:
    """One row per partition: what all earlier partitions have together."""
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__part", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(name))


def running_sum(df: DataFrame, order: str, value: Column, name: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, by the numbers in ``order``.

    Runs of ``width`` numbers are summed apart; ``order`` must count rows without large gaps.
    """
    cut = df.withColumn("__v", value).withColumn("__part", F.floor(F.col(order) / width))
    before = before_each(cut.groupBy("__part").agg(F.sum("__v").alias("__n")), "__n", "__before")
    w = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("__v").over(w), F.lit(0))
    return cut.withColumn(name, inner).join(before, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__v", "__part", "__before")
