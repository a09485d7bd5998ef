"""A global order of rows without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.storage import stored


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` written in this order, with ``place`` (ascending, with gaps) and ``part``, the range a row lies in.

    Ranges are dealt by samples of the order, so the rows of one key lie in as many ranges as they need. What is sampled
    is read twice: give a written table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))


def numbered(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """``df`` with ``at`` (0, 1, ... within each group in this order) and ``n``, the rows of the group; a null group has none.

    One row a group and range is summed up; the rows of a group are never gathered.
    """
    placed = in_order(df, F.col(group), *order)
    runs = placed.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "part", "first", before.alias("before"), F.sum("rows").over(of).alias("n"))
    return placed.join(runs, [group, "part"]).withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")
