"""Numbering rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def number_in_groups(df: DataFrame, groups: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` with the place of each row in its group, from 1; rows that tie in ``order`` take any turn.

    Rows are placed by ranges of group and order, so a group that holds a third
    of all rows is spread over many tasks. Each range numbers its own rows and
    adds the rows of the group in the ranges before. Rows without a group are one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *groups, *order).withColumn("_range", F.spark_partition_id())
    # Written once: the ranges are drawn from a sample, and must not be drawn again.
    placed = materialize(placed, "ranges")
    local = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order))
    cells = placed.groupBy(*groups, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    offsets = cells.select(*keys, F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        placed.withColumn("_local", local)
        .join(offsets, same)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .select(*df.columns, name)
    )
