"""Places in a global order without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder

#: Rows of one range, about: what one task puts in order.
ROWS_EACH = 1_000_000


def written(df: DataFrame, name: str = "ordered") -> DataFrame:
    """`df` written to the shared folder and read again, so that what follows does not work it out anew."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str | Column, rows_each: int | None = None) -> DataFrame:
    """`df` with _part, the number of a range in `order`; ranges ascend and rows that are equal in `order` share one.

    There are as many ranges as the number of rows asks for, with bounds that Spark samples. The table is written once
    before it is counted and, if there is more than one range, once in ranges."""
    held = written(df)
    parts = -(-held.count() // (rows_each or ROWS_EACH))
    if parts <= 1:
        return held.withColumn("_part", F.lit(0))
    return written(held.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, *order: str, rows_each: int | None = None) -> DataFrame:
    """`df` with _at, each row's place in `order`, from 0: places within a range and the sizes of the ranges before it."""
    ranged = in_ranges(df, *order, rows_each=rows_each)
    sizes = ranged.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_nth", nth).join(starts, F.col("_part") == F.col("_of"))
    return placed.select(*df.columns, (F.col("_start") + F.col("_nth")).alias("_at"))
