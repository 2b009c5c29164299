"""Lines of text files, read by ranges in many tasks and numbered as they stand in their files.

Spark's text reader cuts a large file into ranges at line ends.  A line's number is
its place in its range and the number of lines in the ranges before it, so that
only a row for each range is summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.session import cut


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, row, line``: the bytes of each line, by the range's start and a number that rises within it."""
    line = F.col("value").cast("binary")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), line.alias("line"))


def running(rows: DataFrame, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """The rows (with ``path, block, row``) with the sum of a value over the lines of the file up to each, itself counted or not."""
    rows = rows.withColumn("\0value", value.cast("long"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = rows.groupBy("path", "block").agg(F.sum("\0value").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("\0before"))
    inside = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("\0value").over(inside) - F.when(F.lit(inclusive), F.lit(0)).otherwise(F.col("\0value"))
    return rows.withColumn("\0own", own).join(before, ["path", "block"]).withColumn(name, F.col("\0own") + F.col("\0before")).drop("\0own", "\0before", "\0value")


def numbered_files(rows: DataFrame) -> DataFrame:
    """``path, file``: files numbered in the order of their paths, one row each."""
    return rows.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file"))


def written_lines(spark: SparkSession, path: str) -> DataFrame:
    """``raw_lines``, written once, so that all steps see the same numbers."""
    return cut(raw_lines(spark, path), "lines")
