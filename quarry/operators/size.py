"""Size checks. The profile's thresholds: files 750 and 1000 lines, functions 100 and 150, nesting 5 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_sizes(lines: DataFrame, warn: int = 750, revise: int = 1000) -> DataFrame:
    """(path, line_count, size_class) of each file with a line."""
    n = lines.groupBy("path").agg(F.count("*").alias("line_count"))
    return n.withColumn("size_class", F.when(F.col("line_count") >= revise, "file_too_large").when(F.col("line_count") >= warn, "file_warn").otherwise("ok"))


def function_sizes(functions: DataFrame, warn: int = 100, revise: int = 150) -> DataFrame:
    """The first function of each file at or over a threshold."""
    big = functions.withColumn("n", F.col("end_line") - F.col("start_line") + 1).where(F.col("n") >= warn)
    first = F.row_number().over(W.partitionBy("path").orderBy("start_line"))
    return big.withColumn("k", first).where("k = 1").select("path", "name", "start_line", "n", F.when(F.col("n") >= revise, "function_too_large").otherwise("function_warn").alias("size_class"))


def nesting(depths: DataFrame, warn: int = 5, revise: int = 8) -> DataFrame:
    return depths.where(F.col("depth") >= warn).withColumn("size_class", F.when(F.col("depth") >= revise, "nesting_too_high").otherwise("nesting_warn"))
