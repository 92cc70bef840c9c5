"""Incremental runs: a stream of file versions, each batch checked on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import line_checks, report
from quarry.sources import tables

FILES = "path string, text string"


def versions(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of (path, text) rows that land in a folder as Parquet."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch).parquet(folder)


def findings(stream: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """Findings of single-line checks; no state is held."""
    return report.identified(line_checks.check_lines(tables.lines(stream), checks))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a sink for each batch of changed files; a file that comes again with the same text in a batch counts once."""
    return stream.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: sink(df.dropDuplicates(["path", "content_hash"]), n)).start()
