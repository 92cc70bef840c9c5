"""Text records as tables: change counts, map files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def churn(numstat: DataFrame) -> DataFrame:
    """(path, added, deleted) from lines (value) of `git log --numstat`; binary files ("-") are left out."""
    p = numstat.select(F.split("value", "\t").alias("p")).where("size(p) = 3")
    n = p.select(F.col("p")[2].alias("path"), F.expr("try_cast(p[0] AS int)").alias("added"), F.expr("try_cast(p[1] AS int)").alias("deleted")).where("added IS NOT NULL AND deleted IS NOT NULL")
    return n.groupBy("path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def write_maps(maps: dict[str, DataFrame], folder: str) -> None:
    """Each map as JSON lines in its own folder, replaced whole."""
    for name, df in maps.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def read_map(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A map; malformed rows are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/{name}")


def index(maps: dict[str, DataFrame]) -> DataFrame:
    """(map, n, schema_hash) of each map."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("map"), "n", F.substring(F.sha2(F.lit(",".join(sorted(df.columns))), 256), 1, 16).alias("schema_hash")) for name, df in maps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corrupt(artifacts: DataFrame) -> DataFrame:
    """meta.artifact_corrupted: JSON files (path, text) that don't parse."""
    bad = artifacts.where(F.col("path").endswith(".json") & F.expr("try_parse_json(text)").isNull())
    return bad.select(F.lit("meta.artifact_corrupted").alias("check_id"), "path", F.lit(1).alias("line_no"), F.lit("not JSON").alias("detail"), F.lit("HIGH").alias("severity"), F.lit("REVISE").alias("impact"))
