"""The base tables: files(path, exists, size, line_count, text) and lines(path, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths

BREAK = "\r\n|[\r\n\x0b\x0c\x1c\x1d\x1e\x85  ]"


def split_lines(text: Column) -> Column:
    """Lines as Python's splitlines: every line break, no empty piece after the last one."""
    parts = F.split(text, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Empty files, which Spark's readers leave out, by a listing on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    it, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while it.hasNext():
        f = it.next()
        if f.getLen() == 0:
            out.append(f.getPath().toUri().getPath())
    return out


def read_tree(spark: SparkSession, folder: str, limit: int = 5 << 20, in_maps: bool = False, roots: list[str] | None = None) -> DataFrame:
    """Source files under a folder, with raw content: those of an audit, or of the maps. Larger ones than `limit` keep a null
    text and are marked `oversized`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, folder)], "path string")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    found = raw.select(plain("path").alias("p"), "length", "content").unionByName(
        empty.select(plain("path").alias("p"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    )
    rows = found.withColumn("root", plain(F.lit(folder.rstrip("/")))).withColumn("path", F.expr("substring(p, length(root) + 2)")).where(paths.in_maps(F.col("path"), roots) if in_maps else paths.wanted(F.col("path"), roots=roots))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return rows.select("path", F.lit(True).alias("exists"), F.col("length").alias("size"), (F.col("length") > limit).alias("oversized"), F.when(F.col("length") <= limit, text).alias("text"), "content").withColumn(
        "line_count", F.coalesce(F.size(split_lines(F.col("text"))), F.lit(0))
    )


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files: path is source/lang/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), a row for each line."""
    return files.where("text IS NOT NULL").select("path", F.posexplode(split_lines(F.col("text"))).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def too_many(files: DataFrame, most: int = 800, top: int = 8) -> DataFrame:
    """The guard's report: the folders with most files, if there are more than `most` files; else no row."""
    head = F.when(F.instr("path", "/") > 0, F.element_at(F.split("path", "/"), 1)).otherwise(".")
    by = files.groupBy(head.alias("dir")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total")).where(F.col("total") > most)
    return by.join(F.broadcast(total)).orderBy(F.desc("n"), "dir").limit(top)


def changed(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Files whose content isn't in the cache (content_hash, version)."""
    keyed = files.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.join(cache.where(F.col("version") == version).select("content_hash"), "content_hash", "left_anti")


def snapshots(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files that are asked for (path); those that aren't there have exists = false and an empty text."""
    j = wanted.select("path").distinct().join(files.select("path", "text", F.lit(True).alias("here")), "path", "left")
    return j.select("path", F.coalesce("here", F.lit(False)).alias("exists"), F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("size"), F.coalesce(F.size(split_lines(F.col("text"))), F.lit(0)).alias("line_count"), F.coalesce("text", F.lit("")).alias("text"))


def oversized(files: DataFrame) -> DataFrame:
    """meta.oversized_file: files whose text was not read."""
    return files.where("oversized").select(F.lit("meta.oversized_file").alias("check_id"), "path", F.lit(1).alias("line_no"), F.col("size").cast("string").alias("detail"), F.lit("MEDIUM").alias("severity"), F.lit("REVISE").alias("impact"))


def package_roots(files: DataFrame) -> DataFrame:
    """(root): top-level folders that are Python packages, also below src, lib and python."""
    return files.where(paths.basename(F.col("path")) == "__init__.py").select(paths.package_root(F.col("path")).alias("root")).where("root IS NOT NULL").distinct()


# What names a platform in a file, and marks that a file is generated.
PLATFORMS = {"windows": r"(?m)^\s*(?:import|from)\s+(?:winreg|msvcrt|win32\w*)\b|ctypes\.windll|sys\.platform\s*==\s*[\"']win32", "posix": r"(?m)^#!.*/(?:ba)?sh|^\s*(?:import|from)\s+(?:fcntl|pwd|grp|termios|resource)\b|sys\.platform\s*(?:==|\.startswith\()\s*[\"'](?:linux|darwin)"}
GENERATED = "(?i)@generated|auto-?generated|do not edit|generated by|code generated"


def deployment(files: DataFrame, least: int = 2) -> DataFrame:
    """(platform, n_files): platforms that at least two files name."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in PLATFORMS.items()]))
    return files.select(F.explode(hits).alias("platform")).groupBy("platform").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= least)


def generated(files: DataFrame) -> DataFrame:
    """(path) of files with a generator's mark in their first ten lines."""
    return files.where(F.substring_index("text", "\n", 10).rlike(GENERATED)).select("path")
