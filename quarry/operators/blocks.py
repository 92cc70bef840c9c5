"""Repeated blocks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def meaningful(lines: DataFrame) -> DataFrame:
    """Lines with blanks collapsed, empty ones left out, numbered anew within each file as k."""
    s = F.trim(F.regexp_replace("line", "[ \t]+", " "))
    kept = lines.select("path", "line_no", s.alias("s")).where("s <> ''")
    return kept.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("line_no")))


def windows(lines: DataFrame, width: int) -> DataFrame:
    """(path, k, line_no, hash) of every run of `width` meaningful lines. Lines are hashed first, so that a window carries 16
    bytes a line, not its text; the run's hash is that of its lines' hashes."""
    w = W.partitionBy("path").orderBy("k").rowsBetween(0, width - 1)
    kept = meaningful(lines).select("path", "k", "line_no", F.unhex(F.sha2("s", 256)).alias("h"))
    runs = kept.withColumn("run", F.collect_list(F.substring("h", 1, 16)).over(w))
    return runs.where(F.size("run") == width).select("path", "k", "line_no", F.md5(F.array_join(F.transform("run", lambda x: F.lower(F.hex(x))), "")).alias("hash"))


def across_files(lines: DataFrame, width: int = 12) -> DataFrame:
    """Runs that stand in two files or more: (hash, n_files, n_places, first_path)."""
    w = windows(lines, width).groupBy("hash", "path").agg(F.count("*").alias("n"))
    return w.groupBy("hash").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_places"), F.min("path").alias("first_path")).where("n_files >= 2")


def merged(lines: DataFrame, width: int = 12) -> DataFrame:
    """(path, first_line, last_line, n_files): regions of a file made of runs that the same number of files share, the first of
    these files being the same; runs that follow one another are one region. A region is given for its first file."""
    w = windows(lines, width)
    shared = across_files(lines, width).select("hash", "n_files", F.col("first_path").alias("path"))
    own = w.join(shared, ["hash", "path"]).groupBy("path", "n_files", "k").agg(F.min("line_no").alias("line_no"))
    island = own.withColumn("g", F.col("k") - F.row_number().over(W.partitionBy("path", "n_files").orderBy("k")))
    found = island.groupBy("path", "n_files", "g").agg(F.min("line_no").alias("first_line"), F.max("k").alias("k"))
    ends = meaningful(lines).select("path", (F.col("k") - (width - 1)).alias("k"), F.col("line_no").alias("last_line"))
    return found.join(ends, ["path", "k"]).select("path", "first_line", "last_line", "n_files")


def within_file(lines: DataFrame, width: int = 12) -> DataFrame:
    """Runs that stand twice or more in one file and nowhere else, with starts at least `width` apart: (path, hash, first_line, last_line, n)."""
    w = windows(lines, width)
    by = w.groupBy("hash", "path").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), (F.max("k") - F.min("k")).alias("span"))
    one = by.groupBy("hash").agg(F.count("*").alias("files")).where("files = 1").select("hash")
    return by.where(F.col("span") >= width).join(one, "hash").select("path", "hash", "first_line", "last_line", "n")


def regions(lines: DataFrame, width: int = 4, least: int = 5) -> DataFrame:
    """Regions of a file that repeat an earlier place of it: `width`-line runs whose first place is at least `width`
    before, consecutive pairs merged, of at least `least` lines: (path, origin, start, n_lines), in meaningful lines."""
    w = windows(lines, width)
    pairs = w.withColumn("origin", F.min("k").over(W.partitionBy("path", "hash"))).where(F.col("k") - F.col("origin") >= width)
    # Consecutive pairs keep k - origin; islands of k within it.
    shift = F.col("k") - F.col("origin")
    island = pairs.withColumn("shift", shift).withColumn("g", F.col("k") - F.row_number().over(W.partitionBy("path", "shift").orderBy("k")))
    found = island.groupBy("path", "shift", "g").agg(F.min("origin").alias("origin"), F.min("k").alias("start"), (F.count("*") + width - 1).alias("n_lines"))
    return found.where(F.col("n_lines") >= least).select("path", "origin", "start", "n_lines")
