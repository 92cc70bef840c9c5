"""Session helpers: shipping the package to Python workers and a shared scratch table."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per context, without relying on their PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="quarry-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._quarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may do without it; it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_quarry_scratch", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
            spark.sparkContext._quarry_scratch = base
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which goes when the driver's JVM ends."""
    home = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_quarry_home", None) != home:
        path, fs = _hadoop(spark, home)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.sparkContext._quarry_home = home
    return f"{home}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and no executor owns the rows. `by` is a
    string column of few values, none null, each of which gets a folder of its own."""
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if by:
        out = out.select(df.columns)
    out._quarry_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_quarry_path", None):
            path, fs = _hadoop(spark, t._quarry_path)
            fs.delete(path, True)
