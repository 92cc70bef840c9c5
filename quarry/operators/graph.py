"""Graphs of edges (src, dst): degrees, tags, strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours."""
    e = edges.distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def _reach(spark: SparkSession, edges: DataFrame, color: DataFrame, a: str, b: str) -> DataFrame:
    """For each node the least node that reaches it over edges (a to b), itself included; labels pass only between nodes of equal color.

    A node also takes its label's label, so that labels jump along paths; it goes on until none moves, which ends as labels only fall."""
    inner = edges.join(color.select(F.col("node").alias(a), F.col("color").alias("ca")), a).join(color.select(F.col("node").alias(b), F.col("color").alias("cb")), b).where("ca = cb")
    inner = materialize(spark, inner.select(F.col(a).alias("x"), F.col(b).alias("y")), "reach-edges")
    now = materialize(spark, color.select("node", F.col("node").alias("low")), "reach")
    while True:
        step = inner.join(now.select(F.col("node").alias("x"), F.col("low").alias("l")), "x").select(F.col("y").alias("node"), "l").groupBy("node").agg(F.min("l").alias("l"))
        jump = now.select(F.col("node").alias("low"), F.col("low").alias("far"))
        least = F.least("low", "l", "far")
        new = materialize(spark, now.join(step, "node", "left").join(jump, "low").select("node", least.alias("low"), (least < F.col("low")).alias("moved")), "reach")
        now = new.select("node", "low")
        if new.where("moved").isEmpty():
            return now


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles: strongly connected components of two nodes or more, and nodes with a loop.
    component is the component's least node.

    Nodes without edges in and out are trimmed first. Then each round labels nodes by the least node that reaches them;
    those that also reach that node form its component and leave, and the rest goes on within equal labels.
    """
    # Inside, names start with 16 digits of their hash: in that order labels jump, where in the order of a path they would walk.
    hashed = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.col(c).cast("string")).alias(c)
    plain = F.substring("node", 17, 2**31 - 1).alias("node")
    e = materialize(spark, edges.select(hashed("src"), hashed("dst")).distinct(), "graph")
    loops = e.where("src = dst").select(F.col("src").alias("node")).select(plain)
    live = e.where("src <> dst")
    while True:  # trim
        n = live.count()
        live = materialize(spark, live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trim")
        if live.count() == n:
            break
    color = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().withColumn("color", F.lit(""))
    done: list[DataFrame] = []
    while not color.isEmpty():  # the least node of each color leaves in each round
        ahead = _reach(spark, live, color, "src", "dst").withColumnRenamed("low", "color")
        back = _reach(spark, live, ahead, "dst", "src")
        both = materialize(spark, ahead.join(back, "node"), "scc")
        # A node that its label reaches and that reaches its label is in the label's component.
        done.append(both.where("color = low").select("node", F.col("color").cast("string").alias("component")))
        color = materialize(spark, both.where("color <> low").select("node", "color"), "colors")
    out = done[0] if done else spark.createDataFrame([], "node string, component string")
    for d in done[1:]:
        out = out.union(d)
    out = out.select(plain, "component")
    sizes = out.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    named = out.join(sizes, "component").where("n >= 2").select("node", F.col("least").alias("component"))
    return named.union(loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))
