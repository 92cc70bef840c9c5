"""Connected components of an edge table, by contraction.

In each round every vertex goes to the neighbour of least hash (or stays, if its own is least), and edges are carried
over to where their ends went; the vertices left fall by a constant share a round, on chains and hubs alike. Each
round is written to the shared folder. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import discard, materialize


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of every end of edges (a, b); ids of a component, and no others, share a label. Loops and repeated
    edges don't matter; edges with a null end are ignored. No edges: no rows."""
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    now = materialize(spark, ends.distinct(), "edges")
    labels = first = None
    for _ in range(rounds):
        if labels is not None and now.isEmpty():
            return labels
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b"))).alias("m"))
        own = F.xxhash64("a")
        moves = materialize(spark, best.select(F.col("a").alias("id"), F.when(F.col("m.h") < own, F.col("m.b")).otherwise(F.col("a")).alias("to")), "moves")
        if labels is None:
            first = moves
            labels = moves.withColumnRenamed("to", "label")
        else:
            step = moves.select(F.col("id").alias("label"), "to")
            old = labels
            labels = materialize(spark, labels.join(step, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
            discard(spark, old)
        at, bt = moves.select(F.col("id").alias("a"), F.col("to").alias("ta")), moves.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = now.join(at, "a").join(bt, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        last, now = now, materialize(spark, moved, "edges")
        discard(spark, last, moves if first is not moves else None)
    if not now.isEmpty():
        raise RuntimeError("components did not settle")
    return labels
