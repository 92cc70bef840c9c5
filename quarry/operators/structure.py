"""Ownership, sharing, drift and score operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths


def shared_targets(writes: DataFrame) -> DataFrame:
    """(target, n_writers, n_roots) with two writers from two roots or more. Writers are made distinct first."""
    w = writes.groupBy("target", "writer").agg(F.min("root").alias("root"))
    return w.groupBy("target").agg(F.count("*").alias("n_writers"), F.countDistinct("root").alias("n_roots")).where("n_writers >= 2 AND n_roots >= 2")


def match_globs(rows: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """rows with a row for each domain whose pattern their path matches. Patterns are few: a filter of literals, no join."""
    hits = [F.when(F.col("path").rlike(paths.glob_regex(g)), F.lit(d)) for d, g in globs]
    return rows.withColumn("domain", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))))


def churn_points(churn: Column) -> Column:
    return F.least(F.lit(25), F.floor(F.log1p(churn) * 4))


def mode_for(score: Column) -> Column:
    return F.when(score >= 90, "do_not_touch").when(score >= 60, "forensic_first").when(score >= 30, "caution").otherwise("safe")


def field_drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys with drift: field_added, field_removed or same."""
    a, b = before.withColumn("in_a", F.lit(True)), after.withColumn("in_b", F.lit(True))
    kind = F.when(F.col("in_a").isNull(), "field_added").when(F.col("in_b").isNull(), "field_removed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("drift"))


def near_names(names: DataFrame, least: int = 6, share: float = 0.3) -> DataFrame:
    """(name, other, distance) of names alike but for `share` of the longer one's letters, plurals left out. names are
    the distinct public names of a code base; only names whose lengths differ by two at most are paired.

    With at most k edits one of k + 1 pieces of the shorter name stands in the longer one, moved by k places at most: names
    meet by such a piece and the longer one's length, not all names of a length."""
    n = names.where(F.length("name") >= least).withColumn("len", F.length("name"))
    k = F.floor((F.col("len") + 2) * share).cast("int")
    cut = lambda i: F.floor(F.col("len") * i / (k + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((cut(i) + 1).alias("at"), F.substring("name", cut(i) + 1, cut(i + 1) - cut(i)).alias("g")))
    a = n.select("name", "len", k.alias("k"), F.explode(pieces).alias("p")).select("name", "k", "p.at", "p.g", F.explode(F.sequence("len", F.col("len") + 2)).alias("l"))
    size = F.array(*[F.lit(i) for i in range(1, 6)])
    grams = F.flatten(F.transform(size, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.col("len") - w + 1, F.lit(1))), lambda i: F.struct(i.alias("pos"), F.substring("name", i, w).alias("g")))))
    b = n.select(F.col("name").alias("other"), F.col("len").alias("l"), F.explode(F.array_distinct(grams)).alias("q")).select("other", "l", "q.pos", "q.g")
    met = a.join(b, ["g", "l"]).where((F.abs(F.col("at") - F.col("pos")) <= F.col("k")) & (F.col("name") != F.col("other")))
    pairs = met.select(F.least("name", "other").alias("name"), F.greatest("name", "other").alias("other")).distinct().withColumn("distance", F.levenshtein("name", "other"))
    close = F.col("distance") <= share * F.greatest(F.length("name"), F.length("other"))
    return pairs.where(close & (F.concat("name", F.lit("s")) != F.col("other")) & (F.concat("other", F.lit("s")) != F.col("name"))).select("name", "other", "distance")
