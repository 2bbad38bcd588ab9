"""Connected components and priority rounds over edges inside scenes, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(edges: DataFrame, scene: str, a: str = "a", b: str = "b") -> DataFrame:
    """(scene, id, root) of every end of an edge; the root is the component's smallest id.

    Rounds of two steps: every node hands the least id it knows to its larger neighbours, then to its smaller ones and
    itself, until all edges are stars. The number of rounds grows with the logarithm of a component's size. Edges with a
    null end are none; loops and repeated edges do no harm.
    """
    e = cut(edges.select(scene, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct())
    while True:
        both = e.unionByName(e.select(scene, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(scene, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        grown = both.where("v > u").join(least, [scene, "u"]).select(scene, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = grown.groupBy(scene, "u").agg(F.min("v").alias("m"))
        told = grown.join(least, [scene, "u"]).select(scene, F.col("v").alias("u"), "m").unionByName(least)
        e = cut(told.where("u <> m").select(scene, "u", F.col("m").alias("v")).distinct())
        inner = e.join(e.select(scene, F.col("v").alias("u")), [scene, "u"], "left_semi")
        if inner.isEmpty() and e.groupBy(scene, "u").count().where("count > 1").isEmpty():
            return e.select(scene, F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(scene, F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def first_takers(edges: DataFrame, scene: str) -> DataFrame:
    """Of the ends of edges (scene, high, low) those that a greedy pass from high to low keeps: (scene, id).

    A node stays when no open node above it is joined to it, and takes out all below it that are. Rounds go on over what is
    still open, so nothing is gathered; they are as many as the longest chain of decisions.
    """
    open_ = cut(edges.select(scene, "high", "low").distinct())
    kept = None
    ends = lambda e, c: e.select(scene, F.col(c).alias("id")).distinct()
    left = cut(ends(open_, "high").unionByName(ends(open_, "low")).distinct())
    while not left.isEmpty():
        stay = cut(left.join(ends(open_, "low"), [scene, "id"], "left_anti"))
        kept = stay if kept is None else cut(kept.unionByName(stay))
        gone = open_.join(stay.withColumnRenamed("id", "high"), [scene, "high"], "left_semi").select(scene, F.col("low").alias("id")).distinct()
        left = cut(left.join(stay.unionByName(gone), [scene, "id"], "left_anti"))
        still = lambda c: left.withColumnRenamed("id", c)  # noqa: B023, E731
        open_ = cut(open_.join(still("high"), [scene, "high"], "left_semi").join(still("low"), [scene, "low"], "left_semi"))
    return left if kept is None else kept
