"""Rows and columns: one-dimensional gap clusters, ordinals, structure and the Rand index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import ontology as o
from ..functions import stats


def _split(df: DataFrame, value: str, order: list, wide: Column, name: str, keys: list[str]) -> DataFrame:
    """Number runs of sorted values: a new run where the step to the value before is wide."""
    w = W.partitionBy(*keys).orderBy(F.col(value), *order)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("__new", F.coalesce((step > wide).cast("int"), F.lit(0))).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__new")


def gap_cluster(df: DataFrame, value: str, name: str, share: float = 0.10, order: list = (), keys: tuple = ("scene_id",)) -> DataFrame:
    """Cluster numbers from 0 along a value: split where a gap is over a share of the value's range in the scene."""
    whole = W.partitionBy(*keys)
    df = df.withColumn("__wide", (F.max(value).over(whole) - F.min(value).over(whole)) * share)
    return _split(df, value, list(order), F.col("__wide"), name, list(keys)).drop("__wide")


def size_cluster(df: DataFrame, value: str, size: str, name: str, factor: float = 0.5, order: list = (), keys: tuple = ("scene_id",)) -> DataFrame:
    """Cluster numbers from 0 along a value: split where a gap is over a share of the scene's (upper) median size."""
    df = df.withColumn("__wide", stats.upper_median(F.collect_list(size).over(W.partitionBy(*keys))) * factor)
    return _split(df, value, list(order), F.col("__wide"), name, list(keys)).drop("__wide")


def rows_and_columns(dets: DataFrame, scene: str = "scene_id") -> DataFrame:
    """row_cluster over all boxes; col_cluster over boxes that are no bars or brackets, which take the nearest box's column."""
    b = g.box()
    df = dets.withColumns({"__cx": g.center_x(b), "__cy": g.center_y(b), "__w": b[2] - b[0], "__h": b[3] - b[1]})
    df = size_cluster(df, "__cy", "__h", "row_cluster", order=["det_id"], keys=(scene,))
    structure = F.col("label").isin("result_bar", "div_bracket")
    alone = ~F.max(~structure).over(W.partitionBy(scene))  # nothing but structure: it is clustered like other boxes
    df = df.withColumn("__follows", structure & ~alone)
    df = size_cluster(df.where("__follows is not null"), "__cx", "__w", "col_cluster", order=["det_id"], keys=(scene, "__follows"))
    others = F.collect_list(F.when(~F.col("__follows"), F.struct("det_id", "__cx", "col_cluster"))).over(W.partitionBy(scene))
    near = F.array_min(F.transform("__others", lambda o: F.struct(F.abs(F.col("__cx") - o["__cx"]).alias("d"), o["det_id"].alias("id"), o["col_cluster"].alias("c"))))
    df = df.withColumn("__others", others).withColumn("col_cluster", F.when(F.col("__follows"), near["c"]).otherwise(F.col("col_cluster")))
    return df.drop("__cx", "__cy", "__w", "__h", "__follows", "__others")


def ordinals(df: DataFrame, most: int = 7, scene: str = "scene_id", order: str = "det_id") -> DataFrame:
    """Place within the row (by column) and within the column (by row), at most 7; ties in node order."""
    place = lambda key, by: F.least(F.row_number().over(W.partitionBy(scene, key).orderBy(by, order)) - 1, F.lit(most))
    return df.withColumns({"within_row_ord": place("row", "col"), "within_col_ord": place("col", "row")})


def islands(df: DataFrame, keys: list[str], x: str = "x", name: str = "island") -> DataFrame:
    """Number runs of consecutive x within the keys; equal islands share the number x - rank."""
    w = W.partitionBy(*keys).orderBy(x)
    return df.withColumn(name, (F.col(x) - F.dense_rank().over(w)).cast("int"))


def row_conflicts(preds: DataFrame, scene: str = "scene_id") -> DataFrame:
    """spatial_conflict: the box's row has a median centre above the row before or below the row after it; never for bars and brackets."""
    structure = F.col("label").isin("result_bar", "div_bracket")
    m = F.median(F.when(~structure, g.center_y(g.box()))).over(W.partitionBy(scene, "row"))
    beyond = lambda order: F.last("__m", ignorenulls=True).over(W.partitionBy(scene).orderBy(order).rangeBetween(W.unboundedPreceding, -1))
    df = preds.withColumn("__m", m)
    df = df.withColumns({"__above": beyond(F.asc("row")), "__below": beyond(F.desc("row"))})
    bad = (F.col("__above") > F.col("__m")) | (F.col("__below") < F.col("__m"))
    known = F.col(scene).isNotNull() & F.col("row").isNotNull()
    return df.withColumn("spatial_conflict", F.coalesce(bad & known, F.lit(False)) & ~structure).drop("__m", "__above", "__below")


def carry_conflicts(preds: DataFrame, scene: str = "scene_id") -> DataFrame:
    """carry_conflict: a carry or borrow without main digit in its column, or with its top above all of them."""
    kind = o.role(F.col("label"))
    top = F.min(F.when(kind == "main", F.col("y0"))).over(W.partitionBy(scene, "col"))
    return preds.withColumn("carry_conflict", kind.isin("carry", "borrow") & (top.isNull() | (F.col("y0") < top)))


def renumbered(preds: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Rows numbered densely from 0 and places within them from 0; grid_col keeps the column."""
    w = W.partitionBy(scene)
    df = preds.withColumn("out_row", F.dense_rank().over(w.orderBy("row")) - 1)
    return df.withColumn("out_col", F.row_number().over(W.partitionBy(scene, "row").orderBy("col", "det_id")) - 1).withColumnRenamed("col", "grid_col")


def nested_rows(df: DataFrame, scene: str = "scene_id") -> DataFrame:
    """One row for each scene: rows as an array of (row, tokens)."""
    tokens = F.sort_array(F.collect_list(F.struct("out_col", "label", "det_id")))
    rows = df.groupBy(scene, "out_row").agg(tokens.alias("tokens"))
    return rows.groupBy(scene).agg(F.sort_array(F.collect_list(F.struct(F.col("out_row").alias("row"), "tokens"))).alias("rows"))


def right_slots(tokens: DataFrame, keys: list[str], order: str = "token_id") -> DataFrame:
    """Slot from the right end of each row: max x - x; of several tokens in a slot the last one stays."""
    w = W.partitionBy(*keys)
    df = tokens.withColumn("slot", F.max("x").over(w) - F.col("x"))
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "slot").orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def rand_index(df: DataFrame, a: str, b: str, scene: str = "scene_id") -> DataFrame:
    """Adjusted Rand index of two groupings in each scene, not below 0; 0 under two items, 1 for equal trivial groupings."""
    n = F.count(F.lit(1))
    cells = df.groupBy(scene, a, b).agg(n.alias("k"))
    both = cells.groupBy(scene).agg(F.sum(stats.choose2(F.col("k"))).alias("index"), F.sum("k").alias("n"))
    left = cells.groupBy(scene, a).agg(F.sum("k").alias("k")).groupBy(scene).agg(F.sum(stats.choose2(F.col("k"))).alias("pa"))
    right = cells.groupBy(scene, b).agg(F.sum("k").alias("k")).groupBy(scene).agg(F.sum(stats.choose2(F.col("k"))).alias("pb"))
    df = both.join(left, scene).join(right, scene)
    expected = F.col("pa") * F.col("pb") / F.nullif(stats.choose2(F.col("n")), F.lit(0.0))
    most = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(F.col("n") < 2, 0.0).when(most == expected, 1.0).otherwise(F.greatest(F.lit(0.0), (F.col("index") - expected) / (most - expected)))
    return df.select(scene, F.col("n").alias("n_items"), ari.alias("ari"))


def gate(preds: DataFrame, scenes: DataFrame, scene: str = "scene_id") -> DataFrame:
    """route (ood, bare_digits or valid) and ood_reason of each scene, from counts of digits, structure and marks."""
    return routed(scenes.select(scene).join(preds.groupBy(scene).agg(*gate_counts()), scene, "left"), scene)


def gate_counts() -> list[Column]:
    """What a scene is routed by, as aggregates over its boxes: n, digits, structural, marks."""
    kind = o.role(F.col("label"))
    n = lambda c: F.sum(c.cast("int"))
    marks = F.col("label").isin("result_bar", "div_bracket")
    return [F.count(F.lit(1)).alias("n"), n(kind.isin("main", "carry", "borrow")).alias("digits"), n(kind.isin("operator", "structure") | marks).alias("structural"), n(marks).alias("marks")]


def routed(df: DataFrame, scene: str = "scene_id", *keep) -> DataFrame:
    """scene_id, route, ood_reason and what else is to be kept, from the counts of the gate; a scene without counts has no boxes."""
    n, digits, structural, marks = (F.coalesce(c, F.lit(0)) for c in ("n", "digits", "structural", "marks"))
    route = F.when(n == 0, "ood").when(n == 1, "bare_digits").when((digits == 0) & (marks > 0), "bare_digits").when(digits == 0, "ood").when(structural == 0, "bare_digits").otherwise("valid")
    reason = F.when(n == 0, "true_empty").when((n > 1) & (digits == 0) & (marks == 0), "no_digits")
    return df.select(scene, route.alias("route"), reason.alias("ood_reason"), *keep)


def gathered(df: DataFrame, token: Column, *aggregates: Column, scene: str = "scene_id") -> DataFrame:
    """One row for each scene: its tokens nested by out_row as an array of (row, tokens), and aggregates over its boxes."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("out_row").alias("row"), token.alias("t"))))
    one = df.groupBy(scene).agg(listed.alias("rows"), *aggregates)
    of_row = lambda r: F.transform(F.filter("rows", lambda x: x["row"] == r), lambda x: x["t"])
    nested = F.transform(F.array_distinct(F.transform("rows", lambda x: x["row"])), lambda r: F.struct(r.alias("row"), of_row(r).alias("tokens")))
    return one.withColumn("rows", nested)


def implied_kind(preds: DataFrame, least_bracket: float = 0.3, scene: str = "scene_id") -> DataFrame:
    """Operator counts and the kind that the tokens imply, for information only: null without a signal."""
    df = preds.groupBy(scene).agg(*operator_counts())
    return df.withColumn("implied", implied(least_bracket))


def operator_counts() -> list[Column]:
    """Operators of a scene by label and the confidence of its best bracket, as aggregates over its boxes."""
    n = lambda x: F.sum((F.col("label") == x).cast("int"))
    bracket = F.coalesce(F.max(F.when(F.col("label") == "div_bracket", F.col("confidence"))), F.lit(0.0))
    return [*[n(x).alias(x) for x in ("op_plus", "op_minus", "op_times", "op_divide")], bracket.alias("bracket_conf")]


def implied(least_bracket: float = 0.3) -> Column:
    divides = (F.col("bracket_conf") > least_bracket) | (F.col("op_divide") > 0)
    plus, minus = F.col("op_plus"), F.col("op_minus")
    return (F.when(divides, "divide").when(F.col("op_times") > 0, "multiply").when(minus > plus, "subtract").when(plus > minus, "add"))


def typeset(tokens: DataFrame, scene: str = "scene_id") -> DataFrame:
    """The scene as text: symbols of a row by column, joined by a blank; rows joined by ' / '."""
    rows = tokens.groupBy(scene, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "det_id", "glyph"))), lambda x: x["glyph"]), " ").alias("text"))
    return rows.groupBy(scene).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " / ").alias("text"))
