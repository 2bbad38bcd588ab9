"""A recognised scene from a table of detections: given boxes merged in, everything placed, checked and nested by rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import ontology as o
from ..functions.stats import let
from . import cluster, graph, match

SCENE = "scene_id"
UNKNOWN = "unknown"
#: Ids of boxes that stand for given cells begin here: they come after all detections.
GIVEN_IDS = 1 << 40
#: Flags for review: detections below LOW_CONFIDENCE are marked, those below FLOOR or further away than FURTHEST are flagged.
LOW_CONFIDENCE, FLOOR, FURTHEST = 0.5, 0.25, 48.0
OPERATORS = tuple(f"op_{x}" for x in o.OPERATORS)


def with_given_cells(dets: DataFrame, cells: DataFrame, most: int = match.MAX_NODES) -> DataFrame:
    """The detections, with given cells as boxes where nothing was drawn over them.

    dets: scene_id, det_id, label, confidence and box. cells: scene_id, cell_id, label and box. A detection whose centre lies
    in a free cell is given; cells that took none become boxes of confidence 1 (ids from GIVEN_IDS), as far as ``most``
    boxes a scene allow, operators first. Detections are never dropped. known_label: what a given box is known to be.
    """
    def side(df, name, ident, confidence):
        box = F.struct(F.col(ident).cast("long").alias("id"), "label", confidence.cast("double").alias("confidence"), *[F.col(c).cast("double").alias(c) for c in g.BOX])
        return df.select(SCENE, F.lit(name).alias("side"), box.alias("b"))

    both = side(dets, "dets", "det_id", F.col("confidence")).unionByName(side(cells, "cells", "cell_id", F.lit(1.0)))
    one = both.groupBy(SCENE).agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == n, F.col("b")))).alias(n) for n in ("dets", "cells")])
    shown = lambda b, ident, known, given: F.struct(ident.alias("det_id"), b["label"].alias("label"), b["confidence"].alias("confidence"), *[b[c].alias(c) for c in g.BOX], known.alias("known_label"), given.alias("given"))

    def step(acc, d):
        cx, cy = (g.center_x(tuple(d[c] for c in g.BOX)), g.center_y(tuple(d[c] for c in g.BOX)))
        holds = lambda c: d["id"].isNotNull() & (cx >= c["x0"]) & (cx <= c["x1"]) & (cy >= c["y0"]) & (cy <= c["y1"])

        def take(hit):
            free = F.when(hit.isNull(), acc["free"]).otherwise(F.filter(acc["free"], lambda c: ~c["id"].eqNullSafe(hit["id"])))
            return F.struct(free.alias("free"), F.array_append(acc["out"], shown(d, d["id"], hit["label"], hit.isNotNull())).alias("out"))

        return let(F.get(F.filter(acc["free"], holds), 0), take)

    none = F.array().cast(f"array<struct<det_id:bigint,label:string,confidence:double,{','.join(f'{c}:double' for c in g.BOX)},known_label:string,given:boolean>>")
    named = F.col(SCENE).isNotNull()
    start = F.struct(F.when(named, F.col("cells")).otherwise(F.slice("cells", 1, 0)).alias("free"), none.alias("out"))

    def with_free(acc):
        rank = lambda c: F.when(c["label"].isNull(), 2).when(c["label"].startswith("op_"), 0).otherwise(1)
        free = F.sort_array(F.transform(F.when(named, acc["free"]).otherwise(F.col("cells")), lambda c: F.struct(rank(c).alias("rank"), c["id"].alias("id"), c.alias("c"))))
        fits = F.slice(free, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size("dets")))
        return F.concat(acc["out"], F.transform(fits, lambda x: shown(x["c"], F.lit(GIVEN_IDS) + x["id"], x["c"]["label"], F.lit(True))))

    return match.exploded(one, SCENE, let(F.aggregate("dets", start, step), with_free), "b").select(SCENE, "b.*")


def with_pins(merged: DataFrame) -> DataFrame:
    """The boxes with ``pin``: what a given box is known to be, by the last (in order of id) given box of the same rounded corners."""
    keys = [F.bround(F.col(c), 0) for c in g.BOX]
    last = F.max_by("known_label", "det_id").over(W.partitionBy(SCENE, "given", *keys))
    placed = functools.reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    return merged.withColumn("pin", F.when(F.col("given") & placed, last))


def recognised(dets: DataFrame, scenes: DataFrame, first_source: str, cells: DataFrame | None = None) -> DataFrame:
    """One row for each scene: route, equation_kind, ood_reason, truncated, n_rows, n_given, n_conflicts, implied, rows.

    dets: two sources of boxes; scenes: scene_id, pred_kind and, if there are any, logits (an array, may be null). In order:
    the second source is gated, overlapping boxes are suppressed, given cells merged in, at most 80 boxes kept, rows and
    columns found, given boxes pinned to what is known of them, stray carries flagged, double operators and bars dropped,
    the scene routed by its shape, rows that cross flagged, and everything numbered and nested. The recognised kind is passed
    on as it is, whatever the operators imply; a valid scene whose logits are too even becomes 'unknown' with reason
    high_entropy and keeps its rows. A scene without digits, or without any box, is 'unknown' and has no rows. Scenes
    without logits are not judged by them. The boxes of a scene are brought together once; each step reads only the one
    before it, so that nothing is worked out twice and nothing is written between.
    """
    kept = match.suppress(match.gated(dets, first_source), first_source)
    if cells is not None:
        merged = with_pins(with_given_cells(kept, cells))
    else:
        none = F.lit(None).cast("string")
        merged = kept.select(SCENE, "det_id", "label", "confidence", *g.BOX, none.alias("known_label"), F.lit(False).alias("given"), none.alias("pin"))
    few = match.truncated(merged)
    placed = cluster.rows_and_columns(few.drop("rank", "known_label")).withColumnsRenamed({"row_cluster": "row", "col_cluster": "col"})
    pinned = placed.withColumn("label", F.when(F.col("given"), F.coalesce("pin", "label")).otherwise(F.col("label"))).drop("pin")
    clean = match.best_bar(match.distinct_operators(cluster.carry_conflicts(pinned)))
    numbered = cluster.renumbered(cluster.row_conflicts(clean))
    token = F.struct(
        F.col("out_col").alias("col"), "label", o.role(F.col("label")).alias("role"), "det_id", "grid_col", *g.BOX, "confidence", "spatial_conflict", "carry_conflict", "given",
    )
    n = lambda c: F.sum(c.cast("long"))
    counts = [n(F.col("given")).alias("n_given"), n(F.col("spatial_conflict")).alias("n_conflicts"), F.max("truncated").alias("truncated")]
    rows = cluster.gathered(numbered, token, *counts, *cluster.gate_counts(), *cluster.operator_counts())
    logits = F.col("logits") if "logits" in scenes.columns else F.lit(None).cast("array<double>")
    df = scenes.select(SCENE, "pred_kind", logits.alias("logits")).join(rows, SCENE, "left")
    df = cluster.routed(df, SCENE, "pred_kind", "logits", "rows", "n_given", "n_conflicts", "truncated", F.when(F.col("n").isNotNull(), cluster.implied()).alias("implied"))
    valid, ood = F.col("route") == "valid", F.col("route") == "ood"
    uneven = F.coalesce(graph.kind_entropy(F.col("logits"))[1], F.lit(False))
    kind = F.when(ood | (valid & uneven), UNKNOWN).when(valid, F.coalesce("pred_kind", F.lit(UNKNOWN))).otherwise("bare_digits")
    shown = F.when(~ood, F.col("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return df.select(
        SCENE, "route", kind.alias("equation_kind"), F.when(valid & uneven, "high_entropy").otherwise(F.col("ood_reason")).alias("ood_reason"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce(F.size(shown), F.lit(0)).alias("n_rows"), zero("n_given").alias("n_given"), zero("n_conflicts").alias("n_conflicts"), "implied",
        F.coalesce(shown, F.array().cast(dict(rows.dtypes)["rows"])).alias("rows"),
    )


def drawn_kinds(original: DataFrame, final: DataFrame, scenes: DataFrame) -> DataFrame:
    """scene_id, swapped, kind: the kind that the final tokens show, where an operator was swapped for another.

    original, final: scene_id and label; scenes: scene_id and kind. Swapped means as many operators as before, but not the
    same ones. Then a bracket or a division sign means divide, else times, minus and plus decide in this order. Scenes
    without a swap, and those of kind 'ood_unknown', keep their kind; a scene without tokens counts none.
    """
    n = lambda x: F.count(F.when(F.col("label") == x, 1))

    def counts(df, name):
        return df.groupBy(SCENE).agg(F.struct(*[n(x).alias(x) for x in OPERATORS]).alias(name), F.bool_or(F.coalesce(F.col("label") == "div_bracket", F.lit(False))).alias(f"{name}_bracket"))

    none = F.struct(*[F.lit(0).cast("long").alias(x) for x in OPERATORS])
    df = scenes.select(SCENE, "kind").join(counts(original, "a"), SCENE, "left").join(counts(final, "b"), SCENE, "left").withColumns({c: F.coalesce(c, none) for c in "ab"})
    total = lambda c: sum(F.col(f"{c}.{x}") for x in OPERATORS)
    swapped = (total("a") == total("b")) & (F.col("a") != F.col("b"))
    has = lambda x: F.col(f"b.{x}") > 0
    shown = F.when(F.coalesce("b_bracket", F.lit(False)) | has("op_divide"), "divide").when(has("op_times"), "multiply").when(has("op_minus"), "subtract").when(has("op_plus"), "add")
    kind = F.when(swapped & (F.coalesce("kind", F.lit("")) != "ood_unknown"), shown).otherwise(F.col("kind"))
    return df.select(SCENE, swapped.alias("swapped"), F.coalesce(kind, "kind").alias("kind"))


def review_flags(confidence: Column, distance: Column) -> tuple[Column, Column]:
    """low_conf, and flagged: further from its target than 48 pixels, or less than 0.25 confident. Nulls do not count."""
    known = lambda c: F.coalesce(c, F.lit(False))
    return known(confidence < LOW_CONFIDENCE), known(distance > FURTHEST) | known(confidence < FLOOR)


def arguments_allowed(template: Column, arguments: Column) -> Column:
    """Whether a template takes its arguments (texts): PRODUCT at most one with a decimal point, DIVISION none, others any."""
    decimals = F.size(F.filter(F.coalesce(arguments, F.array().cast("array<string>")), lambda a: F.contains(a, F.lit("."))))
    name = F.coalesce(template, F.lit(""))
    return F.when(name.startswith("PRODUCT"), decimals <= 1).when(name.startswith("DIVISION"), decimals == 0).otherwise(True)
