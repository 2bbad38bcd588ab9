"""Evaluation of predicted scenes: per-scene metrics, macro averages, confusion, intervals, scene scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import ontology as o
from ..functions import stats
from . import match
from .lineage import cut

SCENE = "scene_id"


def scene_boxes(**sides: tuple[DataFrame, str]) -> DataFrame:
    """scene_id and an array of boxes (id, label, x0, y0, x1, y1, row, col) for each named side, a table and its id column.

    Label, row and column are null where a table has none.

    One exchange on the scene brings all sides together; what follows stays inside a row.
    """
    parts = []
    for name, (df, ident) in sides.items():
        held = lambda c, kind, df=df: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        place = [held("row", "int"), held("col", "int")]
        parts.append(df.select(SCENE, F.lit(name).alias("side"), F.struct(F.col(ident).cast("long").alias("id"), held("label", "string"), *[F.col(c).cast("double").alias(c) for c in g.BOX], *place).alias("box")))
    both = functools.reduce(DataFrame.unionByName, parts)
    return both.groupBy(SCENE).agg(*[F.collect_list(F.when(F.col("side") == name, F.col("box"))).alias(name) for name in sides])


def _corners(box: Column) -> tuple[Column, ...]:
    return tuple(box[c] for c in g.BOX)


def matched_boxes(gts: Column, preds: Column, threshold: float = match.MATCH_IOU) -> Column:
    """Array of (s, p, q, gt, pred): the greedy matching of two arrays of boxes, with its IoU, ids and boxes."""
    near = lambda a: preds if threshold <= 0 else F.filter(preds, lambda b: ~g.apart(_corners(a), _corners(b)))
    pairs = F.flatten(F.transform(gts, lambda a: F.transform(near(a), lambda b: F.struct(g.iou(_corners(a), _corners(b)).alias("s"), a["id"].alias("p"), b["id"].alias("q"), a.alias("gt"), b.alias("pred")))))
    return match.greedy_fold(F.filter(pairs, lambda x: x["s"] >= threshold))


#: What the table of samples shows of each.
SAMPLE_METRICS = ("n_pred", "n_gt", "matched", "label_correct", "recall", "row_acc", "col_acc", "mean_iou", "wall_ms")


def label_pairs(gt: DataFrame, pred: DataFrame, threshold: float = match.MATCH_IOU) -> DataFrame:
    """Matched boxes with both labels: scene_id, gt_id, pred_id, iou, gt_label, pred_label."""
    pairs = scene_boxes(gts=(gt, "gt_id"), preds=(pred, "pred_id"))
    pairs = match.exploded(pairs, SCENE, matched_boxes(F.col("gts"), F.col("preds"), threshold), "m")
    return pairs.select(SCENE, F.col("m.p").alias("gt_id"), F.col("m.q").alias("pred_id"), F.col("m.s").alias("iou"), F.col("m.gt.label").alias("gt_label"), F.col("m.pred.label").alias("pred_label"))


def _cuts(values: Column, share: float = 0.10) -> Column:
    """Of an array of numbers, those that begin a new cluster: the step from the next smaller one is over a share of the range."""
    split = lambda v, wide: F.filter(v, lambda x, i: (i > 0) & (x - F.coalesce(F.get(v, i - 1), x) > wide))
    return stats.let(F.sort_array(values), lambda v: stats.let((F.array_max(v) - F.array_min(v)) * share, lambda wide: split(v, wide)))


def _cluster(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def sample_metrics(scenes: DataFrame, gt: DataFrame, pred: DataFrame, dets: DataFrame) -> DataFrame:
    """One row for each scene, empty scenes too.

    scenes: scene_id, equation_kind, scene_case, has_symbols, pred_kind, ood_reason, wall_ms. gt: gt_id, label and box; pred:
    pred_id, label and box; dets: det_id, box, row, col. Without symbols all spatial metrics are null; with symbols
    but no predictions recall is 0 and rows and columns are null; a scene with an empty list of symbols has null recall.
    """
    boxes = scene_boxes(gts=(gt, "gt_id"), preds=(pred, "pred_id"), dets=(dets, "det_id"))
    cx, cy = lambda b: g.center_x(_corners(b)), lambda b: g.center_y(_corners(b))
    # A lambda works out again, for each element, what it takes from outside; so that comes in worked out once, by let.
    scene = F.struct(
        _cuts(F.transform("gts", cy)).alias("rows"), _cuts(F.transform("gts", cx)).alias("cols"),
        F.transform("dets", lambda d: F.struct(cx(d).alias("x"), cy(d).alias("y"), d["id"].alias("id"), d["row"].alias("row"), d["col"].alias("col"))).alias("dets"),
    )

    def judged(s: Column, m: Column) -> Column:
        d2 = lambda d, at: (d["x"] - at["x"]) * (d["x"] - at["x"]) + (d["y"] - at["y"]) * (d["y"] - at["y"])
        places = lambda at: F.transform(s["dets"], lambda d: F.struct(d2(d, at).alias("d2"), d["id"].alias("id"), d["row"].alias("row"), d["col"].alias("col")))
        near = F.array_min(stats.let(F.struct(cx(m["pred"]).alias("x"), cy(m["pred"]).alias("y")), places))
        return F.struct(
            m["s"].alias("iou"), (m["gt"]["label"] == m["pred"]["label"]).alias("same"), near.alias("near"),
            stats.let(cy(m["gt"]), lambda y: _cluster(s["rows"], y)).alias("row"), stats.let(cx(m["gt"]), lambda x: _cluster(s["cols"], x)).alias("col"),
        )

    matched = matched_boxes(F.col("gts"), F.col("preds"))
    boxes = boxes.select(
        SCENE, F.size("gts").cast("long").alias("__g"), F.size("preds").cast("long").alias("__p"), stats.let(scene, lambda s: F.transform(matched, lambda m: judged(s, m))).alias("m"),
    )
    n = F.size("m")
    count = lambda holds: F.size(F.filter("m", holds))
    placed = count(lambda x: x["near"].isNotNull())
    share = lambda c: F.when(placed > 0, count(lambda x: x["near"][c] == x[c]) / placed)
    hits = boxes.select(
        SCENE, "__g", "__p", F.when(n > 0, n).cast("long").alias("matched"), F.when(n > 0, count(lambda x: x["same"])).cast("long").alias("label_correct"),
        share("row").alias("row_acc"), share("col").alias("col_acc"), F.when(n > 0, F.aggregate("m", F.lit(0.0), lambda a, x: a + x["iou"]) / n).alias("mean_iou"),
    )
    df = scenes.join(hits, SCENE, "left").withColumn("__g", F.when(F.col("__g") > 0, F.col("__g")))
    has = F.col("has_symbols")
    n_gt = F.when(has, F.coalesce("__g", F.lit(0).cast("long")))
    triggered = (F.coalesce("pred_kind", F.lit("")) == "unknown") & F.coalesce(F.col("ood_reason") != "", F.lit(False))
    zero = lambda c: F.when(has, F.coalesce(c, F.lit(0).cast("long")))
    return df.select(
        SCENE, "equation_kind", "scene_case",
        F.coalesce(o.long_kind(F.coalesce("pred_kind", F.lit(""))) == F.col("equation_kind"), F.lit(False)).alias("kind_ok"),
        triggered.alias("ood_triggered"), (triggered & F.col("equation_kind").isin(*o.TRAINED_KINDS, "bare_digits")).alias("ood_honest"),
        F.coalesce("__p", F.lit(0).cast("long")).alias("n_pred"), n_gt.alias("n_gt"), zero("matched").alias("matched"), zero("label_correct").alias("label_correct"),
        F.when(n_gt > 0, F.coalesce("matched", F.lit(0)) / n_gt).alias("recall"),
        F.when(has, F.col("row_acc")).alias("row_acc"), F.when(has, F.col("col_acc")).alias("col_acc"), F.when(has, F.col("mean_iou")).alias("mean_iou"), "wall_ms",
    )


def _macro() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return [
        F.count(F.lit(1)).alias("n_samples"), share("kind_ok").alias("kind_acc"), share("ood_triggered").alias("ood_rate"), share("ood_honest").alias("ood_honest_rate"),
        F.avg(F.when(F.col("matched") > 0, F.col("label_correct") / F.col("matched"))).alias("label_acc"),
        F.avg("recall").alias("recall"), F.avg("row_acc").alias("row_acc"), F.avg("col_acc").alias("col_acc"), F.count("row_acc").alias("n_spatial"), F.sum("wall_ms").alias("total_wall_ms"),
    ]


def aggregate_metrics(samples: DataFrame) -> DataFrame:
    """One row: macro means over scenes that have a value."""
    return samples.agg(*_macro())


def metrics_by(samples: DataFrame) -> DataFrame:
    """Macro means by kind, by case and overall in one pass; scenes without a case are left out of the cases."""
    kind, case = F.col("equation_kind"), F.col("scene_case")
    df = samples.groupingSets([[kind], [case], []], kind, case).agg(F.grouping_id().alias("g"), *_macro())
    grouping = F.when(F.col("g") == 1, "equation_kind").when(F.col("g") == 2, "scene_case").otherwise("all")
    key = F.when(F.col("g") == 1, kind).when(F.col("g") == 2, case).otherwise("")
    return df.select(grouping.alias("grouping"), key.alias("key"), *[c for c in df.columns if c not in ("g", "equation_kind", "scene_case")]).where("key is not null")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gt_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def label_recall(conf: DataFrame, top: int = 3) -> DataFrame:
    """Recall of each label with its most frequent confusions, worst recall first in ``rank``."""
    wrong = F.when(F.col("gt_label") != F.col("pred_label"), F.struct((-F.col("n")).alias("less"), "pred_label", "n"))
    per = conf.groupBy("gt_label").agg(F.sum(F.when(F.col("gt_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("correct"), F.sum("n").alias("total"), F.sort_array(F.collect_list(wrong)).alias("wrong"))
    listed = F.array_join(F.transform(F.slice("wrong", 1, top), lambda x: F.concat_ws(":", x["pred_label"], x["n"])), " ")
    out = per.select("gt_label", "correct", "total", (F.col("correct") / F.col("total")).alias("recall"), listed.alias("confused_with"))
    return out.withColumn("rank", F.row_number().over(W.orderBy("recall", "gt_label")))


def intervals(aggregate: DataFrame, metrics: tuple = ("kind_acc", "row_acc", "col_acc")) -> DataFrame:
    """Wilson intervals from half-even rounded counts; n is the number of all samples for every metric."""
    long = aggregate.select("n_samples", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "value")).where("value is not null")
    lo, hi = stats.wilson(F.bround(F.col("value") * F.col("n_samples"), 0), F.col("n_samples"))
    return long.select("metric", "value", F.col("n_samples").alias("n_all"), lo.alias("lo"), hi.alias("hi"))


def scene_scores(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Strict token F1, row and column accuracy and exact match of each scene; a matched wrong label is a false positive."""
    out = match.match_outcomes(gt, pred)
    ok, kind = F.col("is_correct"), F.col("outcome")
    n = lambda c: F.sum(c.cast("long"))
    sums = out.groupBy(SCENE).agg(
        n(ok).alias("tp"), n((kind == "false_positive") | ((kind == "matched") & ~ok)).alias("fp"), n(kind == "missed").alias("fn"), n(kind == "matched").alias("n_matched"),
        n(F.coalesce(F.col("gt_row") == F.col("pred_row"), F.lit(False))).alias("row_ok"), n(F.coalesce(F.col("gt_col") == F.col("pred_col"), F.lit(False))).alias("col_ok"), n(F.col("gt_id").isNotNull()).alias("n_total"),
    )
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = part(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.select(
        SCENE, f1.alias("token_f1"), part(F.col("row_ok"), F.col("n_matched")).alias("row_accuracy"), part(F.col("col_ok"), F.col("n_matched")).alias("col_accuracy"),
        ((F.col("tp") == F.col("n_total")) & (F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact_match"), F.col("tp").alias("n_correct"), "n_total",
    )


def aligned_metrics(pred: DataFrame, gt: DataFrame, kinds: DataFrame) -> DataFrame:
    """Scores of scenes compared place by place (columns ord, label, row, col); all 0 where the lengths differ."""
    a = pred.select(SCENE, "ord", *[F.col(c).alias(f"p_{c}") for c in ("label", "row", "col")])
    b = gt.select(SCENE, "ord", "label", "row", "col")
    both = a.join(b, [SCENE, "ord"], "full_outer")
    same = {c: F.coalesce(F.col(f"p_{c}") == F.col(c), F.lit(False)) for c in ("label", "row", "col")}
    sums = both.groupBy(SCENE).agg(F.count("p_label").alias("n"), F.count("label").alias("m"), *[F.avg(v.cast("double")).alias(f"{k}_acc") for k, v in same.items()], F.bool_and(same["label"] & same["row"] & same["col"]).alias("same"))
    fits = F.col("n") == F.col("m")
    zero = lambda c: F.when(fits, c).otherwise(0.0)
    return sums.join(kinds, SCENE).select(
        SCENE, *[zero(F.col(f"{k}_acc")).alias(f"{k}_acc") for k in same],
        zero((F.col("pred_kind") == F.col("equation_kind")).cast("double")).alias("kind_acc"), zero(F.col("same").cast("double")).alias("exact"),
    )


def macro_f1(conf: DataFrame, labels: list[str]) -> DataFrame:
    """Accuracy and macro F1 over a fixed list of labels; a label without any row counts as 0."""
    spark = conf.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    tp = F.sum(F.when(F.col("gt_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    of = lambda c, n: conf.groupBy(F.col(c).alias("label")).agg(tp.alias(f"tp_{n}"), F.sum("n").alias(n))
    per = names.join(of("gt_label", "real"), "label", "left").join(of("pred_label", "said"), "label", "left").na.fill(0)
    f1 = F.when(F.col("real") + F.col("said") > 0, 2 * F.col("tp_real") / (F.col("real") + F.col("said"))).otherwise(0.0)
    scores = per.agg(F.avg(f1).alias("macro_f1"), (F.sum("tp_real") / F.sum("real")).alias("accuracy"))
    return scores


def ordinal_metrics(nodes: DataFrame, scenes: DataFrame) -> DataFrame:
    """Accuracy of ordinals over nodes, of kinds over scenes (masked kinds left out), and of whole scenes."""
    same = lambda c: F.col(f"p_{c}") == F.col(c)
    per = nodes.groupBy(SCENE).agg(
        F.sum(same("ord").cast("long")).alias("ord_ok"), F.count(F.lit(1)).alias("n"), F.bool_and(same("label") & same("row")).alias("exact"),
    )
    out = scenes.join(per, SCENE, "left")
    kind = F.when(F.col("kind_class") >= 0, (F.col("p_kind_class") == F.col("kind_class")).cast("double"))
    return out.agg((F.sum("ord_ok") / F.sum("n")).alias("ordinal_acc"), F.avg(kind).alias("kind_acc"), F.avg(F.col("exact").cast("double")).alias("exact_scene"))


def compared(current: DataFrame, baseline: DataFrame, metrics: tuple = ("kind_acc", "label_acc", "recall", "row_acc", "col_acc")) -> DataFrame:
    """metric, current, baseline, delta."""
    tall = lambda df, n: df.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", n))
    return tall(current, "current").join(tall(baseline, "baseline"), "metric").withColumn("delta", F.col("current") - F.col("baseline"))


def by_metric(aggregate: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A report table: one row for each metric."""
    names = [c for c in aggregate.columns if c not in keys]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return aggregate.select(*keys, F.explode(F.create_map(*pairs)).alias("metric", "value"))


def report(scenes: DataFrame, gt: DataFrame, pred: DataFrame, dets: DataFrame) -> DataFrame:
    """section, key, metric, value: means overall (aggregate), per_kind and per_case, recall per_label and per_sample.

    The samples are worked out once (a checkpoint).
    """
    samples = cut(sample_metrics(scenes, gt, pred, dets))
    section = F.create_map(*[F.lit(x) for x in ("all", "aggregate", "equation_kind", "per_kind", "scene_case", "per_case")])[F.col("grouping")]
    groups = by_metric(metrics_by(samples).withColumn("section", section).drop("grouping"), ["section", "key"]).where("value is not null")
    labels = label_recall(confusion(label_pairs(gt, pred))).select(F.lit("per_label").alias("section"), F.col("gt_label").alias("key"), F.lit("recall").alias("metric"), F.col("recall").alias("value"))
    each = samples.where("recall is not null").select(F.lit("per_sample").alias("section"), F.col(SCENE).cast("string").alias("key"), F.lit("recall").alias("metric"), F.col("recall").alias("value"))
    return groups.unionByName(labels).unionByName(each)


def report_tables(scenes: DataFrame, gt: DataFrame, pred: DataFrame, dets: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a report, each with key, metric and value: aggregate, per_kind, per_case, per_label, per_sample.

    The samples are worked out once (a checkpoint) and serve four of them. Metrics without a value have no row.
    """
    samples = cut(sample_metrics(scenes, gt, pred, dets))
    groups = by_metric(metrics_by(samples), ["grouping", "key"]).where("value is not null")
    pick = lambda name: groups.where(F.col("grouping") == name).drop("grouping")
    labels = by_metric(label_recall(confusion(label_pairs(gt, pred))).select(F.col("gt_label").alias("key"), "correct", "total", "recall"), ["key"])
    each = by_metric(samples.select(F.col(SCENE).alias("key"), *SAMPLE_METRICS), ["key"]).where("value is not null")
    return {"aggregate": pick("all"), "per_kind": pick("equation_kind"), "per_case": pick("scene_case"), "per_label": labels, "per_sample": each}
