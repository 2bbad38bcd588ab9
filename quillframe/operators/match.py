"""Matching boxes within scenes: theta joins, greedy one-to-one matching, suppression, assignment."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import tiles
from .components import components, first_takers
from .lineage import cut

#: Scenes with more boxes on a side are paired over tiles and folded by components.
SCENE_BOXES = 2_000
MATCH_IOU = 0.35
OUTCOME_IOU = 0.40
NMS_IOU = 0.3
MAX_NODES = 80
#: Cost matrices of up to so many cells are solved in plain lists.
FEW_PAIRS = 1_000
#: Scenes of up to so many boxes are merged in one row.
MERGED_BOXES = 200
MOST_SOURCES = 100


def _sided(df: DataFrame, side: str, scene: str = "scene_id") -> DataFrame:
    """Columns of one side of a join: all but the scene get a prefix."""
    return df.select(scene, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != scene])


def exploded(df: DataFrame, scene: str, items: Column, name: str) -> DataFrame:
    """One row (scene, item) for each item of an array.

    With an inner explode Spark infers a filter on the array's size, for which it works out the array once more.
    """
    return df.select(scene, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def crowded(scene: str, most: int, *tables: DataFrame) -> DataFrame:
    """The scenes with more than ``most`` rows in one of the tables."""
    found = [t.groupBy(scene).count().where(F.col("count") > most).select(scene) for t in tables]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def iou_pairs(left: DataFrame, right: DataFrame, threshold: float = MATCH_IOU, left_id: str = "gt_id", right_id: str = "pred_id", scene: str = "scene_id", scene_boxes: int = SCENE_BOXES) -> DataFrame:
    """All pairs of one scene with IoU >= threshold: scene, both ids, iou.

    Scenes of up to ``scene_boxes`` boxes on each side are paired whole, with one shuffle on the scene; larger ones over
    tiles, where candidates are near the result and a scene spreads over many tasks. Pairs without common area come back
    only for a threshold of 0 or less, which pairs all scenes whole.
    """

    def whole(a, b):
        both = _sided(a, "a", scene).join(_sided(b, "b", scene), scene)
        return both.withColumn("iou", g.iou(g.box("a_"), g.box("b_"))).where(F.col("iou") >= threshold)

    picked = [scene, F.col(f"a_{left_id}").alias(left_id), F.col(f"b_{right_id}").alias(right_id), "iou"]
    large = crowded(scene, scene_boxes, left, right)
    if threshold <= 0 or large.isEmpty():
        return whole(left, right).select(*picked)
    large = cut(large)
    few, many = ([t.join(large, scene, how) for t in (left, right)] for how in ("left_anti", "left_semi"))
    return whole(*few).select(*picked).unionByName(tiled_iou_pairs(*many, threshold, scene).select(*picked))


def tiled_iou_pairs(left: DataFrame, right: DataFrame, threshold: float, scene: str = "scene_id") -> DataFrame:
    """The same over tiles; a pair of this IoU has sides at most 1 / threshold apart, which bounds the levels between them."""
    meets = lambda a, b: g.iou(a, b) >= threshold
    reach = max(1, int(np.ceil(np.log2(1 / threshold))) + 1)
    return tiles.pairs(left, right, scene, meets, reach=reach).withColumn("iou", g.iou(g.box("a_"), g.box("b_")))


def greedy_match(pairs: DataFrame, left_id: str = "gt_id", right_id: str = "pred_id", score: str = "iou", larger_first: tuple[str, str] | None = None, scene: str = "scene_id") -> DataFrame:
    """One-to-one matching by falling score; equal scores prefer the larger id of ``larger_first`` in turn.

    A scene's pairs (a few thousand at most) are folded inside one row; a scene needs no more than one shuffle.
    """
    first, second = larger_first or (left_id, right_id)
    listed = F.collect_list(F.struct(F.col(score).alias("s"), F.col(first).alias("p"), F.col(second).alias("q")))
    out = exploded(pairs.groupBy(scene).agg(listed.alias("ps")), scene, greedy_fold(F.col("ps")), "m")
    return out.select(scene, F.col("m.p").alias(first), F.col("m.q").alias(second), F.col("m.s").alias(score))


def greedy_fold(pairs: Column) -> Column:
    """Of an array of structs (s, p, q, ...) those taken by falling s, p, q, so that no p and no q is taken twice."""

    def step(got, x):
        taken = F.exists(got, lambda y: (y["p"] == x["p"]) | (y["q"] == x["q"]))
        return F.when(taken, got).otherwise(F.array_append(got, x))

    return F.aggregate(F.sort_array(pairs, asc=False), F.slice(pairs, 1, 0), step)


def match_outcomes(gt: DataFrame, pred: DataFrame, threshold: float = OUTCOME_IOU, scene: str = "scene_id") -> DataFrame:
    """Every ground-truth and predicted box once: matched, missed or false_positive, with is_correct."""
    matched = greedy_match(iou_pairs(gt, pred, threshold, scene=scene), larger_first=("pred_id", "gt_id"), scene=scene)
    a = gt.select(scene, "gt_id", F.col("label").alias("gt_label"), *[F.col(c).alias(f"gt_{c}") for c in ("row", "col") if c in gt.columns])
    b = pred.select(scene, "pred_id", F.col("label").alias("pred_label"), *[F.col(c).alias(f"pred_{c}") for c in ("row", "col") if c in pred.columns])
    out = a.join(matched, [scene, "gt_id"], "left").join(b, [scene, "pred_id"], "full_outer")
    outcome = F.when(F.col("gt_id").isNull(), "false_positive").when(F.col("pred_id").isNull(), "missed").otherwise("matched")
    return out.withColumn("outcome", outcome).withColumn("is_correct", F.coalesce(F.col("gt_label") == F.col("pred_label"), F.lit(False))).withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def nearest(queries: DataFrame, targets: DataFrame, query_id: str, target_id: str, scene: str = "scene_id") -> DataFrame:
    """For each query box the target box of its scene with the nearest centre; the smallest id wins ties."""
    both = _sided(queries, "a", scene).join(_sided(targets, "b", scene), scene)
    a, b = g.box("a_"), g.box("b_")
    dx, dy = g.center_x(b) - g.center_x(a), g.center_y(b) - g.center_y(a)
    best = F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col(f"b_{target_id}").alias("id")))
    return both.groupBy(scene, F.col(f"a_{query_id}").alias(query_id)).agg(best.alias("m")).select(scene, query_id, F.col("m.id").alias(target_id), F.col("m.d2").alias("d2"))


def suppress(dets: DataFrame, first_source: str, threshold: float = NMS_IOU, use_ioa: bool = True, scene: str = "scene_id", scene_boxes: int = SCENE_BOXES) -> DataFrame:
    """Greedy suppression over two sources: one source first, falling confidence within a source, then rising id.

    A box goes where its IoU (or intersection over the smaller area) with a kept box is over the threshold. Ids are unique in
    a scene. A scene of up to ``scene_boxes`` boxes is folded in one row. A larger one is split into the connected
    components of its overlaps, found over tiles: boxes that overlap none stay, a component of up to ``scene_boxes`` boxes is
    folded by itself, and a larger one is decided in rounds over its overlaps, without being gathered.
    """
    named = dets.where(F.col(scene).isNotNull())
    large = crowded(scene, scene_boxes, named)
    if large.isEmpty():
        return _kept(named, first_source, threshold, use_ioa, [scene])
    large = cut(large)
    few, many = (named.join(large, scene, how) for how in ("left_anti", "left_semi"))
    whole = _kept(few, first_source, threshold, use_ioa, [scene])
    kept = _kept_by_component(many, first_source, threshold, use_ioa, scene, scene_boxes)
    return whole.unionByName(many.join(kept, [scene, "det_id"], "left_semi"))


def _turn(first_source: str) -> list[Column]:
    return [(F.col("source") != first_source).cast("int").alias("l"), (-F.col("confidence")).alias("c"), F.col("det_id")]


def _hides(threshold: float, use_ioa: bool):
    def meets(a, b):
        over = g.iou(a, b) > threshold
        over = over | (g.ioa(a, b) > threshold) if use_ioa else over
        return ~g.apart(a, b) & over if threshold >= 0 else over

    return meets


def _kept(dets: DataFrame, first_source: str, threshold: float, use_ioa: bool, keys: list[str]) -> DataFrame:
    """The rows of the boxes that stay, each group of the keys folded in one row."""
    order = F.sort_array(F.collect_list(F.struct(*_turn(first_source), *[F.col(c).cast("double").alias(c) for c in g.BOX], F.struct(*dets.columns).alias("row"))))
    meets = _hides(threshold, use_ioa)

    def step(kept, d):
        here = tuple(d[c] for c in g.BOX)
        return F.when(F.exists(kept, lambda k: meets(here, tuple(k[c] for c in g.BOX))), kept).otherwise(F.array_append(kept, d))

    grouped = dets.groupBy(*keys).agg(order.alias("ds"))
    kept = exploded(grouped, keys[0], F.transform(F.aggregate("ds", F.slice("ds", 1, 0), step), lambda k: k["row"]), "row")
    return kept.where("row.det_id is not null").select(*[keys[0] if c == keys[0] else F.col(f"row.{c}") for c in dets.columns])


def _kept_by_component(dets: DataFrame, first_source: str, threshold: float, use_ioa: bool, scene: str, fold: int) -> DataFrame:
    rows = cut(dets.select(scene, "source", "confidence", "det_id", *g.BOX))
    wide = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    # of boxes with the same corners only the first can hide others, and it hides the rest or goes with them
    firsts = rows.where(wide).groupBy(scene, *g.BOX).agg(F.min(F.struct(*_turn(first_source))).alias("turn"))
    boxes = cut(firsts.select(scene, "turn", F.col("turn.det_id").alias("id"), *g.BOX))
    over = tiles.pairs(boxes, None, scene, _hides(threshold, use_ioa))
    above = F.col("a_turn") < F.col("b_turn")
    edges = cut(over.select(scene, F.when(above, F.col("a_id")).otherwise(F.col("b_id")).alias("high"), F.when(above, F.col("b_id")).otherwise(F.col("a_id")).alias("low")))
    roots = cut(components(edges, scene, "high", "low"))
    alone = boxes.join(roots, [scene, "id"], "left_anti").select(scene, F.col("id").alias("det_id"))
    flat = rows.where(~F.coalesce(wide, F.lit(False))).select(scene, "det_id")
    huge = cut(roots.groupBy(scene, "root").count().where(F.col("count") > fold).select(scene, "root"))
    joined = rows.join(roots.withColumnRenamed("id", "det_id"), [scene, "det_id"])
    kept = _kept(joined.join(huge, [scene, "root"], "left_anti"), first_source, threshold, use_ioa, [scene, "root"]).select(scene, "det_id")
    out = kept.unionByName(alone).unionByName(flat)
    if not huge.isEmpty():
        within = edges.join(roots.join(huge, [scene, "root"], "left_semi").select(scene, F.col("id").alias("low")), [scene, "low"], "left_semi")
        out = out.unionByName(first_takers(within, scene).select(scene, F.col("id").alias("det_id")))
    return out


def provenance(kept: DataFrame, sources: list[str] | None = None, scene: str = "scene_id") -> DataFrame:
    """How many boxes each source keeps in a scene, a column for each.

    Without ``sources`` the columns are those that occur, in order (a few at most: they come to the driver). With them,
    boxes of other sources, or of none, count in a column ``other``, which is there only when such a box is.
    """
    if sources is None:
        sources = sorted(r[0] for r in kept.select("source").distinct().where("source is not null").limit(MOST_SOURCES + 1).collect())
        if len(sources) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources: name those that are wanted")
    known = F.coalesce(F.col("source").isin(*sources), F.lit(False))
    columns = [F.count(F.when(F.col("source") == s, 1)).alias(s) for s in sources]
    # the counts are written before they are asked for other sources, so that the boxes are worked out once
    counts = cut(kept.groupBy(scene).agg(*columns, F.count(F.when(~known, 1)).alias("other")))
    return counts.drop("other") if counts.where("other > 0").isEmpty() else counts


def gated(dets: DataFrame, first_source: str, min_boxes: int = 6, min_confidence: float = 0.6, scene: str = "scene_id") -> DataFrame:
    """Drop the second source where the first one has enough confident boxes."""
    w = W.partitionBy(scene)
    own = F.when(F.col("source") == first_source, F.col("confidence"))
    enough = (F.count(own).over(w) >= min_boxes) & (F.avg(own).over(w) >= min_confidence)
    return dets.withColumn("__skip", F.coalesce(enough, F.lit(False))).where(~F.col("__skip") | (F.col("source") == first_source)).drop("__skip")


def truncated(dets: DataFrame, most: int = MAX_NODES, scene: str = "scene_id") -> DataFrame:
    """The most confident boxes of each scene and whether some were left out."""
    w = W.partitionBy(scene)
    ranked = dets.withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "det_id"))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    return ranked.where(F.col("rank") <= most)


def capped_given(given: DataFrame, child_counts: DataFrame, most: int = MAX_NODES, scene: str = "scene_id") -> DataFrame:
    """Given boxes that fit beside the child's boxes, operators first, then in order."""
    rank = F.row_number().over(W.partitionBy(scene).orderBy(F.desc(F.col("label").startswith("op_").cast("int")), "given_id"))
    both = given.join(child_counts, scene, "left").withColumn("__r", rank)
    return both.where(F.col("__r") <= F.greatest(F.lit(0), F.lit(most) - F.coalesce("n_child", F.lit(0)))).drop("__r", "n_child")


def merge_given(dets: DataFrame, cells: DataFrame, scene: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Each detection, in order, takes the first free given cell that holds its centre; a cell takes one detection.

    Returns (scene, det_id, cell_id) and the detections without a cell.
    """
    both = _sided(dets, "a", scene).join(_sided(cells, "b", scene), scene)
    a, b = g.box("a_"), g.box("b_")
    cx, cy = g.center_x(a), g.center_y(a)
    inside = both.where((cx >= b[0]) & (cx <= b[2]) & (cy >= b[1]) & (cy <= b[3]))
    order = F.sort_array(F.collect_list(F.struct(F.col("a_det_id").alias("d"), F.col("b_cell_id").alias("c"))))
    kinds = dict(inside.dtypes)
    pair = f"struct<d:{kinds['a_det_id']},c:{kinds['b_cell_id']}>"
    none = F.array().cast(f"array<{pair}>")

    def step(got, x):
        taken = F.exists(got, lambda y: (y["d"] == x["d"]) | (y["c"] == x["c"]))
        return F.when(taken, got).otherwise(F.array_append(got, x))

    took = exploded(inside.groupBy(scene).agg(order.alias("o")), scene, F.aggregate("o", none, step), "m")
    took = took.select(scene, F.col("m.d").alias("det_id"), F.col("m.c").alias("cell_id"))
    return took, dets.join(took, [scene, "det_id"], "left_anti")


def pin_labels(preds: DataFrame, known: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Given boxes whose rounded corners are known take the known label; all others stay."""
    keys = [F.bround(F.col(c), 0).alias(f"__{c}") for c in g.BOX]
    table = known.select(scene, *keys, F.col("label").alias("__label")).dropDuplicates([scene, *[f"__{c}" for c in g.BOX]])
    joined = preds.select("*", *keys).join(table, [scene, *[f"__{c}" for c in g.BOX]], "left")
    return joined.withColumn("label", F.when(F.col("given"), F.coalesce("__label", "label")).otherwise(F.col("label"))).drop("__label", *[f"__{c}" for c in g.BOX])


def best_bar(preds: DataFrame, scene: str = "scene_id") -> DataFrame:
    """One result bar for each row: the most confident, the first among equals. Other boxes stay."""
    rank = F.row_number().over(W.partitionBy(scene, "row", "label").orderBy(F.desc("confidence"), "det_id"))
    return preds.withColumn("__r", rank).where((F.col("label") != "result_bar") | (F.col("__r") == 1)).drop("__r")


def distinct_operators(preds: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Operators of one row and label whose x-spans meet (touching counts) thin out to the most confident.

    In order of det_id, each operator that is still there compares itself with all later ones that meet it: a less or equally
    confident one goes, a more confident one takes over (and has its own turn later). A taken-over operator goes.
    """
    order = F.sort_array(F.collect_list(F.struct("det_id", *g.BOX, F.col("confidence").alias("c"), F.struct(*preds.columns).alias("whole"))))
    groups = preds.where(F.col("label").isNotNull()).groupBy(scene, "row", "label").agg(order.alias("o"))
    item = lambda i: F.get("o", i)
    span = lambda d: tuple(d[c] for c in g.BOX)

    def turn(acc, i):
        def later(inner, j):
            meets = ~F.array_contains(inner["gone"], j) & g.spans_overlap(span(item(i)), span(item(j)))
            wins = item(j)["c"] > item(inner["best"])["c"]
            took = F.struct(j.alias("best"), F.array_append(inner["gone"], inner["best"]).alias("gone"))
            lost = F.struct(inner["best"].alias("best"), F.array_append(inner["gone"], j).alias("gone"))
            return F.when(meets & wins, took).when(meets, lost).otherwise(inner)

        rest = F.filter(F.sequence(F.lit(0), F.size("o") - 1), lambda j: j > i)
        done = F.aggregate(rest, F.struct(i.alias("best"), acc["gone"].alias("gone")), later)
        after = F.struct(done["gone"].alias("gone"), F.array_append(acc["kept"], done["best"]).alias("kept"))
        return F.when(F.array_contains(acc["gone"], i), acc).otherwise(after)

    none = F.array().cast("array<int>")
    kept = F.aggregate(F.sequence(F.lit(0), F.size("o") - 1), F.struct(none.alias("gone"), none.alias("kept")), turn)["kept"]
    several = F.col("label").startswith("op_") & (F.size("o") > 1)
    rest = F.when(several, F.transform(F.array_distinct(kept), item)).otherwise(F.col("o"))
    out = groups.select(scene, "label", F.explode_outer(rest).alias("d")).where("d is not null")
    named = F.col(scene).isNotNull() & F.col("d.det_id").isNotNull()
    return out.where(named | ~F.col("label").startswith("op_")).select(*[c if c in (scene, "label") else F.col(f"d.whole.{c}") for c in preds.columns])


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the least total cost (shortest augmenting paths with potentials)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        low, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            seen[j] = True
            row = owner[j]
            slack = np.append(np.inf, c[row - 1] - u[row] - v[1:])
            nearer = ~seen & (slack < low)
            low[nearer], back[nearer] = slack[nearer], j
            j2 = int(np.where(seen, np.inf, low).argmin())
            step = low[j2]
            u[owner[seen]] += step
            v[seen] -= step
            low[~seen] -= step
            j = j2
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def _assign_few(c: list[list[float]]) -> list[tuple[int, int]]:
    """The same pairs, in plain lists: of a few boxes the arrays would take longer to make than to search."""
    flip = len(c) > len(c[0])
    if flip:
        c = [list(r) for r in zip(*c, strict=True)]
    n, m = len(c), len(c[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        low, back, seen = [np.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            seen[j] = True
            row, j2 = owner[j], -1
            for k in range(1, m + 1):
                if not seen[k]:
                    slack = c[row - 1][k - 1] - u[row] - v[k]
                    if slack < low[k]:
                        low[k], back[k] = slack, j
                    if j2 < 0 or low[k] < low[j2]:
                        j2 = k
            step = low[j2]
            for k in range(m + 1):
                if seen[k]:
                    u[owner[k]] += step
                    v[k] -= step
                else:
                    low[k] -= step
            j = j2
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def _by_scene(gathered: DataFrame, solve, schema: str) -> DataFrame:
    """solve(*row) of each row, a scene with its arrays, gives rows of the schema; rows come in Arrow batches of many scenes."""
    kinds = {"long": pa.int64(), "double": pa.float64()}
    fields = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])

    def run(batches):
        for batch in batches:
            rows = [r for scene in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in solve(*scene)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return gathered.mapInArrow(run, schema)


def assign(targets: DataFrame, dets: DataFrame, furthest: float = 96.0, scene: str = "scene_id") -> DataFrame:
    """Assignment of detections to targets with the least total centre distance; pairs beyond ``furthest`` are cut after.

    Returns scene, det_id, target_id (null for a detection of its own) and distance. One scene at a time, as far as its
    cost matrix goes: a scene has up to a few hundred boxes. Rows of a null scene, of a null id or without four coordinates
    take no part; a detection among them that has scene and id comes back without a target.
    """
    wanted = [scene, "target_id", *g.BOX], [scene, "det_id", *g.BOX]
    placed = " and ".join(f"{c} is not null and not isnan({c})" for c in g.BOX)
    a_rows, b_rows = (t.select(*c).where(f"`{scene}` is not null and `{c[1]}` is not null") for t, c in zip((targets, dets), wanted, strict=True))

    def solve(key, a, xa, ya, b, xb, yb):
        got: dict = {}
        if a and b:
            cost = np.hypot(np.subtract.outer(xa, xb), np.subtract.outer(ya, yb))
            few = len(a) * len(b) <= FEW_PAIRS and bool(np.isfinite(cost).all())
            got = {j: (a[i], float(cost[i, j])) for i, j in (_assign_few(cost.tolist()) if few else _assign(cost)) if cost[i, j] <= furthest}
        return [(key, b[j], *got.get(j, (None, None))) for j in range(len(b))]

    def side(df, name, ident):
        centre = F.struct(F.col(ident).cast("long").alias("id"), ((F.col("x0") + F.col("x1")) / 2).cast("double").alias("x"), ((F.col("y0") + F.col("y1")) / 2).cast("double").alias("y"))
        return df.where(placed).select(F.col(scene).cast("long").alias(scene), F.lit(name).alias("side"), centre.alias("c"))

    both = side(a_rows, "a", "target_id").unionByName(side(b_rows, "b", "det_id"))
    gathered = both.groupBy(scene).agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == n, F.col("c")))).alias(n) for n in "ab"])
    arrays = gathered.select(scene, *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in ("id", "x", "y")])
    solved = _by_scene(arrays, solve, f"{scene} long, det_id long, target_id long, distance double")
    nowhere = b_rows.where(f"not ({placed})").select(F.col(scene).cast("long"), F.col("det_id").cast("long"), F.lit(None).cast("long").alias("target_id"), F.lit(None).cast("double").alias("distance"))
    return solved.unionByName(nowhere)


def merge_boxes(boxes: DataFrame, gap: float = 14.0, scene: str = "scene_id", scene_boxes: int = MERGED_BOXES) -> DataFrame:
    """Join boxes of a scene that lie within a gap until nothing changes; the boxes of what is left.

    The result does not depend on the order. Scenes of up to ``scene_boxes`` boxes are joined in one row each. In larger ones
    each round joins at once: pairs within the gap, found over tiles, hand on the least of their digests, and the boxes of one digest become their hull. Digests stand in no order in space, so a chain
    shrinks by a share in each round and the rounds grow with the logarithm of its length. Boxes without four finite
    coordinates in order are left out, and so are those of a null scene; equal boxes are one.
    """
    rows = tiles.solid(boxes.where(F.col(scene).isNotNull()).select(scene, *[F.col(c).cast("double") for c in g.BOX]), g.box())

    def whole(few):
        gathered = few.groupBy(scene).agg(F.collect_list(F.struct(*g.BOX)).alias("b"))
        return gathered.select(scene, F.explode_outer(_joined_up(F.col("b"), gap)).alias("b")).select("b.*", scene)

    large = crowded(scene, scene_boxes, rows)
    if large.isEmpty():
        return whole(rows)
    large = cut(large)
    return whole(rows.join(large, scene, "left_anti")).unionByName(_merge_rounds(rows.join(large, scene, "left_semi"), gap, scene))


def _joined_up(boxes: Column, gap: float) -> Column:
    """An array of boxes joined to its fixpoint: each box in turn takes in what is near it, until nothing more is."""
    near = lambda a, b: (a["x0"] <= b["x1"] + gap) & (b["x0"] <= a["x1"] + gap) & (a["y0"] <= b["y1"] + gap) & (b["y0"] <= a["y1"] + gap)
    hull = lambda a, b: F.struct(*[f(a[c], b[c]).alias(c) for f, c in zip((F.least, F.least, F.greatest, F.greatest), g.BOX, strict=True)])

    def take_in(acc, _):
        met = F.filter(acc["left"], lambda o: near(o, acc["b"]))
        grown = F.struct(F.aggregate(met, acc["b"], hull).alias("b"), F.filter(acc["left"], lambda o: ~near(o, acc["b"])).alias("left"), (F.size(met) == 0).alias("done"))
        return F.when(acc["done"], acc).otherwise(grown)

    def add(left, b):
        start = F.struct(b.alias("b"), left.alias("left"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(0), F.size(left)), start, take_in, lambda acc: F.array_append(acc["left"], acc["b"]))

    return F.aggregate(F.array_distinct(boxes), F.slice(boxes, 1, 0), add)


def _merge_rounds(rows: DataFrame, gap: float, scene: str) -> DataFrame:
    corners = [F.col(c) for c in g.BOX]
    digest = F.struct(F.xxhash64(*corners), *corners)
    near = lambda a, b: (a[0] <= b[2] + gap) & (b[0] <= a[2] + gap) & (a[1] <= b[3] + gap) & (b[1] <= a[3] + gap)
    own = lambda side: [F.col(f"{side}_{c}") for c in ("p0", "q0", "p1", "q1")]
    now = cut(rows.distinct())
    while True:
        wider = now.select(
            scene, digest.alias("id"), *[c.alias(n) for c, n in zip(corners, ("p0", "q0", "p1", "q1"), strict=True)],
            (F.col("x0") - gap).alias("x0"), (F.col("y0") - gap).alias("y0"), (F.col("x1") + gap).alias("x1"), (F.col("y1") + gap).alias("y1"),
        )
        met = cut(tiles.pairs(wider, None, scene, lambda a, b: near(own("a"), own("b"))).select(scene, "a_id", "b_id"))
        if met.isEmpty():
            return now.select(*g.BOX, scene)
        told = met.unionByName(met.select(scene, F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))).groupBy(scene, F.col("a_id").alias("id")).agg(F.min("b_id").alias("least"))
        joined = now.withColumn("id", digest).join(told, [scene, "id"], "left")
        hull = joined.groupBy(scene, F.least(F.col("id"), F.col("least")).alias("to")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        now = cut(hull.select(scene, *g.BOX).distinct())


def merge_overlapping(boxes: DataFrame, overlap: float = 0.5, near: float = 0.1, scene: str = "scene_id") -> DataFrame:
    """Join boxes, in order of id, that overlap by more than a share of the smaller or lie nearer than a share of the diagonal."""

    def joins(a, b) -> bool:
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
        if w > 0 and h > 0 and small > 0 and w * h / small > overlap:
            return True
        d = math.hypot(max(0.0, -w), max(0.0, -h))
        diag = max(math.hypot(x[2] - x[0], x[3] - x[1]) for x in (a, b))
        return diag > 0 and d / diag < near

    def merge(key, *corners):
        todo = [tuple(np.nan if c is None else c for c in r) for r in zip(*corners, strict=True)]
        again = True
        while again:
            again = False
            for i, j in itertools.combinations(range(len(todo)), 2):
                if joins(todo[i], todo[j]):
                    a, b = todo[i], todo.pop(j)
                    todo[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    again = True
                    break
        return [(*b, key) for b in sorted(todo)]

    box = F.struct(F.col("box_id").isNull().alias("last"), "box_id", *[F.col(c).cast("double").alias(c) for c in g.BOX])
    gathered = boxes.groupBy(F.col(scene).cast("long").alias(scene)).agg(F.sort_array(F.collect_list(box)).alias("b")).select(scene, *[F.col(f"b.{c}").alias(c) for c in g.BOX])
    return _by_scene(gathered, merge, f"x0 double, y0 double, x1 double, y1 double, {scene} long")
