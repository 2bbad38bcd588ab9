"""Scene graphs as two tables: node features, dense ordered edges with features and types, scene summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import ontology as o
from ..functions import stats
from .cluster import size_cluster

SCENE = "scene_id"
# Weight of each coarse class among node features.
IMPORTANCE = {"digit_main": 0.5, "digit_carry": 0.3, "digit_borrow": 0.3, "operator": 1.0, "result_bar": 1.0, "divide_bracket": 1.0}
ANNOTATIONS = ("digit_carry", "digit_borrow")
DIGITS = ("digit_main", *ANNOTATIONS)
STRUCTURE = ("result_bar", "divide_bracket")


def node_features(dets: DataFrame, size: float = g.CANVAS) -> DataFrame:
    """features: 13 numbers (centre, size and area over the canvas, six class flags, confidence, class weight).

    dets has a coarse column. Sides count as at least one pixel; an unknown class counts as digit_main, weight 0.5.
    """
    b = g.box()
    w, h = F.greatest(b[2] - b[0], F.lit(1.0)), F.greatest(b[3] - b[1], F.lit(1.0))
    known = F.when(F.col("coarse").isin(*o.COARSE), F.col("coarse")).otherwise("digit_main")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])[F.col("coarse")], F.lit(0.5))
    flags = [(known == c).cast("double") for c in o.COARSE]
    parts = [g.center_x(b) / size, g.center_y(b) / size, w / size, h / size, w * h / (size * size), *flags, F.col("confidence").cast("double"), weight]
    return dets.withColumn("features", F.array(*parts))


def edge_type(a: Column, b: Column) -> Column:
    """0 to 7 for a pair of coarse classes, in either order; 7 for all other pairs and unknown classes."""
    is_in = lambda c, names: c.isin(*names)
    pair = lambda xs, ys: (is_in(a, xs) & is_in(b, ys)) | (is_in(b, xs) & is_in(a, ys))
    main = ("digit_main",)
    return (
        F.when(pair(main, main), 0).when(pair(main, ANNOTATIONS), 1).when(pair(ANNOTATIONS, ANNOTATIONS), 2).when(pair(DIGITS, ("operator",)), 3)
        .when(pair(DIGITS, ("result_bar",)), 4).when(pair(DIGITS, ("divide_bracket",)), 5).when(pair(("operator",), (*STRUCTURE, "operator")), 6).otherwise(7)
    )


def scene_medians(nodes: DataFrame) -> DataFrame:
    """Lower median of the normalised digit widths and heights; of all boxes where a scene has no main digit."""
    main = F.coalesce(F.col("coarse"), F.lit("")).isin("digit_main") | ~F.coalesce(F.col("coarse").isin(*o.COARSE), F.lit(False))
    out = []
    for i, name in ((2, "median_w"), (3, "median_h")):
        value = F.get("features", i)
        own = F.collect_list(F.when(main, value))
        out.append(stats.lower_median(F.when(F.size(own) > 0, own).otherwise(F.collect_list(value))).alias(name))
    return nodes.groupBy(SCENE).agg(*out)


def edges(nodes: DataFrame) -> DataFrame:
    """scene_id, src, dst, edge_type and 16 features for every ordered pair of different nodes of a scene.

    nodes: scene_id, det_id, coarse and features, at most 80 for each scene (cut before).
    """
    n = nodes.select(SCENE, "det_id", "coarse", "features").join(scene_medians(nodes), SCENE)
    a = n.select(SCENE, F.col("det_id").alias("src"), F.col("coarse").alias("ca"), F.col("features").alias("fa"), "median_w", "median_h")
    b = n.select(SCENE, F.col("det_id").alias("dst"), F.col("coarse").alias("cb"), F.col("features").alias("fb"))
    pairs = a.join(b, SCENE).where("src <> dst")
    fa, fb = (lambda i: F.get("fa", i)), (lambda i: F.get("fb", i))
    dx, dy = fb(0) - fa(0), fb(1) - fa(1)
    pairs = pairs.withColumns({"dx": dx, "dy": dy, "dist": F.sqrt(dx * dx + dy * dy + 1e-8)})
    dx, dy, dist = F.col("dx"), F.col("dy"), F.col("dist")
    flag = lambda c, names: F.coalesce(c.isin(*names), F.lit(False)).cast("double")
    known = lambda c: F.when(c.isin(*o.COARSE), c).otherwise("digit_main")
    ca, cb = F.col("ca"), F.col("cb")
    feats = [
        dx, dy, dist, fb(2) / (fa(2) + 1e-6), fb(3) / (fa(3) + 1e-6), dy / (dist + 1e-8), dx / (dist + 1e-8), dx / (F.col("median_w") + 1e-6), dy / (F.col("median_h") + 1e-6),
        fb(2) * fb(3) / (fa(2) * fa(3) + 1e-6), F.log(dist + 1e-8), flag(ca, ["operator"]), flag(cb, ["operator"]), flag(ca, STRUCTURE), flag(cb, STRUCTURE), (known(ca) == known(cb)).cast("double"),
    ]
    return pairs.select(SCENE, "src", "dst", edge_type(F.coalesce(ca, F.lit("")), F.coalesce(cb, F.lit(""))).alias("edge_type"), F.array(*feats).alias("features"))


def scene_summary(dets: DataFrame, most: int = 80) -> DataFrame:
    """Eight numbers for each scene: counts by class, estimated rows and the spread of aspect ratios, each over a fixed maximum."""
    b = g.box()
    w, h = F.greatest(F.abs(b[2] - b[0]), F.lit(1.0)), F.greatest(F.abs(b[3] - b[1]), F.lit(1.0))
    df = size_cluster(dets.withColumns({"__cy": g.center_y(b), "__h": h, "__r": w / h}), "__cy", "__h", "__row", order=["det_id"])
    n = lambda c: F.sum((F.coalesce(F.col("coarse"), F.lit("")) == c).cast("int"))
    parts = [F.count(F.lit(1)) / most, n("result_bar") / 3, n("divide_bracket") / 2, n("operator") / 4, n("digit_carry") / 8, n("digit_borrow") / 8, (F.max("__row") + 1) / 6, F.stddev_pop("__r") / 2]
    return df.groupBy(SCENE).agg(F.array(*[p.cast("double") for p in parts]).alias("summary"))


def jittered(boxes: DataFrame, amount: float, seed: int = 0, size: float = g.CANVAS, keys: tuple = (SCENE, "det_id")) -> DataFrame:
    """Boxes moved by at most ``amount`` pixels on each side, clamped to the canvas; sides that cross are swapped back.

    The uniform numbers are digests of the keys and the seed, so a rerun gives the same boxes.
    """
    moved = []
    for i, c in enumerate(g.BOX):
        u = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20)
        moved.append(F.least(F.lit(size), F.greatest(F.lit(0.0), F.col(c) + (u * 2 - 1) * amount)))
    x0, y0, x1, y1 = moved
    return boxes.withColumns({"x0": F.least(x0, x1), "y0": F.least(y0, y1), "x1": F.greatest(x0, x1), "y1": F.greatest(y0, y1)})


def kind_entropy(logits: Column, share: float = 0.85) -> tuple[Column, Column]:
    """Entropy of the softmax of an array of logits, and whether it is out of distribution (over share * ln n)."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(e, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total + 1e-12))
    return entropy, entropy > share * F.log(F.size(logits))
