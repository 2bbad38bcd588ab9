"""Pairs over tiles, components, suppression of crowded scenes and merging to a fixpoint, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.functions import geometry as g
from quillframe.operators import components as comp
from quillframe.operators import match, tiles

BOXES = "scene_id long, det_id long, x0 double, y0 double, x1 double, y1 double, confidence double, source string"


def some(rng, n, size, spread):
    out = []
    for i in range(n):
        x, y = rng.randint(-spread, spread), rng.randint(-spread, spread)
        w, h = (rng.choice([0, 1, 2, 8, 8, 16, 60, size]) for _ in range(2))
        out.append((i, float(x), float(y), float(x + w), float(y + h), rng.choice([0.25, 0.5, 0.75]), rng.choice("ab")))
    return out


def area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def shared(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a, b):
    u = area(a) + area(b) - shared(a, b)
    return shared(a, b) / u if u > 0 else 0.0


def hides(a, b):
    small = min(area(a), area(b))
    return iou(a, b) > 0.3 or small > 0 and shared(a, b) / small > 0.3


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[6] != "a", -r[5], r[0])):
        if not any(hides(r[1:5], k[1:5]) for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def table(spark, scenes):
    return spark.createDataFrame([(k, *r) for k, rows in scenes.items() for r in rows], BOXES)


@pytest.mark.parametrize("threshold", [0.05, 0.35, 0.9])
def test_tiles_give_each_pair_once(spark, threshold):
    rng = random.Random(3)
    left, right = ({k: some(rng, 60, 300, 150) for k in range(4)} for _ in range(2))
    want = sorted((k, a[0], b[0]) for k in left for a in left[k] for b in right[k] if iou(a[1:5], b[1:5]) >= threshold)
    dfs = table(spark, left).withColumnRenamed("det_id", "gt_id"), table(spark, right).withColumnRenamed("det_id", "pred_id")
    for most in (0, 59, 10_000):
        got = match.iou_pairs(*dfs, threshold, scene_boxes=most).collect()
        assert sorted((r.scene_id, r.gt_id, r.pred_id) for r in got) == want


def test_boxes_without_a_place_meet_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, 0.0, 0.0, 4.0, 4.0, 0.5, "a"), (1, 2, nan, 0.0, 4.0, 4.0, 0.5, "a"), (1, 3, 0.0, None, 4.0, 4.0, 0.5, "a"), (1, 4, 0.0, 0.0, inf, 4.0, 0.5, "a"), (1, 5, 4.0, 0.0, 0.0, 4.0, 0.5, "a"), (None, 6, 0.0, 0.0, 4.0, 4.0, 0.5, "a"), (1, 7, 1.0, 0.0, 4.0, 4.0, 0.5, "a")]
    df = spark.createDataFrame(rows, BOXES)
    assert [(r.a_det_id, r.b_det_id) for r in tiles.pairs(df, None, "scene_id", lambda a, b: g.iou(a, b) > 0, key="det_id").collect()] in ([(1, 7)], [(7, 1)])
    assert tiles.pairs(df.limit(0), df, "scene_id", lambda a, b: g.iou(a, b) > 0).count() == 0


def test_candidates_of_a_sparse_scene_stay_near_the_result(spark):
    """10,000 boxes on a large canvas: whole pairing looks at 10 ** 8 pairs."""
    rng = random.Random(9)
    rows = [(1, i, float(x := rng.randrange(20_000)), float(y := rng.randrange(20_000)), x + 20.0, y + 20.0, 0.5, "a") for i in range(10_000)]
    df = spark.createDataFrame(rows, BOXES)
    candidates = tiles.pairs(df, None, "scene_id", lambda a, b: F.lit(True), key="det_id").count()
    assert candidates < 40_000
    assert tiles.pairs(df, None, "scene_id", lambda a, b: g.iou(a, b) > 0, key="det_id").count() <= candidates


@pytest.mark.parametrize("most,fold", [(0, 10_000), (0, 0), (30, 5), (10_000, 10_000)])
def test_suppression_of_crowded_scenes_equals_the_greedy_pass(spark, monkeypatch, most, fold):
    rng = random.Random(most + fold)
    scenes = {k: some(rng, rng.choice([1, 20, 50]), 100, 60) for k in range(8)}
    scenes[99] = [(i, 0.0, 0.0, 8.0, 8.0, 0.5, "b") for i in range(40)]
    real = match._kept_by_component
    monkeypatch.setattr(match, "_kept_by_component", lambda *a: real(*a[:-1], fold))
    got = {}
    for r in match.suppress(table(spark, scenes), "a", scene_boxes=most).collect():
        got.setdefault(r.scene_id, set()).add(r.det_id)
    assert got == {k: greedy(rows) for k, rows in scenes.items()}


def test_a_sparse_scene_of_many_boxes_spreads_over_tasks(spark, monkeypatch):
    """One scene of 100,000 boxes, a twentieth of which overlap a neighbour: the fold's groups are small and in several tasks."""
    n = 100_000
    at = spark.range(n).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("det_id"), ((F.col("id") % 400) * 50).cast("double").alias("x0"), (F.floor(F.col("id") / 400) * 50).cast("double").alias("y0"))
    boxes = at.withColumns({"x0": F.when(F.col("det_id") % 20 == 1, F.col("x0") - 45).otherwise(F.col("x0"))})
    df = boxes.select("scene_id", "det_id", "x0", "y0", (F.col("x0") + 20).alias("x1"), (F.col("y0") + 20).alias("y1"), F.lit(0.5).alias("confidence"), F.lit("a").alias("source"))
    real, folded = match._kept, []
    monkeypatch.setattr(match, "_kept", lambda d, *a: folded.append(real(d, *a)) or folded[-1])
    kept = match.suppress(df, "a")
    assert kept.count() == n - n // 20
    assert kept.where("det_id % 20 = 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r[1] for r in folded[-1].groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 1 and max(parts) < 0.6 * sum(parts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    edges = [(1, i, i + 1) for i in range(1500)] + [(2, 0, i) for i in range(1, 300)] + [(3, i, (i + 1) % 40) for i in range(40)] + [(4, 5, 5), (4, None, 2), (4, 7, 6), (4, 7, 6)]
    order = list(range(900))
    rng.shuffle(order)
    edges += [(5, a, b) for a, b in zip(order[:-1], order[1:], strict=True) if a % 10]
    got = {}
    for r in comp.components(spark.createDataFrame(edges, "s long, a long, b long"), "s").collect():
        got[r.s, r.id] = r.root
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root((s, a)), root((s, b))
            up[max(x, y)] = min(x, y)
    assert got == {k: root(k)[1] for k in up}


def test_merging_ends_on_a_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = tiles.pairs
    monkeypatch.setattr(tiles, "pairs", lambda *a, **k: rounds.append(1) or real(*a, **k))
    chain = spark.range(1500).select(F.lit(1).cast("long").alias("scene_id"), (F.col("id") * 20).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 20 + 10).cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    out = match.merge_boxes(chain.unionByName(chain.limit(10)))
    assert [tuple(r) for r in out.collect()] == [(0.0, 0.0, 1499 * 20.0 + 10, 10.0, 1)]
    assert len(rounds) <= 16
    assert "Python" not in match.merge_boxes(chain.limit(3))._jdf.queryExecution().executedPlan().toString()


def test_merging_leaves_out_boxes_without_a_place(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0), (1, None, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0), (1, float("nan"), 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scene_id long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(r) for r in match.merge_boxes(df).collect()) == [(0.0, 0.0, 0.0, 0.0, 2), (0.0, 0.0, 1.0, 1.0, 1)]
    assert match.merge_boxes(df.limit(0)).count() == 0
