import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.operators import cluster, evaluate, match

BOX = "scene_id long, gt_id long, label string, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows, ident="gt_id"):
    return spark.createDataFrame(rows, BOX.replace("gt_id", ident))


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def greedy(gt, pred, limit, gt_first=True):
    pairs = [(iou(g[3:], p[3:]), *((g[1], p[1]) if gt_first else (p[1], g[1]))) for g in gt for p in pred]
    used_a, used_b, out = set(), set(), set()
    for s, a, b in sorted((x for x in pairs if x[0] >= limit), reverse=True):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b) if gt_first else (b, a))
    return out


def scene(rng, k, n):
    out = []
    for i in range(n):
        x, y = rng.randrange(0, 60, 10), rng.randrange(0, 60, 10)
        out.append((k, i, f"main_{rng.randrange(3)}", float(x), float(y), float(x + 20), float(y + 20)))
    return out


def test_greedy_match_equals_sequential(spark):
    rng = random.Random(3)
    gt, pred = [], []
    for k in range(60):
        gt += scene(rng, k, rng.randrange(0, 8))
        pred += scene(rng, k, rng.randrange(0, 8))
    a, b = boxes(spark, gt), boxes(spark, pred, "pred_id")
    got = {(r.scene_id, r.gt_id, r.pred_id) for r in match.greedy_match(match.iou_pairs(a, b)).collect()}
    want = {(k, *p) for k in range(60) for p in greedy([g for g in gt if g[0] == k], [p for p in pred if p[0] == k], 0.35)}
    assert got == want
    got = {(r.scene_id, r.gt_id, r.pred_id) for r in match.match_outcomes(a, b).where("outcome = 'matched'").collect()}
    want = {(k, *p) for k in range(60) for p in greedy([g for g in gt if g[0] == k], [p for p in pred if p[0] == k], 0.40, False)}
    assert got == want


def test_equal_iou_prefers_larger_ids(spark):
    same = (0.0, 0.0, 10.0, 10.0)
    a = boxes(spark, [(1, 0, "x", *same), (1, 1, "x", *same)])
    b = boxes(spark, [(1, 7, "x", *same)], "pred_id")
    assert [r.gt_id for r in match.greedy_match(match.iou_pairs(a, b)).collect()] == [1]


def test_suppress_keeps_a_box_at_the_threshold(spark):
    rows = [(1, 1, "x", 0.9, 0.0, 0.0, 10.0, 10.0, "a"), (1, 2, "x", 0.9, 5.0, 0.0, 15.0, 10.0, "b"), (1, 3, "x", 0.8, 0.0, 0.0, 10.0, 10.0, "a")]
    df = spark.createDataFrame(rows, "scene_id long, det_id long, label string, confidence double, x0 double, y0 double, x1 double, y1 double, source string")
    assert {r.det_id for r in match.suppress(df, "a", 1 / 3, use_ioa=False).collect()} == {1, 2}
    assert {r.det_id for r in match.suppress(df, "b", 0.3, use_ioa=True).collect()} == {2}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_has_the_least_cost(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    pairs = match._assign(cost)
    assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    if n <= m:
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    else:
        best = min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
    assert sum(cost[i, j] for i, j in pairs) == best


def test_assignment_cuts_after_solving(spark):
    t = boxes(spark, [(1, 0, "x", 0.0, 0.0, 2.0, 2.0), (1, 1, "x", 300.0, 0.0, 302.0, 2.0)], "target_id")
    d = boxes(spark, [(1, 5, "x", 10.0, 0.0, 12.0, 2.0), (1, 6, "x", 50.0, 0.0, 52.0, 2.0)], "det_id")
    got = {r.det_id: r.target_id for r in match.assign(t, d).collect()}
    assert got == {5: 0, 6: None}


def distinct_ops(ops):
    """Sequential form of operator thinning for one row and label: (id, x0, x1, confidence)."""
    gone, kept = set(), []
    for i, a in enumerate(ops):
        if i in gone:
            continue
        best = i
        for j in range(i + 1, len(ops)):
            if j not in gone and a[1] <= ops[j][2] and ops[j][1] <= a[2]:
                if ops[j][3] > ops[best][3]:
                    gone.add(best)
                    best = j
                else:
                    gone.add(j)
        if best not in kept:
            kept.append(best)
    return {ops[i][0] for i in kept}


def test_distinct_operators_equals_sequential(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for k in range(80):
        ops = [(i, float(x := rng.randrange(0, 40, 5)), float(x + 10), rng.randrange(10) / 10) for i in range(rng.randrange(0, 7))]
        want |= {(k, i) for i in distinct_ops(ops)}
        rows += [(k, i, "op_plus", 0, x0, 0.0, x1, 5.0, c) for i, x0, x1, c in ops]
    df = spark.createDataFrame(rows, "scene_id long, det_id long, label string, row int, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert {(r.scene_id, r.det_id) for r in match.distinct_operators(df).collect()} == want


def test_merge_given_takes_first_free_cell(spark):
    d = boxes(spark, [(1, 1, "x", 0.0, 0.0, 4.0, 4.0), (1, 2, "x", 1.0, 1.0, 3.0, 3.0), (1, 3, "x", 90.0, 90.0, 92.0, 92.0)], "det_id")
    c = boxes(spark, [(1, 10, "x", 0.0, 0.0, 5.0, 5.0), (1, 11, "x", 1.0, 1.0, 6.0, 6.0)], "cell_id")
    took, rest = match.merge_given(d, c)
    assert {(r.det_id, r.cell_id) for r in took.collect()} == {(1, 10), (2, 11)}
    assert [r.det_id for r in rest.collect()] == [3]


def test_gap_cluster_edges(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 3.0), (2, 1, 3.0), (3, 0, 0.0), (3, 1, 100.0), (3, 2, 105.0)], "scene_id long, gt_id long, v double")
    got = {(r.scene_id, r.gt_id): r.c for r in cluster.gap_cluster(df, "v", "c", order=["gt_id"]).collect()}
    assert got == {(1, 0): 0, (2, 0): 0, (2, 1): 0, (3, 0): 0, (3, 1): 1, (3, 2): 1}


def test_rand_index_edges(spark):
    rows = [(1, "a", 0), (1, "a", 0), (2, "a", 5), (2, "b", 9), (2, "b", 9), (3, "a", 0)]
    got = {r.scene_id: r.ari for r in cluster.rand_index(spark.createDataFrame(rows, "scene_id long, p string, q int"), "p", "q").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}


def test_null_and_empty_symbols(spark):
    s = spark.createDataFrame([(1, False), (2, True), (3, True)], "scene_id long, has_symbols boolean").selectExpr("*", "'addition' as equation_kind", "cast(null as string) as scene_case", "'add' as pred_kind", "cast(null as string) as ood_reason", "1.0 as wall_ms")
    gt = boxes(spark, [(3, 1, "main_1", 0.0, 0.0, 10.0, 10.0)])
    pred = boxes(spark, [], "pred_id")
    dets = spark.createDataFrame([], "scene_id long, det_id long, x0 double, y0 double, x1 double, y1 double, row int, col int")
    got = {r.scene_id: (r.n_gt, r.matched, r.recall, r.row_acc) for r in evaluate.sample_metrics(s, gt, pred, dets).collect()}
    assert got == {1: (None, None, None, None), 2: (0, 0, None, None), 3: (1, 0, 0.0, None)}


def test_wilson_edges(spark):
    from pyspark.sql import functions as F

    from quillframe.functions import stats

    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "k long, n long")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    a, b, c = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (a.lo, a.hi) == (0.0, 0.0) and b.lo == 0.0 and abs(c.hi - 1.0) < 1e-12


def test_carry_above_all_mains_is_flagged(spark):
    rows = [(1, 1, "carry_1", 5.0, 0), (1, 2, "main_3", 50.0, 0), (1, 3, "carry_1", 60.0, 0), (1, 4, "borrow_1", 9.0, 4)]
    df = spark.createDataFrame(rows, "scene_id long, det_id long, label string, y0 double, col int")
    assert {r.det_id for r in cluster.carry_conflicts(df).where("carry_conflict").collect()} == {1, 4}


def random_boxes(seed, n=12, size=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = rng.randrange(size), rng.randrange(size)
        out.append((float(x), float(y), float(x + rng.randrange(2, 40)), float(y + rng.randrange(2, 40))))
    return out


def test_box_merging_by_gap_equals_closure(spark):
    """Boxes within a gap of each other end in one; the rectangles of what is left are further apart than the gap."""
    scenes = {k: random_boxes(k, 10, 400) for k in range(8)}
    df = spark.createDataFrame([(k, i, *b) for k, boxes in scenes.items() for i, b in enumerate(boxes)], "scene_id long, det_id long, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in match.merge_boxes(df).collect():
        got.setdefault(r.scene_id, []).append((r.x0, r.y0, r.x1, r.y1))
    near = lambda a, b: a[0] <= b[2] + 14 and b[0] <= a[2] + 14 and a[1] <= b[3] + 14 and b[1] <= a[3] + 14
    for k, boxes in scenes.items():
        left = set(boxes)
        while pair := next(((a, b) for a in left for b in left if a < b and near(a, b)), None):
            a, b = pair
            left = (left - {a, b}) | {(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))}
        assert sorted(got[k]) == sorted(left)


def test_overlapping_boxes_merge_until_none_overlaps(spark):
    scenes = {k: random_boxes(100 + k) for k in range(8)}
    df = spark.createDataFrame([(k, i, *b) for k, boxes in scenes.items() for i, b in enumerate(boxes)], "scene_id long, box_id long, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in match.merge_overlapping(df).collect():
        got.setdefault(r.scene_id, []).append((r.x0, r.y0, r.x1, r.y1))
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    shared = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    for k, boxes in scenes.items():
        for i, a in enumerate(got[k]):
            assert all(shared(a, b) <= 0.5 * min(area(a), area(b)) for b in got[k][i + 1 :])
        for b in boxes:  # no box is lost: each lies inside one that is left
            assert any(g[0] <= b[0] and g[1] <= b[1] and g[2] >= b[2] and g[3] >= b[3] for g in got[k])


def test_jitter_stays_near_and_inside(spark):
    from quillframe.operators import graph

    rows = [(k, i, *b) for k in range(30) for i, b in enumerate(random_boxes(k, 6, 500))]
    df = spark.createDataFrame(rows, "scene_id long, det_id long, x0 double, y0 double, x1 double, y1 double")
    kept = {(r.scene_id, r.det_id): tuple(r)[2:] for r in graph.jittered(df, 6.0).collect()}
    again = {(r.scene_id, r.det_id): tuple(r)[2:] for r in graph.jittered(df.repartition(5), 6.0).collect()}
    assert kept == again
    moved = []
    for k, i, *b in rows:
        got = kept[k, i]
        assert all(0 <= v <= 512 for v in got) and got[0] <= got[2] and got[1] <= got[3]
        if b[2] - b[0] > 12 and b[3] - b[1] > 12:
            assert all(abs(v - min(512.0, w)) <= 6 for v, w in zip(got, b))
            moved += [v - w for v, w in zip(got, b) if 6 < w < 506]
    assert abs(sum(moved) / len(moved)) < 1 and min(moved) < -4 and max(moved) > 4



def test_few_boxes_are_assigned_like_many():
    rng = np.random.default_rng(5)
    for _ in range(300):
        cost = rng.integers(0, 6, (rng.integers(1, 9), rng.integers(1, 9))).astype(float)
        assert match._assign_few(cost.tolist()) == match._assign(cost)


def test_small_scenes_are_folded_without_a_group_of_pandas_or_rounds(spark):
    box = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0), (1, 2, 4.0, 0.0, 9.0, 5.0)], "scene_id long, id long, x0 double, y0 double, x1 double, y1 double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (match.assign(box.withColumnRenamed("id", "target_id"), box.withColumnRenamed("id", "det_id")), match.merge_overlapping(box.withColumnRenamed("id", "box_id"))):
        assert "InPandas" not in plan(df) and df.count() > 0
    assert [tuple(r) for r in match.merge_boxes(box).collect()] == [(0.0, 0.0, 9.0, 5.0, 1)]
