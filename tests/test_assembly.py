"""Given cells, recognised scenes, drawn kinds, whole evaluations and report tables, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillframe.operators import assembly, evaluate, grade
from quillframe.plans.registry import QUERIES  # first: it loads the query modules
from quillframe.plans.arithmetic import expected, submitted
from quillframe.plans.fixtures import Tables
from quillframe.sources import sinks

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n):
    out = []
    for i in range(n):
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        out.append((i, rng.choice(["main_1", "op_plus", "main_2", "result_bar"]), float(x), float(y), float(x + rng.randrange(2, 20)), float(y + rng.randrange(2, 20))))
    return out


def merged_by_hand(dets, cells, most):
    taken, rows = {}, []
    for d in dets:
        cx, cy = (d[2] + d[4]) / 2, (d[3] + d[5]) / 2
        hit = next((c for c in cells if c[0] not in taken and c[2] <= cx <= c[4] and c[3] <= cy <= c[5]), None)
        if hit:
            taken[hit[0]] = d
        rows.append((d[0], d[1], hit is not None, hit[1] if hit else None))
    free = sorted((c for c in cells if c[0] not in taken), key=lambda c: (not c[1].startswith("op_"), c[0]))
    return rows + [(assembly.GIVEN_IDS + c[0], c[1], True, c[1]) for c in free[: max(0, most - len(dets))]]


@pytest.mark.parametrize("most", [5, 12, 80])
def test_given_cells_equal_the_walk(spark, most):
    rng = random.Random(most)
    scenes = {s: (boxes(rng, rng.randrange(0, 10)), boxes(rng, rng.randrange(0, 8))) for s in range(12)}
    dets = spark.createDataFrame([(s, d[0], d[1], 0.7, *d[2:]) for s, (ds, _) in scenes.items() for d in ds], f"scene_id long, det_id long, label string, confidence double, {BOX}")
    cells = spark.createDataFrame([(s, *c) for s, (_, cs) in scenes.items() for c in cs], f"scene_id long, cell_id long, label string, {BOX}")
    got = sorted((r.scene_id, r.det_id, r.label, r.given, r.known_label or "") for r in assembly.with_given_cells(dets, cells, most).collect())
    want = sorted((s, *r[:3], r[3] or "") for s, (ds, cs) in scenes.items() for r in merged_by_hand(ds, cs, most))
    assert got == want


def test_recognised_scenes(spark):
    """A scene over its given cells, one of uneven logits, one of bare digits, one without digits and an empty one."""
    row = lambda s, i, label, x, y, src="a": (s, i, label, 0.9, float(x), float(y), float(x + 20), float(y + 20), src)
    line = lambda s: [row(s, 1, "main_1", 0, 0), row(s, 2, "op_plus", 40, 0), row(s, 3, "main_2", 80, 0), row(s, 4, "main_3", 0, 100)]
    rows = line(1) + line(2) + [row(3, 1, "main_4", 0, 0), row(3, 2, "main_5", 40, 0)] + [row(4, 1, "op_plus", 0, 0), row(4, 2, "op_plus", 200, 200)]
    rows += [row(1, 50, "main_1", 1, 0, "b")]  # hidden by the first source's box
    dets = spark.createDataFrame(rows, f"scene_id long, det_id long, label string, confidence double, {BOX}, source string")
    sure, even = [9.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0]
    scenes = spark.createDataFrame([(1, "add", sure), (2, "add", even), (3, "add", even), (4, "add", sure), (5, "add", None)], "scene_id long, pred_kind string, logits array<double>")
    cells = spark.createDataFrame([(1, 1, "main_7", -5.0, -5.0, 25.0, 25.0), (1, 2, "main_8", 40.0, 100.0, 60.0, 120.0)], f"scene_id long, cell_id long, label string, {BOX}")
    got = {r.scene_id: r for r in assembly.recognised(dets, scenes, "a", cells).collect()}
    assert {s: (r.route, r.equation_kind, r.ood_reason, r.n_rows, r.n_given) for s, r in got.items()} == {
        1: ("valid", "add", None, 2, 2), 2: ("valid", "unknown", "high_entropy", 2, 0), 3: ("bare_digits", "bare_digits", None, 1, 0), 4: ("ood", "unknown", "no_digits", 0, 0), 5: ("ood", "unknown", "true_empty", 0, 0),
    }
    labels = [[t.label for t in r.tokens] for r in got[1].rows]
    assert labels == [["main_7", "op_plus", "main_2"], ["main_3", "main_8"]]  # the drawn 1 is known to be a 7, the undrawn 8 is there
    assert [t.given for t in got[1].rows[0].tokens] == [True, False, False]
    plain = {r.scene_id: r for r in assembly.recognised(dets, scenes.drop("logits"), "a").collect()}
    assert plain[2].equation_kind == "add" and plain[1].n_given == 0


def test_drawn_kinds(spark):
    label = "scene_id long, label string"
    before = spark.createDataFrame([(s, x) for s in (1, 2, 3, 4, 5) for x in ("op_plus", "main_1")] + [(6, None)], label)
    after = spark.createDataFrame([(1, "op_minus"), (2, "op_plus"), (3, "div_bracket"), (3, "op_times"), (4, "op_minus"), (6, None)], label)
    scenes = spark.createDataFrame([(1, "add"), (2, "add"), (3, "add"), (4, "ood_unknown"), (5, "add"), (6, None), (7, "add")], "scene_id long, kind string")
    got = {r.scene_id: (r.swapped, r.kind) for r in assembly.drawn_kinds(before, after, scenes).collect()}
    assert got == {1: (True, "subtract"), 2: (False, "add"), 3: (True, "divide"), 4: (True, "ood_unknown"), 5: (False, "add"), 6: (False, None), 7: (False, "add")}


def test_flags_and_arguments_of_nulls(spark):
    df = spark.createDataFrame([(0.24, 1.0), (0.25, 48.0), (0.5, 48.1), (None, None)], "c double, d double")
    low, flagged = assembly.review_flags(F.col("c"), F.col("d"))
    assert [tuple(r) for r in df.select(low, flagged).collect()] == [(True, True), (True, False), (False, True), (False, False)]
    cases = [("PRODUCT_1", ["1.5", "2"], True), ("PRODUCT_1", ["1.5", "2.5"], False), ("DIVISION_1", ["1.5", "2"], False), ("DIVISION_1", [], True), ("SUM_1", ["1.5", "2.5"], True), (None, None, True), ("DIVISION_2", None, True)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, a array<string>")
    assert [r[0] for r in df.select(assembly.arguments_allowed(F.col("t"), F.col("a"))).collect()] == [c[2] for c in cases]


def test_whole_evaluation_equals_its_parts(spark, sf):
    t = Tables(spark, sf)
    e, s = expected(t), submitted(t)
    got = {r.submission_id: r for r in grade.evaluated(s, e).collect()}
    cells = grade.graded_cells(grade.with_given(s, e), e)
    verdicts = {r.submission_id: r for r in grade.verdicts(cells).collect()}
    assert got.keys() == verdicts.keys()
    for k, r in got.items():
        assert (r.outcome, r.short_outcome) == (verdicts[k].outcome, verdicts[k].short_outcome) and math.isclose(r.progress, verdicts[k].progress)
    rows = e.where("role = 'answer' and not given").groupBy("exercise_id").agg(F.max("y").alias("answer_y"))
    hints = {r.submission_id: (r.role, r.left_x, r.y) for r in grade.next_hint(cells, rows).collect()}
    assert {k: tuple(r.hint) for k, r in got.items() if r.hint} == hints
    names = ["role", "left_x", "y", "width", "num", "status"]
    elements = sorted((r.submission_id, *[str(r[n]) for n in names], sorted(r.token_ids)) for r in grade.graded_elements(cells).collect())
    assert sorted((k, *[str(x[n]) for n in names], sorted(x.token_ids)) for k, r in got.items() for x in r.elements) == elements


def test_recognised_scenes_of_the_tables(spark, sf):
    """Every scene once, tokens nested as counted."""
    import json

    rows = QUERIES["c06_recognised_scenes"](spark, sf).collect()
    assert sorted(r.scene_id for r in rows) == sorted(r.scene_id for r in Tables(spark, sf).scenes.select("scene_id").collect())
    for r in rows:
        nested = json.loads(r.rows_json)
        assert len(nested) == r.n_rows and [x["row"] for x in nested] == list(range(r.n_rows))
        assert (r.route == "ood") == (r.n_rows == 0)
        if nested:
            tokens = [x for line in nested for x in line["tokens"]]
            assert sum(x["given"] for x in tokens) == r.n_given and sum(x["spatial_conflict"] for x in tokens) == r.n_conflicts


def test_recognised_set_tells_its_conflicts(spark):
    """A carry above its column's main digit and one without a main digit are flagged, a borrow below its main digit is not."""
    import json
    from types import SimpleNamespace

    from quillframe.plans.composites import c06_recognised_set

    placed = [("main_3", 0, 100), ("carry_1", 0, 0), ("carry_1", 100, 0), ("main_2", 200, 0), ("borrow_1", 200, 100), ("op_plus", 300, 0)]
    rows = [(1, i, label, 0.9, float(x), float(y), float(x + 20), float(y + 20), "a") for i, (label, x, y) in enumerate(placed)]
    two_sources = spark.createDataFrame(rows, f"scene_id long, det_id long, label string, confidence double, {BOX}, source string")
    scenes = spark.createDataFrame([(1,), (2,)], "scene_id long")
    got = {r.scene_id: r for r in c06_recognised_set(SimpleNamespace(two_sources=two_sources, scenes=scenes)).collect()}
    tokens = [x for line in json.loads(got[1].rows_json) for x in line["tokens"]]
    assert {x["det_id"]: x["carry_conflict"] for x in tokens} == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False}
    assert not any(x["spatial_conflict"] for x in tokens)
    assert {s: (r.n_conflicts, r.n_carry_conflicts) for s, r in got.items()} == {1: (0, 2), 2: (0, 0)}


def test_report_is_written(spark, sf, tmp_path):
    t = Tables(spark, sf)
    tables = evaluate.report_tables(t.scenes, t.gt_symbols, t.predictions, t.detections)
    sinks.write_report(tables, str(tmp_path))
    assert set(tables) == {"aggregate", "per_kind", "per_case", "per_label", "per_sample"}
    n = spark.read.parquet(str(tmp_path / "aggregate")).where("metric = 'n_samples'").first().value
    assert n == t.scenes.count() == spark.read.parquet(str(tmp_path / "per_sample")).where("metric = 'n_pred'").count()
