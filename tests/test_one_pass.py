"""Scene queries bring the rows of a scene together once and work out what they share once."""

import pytest
from pyspark.sql import functions as F

from quillframe.operators import evaluate, match
from quillframe.plans.registry import QUERIES  # noqa: F401  first: it loads the query modules
from quillframe.plans.fixtures import FORMS, VIEWS, Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(FORMS))
def test_forms_of_views_equal_their_sql(spark, sf, name):
    t = Tables(spark, sf)
    got, want = getattr(t, name), t.sql(VIEWS[name])
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["predictions", "detections", "two_sources"])
def test_a_view_by_scene_takes_one_exchange(spark, sf, name):
    assert plan(getattr(Tables(spark, sf), name).groupBy("scene_id").count()).count("Exchange hashpartitioning") == 1


def test_suppression_takes_one_exchange_and_no_join(spark, sf):
    found = plan(match.suppress(Tables(spark, sf).two_sources, "a"))
    assert "Join" not in found and found.count("Exchange hashpartitioning") == 1


def test_provenance_works_the_boxes_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def source(i):
        seen.add(1)
        return "ab"[i % 2]

    df = spark.range(40).select((F.col("id") % 7).alias("scene_id"), source("id").alias("source"))
    assert sum(r.a + r.b for r in match.provenance(df, ["a", "b"]).collect()) == 40
    assert seen.value == 40


def test_matched_pairs_are_worked_out_once(spark, sf):
    t = Tables(spark, sf)
    assert "size(" not in plan(evaluate.label_pairs(t.gt_symbols, t.predictions))


@pytest.mark.parametrize("name, passes", [("c06_recognised_set", 1), ("c06_recognised_scenes", 2)])
def test_recognised_scenes_work_their_boxes_out_once(spark, sf, name, passes):
    """The symbols are numbered once for each side (boxes, given cells), nothing is written between the steps, and scenes are joined last."""
    found = plan(QUERIES[name](spark, sf))
    assert sum("Window [" in line and "l_linenumber" in line for line in found.splitlines()) == passes
    assert "Scan ExistingRDD" not in found


def test_row_conflicts_skip_rows_of_structure_only(spark):
    """The row of a bar has no median: the rows around it are compared with each other."""
    from quillframe.operators import cluster

    rows = [(1, 1, "main_1", 0, 100.0), (1, 2, "result_bar", 1, 0.0), (1, 3, "main_2", 2, 50.0), (1, 4, "main_3", None, 0.0)]
    df = spark.createDataFrame([(s, i, k, r, 0.0, y, 10.0, y + 10) for s, i, k, r, y in rows], "scene_id long, det_id long, label string, row int, x0 double, y0 double, x1 double, y1 double")
    assert {r.det_id: r.spatial_conflict for r in cluster.row_conflicts(df).collect()} == {1: True, 2: False, 3: True, 4: False}


@pytest.mark.parametrize("name, passes", [("a05_label_recall", 2), ("c08_evaluation_report", 2)])
def test_evaluation_works_its_pairs_out_once(spark, sf, name, passes):
    """The symbols are numbered once for each side of the pairs; confusions come with the recall, samples from their checkpoint."""
    found = plan(QUERIES[name](spark, sf))
    assert sum("Window [" in line and "l_linenumber" in line for line in found.splitlines()) == passes


def test_three_most_frequent_confusions(spark):
    rows = [("a", "a", 5), ("a", "d", 1), ("a", "c", 2), ("a", "b", 2), ("a", "e", 1), ("b", "b", 1)]
    got = evaluate.label_recall(spark.createDataFrame(rows, "gt_label string, pred_label string, n long")).collect()
    assert [(r.gt_label, r.correct, r.total, r.confused_with, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [("a", 5, 11, "b:2 c:2 d:1", 1), ("b", 1, 1, "", 2)]
