"""Stages and errors of rows of tokens: rules by hand, chances, and rows without tokens."""

import pytest
from pyspark.sql import functions as F

from quillframe.operators import stages, worked

EX = "exercise_id long, op string, a long, b long"


def rows(spark, write, *pairs):
    return write(spark.createDataFrame([(i, "x", a, b) for i, (a, b) in enumerate(pairs)], EX), rows=True)


def left(df, case, stage):
    out = stages.staged(df.withColumns({"scene_case": F.lit(case), "stage": F.lit(stage)}))
    return {r.exercise_id: sorted((t.row, t.col, t.label) for t in r.tokens) for r in out.collect()}


def whole(df):
    return {r.exercise_id: sorted((t.row, t.col, t.label) for t in r.tokens) for r in df.collect()}


@pytest.mark.parametrize("case,stage,keep", [
    ("addition", "done_80", lambda r, c, x: not (r == 4 and c == 4)), ("addition", "done_40", lambda r, c, x: r < 3), ("addition", "done_20", lambda r, c, x: r < 3 and "carry" not in x),
    ("addition_no_bar", "done_80", lambda r, c, x: True), ("bare_digits", "done_20", lambda r, c, x: True), ("division_simple", "done_80", lambda r, c, x: r != 4), ("addition", "no_carries", lambda r, c, x: "carry" not in x),
    ("addition", "missing_next_to_operator", lambda r, c, x: not (r == 2 and c == 4)), (None, "no_result", lambda r, c, x: r != 4), ("addition", None, lambda r, c, x: True),
])
def test_stages_of_a_sum(spark, case, stage, keep):
    df = rows(spark, worked.addition, (58, 67))
    assert left(df, case, stage) == {0: [t for t in whole(df)[0] if keep(*t)]}


def test_division_stages(spark):
    df = rows(spark, worked.long_division, (9876, 4), (7, 9))
    all_ = whole(df)
    assert left(df, "division_long", "done_20") == {k: [t for t in v if t[0] == 1] for k, v in all_.items()}
    assert left(df, "division_short", "done_40") == {k: [t for t in v if t[0] <= 4] for k, v in all_.items()}
    some = left(df, "division_long", "done_60")
    assert some[1] == all_[1]  # one step stays
    assert some[0] in [[t for t in all_[0] if t[0] < 2 + 3 * k] for k in (1, 2, 3)]
    gone = left(df, "division_long", "missing_quotient_digit_k")
    assert all(len(all_[k]) - len(gone[k]) == 1 and set(gone[k]) < set(all_[k]) for k in all_)


def test_rows_without_tokens_stay(spark):
    df = spark.createDataFrame([(1, [], "addition", "done_20"), (2, None, "addition", "done_80"), (None, [(4, 1, "main_1")], None, None)], f"exercise_id long, tokens {stages.TOKENS}, scene_case string, stage string")
    out = {r.exercise_id: r.tokens for r in stages.staged(df).collect()}
    assert out[1] == [] and out[2] is None and len(out[None]) == 1
    made = stages.with_errors(df, dict.fromkeys(stages.KNOBS, 1.0)).collect()
    assert {r.exercise_id: r.tokens for r in made}[1] == []
    with pytest.raises(ValueError):
        stages.with_errors(df, {"no such error": 1.0})


def test_errors_come_at_their_chance(spark):
    df = rows(spark, worked.subtraction, *[(300 + i, 7) for i in range(400)]).withColumn("scene_case", F.lit("subtraction"))
    before = whole(df)
    for knob in ("wrong_result", "missing_structural", "wrong_operator"):
        after = whole(stages.with_errors(df, {knob: 0.3}))
        hit = sum(before[k] != after[k] for k in before)
        assert 80 < hit < 165
        assert whole(stages.with_errors(df, {knob: 0.0})) == before
    assert "Window" not in stages.with_errors(df, {"wrong_result": 0.3})._jdf.queryExecution().executedPlan().toString()
