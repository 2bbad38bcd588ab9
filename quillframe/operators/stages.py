"""Scene cases, completion stages and deliberate errors on rows of tokens: one row an exercise, tokens an array.

Every function is an expression over the row's own array, chosen by the row's own case, stage or draw: no window, no
exchange, no scan for each stage. Draws come from a digest of the exercise, the knob and the token's place, so that a rerun
gives the same rows and SQL can follow. Null token arrays stay null; empty ones stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import let
from . import worked

ID = worked.ID
TOKENS = "array<struct<row:int,col:int,label:string>>"
# Operator labels, and the scene cases by how their solutions are left unfinished.
OPERATORS = ("op_plus", "op_minus", "op_times", "op_divide")
COLUMN_CASES = (
    "addition", "subtraction", "addition_op_right", "subtraction_op_right", "subtraction_heavy_borrow", "addition_dense_carries", "addition_no_carries",
    "subtraction_crowded_borrow", "addition_crowded_carry",
)
PRODUCT_CASES = ("multiplication_simple", "multiplication_multi", "multiplication_simple_op_right")
NO_BAR_CASES = ("addition_no_bar", "subtraction_no_bar", "multiplication_simple_no_bar")
DIVISION_CASES = ("division_short", "division_long")
# What a named stage leaves out, by the group of cases.
RULES = {
    "column": {"done_80": "result_80", "done_60": "result_60", "done_40": "no_bar_no_result", "done_20": "operands"},
    "product": {"done_80": "result_80", "done_60": "result_60", "done_40": "no_bar_no_result", "done_20": "first_product_or_operands"},
    "no_bar": {"done_60": "result_60", "done_40": "no_result", "done_20": "bare_operands"},
    "division": {"done_80": "no_final_remainder", "done_60": "steps_k_of_K", "done_40": "first_step_only", "done_20": "bracket_only"},
    "simple": {"done_80": "no_result", "done_40": "no_bar_no_result"},
}
#: Stages that say themselves what they leave out, whatever the case.
PLAIN_STAGES = (
    "no_result", "no_bar_no_result", "partial_carries_or_borrows", "partial_result_digits", "missing_next_to_operator", "no_carries", "first_pp_only",
    "pp_rows_no_sum_bar", "no_sum_bar_no_result", "missing_pp_carry_row", "bracket_only", "first_step_only", "steps_k_of_K", "missing_quotient_digit_k", "no_final_remainder",
)


def draw(knob: str, *place, seed: int = 0) -> Column:
    """A number from 0 to 1 (exclusive) from a digest of seed, exercise, knob and place."""
    parts = [F.lit(str(seed)), F.col(ID).cast("string"), F.lit(knob), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in place]]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _below(u: Column, n) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(u * n).cast("int")


def is_main(t: Column) -> Column:
    return t["label"].startswith("main_")


def is_mark(t: Column) -> Column:
    return t["label"].startswith("carry_") | t["label"].startswith("borrow_")


def is_bar(t: Column) -> Column:
    return t["label"] == "result_bar"


def is_operator(t: Column) -> Column:
    return t["label"].startswith("op_")


def token(row: Column, col: Column, label: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), label.alias("label"))


def relabelled(t: Column, label: Column) -> Column:
    return token(t["row"], t["col"], label)


def number(t: Column) -> Column:
    """The digit at the end of a token's label."""
    return F.element_at(F.split(t["label"], "_"), -1).cast("int")


def _rows(ts: Column) -> Column:
    return F.transform(ts, lambda t: t["row"])


def _cols(ts: Column) -> Column:
    return F.transform(ts, lambda t: t["col"])


# ---- scene cases ----


def cased(ts: Column, case: Column) -> Column:
    """Tokens of a worked solution as its scene case writes them.

    ``_op_right``: the operator of row 2 one column right of the digits. ``_no_bar``: neither bars nor the last row that is
    left. ``bare_digits``: one to three digits in a row; ``bare_digit_grid``: two or three rows of two or three digits;
    ``standalone_bar`` and ``standalone_bracket``: that mark alone. Other cases stay as they are.
    """
    moved = let(F.array_max(_cols(F.filter(ts, is_main))), lambda edge: F.transform(ts, lambda t: F.when(is_operator(t) & (t["row"] == 2), token(t["row"], edge + 1, t["label"])).otherwise(t)))
    cut = let(F.filter(ts, lambda t: ~is_bar(t)), lambda rest: let(F.array_max(_rows(rest)), lambda top: F.filter(rest, lambda t: t["row"] != top)))
    digit = lambda r, c: token(r, c, F.concat(F.lit("main_"), _below(draw("digit", r, c), 10).cast("string")))
    line = F.transform(F.sequence(F.lit(0), _below(draw("digits"), 3)), lambda c: digit(F.lit(0), c))
    across = F.sequence(F.lit(0), 1 + _below(draw("cols"), 2))
    grid = F.flatten(F.transform(F.sequence(F.lit(0), 1 + _below(draw("rows"), 2)), lambda r: F.transform(across, lambda c: digit(r, c))))
    alone = lambda label: F.array(token(F.lit(0), F.lit(0), F.lit(label)))
    out = F.when(case.endswith("_op_right"), moved).when(case.endswith("_no_bar"), cut).when(case == "bare_digits", line).when(case == "bare_digit_grid", grid)
    return out.when(case == "standalone_bar", alone("result_bar")).when(case == "standalone_bracket", alone("div_bracket")).otherwise(ts)


# ---- completion stages ----


def rule(case: Column, stage: Column) -> Column:
    """What a stage leaves out of a case's solution; ``full`` where the case does not know the stage."""
    group = F.when(case.isin(*COLUMN_CASES), "column").when(case.isin(*PRODUCT_CASES), "product").when(case.isin(*NO_BAR_CASES), "no_bar").when(case.isin(*DIVISION_CASES), "division").when(case == "division_simple", "simple")
    pairs = [F.lit(x) for g, stages in RULES.items() for s, r in stages.items() for x in (f"{g}/{s}", r)]
    known = F.try_element_at(F.create_map(*pairs), F.concat_ws("/", group, stage))
    return F.coalesce(F.when(stage.isin(*PLAIN_STAGES), stage), F.when(group.isNotNull(), known), F.lit("full"))


def staged(df: DataFrame, seed: int = 0, case: str = "scene_case", stage: str = "stage") -> DataFrame:
    """df (exercise_id, tokens, scene_case, stage) with the tokens that the row's stage leaves, and ``rule``, what it left out.

    Shares round half to even, at least one digit goes and one stays; half to four fifths of the carry and borrow marks go
    (rounded down, one at least), drawn by their place; a number of division steps from 1 to all but one and the quotient
    digit that is missing are drawn. The last row is that of all tokens.
    """
    u = draw("stage", seed=seed)
    named = rule(F.col(case), F.col(stage))

    def left(ts: Column) -> Column:
        big = F.exists(ts, lambda t: t["row"] >= 5)
        name = F.when(named == "first_product_or_operands", F.when(big, "first_pp_only").otherwise("operands")).otherwise(named)
        return let(F.struct(name.alias("rule"), F.array_max(_rows(ts)).alias("top"), u.alias("u")), lambda s: let(_details(ts, s["rule"], s["top"], s["u"], seed), lambda d: F.struct(s["rule"].alias("rule"), _left(ts, s["rule"], s["top"], d).alias("tokens"))))

    return df.withColumn("__out", let(F.col("tokens"), left)).withColumns({"tokens": F.col("__out.tokens"), "rule": F.col("__out.rule")}).drop("__out")


def _details(ts: Column, name: Column, top: Column, u: Column, seed: int) -> Column:
    """What a rule needs to know of the row: the last column of the result that stays, marks that stay, and so on."""
    of = lambda names, value: F.when(name.isin(*names), value)
    digits = F.array_sort(_cols(F.filter(ts, lambda t: is_main(t) & (t["row"] == top))))
    share = F.when(name == "result_80", 0.2).when(name == "result_60", 0.4).otherwise(0.5)

    def last(ds: Column) -> Column:
        n = F.size(ds)
        dropped = F.when(n <= 1, 0).otherwise(F.least(F.greatest(F.lit(1), F.bround(n * share, 0).cast("int")), n - 1))
        return F.when(n > 0, F.get(ds, n - dropped - 1))

    marks = F.array_sort(F.transform(F.filter(ts, is_mark), lambda t: F.struct(draw("mark", t["row"], t["col"], t["label"], seed=seed).alias("u"), t.alias("t"))))
    gone = lambda ms: F.greatest(F.lit(1), F.floor(F.size(ms) * (0.5 + 0.3 * u)).cast("int"))
    n_steps = F.size(F.array_distinct(_rows(F.filter(ts, is_bar))))
    quotient = F.array_sort(_cols(F.filter(ts, lambda t: is_main(t) & (t["row"] == 0))))
    return F.struct(
        of(("result_80", "result_60", "partial_result_digits"), let(digits, last)).alias("last"),
        of(("partial_carries_or_borrows",), let(marks, lambda ms: F.transform(F.slice(ms, gone(ms) + 1, F.greatest(F.lit(1), F.size(ms))), lambda m: m["t"]))).alias("marks"),
        of(("missing_next_to_operator",), F.array_max(_cols(F.filter(ts, lambda t: is_main(t) & (t["row"] == 2))))).alias("end"),
        of(("steps_k_of_K",), let(n_steps, lambda n: F.when(n > 1, 2 + 3 * (1 + _below(u, n - 1))))).alias("upto"),
        of(("missing_quotient_digit_k",), let(quotient, lambda q: F.get(q, _below(u, F.size(q))))).alias("missing"),
    )


def _left(ts: Column, name: Column, top: Column, d: Column) -> Column:
    def stays(t: Column) -> Column:
        row, col = t["row"], t["col"]
        some = lambda c: F.coalesce(c, F.lit(True))
        out = F.when(name == "full", F.lit(True)).when(name.isin("result_80", "result_60", "partial_result_digits"), some(~is_main(t) | (row != top) | (col <= d["last"])))
        out = out.when(name.isin("no_result", "no_final_remainder"), row != top).when(name.isin("no_bar_no_result", "no_sum_bar_no_result"), row < top - 1).when(name == "operands", (row < top - 1) & ~is_mark(t))
        out = out.when(name == "bare_operands", (row != top) & ~is_mark(t)).when(name.isin("no_carries", "partial_carries_or_borrows"), ~is_mark(t)).when(name == "missing_next_to_operator", some(~(is_main(t) & (row == 2) & (col == d["end"]))))
        out = out.when(name == "first_pp_only", row <= 4).when(name == "pp_rows_no_sum_bar", row < top - 2).when(name == "missing_pp_carry_row", row != top - 2).when(name == "bracket_only", row == 1)
        out = out.when(name == "first_step_only", row.between(0, 4)).when(name == "steps_k_of_K", some(row < d["upto"])).when(name == "missing_quotient_digit_k", some(~(is_main(t) & (row == 0) & (col == d["missing"]))))
        return out.otherwise(F.lit(True))

    return F.concat(F.filter(ts, stays), F.coalesce(d["marks"], F.array().cast(TOKENS)))


# ---- errors ----


def _picked(found: Column, u: Column) -> Column:
    return F.get(found, _below(u, F.size(found)))


def _replaced(ts: Column, old: Column, new: Column) -> Column:
    """The tokens with one of them replaced; as they are when there is none to replace."""
    return let(new, lambda n: F.transform(ts, lambda t: F.when(t == old, n).otherwise(t)))


def wrong_result(ts: Column, p: float, seed: int = 0) -> Column:
    """One digit of the lowest row of digits becomes another digit."""
    other = lambda old: relabelled(old, F.concat(F.lit("main_"), ((number(old) + 1 + _below(draw("result_digit", seed=seed), 9)) % 10).cast("string")))
    lowest = lambda mains: let(F.array_max(_rows(mains)), lambda top: F.array_sort(F.filter(mains, lambda t: t["row"] == top)))
    old = let(let(F.filter(ts, is_main), lowest), lambda found: _picked(found, draw("result_place", seed=seed)))
    return F.when(draw("wrong_result", seed=seed) < p, let(old, lambda o: _replaced(ts, o, other(o)))).otherwise(ts)


def missing_structural(ts: Column, p: float, seed: int = 0) -> Column:
    """One bar or operator goes, unless it is all there is."""
    old = let(F.array_sort(F.filter(ts, lambda t: is_bar(t) | is_operator(t))), lambda found: _picked(found, draw("structural_place", seed=seed)))
    without = let(old, lambda o: F.filter(ts, lambda t: F.coalesce(t != o, F.lit(True))))
    return F.when((draw("missing_structural", seed=seed) < p) & (F.size(ts) > 1), without).otherwise(ts)


def wrong_operator(ts: Column, p: float, seed: int = 0) -> Column:
    """One operator becomes another one."""
    old = let(F.array_sort(F.filter(ts, is_operator)), lambda found: _picked(found, draw("operator_place", seed=seed)))
    others = lambda old: F.filter(F.array(*[F.lit(o) for o in OPERATORS]), lambda o: o != old["label"])
    other = lambda old: relabelled(old, _picked(others(old), draw("operator_label", seed=seed)))
    return F.when(draw("wrong_operator", seed=seed) < p, let(old, lambda o: _replaced(ts, o, other(o)))).otherwise(ts)


def _left_of(ts: Column, row: Column) -> Column:
    """The column left of a row's digits; null where it has none."""
    return F.array_min(_cols(F.filter(ts, lambda t: is_main(t) & (t["row"] == row)))) - 1


def step_minus(ts: Column, p: float, seed: int = 0) -> Column:
    """A minus left of the product of a division step, for each step by itself."""
    bars = F.filter(ts, lambda t: is_bar(t) & (draw("step_minus", t["row"], seed=seed) < p) & _left_of(ts, t["row"] - 1).isNotNull())
    return F.concat(ts, F.transform(bars, lambda b: token(b["row"] - 1, _left_of(ts, b["row"] - 1), F.lit("op_minus"))))


def step_borrow(ts: Column, p: float, seed: int = 0) -> Column:
    """In a division step, a borrow mark over each digit that is less than the one taken from it; a missing digit counts as 0."""
    mains = F.filter(ts, is_main)
    over = lambda s: F.coalesce(number(F.get(F.filter(mains, lambda m: (m["row"] == s["row"] - 1) & (m["col"] == s["col"])), 0)), F.lit(0))
    taken = lambda b: F.filter(mains, lambda s: (s["row"] == b["row"] - 1) & (number(s) > over(s)))
    marks = lambda b: F.transform(taken(b), lambda s: token(s["row"] - 1, s["col"], F.concat(F.lit("borrow_"), over(s).cast("string"))))
    return F.concat(ts, F.flatten(F.transform(F.filter(ts, lambda t: is_bar(t) & (draw("step_borrow", t["row"], seed=seed) < p)), marks)))


def product_operators(ts: Column, shown: float, wrong: float = 0.0, seed: int = 0) -> Column:
    """The plus signs beside partial products: none for ``shown`` = 0, else all, each a minus with chance ``wrong``."""
    if shown == 0:
        rows = _rows(F.filter(ts, is_main))
        return F.filter(ts, lambda t: ~((t["label"] == "op_plus") & F.array_contains(rows, t["row"])))
    return F.transform(ts, lambda t: F.when((t["label"] == "op_plus") & (draw("product_operator", t["row"], seed=seed) < wrong), relabelled(t, F.lit("op_minus"))).otherwise(t))


def _between(ts: Column) -> Column:
    """The rows of digits between the first and the last bar, a row for each digit."""
    ends = let(_rows(F.filter(ts, is_bar)), lambda r: F.struct(F.array_min(r).alias("lo"), F.array_max(r).alias("hi")))
    return let(ends, lambda e: _rows(F.filter(ts, lambda t: is_main(t) & (t["row"] > e["lo"]) & (t["row"] < e["hi"]))))


def helper_operators(ts: Column, p: float, division: Column | bool = False, seed: int = 0) -> Column:
    """A plus or minus left of rows between bars that have no operator; in divisions also of the rows over bars."""
    division = division if isinstance(division, Column) else F.lit(division)
    bars, signs = _rows(F.filter(ts, is_bar)), _rows(F.filter(ts, is_operator))
    between = _between(ts)
    over = F.when(division, F.transform(bars, lambda r: r - 1)).otherwise(F.array().cast("array<int>"))
    rows = F.array_except(F.array_union(between, over), signs)
    rows = F.filter(rows, lambda r: (draw("helper", r, seed=seed) < p) & _left_of(ts, r).isNotNull())
    sign = lambda r: F.when(draw("helper_sign", r, seed=seed) < 0.5, "op_plus").otherwise("op_minus")
    return F.concat(ts, F.transform(F.array_sort(rows), lambda r: token(r, _left_of(ts, r), sign(r))))


def _is_carry(t: Column) -> Column:
    return t["label"].startswith("carry_")


def _is_borrow(t: Column) -> Column:
    return t["label"].startswith("borrow_")


def missing_marks(ts: Column, carry: float, borrow: float, seed: int = 0) -> Column:
    """Carry and borrow marks go, each with its own chance."""
    u = lambda t: draw("missing_mark", t["row"], t["col"], t["label"], seed=seed)
    return F.filter(ts, lambda t: ~(_is_carry(t) & (u(t) < carry)) & ~(_is_borrow(t) & (u(t) < borrow)))


def shifted_carries(ts: Column, p: float, seed: int = 0) -> Column:
    """Carry marks move one column to either side."""
    place = lambda t: (t["row"], t["col"], t["label"])
    side = lambda t: F.when(draw("shift_side", *place(t), seed=seed) < 0.5, -1).otherwise(1)
    return F.transform(ts, lambda t: F.when(_is_carry(t) & (draw("shifted_carry", *place(t), seed=seed) < p), token(t["row"], t["col"] + side(t), t["label"])).otherwise(t))


def wrong_marks(ts: Column, carry: float, borrow: float, seed: int = 0) -> Column:
    """Carry and borrow marks show another digit."""
    place = lambda t: (t["row"], t["col"], t["label"])
    other = lambda t: F.concat(F.element_at(F.split(t["label"], "_"), 1), F.lit("_"), ((number(t) + 1 + _below(draw("mark_digit", *place(t), seed=seed), 9)) % 10).cast("string"))
    u = lambda t: draw("wrong_mark", *place(t), seed=seed)
    hit = lambda t: (_is_carry(t) & (u(t) < carry)) | (_is_borrow(t) & (u(t) < borrow))
    return F.transform(ts, lambda t: F.when(hit(t), relabelled(t, other(t))).otherwise(t))


def missing_partial(ts: Column, p: float, seed: int = 0) -> Column:
    """A row of digits between the first and the last bar, but the last such row, goes with the row above it."""
    inner = F.array_sort(F.array_distinct(_between(ts)))
    row = let(inner, lambda rows: F.when(F.size(rows) > 1, F.get(rows, _below(draw("partial_place", seed=seed), F.size(rows) - 1))))
    cut = let(row, lambda r: F.filter(ts, lambda t: F.coalesce((t["row"] != r) & (t["row"] != r - 1), F.lit(True))))
    return F.when(draw("missing_partial", seed=seed) < p, cut).otherwise(ts)


#: Chances by name, in the order in which the errors are made.
KNOBS = (
    "wrong_result", "missing_structural", "wrong_operator", "step_minus", "step_borrow", "product_plus", "product_wrong", "helper_operator", "missing_carry", "shifted_carry",
    "wrong_carry", "missing_borrow", "wrong_borrow", "missing_partial",
)


def with_errors(df: DataFrame, knobs: dict[str, float], seed: int = 0, case: str = "scene_case") -> DataFrame:
    """df (exercise_id, tokens, scene_case) with errors of several kinds, each with its chance; kinds not named are not made.

    Minus signs and borrow marks of steps belong to long divisions, plus signs and missing rows of products to products of
    several digits. Naming ``product_plus`` decides whether those plus signs are shown at all.
    """
    if unknown := set(knobs) - set(KNOBS):
        raise ValueError(f"unknown errors: {sorted(unknown)}")
    p = lambda name: float(knobs.get(name, 0.0))
    where = F.col(case)
    long, multi = where == "division_long", where == "multiplication_multi"
    only = lambda c, make: lambda ts: F.when(c, make(ts)).otherwise(ts)
    made = [
        ("wrong_result", lambda ts: wrong_result(ts, p("wrong_result"), seed)), ("missing_structural", lambda ts: missing_structural(ts, p("missing_structural"), seed)), ("wrong_operator", lambda ts: wrong_operator(ts, p("wrong_operator"), seed)),
        ("step_minus", only(long, lambda ts: step_minus(ts, p("step_minus"), seed))), ("step_borrow", only(long, lambda ts: step_borrow(ts, p("step_borrow"), seed))),
        ("product_plus", only(multi, lambda ts: product_operators(ts, p("product_plus"), p("product_wrong"), seed))), ("helper_operator", lambda ts: helper_operators(ts, p("helper_operator"), where.isin(*DIVISION_CASES), seed)),
        ("missing_carry", lambda ts: missing_marks(ts, p("missing_carry"), 0.0, seed)), ("shifted_carry", lambda ts: shifted_carries(ts, p("shifted_carry"), seed)), ("wrong_carry", lambda ts: wrong_marks(ts, p("wrong_carry"), 0.0, seed)),
        ("missing_borrow", lambda ts: missing_marks(ts, 0.0, p("missing_borrow"), seed)), ("wrong_borrow", lambda ts: wrong_marks(ts, 0.0, p("wrong_borrow"), seed)), ("missing_partial", only(multi, lambda ts: missing_partial(ts, p("missing_partial"), seed))),
    ]
    for name, make in made:
        if name in knobs:
            df = df.withColumn("tokens", let(F.col("tokens"), make))
    return df


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each token."""
    return worked.token_rows(df, *keep)
