"""Queries over rows of tokens: scene cases, completion stages and deliberate errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stages, worked
from .arithmetic import ADD, DIV, MUL, PLACES, SUB, WIDTH, number_sql
from .composites import CASES
from .registry import query

# Tokens of long divisions from their steps, which take consecutive columns.
LONG = f"""{DIV}, z as (select exercise_id, a, b, step, q, r, col, q * b as p, max(step) over (partition by exercise_id) as last_step from st),
s as (select exercise_id, 0 as row, cast(col as int) as col, 'main_' || q as label from z union all {number_sql('z', 'p', '2 + 3 * step', 'col')} union all select exercise_id, cast(3 + 3 * step as int), cast(col - {WIDTH.format('p')} as int), 'result_bar' from z
  union all select * from ({number_sql('(select * from z where r > 0 or step = last_step)', 'r', '4 + 3 * step', 'col')}) n1
  union all select exercise_id, cast(4 + 3 * step as int), cast(col + 1 as int), 'main_' || substring(cast(a as varchar), cast(col + 2 as int), 1) from z where step < last_step
  union all {number_sql('x', 'b', '1', '-2')} union all select exercise_id, 1, -1, 'div_bracket' from x union all {number_sql('x', 'a', '1', '(w - 1)')})"""
OPS = {"add": ADD, "subtract": SUB, "multiply": MUL, "divide": LONG}
WRITE = {"add": worked.addition, "subtract": worked.subtraction, "multiply": worked.multiplication, "divide": worked.long_division}


def u(knob: str, *place: str, id: str = "exercise_id") -> str:
    """The draw of a knob at a place, in SQL."""
    return "(cast('0x' || substr(md5(" + " || '/' || ".join(["'0'", id, f"'{knob}'", *place]) + "), 1, 8) as bigint) / 4294967296.0)"


def rows_of(t, op: str):
    return WRITE[op](t.exercises.where(f"op = '{op}'"), rows=True)


def picked(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][cast(exercise_id % {len(names)} as int) + 1]"


def with_stage(df, case: str, names: tuple[str, ...]):
    stage = F.get(F.array(*[F.lit(n) for n in names]), (F.col("exercise_id") % len(names)).cast("int"))
    return df.withColumns({"scene_case": F.lit(case), "stage": stage})


KEEP = """case rule when 'no_result' then row <> top when 'no_final_remainder' then row <> top when 'no_bar_no_result' then row < top - 1 when 'no_sum_bar_no_result' then row < top - 1
  when 'operands' then row < top - 1 and not mk when 'bare_operands' then row <> top and not mk when 'no_carries' then not mk
  when 'result_80' then not res or pos > gone(0.2) when 'result_60' then not res or pos > gone(0.4) when 'partial_result_digits' then not res or pos > gone(0.5)
  when 'partial_carries_or_borrows' then not mk or mp > greatest(1, floor(nm * (0.5 + 0.3 * us))) when 'missing_next_to_operator' then not (mn and row = 2 and col = endc)
  when 'first_pp_only' then row <= 4 when 'pp_rows_no_sum_bar' then row < top - 2 when 'missing_pp_carry_row' then row <> top - 2 when 'bracket_only' then row = 1 when 'first_step_only' then row <= 4
  when 'steps_k_of_K' then bars <= 1 or row < 2 + 3 * (1 + floor(us * (bars - 1))) when 'missing_quotient_digit_k' then not (mn and row = 0 and qp = floor(us * nq) + 1) else true end"""


def staged_sql(source: str, rules: str) -> str:
    """CTEs up to f: what is left of the tokens of CTE ``source``, given an expression for the rule over exercise_id and big (a row from 5 on)."""
    keep = KEEP
    for share in ("0.2", "0.4", "0.5"):
        keep = keep.replace(f"gone({share})", f"case when n <= 1 then 0 else least(greatest(1, round_even(n * {share}, 0)), n - 1) end")
    return f"""w0 as (select *, max(row) over (partition by exercise_id) as top, max(row) over (partition by exercise_id) >= 5 as big, label like 'main%' as mn, label like 'carry%' or label like 'borrow%' as mk, {u('stage')} as us from {source}),
w1 as (select *, mn and row = top as res, {rules} as rule, {u('mark', 'row', 'col', 'label')} as um from w0),
w2 as (select *, count(*) filter (where res) over e as n, row_number() over (partition by exercise_id, res order by col desc) as pos, count(*) filter (where mk) over e as nm, row_number() over (partition by exercise_id, mk order by um, row, col, label) as mp,
    max(col) filter (where mn and row = 2) over e as endc, count(*) filter (where label = 'result_bar') over e as bars, count(*) filter (where mn and row = 0) over e as nq, row_number() over (partition by exercise_id, mn and row = 0 order by col) as qp
  from w1 window e as (partition by exercise_id)),
f as (select exercise_id, row, col, label from w2 where {keep})"""


def rule_sql(group: str, names: tuple[str, ...]) -> str:
    known = {s: r for s, r in stages.RULES[group].items()}
    stage = picked(names)
    arms = " ".join(f"when '{s}' then " + ("case when big then 'first_pp_only' else 'operands' end" if r == "first_product_or_operands" else f"'{r}'") for s, r in known.items())
    return f"case {stage} {arms} else {stage} end"


SUMS = ("done_80", "done_60", "done_40", "done_20", "no_result", "missing_next_to_operator", "no_carries", "partial_result_digits", "partial_carries_or_borrows", "no_bar_no_result", "full")
PRODUCTS = ("done_80", "done_60", "done_40", "done_20", "first_pp_only", "missing_pp_carry_row", "pp_rows_no_sum_bar", "no_sum_bar_no_result")
DIVISIONS = ("done_80", "done_60", "done_40", "done_20", "missing_quotient_digit_k", "first_step_only", "full")
BARLESS = ("done_60", "done_40", "done_20", "full")


@query(f"with {ADD}, {staged_sql('s', rule_sql('column', SUMS))} select * from f")
def g10_stages_of_sums(t):
    """Each sum at a stage of its own."""
    return stages.exploded(stages.staged(with_stage(rows_of(t, "add"), "addition", SUMS)))


@query(f"with {SUB}, {staged_sql('s', rule_sql('column', SUMS))} select * from f")
def g10_stages_of_differences(t):
    return stages.exploded(stages.staged(with_stage(rows_of(t, "subtract"), "subtraction", SUMS)))


@query(f"with {MUL}, {staged_sql('s', rule_sql('product', PRODUCTS))} select * from f")
def g10_stages_of_products(t):
    return stages.exploded(stages.staged(with_stage(rows_of(t, "multiply"), "multiplication_multi", PRODUCTS)))


@query(f"with {LONG}, {staged_sql('s', rule_sql('division', DIVISIONS))} select * from f")
def g10_stages_of_divisions(t):
    return stages.exploded(stages.staged(with_stage(rows_of(t, "divide"), "division_long", DIVISIONS)))


@query(f"with {SUB}, v as (select * from s where row < 3), {staged_sql('v', rule_sql('no_bar', BARLESS))} select * from f")
def g10_stages_without_bar(t):
    """Differences written without a bar, then left at a stage."""
    df = with_stage(rows_of(t, "subtract"), "subtraction_no_bar", BARLESS)
    return stages.exploded(stages.staged(df.withColumn("tokens", stages.cased(F.col("tokens"), F.col("scene_case")))))


@query(f"with {LONG} select * from s")
def g05_division_tokens(t):
    return stages.exploded(rows_of(t, "divide"))


DRAWN = "case when uu < 0.65 then 'full' when uu < 0.80 then 'result_80' when uu < 0.87 then 'result_60' when uu < 0.93 then 'no_bar_no_result' else 'operands' end"
DRAWN_BARLESS = "case when uu < 0.65 then 'full' when uu < 0.72 then 'result_60' when uu < 0.78 then 'no_result' else 'bare_operands' end"


@query(f"""with {ADD}, d as (select exercise_id, b % 3 = 0 as barless, (exercise_id * 7919 % 1000) / 1000.0 as uu from x), v as (select s.*, barless, uu from s join d on d.exercise_id = s.exercise_id where not barless or row < 3),
{staged_sql('v', f"case when barless then {DRAWN_BARLESS} else {DRAWN} end")} select * from f""")
def g11_drawn_tokens(t):
    """Sums in two scene cases, each at a stage drawn by the weights of its case, with the tokens that are left."""
    ex = t.exercises.where("op = 'add'").selectExpr("*", f"{CASES} as scene_case").withColumn("u", (F.col("exercise_id") * 7919 % 1000) / 1000.0)
    df = rows_of(t, "add").join(worked.drawn_stage(ex, "u").select("exercise_id", "scene_case", "stage"), "exercise_id")
    return stages.exploded(stages.staged(df.withColumn("tokens", stages.cased(F.col("tokens"), F.col("scene_case")))))


GRID = f"""x as (select exercise_id, ['bare_digits', 'bare_digit_grid', 'standalone_bar', 'standalone_bracket'][cast(exercise_id % 4 as int) + 1] as c from exercises),
g as (select exercise_id, c, case when c = 'bare_digits' then 1 else 2 + floor({u('rows')} * 2) end as nr, case when c = 'bare_digits' then 1 + floor({u('digits')} * 3) else 2 + floor({u('cols')} * 2) end as nc from x where c like 'bare%')"""


@query(f"""with {GRID} select exercise_id, c as scene_case, cast(r.k as int) as row, cast(q.k as int) as col, 'main_' || cast(floor({u('digit', 'r.k', 'q.k')} * 10) as int) as label from g, {PLACES} r, {PLACES} q where r.k < nr and q.k < nc
union all select exercise_id, c, 0, 0, case c when 'standalone_bar' then 'result_bar' else 'div_bracket' end from x where c like 'standalone%'""")
def g07_isolated(t):
    """Bare digits, grids of digits and marks that stand alone."""
    cases = F.array(*[F.lit(c) for c in ("bare_digits", "bare_digit_grid", "standalone_bar", "standalone_bracket")])
    df = t.exercises.select("exercise_id", F.get(cases, (F.col("exercise_id") % 4).cast("int")).alias("scene_case"), F.array().cast(stages.TOKENS).alias("tokens"))
    return stages.exploded(df.withColumn("tokens", stages.cased(F.col("tokens"), F.col("scene_case"))), "scene_case")


@query(f"with {MUL}, e as (select exercise_id, max(col) filter (where label like 'main%') as edge from s group by exercise_id) select s.exercise_id, row, case when label like 'op%' and row = 2 then edge + 1 else col end as col, label from s join e on e.exercise_id = s.exercise_id")
def g07_product_operator_right(t):
    return stages.exploded(rows_of(t, "multiply").withColumn("tokens", stages.cased(F.col("tokens"), F.lit("multiplication_simple_op_right"))))


def erring(t, op: str, case: str, **knobs: float):
    return stages.exploded(stages.with_errors(rows_of(t, op).withColumn("scene_case", F.lit(case)), knobs))


def one_of(found: str, knob: str) -> str:
    """The drawn one among the tokens of a condition, in the order of row, column, label."""
    return f"select exercise_id, row, col, label from (select *, row_number() over (partition by exercise_id order by row, col, label) as k, count(*) over (partition by exercise_id) as n from s where {found}) q where k = floor({u(knob)} * n) + 1"


SAME = "o.exercise_id = s.exercise_id and o.row = s.row and o.col = s.col and o.label = s.label"


@query(f"""with {SUB}, o as ({one_of("row = 4 and label like 'main%'", 'result_place')}) select s.exercise_id, s.row, s.col, case when o.label is not null and {u('wrong_result', id='s.exercise_id')} < 0.6
  then 'main_' || cast((cast(substring(s.label, 6) as int) + 1 + floor({u('result_digit', id='s.exercise_id')} * 9)) % 10 as int) else s.label end as label from s left join o on {SAME}""")
def g13_any_result_digit(t):
    """A drawn digit of the result is another one, in some exercises."""
    return erring(t, "subtract", "subtraction", wrong_result=0.6)


@query(f"""with {ADD}, o as ({one_of("label like 'op%' or label = 'result_bar'", 'structural_place')}) select s.exercise_id, s.row, s.col, s.label from s left join o on {SAME} where o.label is null or {u('missing_structural', id='s.exercise_id')} >= 0.5""")
def g13_missing_structural(t):
    return erring(t, "add", "addition", missing_structural=0.5)


@query(f"""with {MUL}, o as ({one_of("label like 'op%'", 'operator_place')}) select s.exercise_id, s.row, s.col, case when o.label is not null and {u('wrong_operator', id='s.exercise_id')} < 0.7
  then list_filter(['op_plus', 'op_minus', 'op_times', 'op_divide'], lambda v: v <> s.label)[cast(floor({u('operator_label', id='s.exercise_id')} * 3) as int) + 1] else s.label end as label from s left join o on {SAME}""")
def g13_any_operator(t):
    return erring(t, "multiply", "multiplication_multi", wrong_operator=0.7)


STEP_BARS = "select exercise_id, row from s where label = 'result_bar'"


@query(f"""with {LONG}, m as (select exercise_id, row, min(col) as c from s where label like 'main%' group by exercise_id, row)
select * from s union all select m.exercise_id, m.row, m.c - 1, 'op_minus' from m join ({STEP_BARS}) b on b.exercise_id = m.exercise_id and b.row = m.row + 1 where {u('step_minus', 'b.row', id='m.exercise_id')} < 0.35""")
def g13_step_minus(t):
    """A minus left of the product of some division steps."""
    return erring(t, "divide", "division_long", step_minus=0.35)


@query(f"""with {LONG}, m as (select exercise_id, row, col, cast(substring(label, 6) as int) as d from s where label like 'main%'),
k as (select p.exercise_id, p.row - 1 as row, p.col, p.d as taken, coalesce(o.d, 0) as over_ from m p join ({STEP_BARS}) b on b.exercise_id = p.exercise_id and b.row = p.row + 1 left join m o on o.exercise_id = p.exercise_id and o.row = p.row - 1 and o.col = p.col where {u('step_borrow', 'b.row', id='p.exercise_id')} < 0.8)
select * from s union all select exercise_id, row, col, 'borrow_' || over_ from k where taken > over_""")
def g13_step_borrow(t):
    return erring(t, "divide", "division_long", step_borrow=0.8)


@query(f"""with {MUL}, r as (select distinct exercise_id, row from s where label like 'main%') select s.* from s where label <> 'op_plus' or not exists (select 1 from r where r.exercise_id = s.exercise_id and r.row = s.row)""")
def g13_products_without_plus(t):
    return erring(t, "multiply", "multiplication_multi", product_plus=0.0)


@query(f"""with {MUL} select exercise_id, row, col, case when label = 'op_plus' and {u('product_operator', 'row')} < 0.4 then 'op_minus' else label end as label from s""")
def g13_product_minus(t):
    return erring(t, "multiply", "multiplication_multi", product_plus=1.0, product_wrong=0.4)


@query(f"""with {MUL}, e as (select exercise_id, min(row) as lo, max(row) as hi from s where label = 'result_bar' group by exercise_id), o as (select distinct exercise_id, row from s where label like 'op%'),
h as (select s.exercise_id, s.row, min(col) - 1 as col from s join e on e.exercise_id = s.exercise_id where label like 'main%' and row > lo and row < hi group by s.exercise_id, s.row)
select * from s union all select h.exercise_id, h.row, h.col, case when {u('helper_sign', 'h.row', id='h.exercise_id')} < 0.5 then 'op_plus' else 'op_minus' end from h anti join o on o.exercise_id = h.exercise_id and o.row = h.row where {u('helper', 'h.row', id='h.exercise_id')} < 0.6""")
def g13_helper_operators(t):
    """Signs beside rows between the bars that have none."""
    return erring(t, "multiply", "multiplication_multi", helper_operator=0.6)


@query(f"""with {LONG}, e as (select exercise_id, min(row) as lo, max(row) as hi from s where label = 'result_bar' group by exercise_id), b as ({STEP_BARS}),
q as (select s.exercise_id, s.row from s join e on e.exercise_id = s.exercise_id where label like 'main%' and row > lo and row < hi union select exercise_id, row - 1 from b),
h as (select s.exercise_id, s.row, min(col) - 1 as col from s join q on q.exercise_id = s.exercise_id and q.row = s.row where label like 'main%' group by s.exercise_id, s.row)
select * from s union all select exercise_id, row, col, case when {u('helper_sign', 'row')} < 0.5 then 'op_plus' else 'op_minus' end from h where {u('helper', 'row')} < 0.5""")
def g13_helper_operators_of_steps(t):
    return erring(t, "divide", "division_long", helper_operator=0.5)


@query(f"""with {ADD}, m as (select *, label like 'carry%' as c from s), k as (select * from m where not c or {u('missing_mark', 'row', 'col', 'label')} >= 0.15),
h as (select exercise_id, row, case when c and {u('shifted_carry', 'row', 'col', 'label')} < 0.4 then col + case when {u('shift_side', 'row', 'col', 'label')} < 0.5 then -1 else 1 end else col end as col, label, c from k)
select exercise_id, row, col, case when c and {u('wrong_mark', 'row', 'col', 'label')} < 0.3 then 'carry_' || cast((cast(substring(label, 7) as int) + 1 + floor({u('mark_digit', 'row', 'col', 'label')} * 9)) % 10 as int) else label end as label from h""")
def g13_carries(t):
    """Carry marks missing, moved and misread."""
    return erring(t, "add", "addition", missing_carry=0.15, shifted_carry=0.4, wrong_carry=0.3)


@query(f"""with {SUB}, m as (select *, label like 'borrow%' as c from s), k as (select * from m where not c or {u('missing_mark', 'row', 'col', 'label')} >= 0.25)
select exercise_id, row, col, case when c and {u('wrong_mark', 'row', 'col', 'label')} < 0.3 then 'borrow_' || cast((cast(substring(label, 8) as int) + 1 + floor({u('mark_digit', 'row', 'col', 'label')} * 9)) % 10 as int) else label end as label from k""")
def g13_borrows(t):
    return erring(t, "subtract", "subtraction", missing_borrow=0.25, wrong_borrow=0.3)


@query(f"""with {MUL}, e as (select exercise_id, min(row) as lo, max(row) as hi from s where label = 'result_bar' group by exercise_id),
i as (select distinct s.exercise_id, row from s join e on e.exercise_id = s.exercise_id where label like 'main%' and row > lo and row < hi),
p as (select *, row_number() over (partition by exercise_id order by row) as k, count(*) over (partition by exercise_id) - 1 as n from i), d as (select exercise_id, row from p where n > 0 and k = floor({u('partial_place')} * n) + 1 and {u('missing_partial')} < 0.7)
select s.* from s left join d on d.exercise_id = s.exercise_id where d.row is null or s.row not in (d.row, d.row - 1)""")
def g13_missing_partial(t):
    """A partial product is missing, with the carries above it."""
    return erring(t, "multiply", "multiplication_multi", missing_partial=0.7)
