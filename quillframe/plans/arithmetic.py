"""Queries over exercises: worked solutions, variants, grading."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import grade, worked
from .registry import query

# SQL: digits of a number as (k, d) with k = place from the units; widths; carries and borrows place by place.
PLACES = "(select unnest(range(0, 7)) as k)"
P10 = "cast(pow(10, k) as bigint)"
WIDTH = "length(cast({0} as varchar))"


def number_sql(source: str, n: str, row: str, right: str, width: str | None = None) -> str:
    """Tokens of number n that ends in column right."""
    return f"select exercise_id, cast({row} as int) as row, cast({right} - k as int) as col, 'main_' || (({n}) // {P10} % 10) as label from {source}, {PLACES} z where k < {width or WIDTH.format(f'({n})')}"


ADD = f"""x as (select exercise_id, a, b, a + b as r, greatest({WIDTH.format('a')}, {WIDTH.format('b')}, {WIDTH.format('(a + b)')}) as w from exercises where op = 'add'),
s as ({number_sql('x', 'a', '1', '(w + 1)')} union all {number_sql('x', 'b', '2', '(w + 1)')} union all {number_sql('x', 'r', '4', '(w + 1)')}
  union all select exercise_id, 2, 1, 'op_plus' from x union all select exercise_id, 3, 1, 'result_bar' from x
  union all select exercise_id, 0, cast(w + 1 - k as int), 'carry_1' from x, {PLACES} z where k between 1 and w - 1 and a % {P10} + b % {P10} >= {P10})"""


@query(f"with {ADD} select * from s")
def g02_addition(t):
    return worked.addition(t.exercises.where("op = 'add'"))


# The borrow chain step by step, from the units to the left: work digit after lending, marks as they are written.
SUB = f"""x as (select exercise_id, greatest(a, b) as a, least(a, b) as b from exercises where op = 'subtract'), y as (select *, a - b as r, {WIDTH.format('a')} as w from x),
q as (select exercise_id, w, k, a // {P10} % 10 as d, a % cast(pow(10, k + 1) as bigint) < b % cast(pow(10, k + 1) as bigint) as lack, k > 0 and a % {P10} < b % {P10} as lent from y, {PLACES} z where k < w),
s as ({number_sql('y', 'a', '1', '(w + 1)')} union all {number_sql('y', 'b', '2', '(w + 1)')} union all {number_sql('y', 'r', '4', '(w + 1)', 'w')}
  union all select exercise_id, 2, 1, 'op_minus' from y union all select exercise_id, 3, 1, 'result_bar' from y
  union all select exercise_id, 0, cast(w + 1 - k as int), 'borrow_' || case when d = 0 then 9 else d - 1 end from q where lent
  union all select exercise_id, 0, cast(w + 1 - k as int), 'borrow_1' from q where lack and not (d = 0 and lent) and k < w - 1)"""


@query(f"with {SUB} select * from s")
def g03_subtraction(t):
    return worked.subtraction(t.exercises.where("op = 'subtract'"))


@query(f"""with x as (select exercise_id, a, b, a * b as r, {WIDTH.format('b')} as n, greatest({WIDTH.format('a')}, {WIDTH.format('b')}, {WIDTH.format('(a * b)')}) + 1 as right from exercises where op = 'multiply'),
p as (select x.*, k as i, b // {P10} % 10 as m from x, {PLACES} z where k < n), f as (select *, a * m * cast(pow(10, i) as bigint) as whole from p)
select exercise_id, count(*) as n_products, cast(max(r) as bigint) as product, cast(sum(whole) as bigint) as total from f group by exercise_id""")
def g04_partial_products(t):
    df = t.exercises.where("op = 'multiply'")
    tokens = worked.multiplication(df)
    rows = tokens.where("label like 'main%'").groupBy("exercise_id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "label"))), lambda x: F.substr(x["label"], F.lit(6))), "").cast("long").alias("n"))
    last = rows.groupBy("exercise_id").agg(F.max("row").alias("last"), F.max_by("n", "row").alias("product"))
    long = df.withColumn("k", F.length(F.col("b").cast("string")))
    parts = rows.join(last, "exercise_id").join(long.select("exercise_id", "k", "b", "a"), "exercise_id")
    many = parts.where("k > 1 and row > 2 and row < last").groupBy("exercise_id").agg(F.count(F.lit(1)).alias("n_products"), F.max("product").alias("product"), F.sum("n").alias("total"))
    one = parts.where("k = 1 and row = last").select("exercise_id", F.lit(1).cast("long").alias("n_products"), "product", F.col("n").alias("total"))
    return many.unionByName(one)


MUL = f"""x as (select exercise_id, a, b, a * b as r, {WIDTH.format('b')} as n, greatest({WIDTH.format('a')}, {WIDTH.format('b')}, {WIDTH.format('(a * b)')}) + 1 as rt from exercises where op = 'multiply'),
one as (select * from x where n = 1), many as (select * from x where n > 1),
ps as (select many.*, k as i, b // {P10} % 10 as m, a * (b // {P10} % 10) as part, a * (b // {P10} % 10) * {P10} as whole, {WIDTH.format(f'(a * (b // {P10} % 10))')} + k as len from many, {PLACES} z where k < n),
sc as (select exercise_id, any_value(rt) as rt, any_value(3 + n * 2) as row, z.k, cast(sum(case when i <= z.k then part % cast(pow(10, z.k + 1 - i) as bigint) * cast(pow(10, i) as bigint) else 0 end) as bigint) // cast(pow(10, z.k + 1) as bigint) as c, max(len) as len
  from ps, {PLACES} z group by exercise_id, z.k),
s1 as (select exercise_id, 0 as row, cast(rt - k - 1 as int) as col, 'carry_' || (a % cast(pow(10, k + 1) as bigint) * b // cast(pow(10, k + 1) as bigint)) as label from one, {PLACES} z where k < {WIDTH.format('a')} - 1 and a % cast(pow(10, k + 1) as bigint) * b >= pow(10, k + 1)
  union all {number_sql('one', 'a', '1', 'rt')} union all {number_sql('one', 'b', '2', 'rt')} union all {number_sql('one', 'r', '4', 'rt')} union all select exercise_id, 2, 1, 'op_times' from one union all select exercise_id, 3, 1, 'result_bar' from one),
s2 as ({number_sql('many', 'a', '0', 'rt')} union all {number_sql('many', 'b', '1', 'rt')} union all {number_sql('many', 'r', '5 + n * 2', 'rt')} union all select exercise_id, 1, 1, 'op_times' from many union all select exercise_id, 2, 1, 'result_bar' from many union all select exercise_id, cast(4 + n * 2 as int), 1, 'result_bar' from many
  union all select exercise_id, cast(3 + i * 2 as int), cast(rt - i - k - 1 as int), 'carry_' || (a % cast(pow(10, k + 1) as bigint) * m // cast(pow(10, k + 1) as bigint)) from ps, {PLACES} z where k < {WIDTH.format('a')} - 1 and a % cast(pow(10, k + 1) as bigint) * m >= pow(10, k + 1)
  union all {number_sql('ps', 'whole', '4 + i * 2', 'rt', 'len')} union all select exercise_id, cast(4 + i * 2 as int), cast(rt - len as int), 'op_plus' from ps where i > 0
  union all select exercise_id, cast(row as int), cast(rt - k - 1 as int), 'carry_' || c from sc where k < len and c > 0 and rt - k > 2),
free as (select many.exercise_id, 3 + z.k * 2 as row from many, {PLACES} z where z.k <= n and not exists (select 1 from s2 where s2.exercise_id = many.exercise_id and s2.row = 3 + z.k * 2)),
s as (select * from s1 union all select s2.exercise_id, cast(s2.row - count(free.row) as int), col, label from s2 left join free on free.exercise_id = s2.exercise_id and free.row < s2.row group by s2.exercise_id, s2.row, col, label)"""


@query(f"with {MUL} select * from s")
def g04_multiplication(t):
    return worked.multiplication(t.exercises.where("op = 'multiply'"))


DIV = f"""x as (select exercise_id, a, b, {WIDTH.format('a')} as w from exercises where op = 'divide' and b > 0),
c as (select *, w - 1 - k as col, a // {P10} as pre, b * (a // {P10} // b) as taken, k from x, {PLACES} z where k < w),
st as (select *, row_number() over (partition by exercise_id order by col) - 1 as step, pre // b % 10 as q, pre % b as r from c where pre >= b or k = 0)"""


@query(f"with {DIV} select exercise_id, cast(step as int) as step, cast(q as bigint) as quotient_digit, cast(q * b as bigint) as product, cast(r as bigint) as remainder, cast(col as int) as right_col from st")
def g05_division_steps(t):
    return worked.division_steps(t.exercises.where("op = 'divide'")).drop("a", "b")


@query(f"""with {DIV}, y as (select exercise_id, max(a // b) as q, max(a % b) as r from st group by exercise_id)
select exercise_id, cast(q as bigint) as quotient, cast(r as bigint) as last_remainder from y""")
def g05_long_division(t):
    tokens = worked.long_division(t.exercises.where("op = 'divide'"))
    number = lambda df: df.groupBy("exercise_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "label"))), lambda x: F.substr(x["label"], F.lit(6))), "").cast("long").alias("n"))
    last = tokens.groupBy("exercise_id").agg(F.max("row").alias("row"))
    return number(tokens.where("row = 0")).withColumnRenamed("n", "quotient").join(number(tokens.join(last, ["exercise_id", "row"])).withColumnRenamed("n", "last_remainder"), "exercise_id")


@query(f"""with x as (select exercise_id, a, b, a // b as r, {WIDTH.format('a')} as wa, {WIDTH.format('b')} as wb from exercises where op = 'divide' and b > 0 and a % b = 0)
{number_sql('x', 'a', '0', '(wa - 1)')} union all {number_sql('x', 'b', '0', '(wa + wb)')} union all {number_sql('x', 'r', '2', '(wa + wb)')} union all select exercise_id, 0, cast(wa as int), 'op_divide' from x union all select exercise_id, 1, 0, 'result_bar' from x""")
def g06_simple_division(t):
    return worked.simple_division(t.exercises.where("op = 'divide'"))


@query(f"""with x as (select exercise_id, a, b, greatest(a, b) as h, least(a, b) as l, greatest({WIDTH.format('a')}, {WIDTH.format('b')}) as w, least({WIDTH.format('a')}, {WIDTH.format('b')}) as n from exercises),
c as (select exercise_id, n, count(*) filter (where a % {P10} + b % {P10} >= {P10}) as ca, count(*) filter (where h % {P10} < l % {P10}) as bo from x, {PLACES} z where k between 1 and w group by exercise_id, n)
select exercise_id, cast(ca as int) as n_carries, cast(bo as int) as n_borrows, ca = 0 as no_carries, ca >= n as dense_carries, bo >= 1 as forced_borrows from c""")
def g08_difficulty(t):
    return worked.difficulty(t.exercises).select("exercise_id", "n_carries", "n_borrows", "no_carries", "dense_carries", "forced_borrows")


def added(t):
    return worked.addition(t.exercises.where("op = 'add'"))


@query(f"with {ADD} select * from s where row < 3")
def g10_without_bar(t):
    return worked.without_bar(added(t))


@query(f"with {ADD}, m as (select *, row = 4 as r, count(*) over (partition by exercise_id, row = 4) as n, row_number() over (partition by exercise_id, row = 4 order by col desc) as p from s) select exercise_id, row, col, label from m where not r or p > case when n <= 1 then 0 else least(greatest(1, round_even(n * 0.5, 0)), n - 1) end")
def g10_partial_result(t):
    return worked.partial_result(added(t))


@query(f"with {SUB} select * from s where label not like 'borrow%'")
def g10_without_marks(t):
    return worked.without_marks(worked.subtraction(t.exercises.where("op = 'subtract'")))


@query(f"with {ADD}, m as (select *, max(case when label like 'main%' then col end) over (partition by exercise_id) as c from s) select exercise_id, row, case when label = 'op_plus' then c + 1 else col end as col, label from m")
def g07_operator_right(t):
    return worked.operator_on_the_right(added(t))


@query(f"with {ADD}, m as (select *, max(col) over (partition by exercise_id) as c from s) select exercise_id, row, col, case when row = 4 and col = c then 'main_' || ((cast(substring(label, 6) as int) + 1) % 10) else label end as label from m")
def g13_wrong_result(t):
    return worked.injected(added(t), "wrong_result")


@query(f"with {ADD} select exercise_id, row, col, case when label = 'op_plus' then 'op_minus' else label end as label from s")
def g13_wrong_operator(t):
    return worked.injected(added(t), "wrong_operator")


@query(f"with {ADD}, y as (select exercise_id, (a * 7) % 1000 as n from x), m as (select s.*, n, max(col) over (partition by s.exercise_id) - col as p from s join y on y.exercise_id = s.exercise_id) select exercise_id, row, col, case when row = 4 and p < length(cast(n as varchar)) then 'main_' || (n // cast(pow(10, p) as bigint) % 10) else label end as label from m")
def g12_result_override(t):
    return worked.result_override(added(t), t.exercises.select("exercise_id", ((F.col("a") * 7) % 1000).alias("result")))


@query(f"with {SUB}, u as (select exercise_id, col, substring(label, 6) as d from s where row = 1) select exercise_id, row, col, 0 as sub_pos, label from s where not (row = 0 and label = 'borrow_1') union all select s.exercise_id, s.row, s.col, v.i, case when v.i = 0 then 'borrow_1' else 'borrow_' || u.d end from s join u on u.exercise_id = s.exercise_id and u.col = s.col, (select unnest([0, 1]) as i) v where s.row = 0 and label = 'borrow_1'")
def g09_two_in_a_cell(t):
    return worked.two_in_a_cell(worked.subtraction(t.exercises.where("op = 'subtract'")))


# ---- grading ----

EXPECTED = f"""{ADD}, expected as (select exercise_id, col as x, 10 - row as y, case when label = 'result_bar' then '_' when label = 'op_plus' then '+' else substring(label, length(label)) end as c,
    case when row = 0 then 'carry' when label = 'op_plus' then 'operator' when row = 3 then 'bar' when row = 4 then 'answer' else 'operand' end as role, row between 1 and 3 as given from s),
submitted as (select exercise_id as submission_id, exercise_id, 't' || lpad(cast(row_number() over (partition by exercise_id order by y, x) as varchar), 2, '0') as token_id,
    case when role = 'answer' and (exercise_id * 3 + x) % 11 = 0 then cast((cast(c as int) + 1) % 10 as varchar) else c end as c,
    cast(x + case when role = 'answer' then exercise_id % 2 else 0 end as int) as x, cast(y + exercise_id % 3 - 1 as int) as y, case when role = 'carry' then 'OVERFLOW' else 'SYMBOL' end as type
  from expected where role <> 'bar' and not (not given and (exercise_id + x) % 7 = 0)
  union all select exercise_id, exercise_id, 't99', '8', 0, cast(5 + exercise_id % 3 as int), 'SYMBOL' from x where exercise_id % 5 = 2)"""


def expected(t):
    k, row = F.col("label"), F.col("row")
    c = F.when(k == "result_bar", "_").when(k == "op_plus", "+").otherwise(F.substr(k, F.length(k)))
    role = F.when(row == 0, "carry").when(k == "op_plus", "operator").when(row == 3, "bar").when(row == 4, "answer").otherwise("operand")
    return added(t).select("exercise_id", F.col("col").alias("x"), (10 - row).alias("y"), c.alias("c"), role.alias("role"), row.between(1, 3).alias("given"))


def submitted(t):
    df = expected(t).where("role <> 'bar' and not (not given and (exercise_id + x) % 7 = 0)")
    n = F.row_number().over(W.partitionBy("exercise_id").orderBy("y", "x"))
    wrong = (F.col("role") == "answer") & ((F.col("exercise_id") * 3 + F.col("x")) % 11 == 0)
    own = df.select(
        F.col("exercise_id").alias("submission_id"), "exercise_id", F.concat(F.lit("t"), F.lpad(n.cast("string"), 2, "0")).alias("token_id"),
        F.when(wrong, ((F.col("c").try_cast("int") + 1) % 10).cast("string")).otherwise(F.col("c")).alias("c"),
        (F.col("x") + F.when(F.col("role") == "answer", F.col("exercise_id") % 2).otherwise(0)).cast("int").alias("x"), (F.col("y") + F.col("exercise_id") % 3 - 1).cast("int").alias("y"),
        F.when(F.col("role") == "carry", "OVERFLOW").otherwise("SYMBOL").alias("type"), F.array().cast("array<string>").alias("tags"),
    )
    # A stray digit far to the left of some answers.
    stray = t.exercises.where("op = 'add' and exercise_id % 5 = 2").select(
        F.col("exercise_id").alias("submission_id"), "exercise_id", F.lit("t99").alias("token_id"), F.lit("8").alias("c"), F.lit(0).alias("x"), (5 + F.col("exercise_id") % 3).cast("int").alias("y"),
        F.lit("SYMBOL").alias("type"), F.array().cast("array<string>").alias("tags"),
    )
    return own.unionByName(stray)


SHIFT = """v as (select u.submission_id, e.y - u.y as dy, count(*) as n from (select distinct submission_id, exercise_id, y from submitted where c not in ('', '_')) u
    join (select exercise_id, y from expected group by exercise_id, y having not bool_and(c in ('', '_'))) e on e.exercise_id = u.exercise_id where abs(e.y - u.y) <= 6 group by 1, 2),
sh as (select submission_id, dy from (select *, row_number() over (partition by submission_id order by n desc, abs(dy), dy) as r from v) q where r = 1)"""
MATCH = f"""{EXPECTED}, {SHIFT}, lv as (select exercise_id, y as ey, bool_and(c in ('', '_')) as bar from expected group by exercise_id, y),
pl as (select * from (select u.*, lv.ey, row_number() over (partition by u.submission_id, token_id order by case when (u.c in ('', '_')) = lv.bar then 0 else 1 end, abs(u.y + coalesce(dy, 0) - lv.ey), lv.ey) as r
    from submitted u left join sh on sh.submission_id = u.submission_id join lv on lv.exercise_id = u.exercise_id) q where r = 1),
sl as (select *, max(x) over (partition by submission_id, ey) - x as slot from pl), so as (select *, row_number() over (partition by submission_id, ey, slot order by token_id desc) as k from sl),
es as (select *, max(x) over (partition by exercise_id, y) - x as slot from expected),
mt as (select so.submission_id, so.exercise_id, so.token_id, so.c, so.x, so.y, case when k = 1 then es.x end as ex, case when k = 1 then es.y end as ey from so left join es on es.exercise_id = so.exercise_id and es.y = so.ey and es.slot = so.slot)"""
CELLS = f"""{MATCH}, gx as (select *, min(x) over (partition by exercise_id, y, role, isl) as group_x from (select *, x - row_number() over (partition by exercise_id, y, role order by x) as isl from expected) q),
ce as (select sub.submission_id, gx.*, mt.c as got, mt.token_id, coalesce(mt.c = gx.c, false) as ok, coalesce(mt.c <> gx.c, false) as bad from (select distinct submission_id, exercise_id from submitted) sub join gx on gx.exercise_id = sub.exercise_id
    left join mt on mt.submission_id = sub.submission_id and mt.ex = gx.x and mt.ey = gx.y),
cw as (select *, bool_and(ok) over w as all_ok, bool_or(bad) over w as any_bad, bool_or(got is not null) over w as any_got, bool_and(given) over w as all_given, role = 'carry' and not given as step from ce window w as (partition by submission_id, y, role, group_x)),
gr as (select submission_id, exercise_id, x, y, c, role, given, group_x, got, token_id, any_bad as group_wrong, step or not given as required, case when step then any_got else all_ok and not given end as matched,
    case when step then case when any_got then 'OK' else 'MISSING' end when all_ok then 'OK' when any_bad then case when bad then 'ERROR' when got is null then 'MISSING' else 'OK' end when all_given then 'OK' else 'MISSING' end as status from cw)"""


@query(f"with {EXPECTED}, {SHIFT} select distinct u.submission_id, cast(coalesce(dy, 0) as int) as dy from submitted u left join sh on sh.submission_id = u.submission_id")
def j13_row_shift(t):
    return grade.row_shift(submitted(t), expected(t)).withColumn("dy", F.col("dy").cast("int"))


@query(f"with {MATCH} select submission_id, token_id, c, cast(ex as int) as ex, cast(ey as int) as ey from mt")
def j13_structure_match(t):
    return grade.structure_match(submitted(t), expected(t)).select("submission_id", "token_id", "c", F.col("ex").cast("int").alias("ex"), F.col("ey").cast("int").alias("ey"))


@query(f"with {CELLS} select exercise_id, x, y, role, group_x from gx")
def w04_groups(t):
    return grade.groups(expected(t)).select("exercise_id", "x", "y", "role", "group_x")


def cells(t):
    return grade.graded_cells(submitted(t), expected(t))


@query(f"with {CELLS} select submission_id, x, y, role, status, required, matched, got from gr")
def a40_graded_cells(t):
    return cells(t).select("submission_id", "x", "y", "role", "status", "required", "matched", "got")


@query(f"""with {CELLS} select submission_id, role, group_x as left_x, y, count(*) as width, string_agg(c, '' order by x) as num, status from gr where not group_wrong or role = 'carry' group by submission_id, role, y, group_x, status
union all select submission_id, role, x, y, 1, c, status from gr where group_wrong and status <> 'OK'""")
def a40_graded_elements(t):
    return grade.graded_elements(cells(t)).drop("token_ids")


PROGRESS = "p as (select submission_id, count(*) filter (where matched and required) as matched, count(*) filter (where required) as total from gr group by submission_id)"


@query(f"with {CELLS}, {PROGRESS} select submission_id, matched, total, round(case when total > 0 then matched / total else 1 end, 6) as progress, total = 0 or matched = total as finished from p")
def a41_progress(t):
    return grade.progress(cells(t)).withColumn("progress", F.round("progress", 6))


@query(f"""with {CELLS}, {PROGRESS}, f as (select submission_id, bool_or(status = 'ERROR' and role = 'answer') as e, bool_or(status = 'MISSING' and role = 'answer') as m, bool_or(status = 'MISSING' and role = 'carry') as s, bool_or(status = 'ERROR') as ae from gr group by submission_id)
select f.submission_id, case when e then 'mistake' when m then 'incomplete' when s then 'missing_step' when matched = total then 'correct' else 'incomplete' end as outcome,
  case when matched = total then 'correct' when ae then 'mistake' else 'incomplete' end as short_outcome from f join p on p.submission_id = f.submission_id""")
def a42_verdicts(t):
    return grade.verdicts(cells(t)).drop("progress")


@query(f"""with {CELLS}, h as (select submission_id, role, y, group_x, max(x) as lx from gr where status = 'MISSING' and not group_wrong and not given group by submission_id, role, y, group_x)
select submission_id, group_x as left_x, y, role from (select *, row_number() over (partition by submission_id order by abs(y - 6), -lx, y, group_x, role) as r from h) q where r = 1""")
def t02_next_hint(t):
    rows = expected(t).select("exercise_id", F.lit(6).alias("answer_y")).distinct()
    return grade.next_hint(cells(t), rows)


@query(f"with {MATCH} select submission_id, token_id, c, cast(x as int) as x, cast(y as int) as y from mt where ex is null and c not in ('', '_') and y <> 10")
def a40_extras(t):
    return grade.extras(submitted(t), expected(t)).where("y <> 10").drop("exercise_id")


@query(f"""with {EXPECTED}, g as (select exercise_id, x, y, c from expected where given), u as (select s.submission_id, s.x, s.y, s.c, 'child' as origin from submitted s left join g on g.exercise_id = s.exercise_id and g.x = s.x and g.y = s.y where g.x is null)
select * from u union all select d.submission_id, g.x, g.y, g.c, 'given' from (select distinct submission_id, exercise_id from submitted) d join g on g.exercise_id = d.exercise_id""")
def j21_with_given(t):
    return grade.with_given(submitted(t), expected(t)).select("submission_id", "x", "y", "c", F.when(F.col("token_id").startswith("G"), "given").otherwise("child").alias("origin"))


@query(f"""with {EXPECTED} select exercise_id, x, y, c, cast(floor(x * 40.5) as int) as x0, cast(floor((10 - y) * 40.5) as int) as y0, cast(floor(x * 40.5 + 40.5) as int) as x1, cast(floor((10 - y) * 40.5 + 40.5) as int) as y1,
  case role when 'bar' then 'result_bar' when 'operator' then 'op_plus' else 'main_' || c end as fine_label, case role when 'bar' then 'result_bar' when 'operator' then 'operator' else 'digit_main' end as coarse_label from expected where given""")
def e05_given_prior(t):
    nodes, _ = grade.given_prior(expected(t), 40.5, 0.0, 0.0, 10)
    return nodes


@query(f"with {EXPECTED} select cast(exercise_id as varchar) || '/' || x || '/' || y as path, 'not_given' as kind, count(*) as n from expected where not given group by all")
def e05_refused_cells(t):
    _, refused = grade.given_prior(expected(t).withColumn("given", F.col("given") | F.col("role").isin("carry", "answer")), 40.5, 0.0, 0.0, 10)
    return refused.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EXPECTED} select exercise_id, x, y, c, case when role = 'carry' then 'OVERFLOW' else 'SYMBOL' end as type, given as fixed from expected")
def e04_as_submission(t):
    return grade.as_submission(expected(t)).select("exercise_id", "x", "y", "c", "type", (F.size("tags") > 0).alias("fixed"))


@query(f"with {MATCH}, d as (select submission_id, count(ex) as matched, count(*) - count(ex) as unmatched, count(distinct case when ex is not null then (x - ex) || ',' || (y - ey) end) as n, min(x - ex) as dx, min(y - ey) as dy from mt group by submission_id) select submission_id, matched, unmatched, n = 1 and dx = 0 and dy = 0 as aligned, cast(case when n = 1 and not (dx = 0 and dy = 0) then dx end as int) as dx, cast(case when n = 1 and not (dx = 0 and dy = 0) then dy end as int) as dy from d")
def a33_calibration(t):
    sent = submitted(t)
    found = grade.structure_match(sent, expected(t)).where("ex is not null").groupBy("submission_id", "ex", "ey").agg(F.collect_list("token_id").alias("token_ids"))
    out = grade.calibration_report(sent, found)
    return out.withColumns({"dx": F.col("dx").cast("int"), "dy": F.col("dy").cast("int")})


@query(f"with {EXPECTED}, b as (select exercise_id, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from expected group by exercise_id), p as (select *, cast(floor(448.0 / greatest(max_x - min_x + 1, max_y - min_y + 1)) as bigint) as pitch from b) select *, (512 - pitch * (max_x - min_x + 1)) / 2 as origin_x, (512 - pitch * (max_y - min_y + 1)) / 2 as origin_y from p")
def a31_layout_bounds(t):
    return grade.layout_bounds(expected(t))


@query(f"""with {EXPECTED}, s2 as (select exercise_id, x, y, c, role from expected), b as (select *, min(case when c = '_' then y end) over (partition by exercise_id) as bar_y from s2)
select exercise_id, x, y, c, role, role in ('operand', 'operator') as given from b""")
def e01_derived_exercise(t):
    df = expected(t)
    tags = F.when(F.col("role").isin("operand", "operator"), F.array(F.lit("AUTOSHOW"))).otherwise(F.array().cast("array<string>"))
    tokens = df.select("exercise_id", "x", "y", "c", tags.alias("tags"), F.when(F.col("role") == "carry", "OVERFLOW").otherwise("SYMBOL").alias("type"))
    return grade.derived_exercise(tokens).drop("answer_y")


@query(f"with {MATCH} select submission_id, ey as element_id, cast(min(x) * 40.0 as double) as x0, cast(min(y) * 40.0 as double) as y0, cast(max(x) * 40.0 + 40 as double) as x1, cast(max(y) * 40.0 + 40 as double) as y1 from mt where ex is not null group by submission_id, ey")
def j19_union_boxes(t):
    sent = submitted(t)
    found = grade.structure_match(sent, expected(t)).where("ex is not null").groupBy("submission_id", F.col("ey").alias("element_id")).agg(F.collect_list("token_id").alias("token_ids"))
    boxes = sent.select("submission_id", "token_id", (F.col("x") * 40.0).alias("x0"), (F.col("y") * 40.0).alias("y0"), (F.col("x") * 40.0 + 40).alias("x1"), (F.col("y") * 40.0 + 40).alias("y1"))
    return grade.union_boxes(found, boxes)


@query(f"""with g as (select l_orderkey as submission_id, l_linenumber % 3 as cluster_id, l_orderkey || '-' || lpad(cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) as varchar), 3, '0') as token_id, cast(l_partkey % 10 as varchar) as c, (l_partkey * 7 % 400) + 0.5 as cx, (l_suppkey * 3 % 400) + 0.25 as cy from lineitem),
ty as (select distinct submission_id, 2 as x, 3 as y, 'REPLACE' as type from g union all select distinct submission_id, 6, 3, 'OVERFLOW' from g),
m as (select submission_id, cluster_id, avg(cx) as mx, avg(cy) as my from g group by 1, 2), b as (select * from (select m.*, ty.x, ty.y, ty.type, abs(mx - (x + 0.5) * 40) <= 60 and abs(my - (y + 0.5) * 40) <= 60 as fits,
    row_number() over (partition by m.submission_id, cluster_id order by (mx - (x + 0.5) * 40) * (mx - (x + 0.5) * 40) + (my - (y + 0.5) * 40) * (my - (y + 0.5) * 40), y, x) as r from m join ty on ty.submission_id = m.submission_id) q where r = 1)
select g.submission_id, min(g.token_id) as first_id, string_agg(c, '' order by cx, token_id) as c, b.x, b.y, b.type from g join b on b.submission_id = g.submission_id and b.cluster_id = g.cluster_id where fits group by g.submission_id, b.x, b.y, b.type
union all select g.submission_id, g.token_id, c, cast(floor(cx / 40) as int), cast(floor(cy / 40) as int), 'SYMBOL' from g join b on b.submission_id = g.submission_id and b.cluster_id = g.cluster_id where not fits""".replace("min(g.token_id) as first_id", "arg_min(g.token_id, struct_pack(a := cx, b := token_id)) as token_id"))
def j25_snapped(t):
    w = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    g = t.lineitem.select(F.col("l_orderkey").alias("submission_id"), (F.col("l_linenumber") % 3).alias("cluster_id"), F.concat_ws("-", "l_orderkey", F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("token_id"), (F.col("l_partkey") % 10).cast("string").alias("c"), (F.col("l_partkey") * 7 % 400 + 0.5).alias("cx"), (F.col("l_suppkey") * 3 % 400 + 0.25).alias("cy"))
    typed = g.select("submission_id").distinct().select("submission_id", F.explode(F.array(F.struct(F.lit(2).alias("x"), F.lit(3).alias("y"), F.lit("REPLACE").alias("type")), F.struct(F.lit(6).alias("x"), F.lit(3).alias("y"), F.lit("OVERFLOW").alias("type")))).alias("s")).select("submission_id", "s.*")
    return grade.snapped(g, typed, 40.0)


@query("""with g as (select l_orderkey as submission_id, l_orderkey || '-' || lpad(cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) as varchar), 3, '0') as token_id, cast(l_partkey % 10 as varchar) as c, l_linenumber % 3 as cluster_id, (l_partkey * 7 % 400) + 20.5 as cx, (l_suppkey * 3 % 400) + 20.25 as cy from lineitem),
p as (select *, cast(greatest(0, least(9, floor((cx - 12) / 40))) as int) as px, cast(greatest(0, least(9, floor((cy - 8) / 40))) as int) as py from g), m as (select submission_id, cluster_id, avg(cx) as mx, avg(cy) as my from p group by all),
ty as (select distinct submission_id, 2 as x, 3 as y, 'REPLACE' as type from g union all select distinct submission_id, 6, 3, 'OVERFLOW' from g),
b as (select * from (select m.*, ty.x, ty.y, ty.type, abs(mx - (x + 0.5) * 40 - 12) <= 60 and abs(my - (y + 0.5) * 40 - 8) <= 60 as fits, row_number() over (partition by m.submission_id, cluster_id order by (mx - (x + 0.5) * 40 - 12) * (mx - (x + 0.5) * 40 - 12) + (my - (y + 0.5) * 40 - 8) * (my - (y + 0.5) * 40 - 8), y, x) as r from m join ty using (submission_id)) q where r = 1),
f as (select p.submission_id, p.token_id, p.c, cx, case when fits then b.x else px end as x, case when fits then b.y else py end as y, case when fits then b.type else 'SYMBOL' end as type, fits from p join b on b.submission_id = p.submission_id and b.cluster_id = p.cluster_id)
select submission_id, min(token_id) as token_id, string_agg(c, '' order by cx, token_id) as c, x, y, type from f where fits group by all union all select submission_id, token_id, c, x, y, type from f where not fits""".replace("min(token_id) as token_id", "arg_min(token_id, struct_pack(a := cx, b := token_id)) as token_id"))
def e03_tokens_to_grid(t):
    """Placed glyphs to grid tokens: pixels to cells, then clusters to the typed cell nearest them."""
    w = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    g = t.lineitem.select(F.col("l_orderkey").alias("submission_id"), F.concat_ws("-", "l_orderkey", F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("token_id"), (F.col("l_partkey") % 10).cast("string").alias("c"), (F.col("l_linenumber") % 3).alias("cluster_id"), (F.col("l_partkey") * 7 % 400 + 20.5).alias("cx"), (F.col("l_suppkey") * 3 % 400 + 20.25).alias("cy"))
    typed = g.select("submission_id").distinct().select("submission_id", F.explode(F.array(F.struct(F.lit(2).alias("x"), F.lit(3).alias("y"), F.lit("REPLACE").alias("type")), F.struct(F.lit(6).alias("x"), F.lit(3).alias("y"), F.lit("OVERFLOW").alias("type")))).alias("s")).select("submission_id", "s.*")
    return grade.tokens_to_grid(g, typed, 40.0, 12.0, 8.0, 10)
