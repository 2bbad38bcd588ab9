"""Queries over pixel and component tables, and reports composed of several operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import ontology as o
from ..operators import assembly, cluster, evaluate, grade, graph, latency, match, pixels, quality, runs, worked
from .arithmetic import ADD, CELLS, MATCH, PROGRESS, SHIFT, added, cells, expected, submitted
from .datasets import LABELS, SPLIT, assets
from .registry import query
from .scenes import MACRO, MEANS, SAMPLES, samples

PIXELS = "select distinct l_orderkey as scene_id, l_partkey * 13 % 512 as y, l_suppkey * 29 % 512 as x, l_partkey * 7 % 256 as v from lineitem"
BOXES = "select scene_id, det_id, x0, y0, x1, y1 from detections"
COMPS = "select scene_id, gt_id as comp_id, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h, cast((x1 - x0) * (gt_id % 5) as double) as area from gt_symbols"


@query(f"""with p as ({PIXELS}), b as ({BOXES}), s as (select b.scene_id, b.det_id, avg(case when v < 128 then 1.0 else 0.0 end) as ink from b join p on p.scene_id = b.scene_id and x between x0 and x1 and y between y0 and y1 group by all)
select b.scene_id, b.det_id, round(coalesce(ink, 0.0), 6) as ink, coalesce(ink, 0.0) >= 0.10 and (x1 - x0) * (y1 - y0) >= 30 as enough from b left join s on s.scene_id = b.scene_id and s.det_id = b.det_id""")
def j20_ink_shares(t):
    return pixels.ink_shares(t.sql(PIXELS), t.sql(BOXES), "det_id").select("scene_id", "det_id", F.round("ink", 6).alias("ink"), "enough")


@query(f"with p as ({PIXELS}), b as ({BOXES}) select * from p where not exists (select 1 from b where b.scene_id = p.scene_id and x between x0 - 4 and x1 + 4 and y between y0 - 4 and y1 + 4)")
def j16_outside(t):
    return pixels.outside(t.sql(PIXELS), t.sql(BOXES), "det_id").select("scene_id", "y", "x", "v")


@query(f"with c as ({COMPS}) select scene_id, comp_id, greatest(0.0, x - 4) as x0, greatest(0.0, y - 4) as y0, least(512.0, x + w + 4) as x1, least(512.0, y + h + 4) as y1 from c where area >= 30 and greatest(w, h) >= 4 and greatest(w, h) <= 10 * least(w, h)")
def p14_components(t):
    return pixels.components_kept(t.sql(COMPS))


@query(f"""with p as ({PIXELS}), c as ({COMPS}), i as (select scene_id, avg(case when v < 200 then 1.0 else 0.0 end) as density, (max(v) - min(v)) / 255 as contrast from p group by scene_id), k as (select scene_id, max(area) / sum(area) as connectivity from c group by scene_id having sum(area) > 0)
select i.scene_id, round(0.4 * density + 0.3 * contrast + 0.3 * coalesce(connectivity, 0), 6) as quality from i left join k on k.scene_id = i.scene_id""")
def a23_source_quality(t):
    comps = t.sql(COMPS)
    some = comps.join(comps.groupBy("scene_id").agg(F.sum("area").alias("s")).where("s > 0"), "scene_id")
    return pixels.source_quality(t.sql(PIXELS), some).select("scene_id", F.round("quality", 6).alias("quality"))


@query("select scene_id, det_id, row, col, cast(row_number() over (partition by scene_id order by row, col, y0, x0, det_id) as int) as n, cast(row_number() over (partition by scene_id order by y0, x0, det_id) as int) as coarse_n from detections")
def t01_reading_order(t):
    w = W.partitionBy("scene_id")
    return t.detections.select("scene_id", "det_id", "row", "col", F.row_number().over(w.orderBy("row", "col", "y0", "x0", "det_id")).alias("n"), F.row_number().over(w.orderBy("y0", "x0", "det_id")).alias("coarse_n"))


@query("""select scene_id, row, det_id, label, slot from (select *, max(col) over (partition by scene_id, row) - col as slot from detections) q qualify row_number() over (partition by scene_id, row, slot order by det_id desc) = 1""")
def w07_right_slots(t):
    return cluster.right_slots(t.detections.withColumnRenamed("col", "x"), ["scene_id", "row"], "det_id").select("scene_id", "row", "det_id", "label", "slot")


@query("""select scene_id, det_id, confidence < 0.5 as low_conf, confidence < 0.55 or d > 40 as flagged from (select d.scene_id, d.det_id, confidence, sqrt(pow((d.x0 + d.x1) / 2 - (s.x0 + s.x1) / 2, 2) + pow((d.y0 + d.y1) / 2 - (s.y0 + s.y1) / 2, 2)) as d from detections d join gt_symbols s on s.scene_id = d.scene_id and s.gt_id = d.det_id) q""")
def p15_flags(t):
    both = t.detections.select("scene_id", "det_id", "confidence", *[F.col(c).alias(f"d_{c}") for c in g.BOX]).join(t.gt_symbols.select("scene_id", F.col("gt_id").alias("det_id"), *g.BOX), ["scene_id", "det_id"])
    a, b = g.box("d_"), g.box()
    d = F.hypot(g.center_x(a) - g.center_x(b), g.center_y(a) - g.center_y(b))
    return both.select("scene_id", "det_id", (F.col("confidence") < 0.5).alias("low_conf"), ((F.col("confidence") < 0.55) | (d > 40)).alias("flagged"))


@query("select scene_id, det_id, given, case when given then 'given' else 'child' end as origin from detections where not (given and det_id % 8 = 0)")
def p23_given_split(t):
    tags = F.when(F.col("det_id") % 8 == 0, F.array(F.lit("AUTOSHOW"))).otherwise(F.array().cast("array<string>"))
    df = t.detections.withColumn("tags", tags).where(~(F.col("given") & F.array_contains("tags", "AUTOSHOW")))
    return df.select("scene_id", "det_id", "given", F.when(F.col("given"), "given").otherwise("child").alias("origin"))


@query("select exercise_id, op, a, b, case when op = 'multiply' then (case when a % 10 = 0 then 0 else 1 end) + (case when b % 10 = 0 then 0 else 1 end) <= 1 when op = 'divide' then a % 10 = 0 and b % 10 = 0 else true end as allowed from exercises")
def p11_templates(t):
    text = lambda c: F.when(F.col(c) % 10 == 0, F.floor(F.col(c) / 10).cast("string")).otherwise(F.concat(F.floor(F.col(c) / 10).cast("string"), F.lit("."), (F.col(c) % 10).cast("string")))
    n = F.size(F.filter(F.array(text("a"), text("b")), lambda x: F.contains(x, F.lit("."))))
    ok = F.when(F.col("op") == "multiply", n <= 1).when(F.col("op") == "divide", n == 0).otherwise(True)
    return t.exercises.select("exercise_id", "op", "a", "b", ok.alias("allowed"))


@query()
def p19_jitter(t):
    return graph.jittered(t.detections.select("scene_id", "det_id", *g.BOX), 6.0)


@query("""with c as (select scene_id, gt_id, x0 - 256 as a, y0 - 256 as b, x1 - 256 as c, y1 - 256 as d, cos(radians(gt_id % 7)) as co, sin(radians(gt_id % 7)) as si from gt_symbols)
select scene_id, gt_id, round(greatest(0, least(512, least(a * co - b * si, a * co - d * si, c * co - b * si, c * co - d * si) + 256)), 6) as x0, round(greatest(0, least(512, greatest(a * si + b * co, a * si + d * co, c * si + b * co, c * si + d * co) + 256)), 6) as y1 from c""")
def p20_rotated(t):
    x0, _, _, y1 = g.rotated(g.box(), F.col("gt_id") % 7)
    return t.gt_symbols.select("scene_id", "gt_id", F.round(x0, 6).alias("x0"), F.round(y1, 6).alias("y1"))


@query("""with k as (select scene_id, count(*) filter (where label = 'op_plus') as p, count(*) filter (where label = 'carry_1') as m from detections group by scene_id), j as (select a.scene_id, a.p as ap, b.p as bp, a.m as am, b.m as bm from k a join k b on b.scene_id = a.scene_id + 1)
select scene_id, ap + am = bp + bm and ap <> bp as swapped from j""")
def a28_operator_swap(t):
    n = lambda x: F.sum((F.col("label") == x).cast("int"))
    k = t.detections.groupBy("scene_id").agg(n("op_plus").alias("p"), n("carry_1").alias("m"))
    counts = lambda d, i: d.select(F.col("scene_id") + i, F.map_from_arrays(F.array(F.lit("p"), F.lit("m")), F.array("p", "m")).alias(f"c{-i}")).toDF("scene_id", f"c{-i}")
    j = counts(k, 0).join(counts(k, -1), "scene_id")
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return j.select("scene_id", ((total("c0") == total("c1")) & (F.map_values("c0") != F.map_values("c1"))).alias("swapped"))


@query("select coalesce(equation_kind, 'all') as kind, coalesce(scene_case, 'all') as case_name, count(*) as n from scenes where scene_case is not null group by grouping sets ((equation_kind), (scene_case), ())")
def a35_tally(t):
    df = t.scenes.where("scene_case is not null")
    out = df.groupingSets([[F.col("equation_kind")], [F.col("scene_case")], []], F.col("equation_kind"), F.col("scene_case")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("equation_kind", F.lit("all")).alias("kind"), F.coalesce("scene_case", F.lit("all")).alias("case_name"), "n")


@query("select equation_kind, sum(wall_ms) as total_ms, round(avg(wall_ms), 6) as mean_ms, max(wall_ms) as most_ms, quantile_disc(wall_ms, 0.5) as median_ms from scenes group by equation_kind")
def a43_timing(t):
    return t.scenes.groupBy("equation_kind").agg(F.sum("wall_ms").alias("total_ms"), F.round(F.avg("wall_ms"), 6).alias("mean_ms"), F.max("wall_ms").alias("most_ms")).join(latency.exact_quantile(t.scenes, "equation_kind", "wall_ms", 0.5).withColumnRenamed("quantile", "median_ms"), "equation_kind")


@query("select run_id, round(0.5 * max(loss % 997) / 997 + 0.5 * max(loss % 499) / 499, 6) as combined from epoch_log group by run_id")
def a38_combined(t):
    return t.epoch_log.groupBy("run_id").agg(F.round(runs.combined_score(F.max(F.col("loss") % 997) / 997, F.max(F.col("loss") % 499) / 499), 6).alias("combined"))


@query("""with n as (select d.scene_id, d.det_id % 4 as ord, g.gt_id % 4 as g_ord, d.label as p_label, g.label, d.row as p_row, cast(floor(g.y0 / 64) as int) as row from detections d join gt_symbols g on g.scene_id = d.scene_id and g.gt_id = d.det_id),
p as (select scene_id, sum(case when ord = g_ord then 1 else 0 end) as ok, count(*) as k, bool_and(p_label = label and p_row = row) as exact from n group by scene_id),
c as (select scene_id, case equation_kind when 'bare_digits' then -1 when 'subtraction' then 1 when 'multiplication' then 2 when 'division' then 3 else 0 end as g, case pred_kind when 'bare_digits' then -1 when 'subtract' then 1 when 'multiply' then 2 when 'divide' then 3 else 0 end as p from scenes)
select round(sum(ok) / sum(k), 6) as ordinal_acc, round(avg(case when c.g >= 0 then (c.g = c.p)::int end), 6) as kind_acc, round(avg(exact::int), 6) as exact_scene from c left join p on p.scene_id = c.scene_id""")
def a11_ordinal_metrics(t):
    gt = t.gt_symbols.select("scene_id", F.col("gt_id").alias("det_id"), "label", F.floor(F.col("y0") / 64).cast("int").alias("row"), (F.col("gt_id") % 4).alias("ord"))
    nodes = t.detections.select("scene_id", "det_id", F.col("label").alias("p_label"), F.col("row").alias("p_row"), (F.col("det_id") % 4).alias("p_ord")).join(gt, ["scene_id", "det_id"])
    kinds = t.scenes.select("scene_id", o.kind_class(F.col("equation_kind")).alias("kind_class"), o.kind_class(F.col("pred_kind")).alias("p_kind_class"))
    out = evaluate.ordinal_metrics(nodes, kinds)
    return out.select([F.round(c, 6).alias(c) for c in out.columns])


@query(f"with {MATCH} select submission_id, token_id, cast(x as int) as x, cast(y as int) as y, x <> ex or y <> ey as moved from mt where ex is not null")
def j26_guides(t):
    df = grade.structure_match(submitted(t), expected(t)).where("ex is not null")
    return df.select("submission_id", "token_id", "x", "y", ((F.col("x") != F.col("ex")) | (F.col("y") != F.col("ey"))).alias("moved"))


@query(f"with {CELLS} select submission_id, x, y, coalesce(role, '') as role from gr where status = 'MISSING'")
def j14_roles_of_missing(t):
    miss = cells(t).where("status = 'MISSING'").select("submission_id", "exercise_id", "x", "y")
    return miss.join(expected(t).select("exercise_id", "x", "y", "role"), ["exercise_id", "x", "y"], "left").select("submission_id", "x", "y", F.coalesce("role", F.lit("")).alias("role"))


GIVEN_IN = CELLS.replace("submitted as (select", "sub0 as (select", 1).replace(f", {SHIFT}", f""", gs as (select exercise_id, x, y, c, 'GE' || (row_number() over (partition by exercise_id order by y, x, role) - 1) as token_id from expected where given),
submitted as (select s.* from sub0 s left join gs on gs.exercise_id = s.exercise_id and gs.x = s.x and gs.y = s.y where gs.x is null union all select d.submission_id, d.exercise_id, gs.token_id, gs.c, gs.x, gs.y, 'SYMBOL' from (select distinct submission_id, exercise_id from sub0) d join gs on gs.exercise_id = d.exercise_id), {SHIFT}""", 1)


@query(f"""with {GIVEN_IN}, {PROGRESS}, f as (select submission_id, bool_or(status = 'ERROR' and role = 'answer') as e, bool_or(status = 'MISSING' and role = 'answer') as m, bool_or(status = 'MISSING' and role = 'carry') as s, bool_or(status = 'ERROR') as ae from gr group by submission_id)
select f.submission_id, round(case when total > 0 then matched / total else 1 end, 6) as progress, case when e then 'mistake' when m then 'incomplete' when s then 'missing_step' when matched = total then 'correct' else 'incomplete' end as outcome,
  case when matched = total then 'correct' when ae then 'mistake' else 'incomplete' end as short_outcome from f join p on p.submission_id = f.submission_id""")
def e06_evaluated(t):
    """Given cells injected, then matched, graded and judged: one row for each submission."""
    e, s = expected(t), submitted(t)
    graded = grade.graded_cells(grade.with_given(s, e), e)
    return grade.verdicts(graded).withColumn("progress", F.round("progress", 6))


@query()
def c06_recognised_set(t):
    """Boxes of two sources to nested rows: gate, suppression, cut to 80, rows and columns, conflicts, duplicates, numbering.

    Each token tells its two conflicts; n_conflicts and n_carry_conflicts count them in the scene.
    """
    d = t.two_sources.withColumn("given", F.lit(False))
    kept = match.truncated(match.suppress(match.gated(d, "a"), "a")).drop("rank", "truncated")
    placed = cluster.rows_and_columns(kept).withColumnsRenamed({"row_cluster": "row", "col_cluster": "col"})
    clean = match.best_bar(match.distinct_operators(cluster.carry_conflicts(placed)))
    flags = {"n_conflicts": "spatial_conflict", "n_carry_conflicts": "carry_conflict"}
    counts = [F.sum(F.col(c).cast("long")).alias(n) for n, c in flags.items()]
    rows = cluster.gathered(cluster.renumbered(cluster.row_conflicts(clean)), F.struct("out_col", "label", "det_id", *flags.values()), *counts, *cluster.gate_counts())
    n_rows, rows_json = F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"), F.to_json("rows").alias("rows_json")
    shown = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in flags]
    return cluster.routed(t.scenes.select("scene_id").join(rows, "scene_id", "left"), "scene_id", n_rows, *shown, rows_json)


@query(f"""{SPLIT}, c as (select label, count(*) as n from a group by label), w as (select unnest(['de', 'en', 'es', 'fr', 'it']) as label), b as (select n, w.label is not null as need from c full join w on w.label = c.label),
i as (select case when not need then 'unknown_label' else 'missing_required_label' end as kind from b where not need or n is null)
select 'issue' as section, kind as key, count(*) as n from i group by kind union all select 'balance', coalesce(split, 'all') || '/' || coalesce(label, 'all'), count(*) from s group by cube (split, label)
union all select 'leakage', x.split || '/' || y.split, count(*) from s x join s y on y.sha256 = x.sha256 and x.split < y.split group by x.split, y.split""")
def c07_preparation_report(t):
    """Issues, balance and leakage of a labelled dataset as one long table."""
    a = assets(t)
    splits = quality.stratified_split(a)
    found = quality.vocabulary_issues(a, LABELS).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("issue").alias("section"), F.col("kind").alias("key"), "n")
    balance = quality.class_balance(splits).select(F.lit("balance").alias("section"), F.concat_ws("/", "split", "label").alias("key"), "n")
    leaks = quality.leakage(splits.select("sha256", "split")).select(F.lit("leakage").alias("section"), F.concat_ws("/", "a", "b").alias("key"), F.col("shared").alias("n"))
    return found.unionByName(balance).unionByName(leaks)


@query(f"""{SAMPLES}, mm as (select count(*) as n_samples, avg(kind_ok::int) as kind_acc, avg(ood_triggered::int) as ood_rate, avg(ood_honest::int) as ood_honest_rate, avg(case when matched > 0 then label_correct / matched end) as label_acc, avg(recall) as recall, avg(row_acc) as row_acc, avg(col_acc) as col_acc, count(row_acc) as n_spatial, sum(wall_ms) as total_wall_ms from s)
unpivot (select cast(n_samples as double) as n_samples, round(kind_acc, 6) as kind_acc, round(ood_rate, 6) as ood_rate, round(ood_honest_rate, 6) as ood_honest_rate, round(label_acc, 6) as label_acc, round(recall, 6) as recall, round(row_acc, 6) as row_acc, round(col_acc, 6) as col_acc, cast(n_spatial as double) as n_spatial, cast(total_wall_ms as double) as total_wall_ms from mm) on columns(*) into name metric value value""")
def s18_report_aggregate(t):
    df = evaluate.aggregate_metrics(samples(t))
    return evaluate.by_metric(df.withColumns({c: F.round(c, 6) for c in MEANS}))


@query("select path, label from (select source || '/' || doc_id || '__rt0' || c as path, lang as label, doc_id from documents, (select unnest([0, 1]) as c) q where doc_id in (select doc_id from labels where quality = 1) union all select source || '/' || doc_id, lang, doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)) u")
def c09_finetune_merge(t):
    a = t.assets.select("path", "label", "doc_id")
    good = t.labels.where("quality = 1").select("doc_id")
    return quality.merged(quality.oversampled(a.join(good, "doc_id", "left_semi"), 2), a.join(good, "doc_id", "left_anti")).select("path", "label")


@query(f"with {ADD} select exercise_id, count(*) as n_tokens, count(*) filter (where label like 'main%') as n_digits, count(*) filter (where label like 'carry%') as n_carries from s group by exercise_id")
def g01_token_counts(t):
    n = lambda p: F.sum(F.col("label").startswith(p).cast("long"))
    return added(t).groupBy("exercise_id").agg(F.count(F.lit(1)).alias("n_tokens"), n("main_").alias("n_digits"), n("carry_").alias("n_carries"))


# Scene cases that stand for the exercises of an operation, by the digits of b.
CASES = "case when op = 'add' then case when b % 3 = 0 then 'addition_no_bar' else 'addition' end when op = 'subtract' then 'subtraction' when op = 'multiply' then 'multiplication_simple' when b > 0 and a % b = 0 then 'division_simple' else 'standalone_bar' end"


@query(f"""with c as (select exercise_id, {CASES} as scene_case from exercises) select exercise_id, scene_case,
  case scene_case when 'addition_no_bar' then 'full,done_60,done_40,done_20' when 'division_simple' then 'full,done_80,done_40' when 'standalone_bar' then 'full' else 'full,done_80,done_60,done_40,done_20' end as stages from c""")
def g11_valid_stages(t):
    valid = worked.stage_weights(t.spark).groupBy("scene_case").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "stage"))), lambda s: s["stage"]), ",").alias("stages"))
    return t.exercises.selectExpr("exercise_id", f"{CASES} as scene_case").join(F.broadcast(valid), "scene_case").select("exercise_id", "scene_case", "stages")


@query(f"""with c as (select exercise_id, {CASES} as scene_case, (exercise_id * 7919 % 1000) / 1000.0 as u from exercises) select exercise_id, scene_case,
  case scene_case when 'addition_no_bar' then case when u < 0.65 then 'full' when u < 0.72 then 'done_60' when u < 0.78 then 'done_40' else 'done_20' end when 'division_simple' then case when u < 0.65 then 'full' when u < 0.80 then 'done_80' else 'done_40' end
  when 'standalone_bar' then 'full' else case when u < 0.65 then 'full' when u < 0.80 then 'done_80' when u < 0.87 then 'done_60' when u < 0.93 then 'done_40' else 'done_20' end end as stage from c""")
def g11_stage_draw(t):
    """One valid stage for each exercise, drawn by the weights of its case; the uniform number is given, so that SQL can follow."""
    ex = t.exercises.selectExpr("exercise_id", f"{CASES} as scene_case").withColumn("u", (F.col("exercise_id") * 7919 % 1000) / 1000.0)
    return worked.drawn_stage(ex, "u").select("exercise_id", "scene_case", "stage")


ISSUES = """r as (select l_orderkey as report_id, l_linenumber as token_index, case l_partkey % 9 when 0 then ' Wrong' when 1 then 'dup' when 2 then 'GHOST' when 3 then 'split' when 4 then 'merge' when 5 then 'y ' when 6 then 'no' when 7 then '' end as issue,
  case when l_suppkey % 4 = 0 then 'main_' || l_suppkey % 10 when l_suppkey % 4 = 1 then ' ' end as should_be from lineitem)"""


@query(f"""with {ISSUES}, k as (select *, case lower(trim(coalesce(issue, ''))) when 'wrong' then 'wrong_label' when 'y' then 'wrong_label' when 'dup' then 'duplicate' when 'ghost' then 'spurious' when 'split' then 'split' when 'merge' then 'merged'
  else case when trim(coalesce(should_be, '')) <> '' then 'wrong_label' end end as issue_type from r) select report_id, token_index, issue_type, trim(coalesce(should_be, '')) as should_be from k where issue_type is not null""")
def p25_issue_types(t):
    return quality.reported_issues(t.sql(f"with {ISSUES} select * from r"))


@query("""with l as (select o_orderkey as report_id, unnest(string_split(o_comment_text, chr(10))) as line from (select o_orderkey, case o_orderkey % 4 when 0 then 'main_' || o_orderkey % 10 || ' after #' || o_custkey || chr(10) || chr(10) || '  op_plus near top ' when 1 then 'carry_1' when 2 then '  ' end as o_comment_text from orders) q)
select report_id, string_split(trim(line), ' ')[1] as should_be, trim(line) as note from l where trim(line) <> ''""")
def p25_missed_lines(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("main_"), F.col("o_orderkey") % 10, F.lit(" after #"), "o_custkey", F.lit("\n\n  op_plus near top "))).when(F.col("o_orderkey") % 4 == 1, "carry_1").when(F.col("o_orderkey") % 4 == 2, "  ")
    return quality.missed_lines(t.orders.select(F.col("o_orderkey").alias("report_id"), text.alias("missed")))


REPORT = """select 'aggregate' as section, '' as key, {0} from s union all select 'per_kind', equation_kind, {0} from s group by equation_kind union all select 'per_case', scene_case, {0} from s where scene_case is not null group by scene_case"""


@query(f"""{SAMPLES}, c as (select a.label as gt_label, p.label as pred_label, count(*) as n from m join gt_symbols a on a.scene_id = m.scene_id and a.gt_id = m.gt_id join predictions p on p.scene_id = m.scene_id and p.pred_id = m.pred_id group by 1, 2),
q as ({REPORT.format(MACRO)}),
long as (unpivot (select section, key, cast(n_samples as double) as n_samples, kind_acc, ood_rate, ood_honest_rate, label_acc, recall, row_acc, col_acc, cast(n_spatial as double) as n_spatial, cast(total_wall_ms as double) as total_wall_ms from q) on n_samples, kind_acc, ood_rate, ood_honest_rate, label_acc, recall, row_acc, col_acc, n_spatial, total_wall_ms into name metric value value)
select section, key, metric, value from long union all select 'per_label', gt_label, 'recall', round(sum(case when gt_label = pred_label then n else 0 end) / sum(n), 6) from c group by gt_label
union all select 'per_sample', cast(scene_id as varchar), 'recall', round(recall, 6) from s where recall is not null""")
def c08_evaluation_report(t):
    """The whole evaluation as one long table: aggregate, by kind, by case, by label and by sample."""
    return evaluate.report(t.scenes, t.gt_symbols, t.predictions, t.detections).withColumn("value", F.round("value", 6))


P11_TEMPLATE = "case op when 'multiply' then 'PRODUCT_' when 'divide' then 'DIVISION_' when 'add' then 'ADDITION_' else 'SUBTRACTION_' end || b % 4 as template, case when a % 10 = 0 then cast(a as string) else a // 10 || '.' || a % 10 end as a_text, case when b % 5 > 0 then cast(b as string) else b // 10 || '.' || b % 10 end as b_text"


@query(f"""with x as (select exercise_id, {P11_TEMPLATE} from exercises), n as (select *, cast(contains(a_text, '.') as int) + cast(contains(b_text, '.') as int) as k from x)
select exercise_id, template, a_text, b_text, case when template like 'PRODUCT%' then k <= 1 when template like 'DIVISION%' then k = 0 else true end as allowed from n""")
def p11_arguments_allowed(t):
    x = t.sql(f"select exercise_id, {P11_TEMPLATE.replace('a // 10', 'a div 10').replace('b // 10', 'b div 10')} from exercises")
    return x.withColumn("allowed", assembly.arguments_allowed(F.col("template"), F.array("a_text", "b_text")))


@query("""select scene_id, det_id, coalesce(confidence < 0.5, false) as low_conf, coalesce(confidence < 0.25, false) or coalesce(d > 48, false) as flagged from (select p.scene_id, p.pred_id as det_id, p.conf * (p.pred_id % 3) / 2 as confidence,
  sqrt(pow((p.x0 + p.x1) / 2 - (s.x0 + s.x1) / 2 - 12 * (p.pred_id % 5), 2) + pow((p.y0 + p.y1) / 2 - (s.y0 + s.y1) / 2, 2)) as d from predictions p left join gt_symbols s on s.scene_id = p.scene_id and s.gt_id = p.pred_id) q""")
def p15_review_flags(t):
    p = t.predictions.select("scene_id", F.col("pred_id").alias("det_id"), "conf", *[F.col(c).alias(f"d_{c}") for c in g.BOX])
    both = p.join(t.gt_symbols.select("scene_id", F.col("gt_id").alias("det_id"), *g.BOX), ["scene_id", "det_id"], "left")
    a, b = g.box("d_"), g.box()
    d = F.sqrt(F.pow(g.center_x(a) - g.center_x(b) - 12 * (F.col("det_id") % 5), F.lit(2)) + F.pow(g.center_y(a) - g.center_y(b), F.lit(2)))
    low, flagged = assembly.review_flags(F.col("conf") * (F.col("det_id") % 3) / 2, d)
    return both.select("scene_id", "det_id", low.alias("low_conf"), flagged.alias("flagged"))


A28_LABELS = ("select scene_id, 'op_' || case gt_id % 3 when 0 then 'plus' when 1 then 'minus' else 'times' end as label from gt_symbols where gt_id <= 3", "select scene_id, case when scene_id % 11 = 0 and gt_id = 2 then 'div_bracket' else 'op_' || case when scene_id % 3 = 0 and gt_id % 3 = 1 then 'divide' when scene_id % 3 = 1 and gt_id % 3 = 2 then 'plus' when gt_id % 3 = 0 then 'plus' when gt_id % 3 = 1 then 'minus' else 'times' end end as label from gt_symbols where gt_id <= 3")
A28_SCENES = "select scene_id, case when equation_kind = 'bare_digits' then 'ood_unknown' else equation_kind end as kind from scenes"


@query(f"""with a as ({A28_LABELS[0]}), b as ({A28_LABELS[1]}), k as (select scene_id, string_agg(label, ',' order by label) as la, count(*) as n from a where label like 'op_%' group by scene_id), m as (select scene_id, string_agg(label, ',' order by label) filter (where label like 'op_%') as lb, count(*) filter (where label like 'op_%') as n, bool_or(label in ('div_bracket', 'op_divide')) as dv, bool_or(label = 'op_times') as ti, bool_or(label = 'op_minus') as mi, bool_or(label = 'op_plus') as pl from b group by scene_id),
j as (select s.scene_id, kind, coalesce(k.n, 0) = coalesce(m.n, 0) and coalesce(la, '') <> coalesce(lb, '') as swapped, dv, ti, mi, pl from ({A28_SCENES}) s left join k on k.scene_id = s.scene_id left join m on m.scene_id = s.scene_id)
select scene_id, swapped, case when swapped and kind <> 'ood_unknown' then case when dv then 'divide' when ti then 'multiply' when mi then 'subtract' when pl then 'add' else kind end else kind end as kind from j""")
def a28_drawn_kinds(t):
    return assembly.drawn_kinds(t.sql(A28_LABELS[0]), t.sql(A28_LABELS[1]), t.sql(A28_SCENES))


@query(f"""with {GIVEN_IN}, {PROGRESS}, f as (select submission_id, bool_or(status = 'ERROR' and role = 'answer') as e, bool_or(status = 'MISSING' and role = 'answer') as m, bool_or(status = 'MISSING' and role = 'carry') as s, bool_or(status = 'ERROR') as ae from gr group by submission_id),
h as (select submission_id, role || ':' || cast(group_x as int) || ':' || cast(y as int) as hint from gr where status = 'MISSING' and not group_wrong and not given qualify row_number() over (partition by submission_id order by abs(y - 6), -x, y, group_x, role) = 1),
el as (select submission_id, role, group_x as left_x, y, count(*) as width, string_agg(c, '' order by x) as num, status from gr where not group_wrong or role = 'carry' group by submission_id, role, y, group_x, status union all select submission_id, role, x, y, 1, c, status from gr where group_wrong and status <> 'OK'),
et as (select submission_id, string_agg(role || ':' || cast(left_x as int) || ':' || cast(y as int) || ':' || width || ':' || num || ':' || status, ',' order by role, left_x, y, width, num, status) as elements from el group by submission_id)
select f.submission_id, round(case when total > 0 then matched / total else 1 end, 6) as progress, total = 0 or matched = total as finished, case when e then 'mistake' when m then 'incomplete' when s then 'missing_step' when matched = total then 'correct' else 'incomplete' end as outcome,
  case when matched = total then 'correct' when ae then 'mistake' else 'incomplete' end as short_outcome, hint, elements from f join p on p.submission_id = f.submission_id left join h on h.submission_id = f.submission_id left join et on et.submission_id = f.submission_id""")
def e06_evaluated_whole(t):
    """Verdict, next hint and elements of each submission, graded once."""
    part = lambda s, *names: F.concat_ws(":", *[s[n] for n in names])
    df = grade.evaluated(submitted(t), expected(t))
    elements = F.array_join(F.transform("elements", lambda e: part(e, "role", "left_x", "y", "width", "num", "status")), ",")
    return df.select("submission_id", F.round("progress", 6).alias("progress"), "finished", "outcome", "short_outcome", F.when(F.col("hint").isNotNull(), part(F.col("hint"), "role", "left_x", "y")).alias("hint"), elements.alias("elements"))


GIVEN_CELLS = "select scene_id, gt_id as cell_id, label, x0 - 8 as x0, y0 - 8 as y0, x1 + 8 as x1, y1 + 8 as y1 from gt_symbols where gt_id % 2 = 0 and gt_id > 1"
KIND_LOGITS = "select s.scene_id, s.pred_kind, embedding from scenes s left join embeddings e on e.vec_id = s.scene_id"


@query()
def c06_recognised_scenes(t):
    """Boxes of two sources and given cells to nested rows, with kinds demoted by the entropy of their logits."""
    scenes = t.sql(KIND_LOGITS).withColumn("logits", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 3))
    df = assembly.recognised(t.two_sources, scenes, "a", t.sql(GIVEN_CELLS))
    return df.withColumn("rows_json", F.to_json("rows")).drop("rows")


REPORT_TABLES = "n_pred, n_gt, matched, label_correct, recall, row_acc, col_acc, mean_iou, wall_ms"


@query(f"""{SAMPLES}, c as (select a.label as gt_label, p.label as pred_label, count(*) as n from m join gt_symbols a on a.scene_id = m.scene_id and a.gt_id = m.gt_id join predictions p on p.scene_id = m.scene_id and p.pred_id = m.pred_id group by 1, 2),
q as ({REPORT.format(MACRO)}), l as (select gt_label, cast(sum(case when gt_label = pred_label then n else 0 end) as double) as correct, cast(sum(n) as double) as total from c group by gt_label),
l2 as (select gt_label, correct, total, round(correct / total, 6) as recall from l),
ps as (select cast(scene_id as varchar) as key, cast(n_pred as double) as n_pred, cast(n_gt as double) as n_gt, cast(matched as double) as matched, cast(label_correct as double) as label_correct, round(recall + 1e-9, 6) as recall, round(row_acc + 1e-9, 6) as row_acc, round(col_acc + 1e-9, 6) as col_acc, round(mean_iou + 1e-9, 6) as mean_iou, cast(wall_ms as double) as wall_ms from s),
long as (unpivot (select section, key, cast(n_samples as double) as n_samples, kind_acc, ood_rate, ood_honest_rate, label_acc, recall, row_acc, col_acc, cast(n_spatial as double) as n_spatial, cast(total_wall_ms as double) as total_wall_ms from q) on n_samples, kind_acc, ood_rate, ood_honest_rate, label_acc, recall, row_acc, col_acc, n_spatial, total_wall_ms into name metric value value),
u as (unpivot ps on {REPORT_TABLES} into name metric value value), v as (unpivot l2 on correct, total, recall into name metric value value)
select section, key, metric, value from long union all select 'per_label', gt_label, metric, value from v union all select 'per_sample', key, metric, value from u""")
def s18_report_tables(t):
    """All five tables of the report with all their metrics, as one long table."""
    tables = evaluate.report_tables(t.scenes, t.gt_symbols, t.predictions, t.detections)
    out = None
    for name, df in tables.items():
        lift = 1e-9 if name == "per_sample" else 0.0
        part = df.select(F.lit(name).alias("section"), F.col("key").cast("string").alias("key"), "metric", F.round(F.col("value") + F.when(F.col("metric").isin("recall", "row_acc", "col_acc", "mean_iou"), lift).otherwise(0.0), 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
