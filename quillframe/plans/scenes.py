"""Queries over scenes: matching, suppression, rows and columns, evaluation, graph features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import ontology, sql
from ..operators import cluster, evaluate, graph, match
from .registry import query

R = 6
#: Means of few values often end in a 5 at the seventh decimal, where the last bit decides; so they are lifted by this much in both engines.
TIE = 1e-9


def rounded(df, *cols, lift=0.0):
    return df.withColumns({c: F.round(F.col(c) + lift, R) for c in cols})


# SQL pieces. IoU of boxes a and b; greedy matching as rounds in which a pair that leads on both sides is taken.
IW = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = "(greatest(0.0, {0}.x1 - {0}.x0) * greatest(0.0, {0}.y1 - {0}.y0))"
IOU = f"(({IW}) / nullif({AREA.format('a')} + {AREA.format('b')} - ({IW}), 0))"
PAIRS = f"select a.scene_id, gt_id, pred_id, {IOU} as iou from gt_symbols a join predictions b on a.scene_id = b.scene_id where {IOU} >= "


def greedy_sql(first: str, second: str, rounds: int = 6) -> str:
    """CTEs p0 .. and m (the matching) from a CTE pairs(scene_id, gt_id, pred_id, iou)."""
    order = f"order by iou desc, {first} desc, {second} desc"
    out = ["p0 as materialized (select * from pairs)"]
    for i in range(rounds):
        out.append(
            f"t{i} as materialized (select scene_id, gt_id, pred_id, iou from (select *, row_number() over (partition by scene_id, gt_id {order}) as rg, row_number() over (partition by scene_id, pred_id {order}) as rp from p{i}) q where rg = 1 and rp = 1)"
        )
        out.append(
            f"p{i + 1} as materialized (select p.* from p{i} p where not exists (select 1 from t{i} t where t.scene_id = p.scene_id and t.gt_id = p.gt_id) and not exists (select 1 from t{i} t where t.scene_id = p.scene_id and t.pred_id = p.pred_id))"
        )
    out.append("m as materialized (" + " union all ".join(f"select * from t{i}" for i in range(rounds)) + ")")
    return ", ".join(out)


M35 = f"with pairs as ({PAIRS}0.35), {greedy_sql('gt_id', 'pred_id')}"
M40 = f"with pairs as ({PAIRS}0.40), {greedy_sql('pred_id', 'gt_id')}"


@query(f"select scene_id, gt_id, pred_id, round(iou, 6) as iou from ({PAIRS}0.35) p")
def j01_iou_pairs(t):
    return rounded(match.iou_pairs(t.gt_symbols, t.predictions), "iou")


@query(f"select scene_id, gt_id, pred_id, round(iou, 6) as iou from ({PAIRS}0.35) p")
def j01_tiled_pairs(t):
    """The same pairs, every scene over tiles."""
    found = match.tiled_iou_pairs(t.gt_symbols, t.predictions, 0.35)
    return rounded(found.select("scene_id", F.col("a_gt_id").alias("gt_id"), F.col("b_pred_id").alias("pred_id"), "iou"), "iou")


@query(f"select a.scene_id, gt_id, pred_id, round({IOU}, 6) as iou, round(coalesce(({IW}) / nullif(least({AREA.format('a')}, {AREA.format('b')}), 0), 0), 6) as ioa from gt_symbols a join predictions b on a.scene_id = b.scene_id where {IOU} >= 0.35")
def f14_box_functions(t):
    """Overlap of boxes by the session's SQL functions."""
    sql.register(t.spark)
    a, b = ("a.x0, a.y0, a.x1, a.y1", "b.x0, b.y0, b.x1, b.y1")
    return t.sql(f"select a.scene_id, gt_id, pred_id, round(iou({a}, {b}), 6) as iou, round(ioa({a}, {b}), 6) as ioa from gt_symbols a join predictions b on a.scene_id = b.scene_id where iou({a}, {b}) >= 0.35")


@query("""with c as (select label, count(*) filter (where conf > 0.7) as hits, count(*) as n from predictions group by label), p as (select label, hits, n, hits / n as p from c)
select label, hits, n, round(greatest(0.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) as lo,
  round(least(1.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) as hi from p""")
def f14_interval_functions(t):
    sql.register(t.spark)
    counts = t.predictions.groupBy("label").agg(F.count(F.when(F.col("conf") > 0.7, 1)).alias("hits"), F.count(F.lit(1)).alias("n"))
    return counts.selectExpr("label", "hits", "n", "round(wilson_lo(hits, n), 6) as lo", "round(wilson_hi(hits, n), 6) as hi")


@query(f"{M35} select scene_id, gt_id, pred_id, round(iou, 6) as iou from m")
def j02_greedy_match(t):
    return rounded(match.greedy_match(match.iou_pairs(t.gt_symbols, t.predictions)), "iou").select("scene_id", "gt_id", "pred_id", "iou")


@query(f"""{M40}, o as (select a.scene_id, a.gt_id, m.pred_id, a.label as gt_label, p.label as pred_label, m.iou
  from gt_symbols a left join m on m.scene_id = a.scene_id and m.gt_id = a.gt_id left join predictions p on p.scene_id = m.scene_id and p.pred_id = m.pred_id
  union all select p.scene_id, null, p.pred_id, null, p.label, null from predictions p left join m on p.scene_id = m.scene_id and p.pred_id = m.pred_id where m.pred_id is null)
select scene_id, gt_id, pred_id, gt_label, pred_label, case when gt_id is null then 'false_positive' when pred_id is null then 'missed' else 'matched' end as outcome,
  coalesce(gt_label = pred_label, false) as is_correct, round(coalesce(iou, 0.0), 6) as iou from o""")
def j03_match_outcomes(t):
    return rounded(match.match_outcomes(t.gt_symbols, t.predictions), "iou")


NEAR = """n as (select scene_id, pred_id, det_id from (select p.scene_id, p.pred_id, d.det_id, row_number() over (partition by p.scene_id, p.pred_id order by
    ((d.x0 + d.x1) / 2 - (p.x0 + p.x1) / 2) * ((d.x0 + d.x1) / 2 - (p.x0 + p.x1) / 2) + ((d.y0 + d.y1) / 2 - (p.y0 + p.y1) / 2) * ((d.y0 + d.y1) / 2 - (p.y0 + p.y1) / 2), d.det_id) as r
  from predictions p join detections d on d.scene_id = p.scene_id) q where r = 1)"""


@query(f"with {NEAR} select scene_id, pred_id, det_id from n")
def j04_nearest_detection(t):
    return match.nearest(t.predictions, t.detections, "pred_id", "det_id").drop("d2")


def gap_sql(source: str, value: str, ident: str, name: str) -> str:
    return f"""(select scene_id, {ident}, cast(sum(case when v - p > w then 1 else 0 end) over (partition by scene_id order by v, {ident} rows unbounded preceding) as int) as {name}
  from (select scene_id, {ident}, {value} as v, lag({value}) over (partition by scene_id order by {value}, {ident}) as p,
    (max({value}) over (partition by scene_id) - min({value}) over (partition by scene_id)) * 0.10 as w from {source}) z)"""


@query(f"select * from {gap_sql('gt_symbols', '(y0 + y1) / 2', 'gt_id', 'row_cluster')} q")
def w01_gap_cluster(t):
    df = t.gt_symbols.withColumn("cy", g.center_y(g.box()))
    return cluster.gap_cluster(df, "cy", "row_cluster", order=["gt_id"]).select("scene_id", "gt_id", "row_cluster")


KIND = "case pred_kind when 'add' then 'addition' when 'subtract' then 'subtraction' when 'multiply' then 'multiplication' when 'divide' then 'division' when 'bare_digits' then 'bare_digits' else '' end"
SAMPLES = f"""{M35}, {NEAR}, gr as {gap_sql('gt_symbols', '(y0 + y1) / 2', 'gt_id', 'gt_row')}, gc as {gap_sql('gt_symbols', '(x0 + x1) / 2', 'gt_id', 'gt_col')},
h as (select m.scene_id, count(*) as matched, cast(sum(case when a.label = p.label then 1 else 0 end) as bigint) as label_correct,
    avg(case when d.row = gr.gt_row then 1.0 else 0.0 end) as row_acc, avg(case when d.col = gc.gt_col then 1.0 else 0.0 end) as col_acc, avg(iou) as mean_iou
  from m join gt_symbols a on a.scene_id = m.scene_id and a.gt_id = m.gt_id join predictions p on p.scene_id = m.scene_id and p.pred_id = m.pred_id
  join gr on gr.scene_id = m.scene_id and gr.gt_id = m.gt_id join gc on gc.scene_id = m.scene_id and gc.gt_id = m.gt_id
  join n on n.scene_id = m.scene_id and n.pred_id = m.pred_id join detections d on d.scene_id = n.scene_id and d.det_id = n.det_id group by m.scene_id),
cg as (select scene_id, count(*) as k from gt_symbols group by scene_id), cp as (select scene_id, count(*) as k from predictions group by scene_id),
s as (select c.scene_id, equation_kind, scene_case, ({KIND}) = equation_kind as kind_ok, pred_kind = 'unknown' and ood_reason is not null as ood_triggered,
    pred_kind = 'unknown' and ood_reason is not null as ood_honest, coalesce(cp.k, 0) as n_pred, case when has_symbols then coalesce(cg.k, 0) end as n_gt,
    case when has_symbols then coalesce(matched, 0) end as matched, case when has_symbols then coalesce(label_correct, 0) end as label_correct,
    case when has_symbols and cg.k > 0 then coalesce(matched, 0) / cg.k end as recall, case when has_symbols then row_acc end as row_acc, case when has_symbols then col_acc end as col_acc,
    case when has_symbols then mean_iou end as mean_iou, wall_ms
  from scenes c left join cg on cg.scene_id = c.scene_id left join cp on cp.scene_id = c.scene_id left join h on h.scene_id = c.scene_id)"""
MACRO = """count(*) as n_samples, round(avg(kind_ok::int), 6) as kind_acc, round(avg(ood_triggered::int), 6) as ood_rate, round(avg(ood_honest::int), 6) as ood_honest_rate,
  round(avg(case when matched > 0 then label_correct / matched end), 6) as label_acc, round(avg(recall), 6) as recall, round(avg(row_acc), 6) as row_acc, round(avg(col_acc), 6) as col_acc,
  count(row_acc) as n_spatial, sum(wall_ms) as total_wall_ms"""
MEANS = ("kind_acc", "ood_rate", "ood_honest_rate", "label_acc", "recall", "row_acc", "col_acc")


def samples(t):
    return evaluate.sample_metrics(t.scenes, t.gt_symbols, t.predictions, t.detections)


@query(f"""{SAMPLES} select scene_id, equation_kind, scene_case, kind_ok, ood_triggered, ood_honest, n_pred, n_gt, matched, label_correct, round(recall + 1e-9, 6) as recall,
  round(row_acc + 1e-9, 6) as row_acc, round(col_acc + 1e-9, 6) as col_acc, round(mean_iou + 1e-9, 6) as mean_iou, wall_ms from s""")
def a01_sample_metrics(t):
    return rounded(samples(t), "recall", "row_acc", "col_acc", "mean_iou", lift=TIE)


@query(f"{SAMPLES} select {MACRO} from s")
def a02_aggregate_metrics(t):
    return rounded(evaluate.aggregate_metrics(samples(t)), *MEANS)


@query(f"""{SAMPLES} select 'all' as grouping, '' as key, {MACRO} from s union all select 'equation_kind', equation_kind, {MACRO} from s group by equation_kind
union all select 'scene_case', scene_case, {MACRO} from s where scene_case is not null group by scene_case""")
def a03_metrics_by_group(t):
    return rounded(evaluate.metrics_by(samples(t)), *MEANS)


CONF = f"{M35}, c as (select a.label as gt_label, p.label as pred_label, count(*) as n from m join gt_symbols a on a.scene_id = m.scene_id and a.gt_id = m.gt_id join predictions p on p.scene_id = m.scene_id and p.pred_id = m.pred_id group by 1, 2)"


@query(f"{CONF} select * from c")
def a04_confusion(t):
    return evaluate.confusion(evaluate.label_pairs(t.gt_symbols, t.predictions))


@query(f"""{CONF}, r as (select gt_label, pred_label, n, row_number() over (partition by gt_label order by n desc, pred_label) as r from c where gt_label <> pred_label),
l as (select gt_label, string_agg(pred_label || ':' || n, ' ' order by r) as confused_with from r where r <= 3 group by gt_label),
k as (select gt_label, cast(sum(case when gt_label = pred_label then n else 0 end) as bigint) as correct, cast(sum(n) as bigint) as total from c group by gt_label)
select k.gt_label, correct, total, round(correct / total, 6) as recall, coalesce(confused_with, '') as confused_with, cast(row_number() over (order by correct / total, k.gt_label) as int) as rank
from k left join l on l.gt_label = k.gt_label""")
def a05_label_recall(t):
    return rounded(evaluate.label_recall(a04_confusion(t)), "recall")


@query(f"""{SAMPLES}, a as (select count(*) as n, avg(kind_ok::int) as kind_acc, avg(row_acc) as row_acc, avg(col_acc) as col_acc from s),
v as (select 'kind_acc' as metric, kind_acc as value, n from a union all select 'row_acc', row_acc, n from a union all select 'col_acc', col_acc, n from a),
p as (select metric, value, n, round_even(value * n, 0) / n as p from v)
select metric, round(value, 6) as value, n as n_all, round(greatest(0.0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) as lo,
  round(least(1.0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) as hi from p""")
def a06_wilson_intervals(t):
    return rounded(evaluate.intervals(evaluate.aggregate_metrics(samples(t))), "value", "lo", "hi")


def placed(df):
    return df.withColumns({"row": F.floor(F.col("y0") / 64), "col": F.floor(F.col("x0") / 64)})


@query(f"""{M40}, o as (select coalesce(a.scene_id, p.scene_id) as scene_id, a.gt_id, p.pred_id, a.label as gl, p.label as pl, floor(a.y0 / 64) as gr, floor(a.x0 / 64) as gc, floor(p.y0 / 64) as pr, floor(p.x0 / 64) as pc
  from gt_symbols a left join m on m.scene_id = a.scene_id and m.gt_id = a.gt_id full join predictions p on p.scene_id = m.scene_id and p.pred_id = m.pred_id),
k as (select scene_id, sum(case when gl = pl then 1 else 0 end) as tp, sum(case when gt_id is null or (pred_id is not null and gl <> pl) then 1 else 0 end) as fp, sum(case when pred_id is null then 1 else 0 end) as fn,
    sum(case when gt_id is not null and pred_id is not null then 1 else 0 end) as nm, sum(case when gr = pr then 1 else 0 end) as r, sum(case when gc = pc then 1 else 0 end) as c, count(gt_id) as n from o group by scene_id)
select scene_id, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as token_f1, round(case when nm > 0 then r / nm else 0 end, 6) as row_accuracy,
  round(case when nm > 0 then c / nm else 0 end, 6) as col_accuracy, tp = n and fp = 0 and fn = 0 as exact_match, cast(tp as bigint) as n_correct, n as n_total from k""")
def a10_scene_scores(t):
    return rounded(evaluate.scene_scores(placed(t.gt_symbols), placed(t.predictions)), "token_f1", "row_accuracy", "col_accuracy")


# Suppression as rounds: a box that no open box above it hides is kept; what kept boxes hide goes.
def suppress_sql(rounds: int = 9) -> str:
    over = f"({IOU.replace('a.x', 'h.x').replace('a.y', 'h.y').replace('b.x', 'd.x').replace('b.y', 'd.y')} > 0.3 or ({IW.replace('a.x', 'h.x').replace('a.y', 'h.y').replace('b.x', 'd.x').replace('b.y', 'd.y')}) / nullif(least({AREA.format('h')}, {AREA.format('d')}), 0) > 0.3)"
    out = [
        "r as materialized (select *, row_number() over (partition by scene_id order by case when source = 'a' then 0 else 1 end, confidence desc, det_id) as k from two_sources)",
        f"e as materialized (select h.scene_id, h.k as hi, d.k as lo from r h join r d on d.scene_id = h.scene_id and h.k < d.k where {over})",
        "o0 as materialized (select scene_id, k, det_id, source from r)",
    ]
    for i in range(rounds):
        out.append(f"k{i} as materialized (select * from o{i} o where not exists (select 1 from e join o{i} h on h.scene_id = e.scene_id and h.k = e.hi where e.scene_id = o.scene_id and e.lo = o.k))")
        out.append(
            f"o{i + 1} as materialized (select * from o{i} o where not exists (select 1 from k{i} k where k.scene_id = o.scene_id and k.k = o.k) and not exists (select 1 from e join k{i} k on k.scene_id = e.scene_id and k.k = e.hi where e.scene_id = o.scene_id and e.lo = o.k))"
        )
    out.append("kept as materialized (" + " union all ".join(f"select * from k{i}" for i in range(rounds)) + ")")
    return ", ".join(out)


NMS = f"with {suppress_sql()}"


@query(f"{NMS} select scene_id, det_id, source from kept")
def n01_suppress(t):
    return match.suppress(t.two_sources, "a").select("scene_id", "det_id", "source")


@query(f"{NMS} select scene_id, count(*) filter (where source = 'a') as a, count(*) filter (where source = 'b') as b from kept group by scene_id")
def n10_provenance(t):
    return match.provenance(match.suppress(t.two_sources, "a"), ["a", "b"])


@query("select scene_id, det_id, label from (select *, row_number() over (partition by scene_id, row, label order by confidence desc, det_id) as r from detections) q where label <> 'result_bar' or r = 1")
def n02_best_bar(t):
    return match.best_bar(t.detections).select("scene_id", "det_id", "label")


@query()
def n03_distinct_operators(t):
    return match.distinct_operators(t.detections).select("scene_id", "det_id", "label")


@query("select scene_id, det_id, cast(rank as int) as rank, n > 5 as truncated from (select *, row_number() over (partition by scene_id order by confidence desc, det_id) as rank, count(*) over (partition by scene_id) as n from detections) q where rank <= 5")
def n08_truncated(t):
    return match.truncated(t.detections, 5).select("scene_id", "det_id", "rank", "truncated")


@query("""with c as (select scene_id, count(*) as n from detections where not given group by scene_id),
g as (select d.scene_id, det_id, n, row_number() over (partition by d.scene_id order by case when label like 'op%' then 0 else 1 end, det_id) as r from detections d left join c on c.scene_id = d.scene_id where given)
select scene_id, det_id as given_id from g where r <= greatest(0, 6 - coalesce(n, 0))""")
def n09_capped_given(t):
    d = t.detections
    given = d.where("given").select("scene_id", F.col("det_id").alias("given_id"), "label")
    child = d.where("not given").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_child"))
    return match.capped_given(given, child, 6).select("scene_id", "given_id")


@query("""with s as (select scene_id, count(*) filter (where source = 'a') >= 2 and avg(confidence) filter (where source = 'a') >= 0.6 as enough from two_sources group by scene_id)
select d.scene_id, det_id from two_sources d join s on s.scene_id = d.scene_id where source = 'a' or not coalesce(enough, false)""")
def n11_gated(t):
    return match.gated(t.two_sources, "a", 2).select("scene_id", "det_id")


CELLS = "select scene_id, gt_id as cell_id, x0 - 8 as x0, y0 - 8 as y0, x1 + 8 as x1, y1 + 8 as y1 from gt_symbols where gt_id % 2 = 0"


@query(f"""with c as ({CELLS}), p as (select d.scene_id, det_id, cell_id from detections d join c on c.scene_id = d.scene_id and (d.x0 + d.x1) / 2 between c.x0 and c.x1 and (d.y0 + d.y1) / 2 between c.y0 and c.y1),
recursive_guard as (select 1 as x), r0 as (select * from p),
{", ".join(f"t{i} as (select scene_id, det_id, cell_id from (select *, row_number() over (partition by scene_id order by det_id, cell_id) as k from r{i}) q where k = 1), r{i + 1} as (select r.* from r{i} r where not exists (select 1 from t{i} t where t.scene_id = r.scene_id and (t.det_id = r.det_id or t.cell_id = r.cell_id)))" for i in range(8))}
{" union all ".join(f"select * from t{i}" for i in range(8))}""".replace("recursive_guard as (select 1 as x), ", ""))
def j06_merge_given(t):
    return match.merge_given(t.detections, t.sql(CELLS))[0]


@query(f"""with c as ({CELLS}), p as (select d.scene_id, det_id, cell_id from detections d join c on c.scene_id = d.scene_id and (d.x0 + d.x1) / 2 between c.x0 and c.x1 and (d.y0 + d.y1) / 2 between c.y0 and c.y1),
i as (select distinct scene_id, det_id from p) select d.scene_id, d.det_id from detections d left join i on i.scene_id = d.scene_id and i.det_id = d.det_id where i.det_id is null""")
def j06_outside_all_cells(t):
    d, c = t.detections, t.sql(CELLS)
    both = d.join(c.select("scene_id", *[F.col(x).alias(f"c_{x}") for x in g.BOX]), "scene_id")
    cx, cy = g.center_x(g.box()), g.center_y(g.box())
    inside = both.where((cx >= F.col("c_x0")) & (cx <= F.col("c_x1")) & (cy >= F.col("c_y0")) & (cy <= F.col("c_y1")))
    return d.select("scene_id", "det_id").join(inside, ["scene_id", "det_id"], "left_anti")


@query("""select d.scene_id, d.det_id, case when given then coalesce(k.label, d.label) else d.label end as label
from detections d left join (select scene_id, x0, y0, x1, y1, min(label) as label from gt_symbols group by all) k on k.scene_id = d.scene_id and k.x0 = d.x0 and k.y0 = d.y0 and k.x1 = d.x1 and k.y1 = d.y1""")
def j07_pin_labels(t):
    known = t.gt_symbols.groupBy("scene_id", *g.BOX).agg(F.min("label").alias("label"))
    return match.pin_labels(t.detections, known).select("scene_id", "det_id", "label")


def size_sql(source: str, value: str, size: str, name: str, where: str = "true") -> str:
    return f"""(select scene_id, det_id, cast(sum(case when v - p > w then 1 else 0 end) over (partition by scene_id order by v, det_id rows unbounded preceding) as int) as {name}, v
  from (select q.*, lag(v) over (partition by scene_id order by v, det_id) as p, m.w from (select scene_id, det_id, {value} as v from {source} where {where}) q
    join (select scene_id, list_sort(list({size}))[count(*) // 2 + 1] * 0.5 as w from {source} where {where} group by scene_id) m using (scene_id)) z)"""


FREE = "label not in ('result_bar', 'div_bracket')"


@query(f"""with rc as {size_sql('detections', '(y0 + y1) / 2', 'y1 - y0', 'row_cluster')}, cc as {size_sql('detections', '(x0 + x1) / 2', 'x1 - x0', 'col_cluster', FREE)},
lone as (select scene_id from detections group by scene_id having count(*) filter (where {FREE}) = 0), ac as {size_sql('detections', '(x0 + x1) / 2', 'x1 - x0', 'col_cluster')},
st as (select d.scene_id, d.det_id, c.col_cluster, row_number() over (partition by d.scene_id, d.det_id order by abs((d.x0 + d.x1) / 2 - c.v), c.det_id) as k from detections d join cc c on c.scene_id = d.scene_id where not ({FREE}))
select rc.scene_id, rc.det_id, row_cluster, coalesce(cc.col_cluster, st.col_cluster, ac.col_cluster) as col_cluster from rc left join cc on cc.scene_id = rc.scene_id and cc.det_id = rc.det_id
left join st on st.scene_id = rc.scene_id and st.det_id = rc.det_id and k = 1 left join ac on ac.scene_id = rc.scene_id and ac.det_id = rc.det_id""")
def w02_rows_and_columns(t):
    return cluster.rows_and_columns(t.detections).select("scene_id", "det_id", "row_cluster", "col_cluster")


@query("""select scene_id, det_id, cast(least(row_number() over (partition by scene_id, row order by col, det_id) - 1, 7) as int) as within_row_ord,
  cast(least(row_number() over (partition by scene_id, col order by row, det_id) - 1, 7) as int) as within_col_ord from detections""")
def w03_ordinals(t):
    return cluster.ordinals(t.detections).select("scene_id", "det_id", F.col("within_row_ord").cast("int").alias("within_row_ord"), F.col("within_col_ord").cast("int").alias("within_col_ord"))


SHAKEN = "select scene_id, det_id, label, confidence, x0, y0, x1, y1, case when det_id % 5 = 0 then row + 3 else row end as row, col from detections"


@query(f"""with d as ({SHAKEN}), m as (select scene_id, row, median((y0 + y1) / 2) as m from d where {FREE} group by scene_id, row),
f as (select scene_id, row, coalesce(lag(m) over w > m or lead(m) over w < m, false) as spatial_conflict from m window w as (partition by scene_id order by row))
select d.scene_id, det_id, coalesce(f.spatial_conflict, false) and {FREE} as spatial_conflict from d left join f on f.scene_id = d.scene_id and f.row = d.row""")
def w05_row_conflicts(t):
    return cluster.row_conflicts(t.sql(SHAKEN)).select("scene_id", "det_id", "spatial_conflict")


@query("select scene_id, det_id, cast(dense_rank() over (partition by scene_id order by row) - 1 as int) as out_row, cast(row_number() over (partition by scene_id, row order by col, det_id) - 1 as int) as out_col, col as grid_col from detections")
def w06_renumbered(t):
    return cluster.renumbered(t.detections).select("scene_id", "det_id", "out_row", "out_col", "grid_col")


@query("""with n as (select scene_id, det_id, label, dense_rank() over (partition by scene_id order by row) - 1 as r, row_number() over (partition by scene_id, row order by col, det_id) - 1 as c from detections),
l as (select scene_id, r, string_agg(label, ' ' order by c) as row_text from n group by scene_id, r) select scene_id, string_agg(row_text, ' / ' order by r) as shown, count(*) as n_rows from l group by scene_id""")
def w06_nested_rows(t):
    df = cluster.nested_rows(cluster.renumbered(t.detections))
    text = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r["tokens"], lambda x: x["label"]), " ")), " / ")
    return df.select("scene_id", text.alias("shown"), F.size("rows").cast("long").alias("n_rows"))


@query("""with m as (select scene_id, col, min(y0) as top from detections where label like 'main%' group by scene_id, col)
select d.scene_id, det_id, label like 'carry%' and (top is null or y0 < top) as carry_conflict from detections d left join m on m.scene_id = d.scene_id and m.col = d.col""")
def j27_carry_conflicts(t):
    return cluster.carry_conflicts(t.detections).select("scene_id", "det_id", "carry_conflict")


@query("""with c as (select scene_id, count(*) as n, count(*) filter (where label like 'main%' or label like 'carry%') as d, count(*) filter (where label like 'op%' or label = 'result_bar') as s, count(*) filter (where label = 'result_bar') as m from detections group by scene_id)
select s.scene_id, case when coalesce(n, 0) = 0 then 'ood' when n = 1 then 'bare_digits' when d = 0 and m > 0 then 'bare_digits' when d = 0 then 'ood' when c.s = 0 then 'bare_digits' else 'valid' end as route,
  case when coalesce(n, 0) = 0 then 'true_empty' when n > 1 and d = 0 and m = 0 then 'no_digits' end as ood_reason from scenes s left join c on c.scene_id = s.scene_id""")
def a27_gate(t):
    return cluster.gate(t.detections, t.scenes)


OPS = "select scene_id, det_id, confidence, case when label like 'carry%' then 'op_minus' when label = 'result_bar' and det_id % 4 = 3 then 'op_times' when det_id % 11 = 1 then 'div_bracket' else label end as label from detections"


@query(f"""with c as (select scene_id, count(*) filter (where label = 'op_plus') as p, count(*) filter (where label = 'op_minus') as m, count(*) filter (where label = 'op_times') as x, count(*) filter (where label = 'op_divide') as d, coalesce(max(confidence) filter (where label = 'div_bracket'), 0.0) as b from ({OPS}) o group by scene_id)
select scene_id, p as op_plus, m as op_minus, x as op_times, d as op_divide, cast(b as double) as bracket_conf, case when b > 0.3 or d > 0 then 'divide' when x > 0 then 'multiply' when m > p then 'subtract' when p > m then 'add' end as implied from c""")
def a26_implied_kind(t):
    return cluster.implied_kind(t.sql(OPS))


@query("""with r as (select scene_id, row, string_agg(case when label like 'main%' then substring(label, 6) when label = 'op_plus' then '+' when label = 'result_bar' then '─────' else label end, ' ' order by col, det_id) as x from detections group by scene_id, row)
select scene_id, string_agg(x, ' / ' order by row) as text from r group by scene_id""")
def a44_typeset(t):
    return cluster.typeset(t.detections.withColumn("glyph", ontology.display_glyph(F.col("label"))))


ARI = "select vec_id % 20 as scene_id, label, cast(floor(embedding[{0}] * 4) as int) as c from embeddings"


@query(f"""with e as ({ARI.format(1)}), n as (select scene_id, label, c, count(*) as k from e group by all),
i as (select scene_id, sum(k * (k - 1) / 2) as x, sum(k) as n from n group by scene_id), a as (select scene_id, sum(k * (k - 1) / 2) as x from (select scene_id, label, sum(k) as k from n group by all) group by scene_id),
b as (select scene_id, sum(k * (k - 1) / 2) as x from (select scene_id, c, sum(k) as k from n group by all) group by scene_id)
select i.scene_id, cast(i.n as bigint) as n_items, round(case when i.n < 2 then 0 when (a.x + b.x) / 2 = a.x * b.x / (i.n * (i.n - 1) / 2) then 1 else greatest(0, (i.x - a.x * b.x / (i.n * (i.n - 1) / 2)) / ((a.x + b.x) / 2 - a.x * b.x / (i.n * (i.n - 1) / 2))) end, 6) as ari
from i join a using (scene_id) join b using (scene_id)""")
def a07_rand_index(t):
    return cluster.rand_index(t.sql(ARI.format(0)), "label", "c").withColumn("ari", F.round("ari", R))


COARSE = "select scene_id, det_id, confidence, x0, y0, x1, y1, case when label like 'main%' then 'digit_main' when label like 'carry%' then 'digit_carry' when label like 'op%' then 'operator' else label end as coarse from detections"
NODE = f"""n as (select scene_id, det_id, coarse, confidence, (x0 + x1) / 2 / 512 as cx, (y0 + y1) / 2 / 512 as cy, greatest(x1 - x0, 1) / 512 as w, greatest(y1 - y0, 1) / 512 as h from ({COARSE}) c)"""


@query(f"with {NODE} select scene_id, det_id, round(cx, 6) as cx, round(cy, 6) as cy, round(w * h, 6) as area, coarse = 'digit_main' as is_main, confidence, case coarse when 'digit_main' then 0.5 when 'digit_carry' then 0.3 else 1.0 end::double as importance from n")
def p16_node_features(t):
    f = lambda i: F.get("features", i)
    df = graph.node_features(t.sql(COARSE))
    return df.select("scene_id", "det_id", F.round(f(0), R).alias("cx"), F.round(f(1), R).alias("cy"), F.round(f(4), R).alias("area"), (f(5) == 1).alias("is_main"), f(11).alias("confidence"), f(12).alias("importance"))


MED = """md as (select scene_id, list_sort(case when count(*) filter (where coarse = 'digit_main') > 0 then list(w) filter (where coarse = 'digit_main') else list(w) end) as ws,
  list_sort(case when count(*) filter (where coarse = 'digit_main') > 0 then list(h) filter (where coarse = 'digit_main') else list(h) end) as hs from n group by scene_id)"""


@query(f"with {NODE}, {MED} select scene_id, round(ws[(len(ws) - 1) // 2 + 1], 9) as median_w, round(hs[(len(hs) - 1) // 2 + 1], 9) as median_h from md")
def a30_scene_medians(t):
    return graph.scene_medians(graph.node_features(t.sql(COARSE))).withColumns({"median_w": F.round("median_w", 9), "median_h": F.round("median_h", 9)})


@query(f"""with {NODE}, {MED}, e as (select a.scene_id, a.det_id as src, b.det_id as dst, b.cx - a.cx as dx, b.cy - a.cy as dy, sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy) + 1e-8) as dist, a.w as aw, b.w as bw, a.h as ah, b.h as bh,
    a.coarse as ca, b.coarse as cb, ws[(len(ws) - 1) // 2 + 1] as mw from n a join n b on b.scene_id = a.scene_id and a.det_id <> b.det_id join md on md.scene_id = a.scene_id)
select scene_id, src, dst, round(dist, 6) as dist, round(bw / (aw + 1e-6), 6) as w_ratio, round(dy / (dist + 1e-8), 6) as angle_sin, round(dx / (mw + 1e-6), 6) as col_delta, round(bw * bh / (aw * ah + 1e-6), 6) as size_ratio, round(ln(dist + 1e-8), 6) as log_dist, ca = cb as same,
  case when ca = 'digit_main' and cb = 'digit_main' then 0 when 'digit_main' in (ca, cb) and 'digit_carry' in (ca, cb) then 1 when ca = 'digit_carry' and cb = 'digit_carry' then 2
    when 'operator' in (ca, cb) and (ca like 'digit%' or cb like 'digit%') then 3 when 'result_bar' in (ca, cb) and (ca like 'digit%' or cb like 'digit%') then 4 when 'operator' in (ca, cb) then 6 else 7 end as edge_type from e""")
def j17_edges(t):
    f = lambda i: F.round(F.get("features", i), R)
    df = graph.edges(graph.node_features(t.sql(COARSE)))
    return df.select("scene_id", "src", "dst", f(2).alias("dist"), f(3).alias("w_ratio"), f(5).alias("angle_sin"), f(7).alias("col_delta"), f(9).alias("size_ratio"), f(10).alias("log_dist"), (f(15) == 1).alias("same"), "edge_type")


@query(f"""with {NODE}, {MED}, e as (select a.scene_id, a.det_id as src, b.det_id as dst, b.cx - a.cx as dx, b.cy - a.cy as dy, sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy) + 1e-8) as dist, a.h as ah, b.h as bh, a.coarse as ca, b.coarse as cb,
    hs[(len(hs) - 1) // 2 + 1] as mh from n a join n b on b.scene_id = a.scene_id and a.det_id <> b.det_id join md on md.scene_id = a.scene_id)
select scene_id, src, dst, round(dx, 6) as dx, round(dy, 6) as dy, round(bh / (ah + 1e-6), 6) as h_ratio, round(dx / (dist + 1e-8), 6) as angle_cos, round(dy / (mh + 1e-6), 6) as row_delta,
  ca = 'operator' as src_operator, cb = 'operator' as dst_operator, ca = 'result_bar' as src_structure, cb = 'result_bar' as dst_structure from e""")
def p17_edge_features(t):
    """The features that j17_edges leaves out."""
    x, f = lambda i: F.get("features", i), lambda i: F.round(F.get("features", i), R)
    df = graph.edges(graph.node_features(t.sql(COARSE)))
    return df.select(
        "scene_id", "src", "dst", f(0).alias("dx"), f(1).alias("dy"), f(4).alias("h_ratio"), f(6).alias("angle_cos"), f(8).alias("row_delta"),
        (x(11) == 1).alias("src_operator"), (x(12) == 1).alias("dst_operator"), (x(13) == 1).alias("src_structure"), (x(14) == 1).alias("dst_structure"),
    )


@query(f"""with c as ({COARSE}), r as {size_sql('c', '(y0 + y1) / 2', 'greatest(abs(y1 - y0), 1)', 'rc')}, k as (select scene_id, max(rc) + 1 as n_rows from r group by scene_id)
select c.scene_id, round(count(*) / 80, 6) as total, round(count(*) filter (where coarse = 'operator') / 4, 6) as operators, round(max(n_rows) / 6, 6) as n_rows, round(stddev_pop(greatest(abs(x1 - x0), 1) / greatest(abs(y1 - y0), 1)) / 2 + 1e-9, 6) as spread from c join k on k.scene_id = c.scene_id group by c.scene_id""")
def a29_scene_summary(t):
    f = lambda i: F.round(F.get("summary", i), R)
    return graph.scene_summary(t.sql(COARSE)).select("scene_id", f(0).alias("total"), f(3).alias("operators"), f(6).alias("n_rows"), F.round(F.get("summary", 7) + TIE, R).alias("spread"))


@query("""with v as (select vec_id, list_transform([1, 2, 3, 4], lambda i: cast(embedding[i] as double) * 3) as l from embeddings), e as (select vec_id, list_transform(l, lambda x: exp(x - list_max(l))) as e from v), p as (select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from e),
h as (select vec_id, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))) as h from p) select vec_id, round(h, 6) as entropy, h > 0.85 * ln(4) as ood from h""")
def p21_kind_entropy(t):
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 3)
    h, ood = graph.kind_entropy(F.col("logits"))
    return t.embeddings.select("vec_id", logits.alias("logits")).select("vec_id", F.round(h, R).alias("entropy"), ood.alias("ood"))


@query("""select scene_id, gt_id, cast(greatest(0, least(9, floor((x0 - 20) / 44))) as int) as cx, cast(greatest(0, least(9, floor((y0 - 10) / 44))) as int) as cy, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) as diagonal, (x1 - x0) * (y1 - y0) as area from gt_symbols""")
def p22_cells(t):
    b = g.box()
    return t.gt_symbols.select("scene_id", "gt_id", g.cell(b[0], F.lit(20), F.lit(44), F.lit(10)).alias("cx"), g.cell(b[1], F.lit(10), F.lit(44), F.lit(10)).alias("cy"), F.round(g.diagonal(b), R).alias("diagonal"), g.area(b).alias("area"))


@query("""select a.scene_id, a.gt_id as a, b.gt_id as b, a.x0 <= b.x1 and b.x0 <= a.x1 as meets, round(sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)), 6) as gap from gt_symbols a join gt_symbols b on b.scene_id = a.scene_id and a.gt_id < b.gt_id""")
def p12_box_relations(t):
    d = t.gt_symbols
    both = d.select("scene_id", F.col("gt_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in g.BOX]).join(d.select("scene_id", F.col("gt_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in g.BOX]), "scene_id").where("a < b")
    x, y = g.box("a_"), g.box("b_")
    return both.select("scene_id", "a", "b", g.spans_overlap(x, y).alias("meets"), F.round(g.gap(x, y), R).alias("gap"))


@query("""with p as (select scene_id, pred_id, label, conf, x0 + 60 as x0, y0 - 30 as y0, x1 + 60 as x1, y1 - 30 as y1 from predictions), c as (select scene_id, pred_id, conf, greatest(0, x0) as x0, greatest(0, y0) as y0, least(512, x1) as x1, greatest(0, y1) as y1 from p)
select scene_id, pred_id, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(y1 as double) as y1, conf < 0.6 as low_conf, (x1 - x0) * (y1 - y0) >= 30 and greatest(x1 - x0, y1 - y0) >= 4 and greatest(x1 - x0, y1 - y0) <= 10 * least(x1 - x0, y1 - y0) as component_ok from c""")
def p13_clipped(t):
    b = g.box()
    moved = (b[0] + 60, b[1] - 30, b[2] + 60, b[3] - 30)
    df = t.predictions.select("scene_id", "pred_id", "conf", *[c.alias(n) for c, n in zip(g.clipped(moved), g.BOX, strict=True)])
    w, h = b[2] - b[0], b[3] - b[1]
    ok = (w * h >= 30) & (F.greatest(w, h) >= 4) & (F.greatest(w, h) <= 10 * F.least(w, h))
    return df.select("scene_id", "pred_id", *g.BOX, (F.col("conf") < 0.6).alias("low_conf"), ok.alias("component_ok"))


@query(f"""{CONF}, l as (select unnest(range(0, 12)) as i), k as (select 'main_' || i as label from l), a as (select gt_label as label, sum(n) as real, sum(case when gt_label = pred_label then n else 0 end) as tp from c group by 1),
s as (select pred_label as label, sum(n) as said from c group by 1), f as (select case when coalesce(real, 0) + coalesce(said, 0) > 0 then 2 * coalesce(tp, 0) / (coalesce(real, 0) + coalesce(said, 0)) else 0 end as f1, real, tp from k left join a on a.label = k.label left join s on s.label = k.label)
select round(avg(f1), 6) as macro_f1, round(sum(tp) / sum(real), 6) as accuracy from f""")
def a08_macro_f1(t):
    return rounded(evaluate.macro_f1(a04_confusion(t), [f"main_{i}" for i in range(12)]), "macro_f1", "accuracy")


ALIGNED = """a as (select scene_id, label, cast(floor(x0 / 64) as int) as col, cast(floor(y0 / 64) as int) as row, gt_id as ord from gt_symbols), b as (select scene_id, pred_id as ord, label, cast(floor(x0 / 64) as int) as col, cast(floor(y0 / 64) as int) as row from predictions where pred_id < 100),
j as (select coalesce(a.scene_id, b.scene_id) as scene_id, a.ord as ao, b.ord as bo, coalesce(a.label = b.label, false) as l, coalesce(a.row = b.row, false) as r, coalesce(a.col = b.col, false) as c from a full join b on a.scene_id = b.scene_id and a.ord = b.ord)"""


@query(f"""with {ALIGNED}, g as (select scene_id, count(ao) = count(bo) as fits, avg(l::int) as l, avg(r::int) as r, avg(c::int) as c, bool_and(l and r and c) as s from j group by scene_id)
select g.scene_id, round(case when fits then l else 0 end, 6) as label_acc, round(case when fits then r else 0 end, 6) as row_acc, round(case when fits then c else 0 end, 6) as col_acc,
  cast(case when fits and pred_kind = equation_kind then 1 else 0 end as double) as kind_acc, cast(case when fits and g.s then 1 else 0 end as double) as exact from g join scenes k on k.scene_id = g.scene_id""")
def a09_aligned_metrics(t):
    tidy = lambda d, i: placed(d).select("scene_id", F.col(i).alias("ord"), "label", "row", "col")
    return rounded(evaluate.aligned_metrics(tidy(t.predictions.where("pred_id < 100"), "pred_id"), tidy(t.gt_symbols, "gt_id"), t.scenes.select("scene_id", "pred_kind", "equation_kind")), "label_acc", "row_acc", "col_acc")


@query(f"""{SAMPLES}, a as (select avg(kind_ok::int) as kind_acc, avg(case when matched > 0 then label_correct / matched end) as label_acc, avg(recall) as recall, avg(row_acc) as row_acc, avg(col_acc) as col_acc from s where scene_id % 2 = 0),
b as (select avg(kind_ok::int) as kind_acc, avg(case when matched > 0 then label_correct / matched end) as label_acc, avg(recall) as recall, avg(row_acc) as row_acc, avg(col_acc) as col_acc from s where scene_id % 2 = 1)
{" union all ".join(f"select '{m}' as metric, round(a.{m}, 6) as current, round(b.{m}, 6) as baseline, round(a.{m} - b.{m}, 6) as delta from a, b" for m in ("kind_acc", "label_acc", "recall", "row_acc", "col_acc"))}""")
def j18_compared(t):
    s = samples(t)
    return rounded(evaluate.compared(evaluate.aggregate_metrics(s.where("scene_id % 2 = 0")), evaluate.aggregate_metrics(s.where("scene_id % 2 = 1"))), "current", "baseline", "delta")


@query()
def j05_assign(t):
    return match.assign(t.gt_symbols.withColumnRenamed("gt_id", "target_id"), t.detections).withColumn("distance", F.round("distance", R))


@query()
def n04_merge_boxes(t):
    return match.merge_boxes(t.detections)


@query()
def n05_merge_overlapping(t):
    return match.merge_overlapping(t.detections.withColumnRenamed("det_id", "box_id"))
