"""Queries over labelled datasets: validation, duplicates, splits, leakage, balance, weights, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ontology as o
from ..operators import quality
from .registry import query

LABELS = ["de", "en", "es", "fr", "it"]


def assets(t):
    return t.assets.select("path", "label", "doc_id", F.sha2("text", 256).alias("sha256"))


A = "with a as (select path, label, doc_id, sha256(text) as sha256 from assets)"
CANONICAL = "f as (select * from (select *, row_number() over (partition by sha256 order by path) as r from a) q where r = 1)"
SPLIT = f"""{A}, {CANONICAL}, q as (select *, count(*) over (partition by label) as n, row_number() over (partition by label order by sha256('42:' || sha256), path) as p from f),
o as (select *, case when n < 2 then 0 else least(cast(round_even(n * (0.1 + 0.1), 0) as int), cast(n - 1 as int)) end as gone from q),
s as (select path, label, doc_id, sha256, case when p <= cast(round_even(gone * (0.1 / (0.1 + 0.1)), 0) as int) then 'val' when p <= gone then 'test' else 'train' end as split from o)"""


@query(f"{A} select path, label, sha256, n from (select *, count(*) over (partition by sha256) as n from a) q where n > 1")
def n06_duplicates(t):
    return quality.duplicates(assets(t)).drop("doc_id")


@query(f"{A}, {CANONICAL} select path, label, sha256 from f")
def n07_first_of_each(t):
    return quality.first_of_each(assets(t)).select("path", "label", "sha256")


@query(f"{SPLIT} select path, label, split from s")
def w10_stratified_split(t):
    return quality.stratified_split(assets(t)).select("path", "label", "split")


BY_LABELLED = "with s as (select sha256(text) as sha256, case when l.doc_id is null then 'open' when quality = 1 then 'good' else 'poor' end as split from documents d left join labels l on l.doc_id = d.doc_id)"


@query(f"{BY_LABELLED} select a.split as a, b.split as b, count(*) as shared from s a join (select distinct sha256, split from s) b on a.sha256 = b.sha256 and a.split < b.split group by 1, 2")
def j09_leakage(t):
    split = F.when(F.col("quality").isNull(), "open").when(F.col("quality") == 1, "good").otherwise("poor")
    rows = t.documents.join(t.labels, "doc_id", "left").select(F.sha2("text", 256).alias("sha256"), split.alias("split"))
    return quality.leakage(rows).withColumn("shared", F.col("shared").cast("long"))


@query(f"{SPLIT} select coalesce(split, 'all') as split, coalesce(label, 'all') as label, count(*) as n from s group by cube (split, label)")
def a12_class_balance(t):
    return quality.class_balance(quality.stratified_split(assets(t)))


@query(f"""{SPLIT}
select (select count(*) from a) as n_rows, (select count(distinct label) from a) as n_classes, (select count(*) - count(distinct sha256) from a) as n_duplicates,
  count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'val') as n_val, count(*) filter (where split = 'test') as n_test,
  (select count(*) from (select l from (select unnest(['de', 'en', 'es', 'fr', 'it']) as l) z where l not in (select label from a))) as n_issues from s""")
def a13_dataset_meta(t):
    a = assets(t)
    meta = quality.dataset_meta(a, quality.stratified_split(a), quality.vocabulary_issues(a, LABELS))
    return meta.select([F.col(c).cast("long").alias(c) for c in meta.columns])


@query(f"""{A}, c as (select label, count(*) as n from a group by label), w as (select unnest(['en', 'fr', 'it', 'de']) as label), b as (select coalesce(c.label, w.label) as label, n, w.label is not null as need from c full join w on w.label = c.label)
select 'unknown_label' as kind, label as path, 'label is not in the vocabulary' as detail, 'error' as severity from b where not need
union all select 'missing_required_label', label, 'no rows', 'error' from b where need and n is null
union all select 'insufficient_class_count', label, 'need 200, got ' || n, 'error' from b where need and n < 200""")
def a14_vocabulary_issues(t):
    return quality.vocabulary_issues(assets(t), ["en", "fr", "it", "de"], 200)


@query(f"{A}, c as (select label, count(*) as n from a group by label) select 'unknown_label' as kind, label as path, 'label is not in the vocabulary' as detail, 'error' as severity from c where label not in ('en', 'fr') order by path limit 10")
def a15_gate(t):
    return quality.gate(quality.vocabulary_issues(assets(t), ["en", "fr"]))


BROKEN = """select scene_id, gt_id, case when gt_id % 7 = 3 then 'label_' || cast(gt_id as string) when gt_id % 11 = 5 then null else label end as label,
  x0, y0, case when scene_id % 13 = 0 then x0 when scene_id % 17 = 0 then x1 + 200 else x1 end as x1, y1 from gt_symbols"""


@query(f"""with b as ({BROKEN}) select 'unknown_label' as kind, scene_id || '/' || gt_id as path, coalesce(label, 'missing') as detail, 'error' as severity from b where label is null or label like 'label%'
union all select 'invalid_box', scene_id || '/' || gt_id, 'box outside the canvas or reversed', 'error' from b where not (x0 >= 0 and y0 >= 0 and x0 < x1 and y0 < y1 and x1 <= 512 and y1 <= 512)""")
def p07_symbol_issues(t):
    return quality.symbol_issues(t.sql(BROKEN))


@query("""select 'invalid_kind' as kind, cast(scene_id as string) as path, equation_kind as detail, 'error' as severity from scenes where equation_kind = 'none'
union all select 'invalid_case', cast(scene_id as string), scene_case, 'error' from scenes where scene_case not in ('BUILDING', 'MACHINERY')""")
def p07_scene_issues(t):
    return quality.scene_issues(t.scenes, ["BUILDING", "MACHINERY"])


LINES = """select cast(l_orderkey as string) || '/' || cast(l_linenumber as string) || '/' || cast(l_partkey as string) || '/' || cast(l_suppkey as string) as path,
  case when l_partkey % 10 = 0 then ' ' when l_partkey % 10 = 1 then '1 0.5 0.5 0.1' when l_partkey % 10 = 2 then 'x 0.5 0.5 0.1 0.1' else
  cast(l_partkey % 8 as string) || ' 0.' || cast(l_suppkey as string) || ' ' || cast(l_suppkey % 3 as string) || '.5 0.25 ' || case when l_partkey % 9 = 0 then '0' else '0.5' end end as text from lineitem"""


@query(f"""with l as ({LINES}), f as (select path, text, string_split(text, ' ') as f from l where trim(text) <> ''),
g as (select *, len(f) = 5 and try_cast(f[1] as int) is not null as ok, len(f) as n from f)
select 'field_count' as kind, path || ':1' as path, cast(n as varchar) as detail, 'error' as severity from g where n <> 5
union all select 'parse', path || ':1', text, 'error' from g where n = 5 and not ok
union all select 'class_range', path || ':1', f[1], 'error' from g where ok and f[1]::int not between 0 and 5
union all select 'cx_range', path || ':1', f[2], 'error' from g where ok and f[2]::double not between 0 and 1
union all select 'cy_range', path || ':1', f[3], 'error' from g where ok and f[3]::double not between 0 and 1
union all select 'h_range', path || ':1', f[5], 'error' from g where ok and not (f[5]::double > 0 and f[5]::double <= 1)
union all select 'empty_file', path, 'no boxes', 'warning' from l where trim(text) = ''""")
def p08_box_line_issues(t):
    return quality.box_line_issues(t.sql(LINES))


TRUTH = """select cast(o_orderkey as string) as path, case when o_orderkey % 5 = 0 then '{"symbols": []}' when o_orderkey % 5 = 1 then '{"equation_type": "addition"}'
  when o_orderkey % 5 = 2 then '{"equation_type": "addition", "symbols": [{"bbox": [1, 2, 3, 4]}]}' when o_orderkey % 5 = 3 then '{"equation_type": "addition", "symbols": [{"fine_label": "main_1", "bbox": [1, 2, 3]}]}'
  else '{"equation_type": "addition", "symbols": [{"fine_label": "main_1", "bbox": [1, 2, 3, 4]}]}' end as json from orders"""


@query("""select case o_orderkey % 5 when 0 then 'missing_equation_type' when 1 then 'missing_symbols' when 2 then 'missing_fine_label' else 'invalid_bbox' end as kind, cast(o_orderkey as string) as path,
  case o_orderkey % 5 when 0 then 'equation_type' when 1 then 'symbols' when 2 then 'fine_label' else 'bbox' end as detail, 'error' as severity from orders where o_orderkey % 5 <> 4""")
def p10_truth_issues(t):
    return quality.truth_issues(t.sql(TRUTH))


@query("select label, count(*) as n from gt_symbols group by label")
def a16_label_counts(t):
    return t.gt_symbols.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


CASES = "select scene_id, scene_case as case_name from scenes where scene_case is not null"


@query(f"""with k as (select label, count(*) as have from gt_symbols group by label having count(*) < (select count(*) / 10 from gt_symbols)), h as (select distinct c.case_name, g.label from gt_symbols g join ({CASES}) c on c.scene_id = g.scene_id)
select h.case_name as "case", h.label, have, cast(greatest(1, round_even(40 * length(h.case_name) / 10.0, 0)) as bigint) as add_images from h join k on k.label = h.label""")
def a17_topup_plan(t):
    cases = t.sql(CASES).withColumnRenamed("case_name", "case")
    budgets = quality.case_budgets(cases.select("case", (F.length("case") / 10.0).alias("weight")).distinct(), 40)
    tenth = t.gt_symbols.count() / 10
    return quality.topup_plan(t.gt_symbols, cases, tenth, budgets)


@query("""with c as (select n_name, (n_nationkey - 3) / 7.0 as w from nation), b as (select n_name, greatest(1, round_even(30 * greatest(w, 0), 0)) as n from c)
select n_name as "case", cast(n as bigint) as n_train, cast(greatest(1, round_even(n * (0.1 / 0.8), 0)) as bigint) as n_val, cast(greatest(1, round_even(n * (0.1 / 0.8), 0)) as bigint) as n_test from b""")
def a18_case_budgets(t):
    return quality.case_budgets(t.nation.select(F.col("n_name").alias("case"), ((F.col("n_nationkey") - 3) / 7.0).alias("weight")), 30)


@query(f"{A}, c as (select label, count(*) as n from a group by label), w as (select label, sum(n) over () / (count(*) over () * n) as weight from c) select l.label, round(coalesce(weight, 1.0), 6) as weight from (select unnest(['de', 'en', 'es', 'fr', 'it']) as label) l left join w on w.label = l.label")
def a19_class_weights(t):
    return quality.class_weights(assets(t), LABELS).withColumn("weight", F.round("weight", 6))


@query("""with c as (select label, count(*) as n from gt_symbols group by label), r as (select label, sum(n) over () / n as rarity from c),
m as (select scene_id, max(rarity) as weight from gt_symbols g join r on r.label = g.label group by scene_id) select s.scene_id, round(coalesce(weight, 1.0), 6) as weight from scenes s left join m on m.scene_id = s.scene_id""")
def a20_scene_weights(t):
    return quality.scene_weights(t.scenes, t.gt_symbols).withColumn("weight", F.round("weight", 6))


@query("select coalesce(lang, 'all') as label, count(*) as processed, count(*) filter (where n_chars < 200) as rejected, count(*) filter (where n_chars >= 200) as saved from documents group by rollup (lang)")
def a21_clean_counters(t):
    return quality.clean_counters(t.documents.select(F.col("lang").alias("label"), (F.col("n_chars") < 200).alias("rejected")))


@query(f"""{A}, h as (select label, sha256(coalesce('v' || path, 'n') || chr(10) || coalesce('v' || sha256, 'n')) as h, count(*) as c from a group by all),
s as (select label, cast(sum(c) as bigint) as n_files, case when count(*) > 16 * 65536 then 3 when count(*) > 16 * 256 then 2 when count(*) > 16 then 1 else 0 end as d from h group by label),
n3 as (select h.label, d, substring(h, 1, 2 * d) as rg, sha256(string_agg(h || ':' || c, chr(10) order by h)) as x from h join s on s.label = h.label group by all),
n2 as (select label, d, substring(rg, 1, 4) as rg, case when d >= 3 then sha256(string_agg(rg || ':' || x, chr(10) order by rg)) else first(x) end as x from n3 group by label, d, substring(rg, 1, 4)),
n1 as (select label, d, substring(rg, 1, 2) as rg, case when d >= 2 then sha256(string_agg(rg || ':' || x, chr(10) order by rg)) else first(x) end as x from n2 group by label, d, substring(rg, 1, 2)),
n0 as (select label, case when d >= 1 then sha256(string_agg(rg || ':' || x, chr(10) order by rg)) else first(x) end as digest from n1 group by label, d)
select n0.label, digest, n_files from n0 join s on s.label = n0.label""")
def a22_tree_digest(t):
    return quality.tree_digest(assets(t), "label", leaf=16)


@query("select path, label, sha256(text) as sha256, substring(sha256(text), 1, 16) as content_id from assets")
def s01_asset_table(t):
    return assets(t).select("path", "label", "sha256", F.substring("sha256", 1, 16).alias("content_id"))


@query("""select scene_id, gt_id, 'main' as role, substring(label, 6) as glyph_key, 'digit_main' as yolo_class, substring(sha256(cast(scene_id as string)), 1, 20) as asset_id, 'digit' as source_type from gt_symbols""")
def p05_enriched(t):
    df = t.gt_symbols.select("scene_id", "gt_id", "label", F.sha2(F.col("scene_id").cast("string"), 256).alias("sha256"))
    return quality.enriched(df).drop("label", "sha256")


@query(f"{A} select label, cast(dense_rank() over (order by label) - 1 as int) as class_id from (select distinct label from a) q")
def p24_class_map(t):
    return quality.class_map(assets(t))


@query("select doc_id, lang, n_chars from documents union all select doc_id, null, null from labels where false union all select doc_id, lang, n_chars from documents where n_chars > 3000")
def u01_merged(t):
    d = t.documents
    return quality.merged(d.select("doc_id", "lang", "n_chars"), d.where("n_chars > 3000").select("doc_id", "lang", "n_chars", "source"))


@query("select doc_id, cast(c as int) as copy, source || '/' || doc_id || '__rt0' || c as path from documents, (select unnest([0, 1, 2]) as c) q where n_chars > 3000")
def u02_oversampled(t):
    rows = t.documents.where("n_chars > 3000").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"))
    return quality.oversampled(rows, 3)


@query("select distinct o_custkey as c_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def u03_missing(t):
    return quality.missing(t.orders.select(F.col("o_custkey").alias("c_custkey")), t.customer.where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("select doc_id, 'poor' as origin from labels where quality = 0 union all select doc_id, 'open' from documents where doc_id not in (select doc_id from labels where quality = 0)")
def u04_preferred(t):
    return quality.preferred(t.labels.where("quality = 0").select("doc_id", F.lit("poor").alias("origin")), t.documents.select("doc_id", F.lit("open").alias("origin")), "doc_id")


@query("select distinct label from gt_symbols where scene_id % 2 = 0 intersect select distinct label from predictions where scene_id % 3 = 0")
def u05_common_labels(t):
    return t.gt_symbols.where("scene_id % 2 = 0").select("label").intersect(t.predictions.where("scene_id % 3 = 0").select("label"))


@query("select d.doc_id, lang, coalesce(quality, -1) as quality, l.doc_id is not null as is_valid from documents d left join labels l on l.doc_id = d.doc_id")
def j08_metadata(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality", F.lit(True).alias("v")), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("v", F.lit(False)).alias("is_valid"))


@query("select 'missing_companion' as kind, cast(doc_id as string) as path, 'no label' as detail, 'warning' as severity from documents where doc_id not in (select doc_id from labels)")
def j10_companions(t):
    lone = t.documents.join(t.labels, "doc_id", "left_anti")
    return quality.issues(lone, F.col("doc_id").cast("string"), [(F.lit(True), "missing_companion", "no label")], "warning")


NAMES = """select scene_id, det_id, label from detections union all select scene_id, det_id + 5000 as det_id, case when det_id % 3 = 0 then 'borrow_' || cast(det_id % 10 as string) when det_id % 3 = 1 then 'div_bracket' else 'odd' end as label from detections where det_id % 4 = 0"""


@query(f"""select scene_id, det_id, label, case when label = 'result_bar' then 'structure' when label like 'op\\_%' escape '\\' then 'operator' when label in ('div_bracket', 'odd') then 'unknown' else split_part(label, '_', 1) end as role,
  case when label = 'result_bar' then label when label in ('div_bracket', 'odd') then null when label like 'op\\_%' escape '\\' then substring(label, 4) else split_part(label, '_', 2) end as detail,
  case when label = 'result_bar' then label when label in ('div_bracket', 'odd') then 'digit_main' when label like 'op\\_%' escape '\\' then 'operator' else 'digit_' || split_part(label, '_', 1) end as coarse,
  case when label in ('result_bar', 'div_bracket') then label when label = 'odd' then null when label like 'op\\_%' escape '\\' then label else split_part(label, '_', 2) end as collapsed,
  case when label = 'op_plus' then '+' when label = 'result_bar' then '─────' when label = 'div_bracket' then '' when label like 'main%' then substring(label, 6) else label end as glyph
from ({NAMES}) n""")
def p01_label_parse(t):
    c = F.col("label")
    return t.sql(NAMES).select("scene_id", "det_id", "label", o.role(c).alias("role"), o.detail(c).alias("detail"), o.coarse_or_main(c).alias("coarse"), o.collapsed(c).alias("collapsed"), o.display_glyph(c).alias("glyph"))


@query("""select scene_id, pred_kind, case pred_kind when 'add' then 'addition' when 'subtract' then 'subtraction' when 'multiply' then 'multiplication' when 'divide' then 'division' when 'bare_digits' then 'bare_digits' end as long_kind,
  case pred_kind when 'bare_digits' then -1 when 'subtract' then 1 when 'multiply' then 2 when 'divide' then 3 else 0 end as kind_class,
  case pred_kind when 'add' then 'Addition' when 'subtract' then 'Subtraction' when 'multiply' then 'Multiplication' when 'divide' then 'Division' when 'bare_digits' then 'Bare digits (no equation)' else 'Unknown (out of distribution)' end as title from scenes""")
def p06_kinds(t):
    k = F.col("pred_kind")
    return t.scenes.select("scene_id", "pred_kind", o.long_kind(k).alias("long_kind"), o.kind_class(k).alias("kind_class"), o.kind_title(k).alias("title"))


@query(f"""select scene_id, det_id, case when collapsed is null then label when collapsed in ('result_bar', 'div_bracket') or collapsed like 'op%' then collapsed when det_id % 2 = 0 then 'carry_' || collapsed else 'main_' || collapsed end as expanded
from (select scene_id, det_id, label, case when label in ('result_bar', 'div_bracket') then label when label = 'odd' then null when label like 'op%' then label else split_part(label, '_', 2) end as collapsed from ({NAMES}) n) q""")
def p03_expanded(t):
    coarse = F.when(F.col("det_id") % 2 == 0, "digit_carry").otherwise("digit_main")
    return t.sql(NAMES).select("scene_id", "det_id", o.expanded(F.coalesce(o.collapsed(F.col("label")), F.col("label")), coarse).alias("expanded"))
