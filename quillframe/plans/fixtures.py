"""Views over the driver's tables, as SQL that both engines accept.

Integer arithmetic only, floor() before any cast from double, every id from a total order. A query names the views it needs;
they are inlined as common table expressions for the oracle and resolved to DataFrames for Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "gt_symbols": """
select scene_id, sym_id as gt_id, 'main_' || cast(pk % 10 as string) as label,
  cast((pk * 37) % 448 as double) as x0, cast((sk * 53) % 448 as double) as y0,
  cast((pk * 37) % 448 + 16 + q % 48 as double) as x1, cast((sk * 53) % 448 + 16 + pk % 48 as double) as y1
from (select l_orderkey as scene_id, l_partkey as pk, l_suppkey as sk, cast(floor(l_quantity) as bigint) as q,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as sym_id
  from lineitem) t""",
    "predictions": """
select scene_id, gt_id as pred_id, case when cast(x0 as bigint) % 13 = 0 then 'main_7' else label end as label,
  x0 + (gt_id % 5) as x0, y0, x1 + (gt_id % 5) as x1, y1, round(0.5 + (gt_id % 4) * 0.125, 3) as conf
from gt_symbols where cast(y0 as bigint) % 11 <> 0
union all
select scene_id, gt_id + 100 as pred_id, label, (x0 + 200) % 448 as x0, y0, (x0 + 200) % 448 + 40 as x1, y1, 0.5 as conf
from gt_symbols where gt_id % 6 = 0""",
    "detections": """
select scene_id, pred_id as det_id, case when pred_id % 9 = 4 then 'op_plus' when pred_id % 9 = 7 then 'result_bar' when pred_id % 9 = 2 then 'carry_1' else label end as label,
  cast(conf as double) as confidence, x0, y0, x1, y1, pred_id % 4 = 0 as given, case when pred_id % 2 = 1 then 'a' else 'b' end as source,
  cast(floor(y0 / 64) as int) as row, cast(floor(x0 / 64) as int) as col
from predictions""",
    "scenes": """
select o_orderkey as scene_id,
  case substring(o_orderpriority, 1, 1) when '1' then 'addition' when '2' then 'subtraction' when '3' then 'multiplication' when '4' then 'division' else 'bare_digits' end as equation_kind,
  case when o_orderkey % 9 = 0 then null else c_mktsegment end as scene_case, o_orderkey % 10 <> 0 as has_symbols,
  case o_custkey % 7 when 0 then 'add' when 1 then 'subtract' when 2 then 'multiply' when 3 then 'divide' when 4 then 'bare_digits' when 5 then 'unknown' else 'add' end as pred_kind,
  case when o_custkey % 14 = 5 then 'high_entropy' end as ood_reason, cast(floor(o_totalprice) as double) as wall_ms
from orders join customer on c_custkey = o_custkey""",
    "two_sources": """
select scene_id, det_id, label, confidence, x0, y0, x1, y1, source from detections
union all
select scene_id, det_id + 1000 as det_id, label, confidence, x0 + 3 as x0, y0, x1 + 3 as x1, y1, 'b' as source from detections where source = 'a' and det_id % 3 = 0""",
    "assets": "select source || '/' || cast(doc_id as string) as path, lang as label, doc_id, text from documents",
    "exercises": """
select k * 1000000 + a * 1000 + b as exercise_id, case k when 0 then 'add' when 1 then 'subtract' when 2 then 'multiply' else 'divide' end as op, a, b
from (select distinct l_linenumber % 4 as k, l_partkey % 1000 as a, l_suppkey % 1000 as b from lineitem) t""",
    "epoch_log": """
select user_id as run_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as epoch, cast(floor(value * 100) as bigint) as loss, event_type, event_id from events""",
}

def _gt_symbols(lines: DataFrame) -> DataFrame:
    """The gt_symbols view with the scene named below its window, so that what follows sees that its rows lie together by scene_id."""
    rows = lines.selectExpr("l_orderkey as scene_id", "l_partkey as pk", "l_suppkey as sk", "cast(floor(l_quantity) as bigint) as q", "l_linenumber", "l_extendedprice", "l_shipdate")
    rows = rows.withColumn("gt_id", F.expr("row_number() over (partition by scene_id order by l_linenumber, pk, sk, l_extendedprice, l_shipdate)"))
    x0, y0 = "(pk * 37) % 448", "(sk * 53) % 448"
    return rows.selectExpr(
        "scene_id", "gt_id", "'main_' || cast(pk % 10 as string) as label", f"cast({x0} as double) as x0", f"cast({y0} as double) as y0",
        f"cast({x0} + 16 + q % 48 as double) as x1", f"cast({y0} + 16 + pk % 48 as double) as y1",
    )


def _predictions(gt: DataFrame) -> DataFrame:
    """The predictions view from one pass over the symbols: each gives its own box, the shifted one, both or none."""
    both = gt.withColumn("k", F.explode(F.expr("case when gt_id % 6 = 0 then array(0, 1) else array(0) end"))).where("k = 1 or cast(y0 as bigint) % 11 <> 0")
    return both.selectExpr(
        "scene_id", "case when k = 0 then gt_id else gt_id + 100 end as pred_id", "case when k = 0 and cast(x0 as bigint) % 13 = 0 then 'main_7' else label end as label",
        "case when k = 0 then x0 + (gt_id % 5) else (x0 + 200) % 448 end as x0", "y0", "case when k = 0 then x1 + (gt_id % 5) else (x0 + 200) % 448 + 40 end as x1", "y1",
        "case when k = 0 then round(0.5 + (gt_id % 4) * 0.125, 3) else 0.5 end as conf",
    )


def _two_sources(dets: DataFrame) -> DataFrame:
    """The two_sources view from one pass over the detections."""
    both = dets.withColumn("k", F.explode(F.expr("case when source = 'a' and det_id % 3 = 0 then array(0, 1) else array(0) end")))
    moved = [f"case when k = 0 then {c} else {c} + 3 end as {c}" for c in ("x0", "x1")]
    return both.selectExpr("scene_id", "case when k = 0 then det_id else det_id + 1000 end as det_id", "label", "confidence", moved[0], "y0", moved[1], "y1", "case when k = 0 then source else 'b' end as source")


#: Views that Spark takes in another form with the same rows: one pass over what their SQL reads twice, and one exchange by scene.
FORMS = {"gt_symbols": ("lineitem", _gt_symbols), "predictions": ("gt_symbols", _predictions), "two_sources": ("detections", _two_sources)}

_USED = re.compile(r"\b(?:from|join)\s+(\w+)")


def needs(sql: str) -> list[str]:
    """The views that a text refers to, each after those that it needs itself."""
    found: list[str] = []
    for name in _USED.findall(sql):
        if name in VIEWS:
            for n in [*needs(VIEWS[name]), name]:
                if n not in found:
                    found.append(n)
    return found


def with_views(sql: str) -> str:
    """The text with its views in front, for the oracle. A text may begin with its own ``with`` list."""
    views = ", ".join(f"{n} as materialized ({VIEWS[n]})" for n in needs(sql))
    sql = sql.strip()
    if not views:
        return sql
    own = re.match(r"with\s+(recursive\s+)?", sql)
    return f"with {own[1] or ''}{views}, {sql[own.end():]}" if own else f"with {views} {sql}"


class Tables:
    """Tables and views of a folder as DataFrames: ``t.lineitem``, ``t.gt_symbols``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if name in FORMS:
            source, rows = FORMS[name]
            return rows(getattr(self, source))
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views of this folder."""
        used = {n for n in _USED.findall(text) if n in TABLES or n in VIEWS}
        body = re.sub(r"\b(from|join)(\s+)(\w+)", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in used else m[0], text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(body, **{n: getattr(self, n) for n in used}) if used else self.spark.sql(text)
