"""Queries over collection planning: nations stand for cases, market segments for stages, customers for existing scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning
from .registry import query

TARGETS = 'select n_name as "case", cast(20 + n_nationkey * 9 as int) as target from nation'
EXISTING = 'select n_name as "case", c_mktsegment as kind, c_acctbal from customer join nation on n_nationkey = c_nationkey'
PAIRS = 'select distinct n_name as "case", c_mktsegment as stage from customer join nation on n_nationkey = c_nationkey'
SERVED = "select 1000000 + (c_custkey % 40) * 10000 + c_custkey % 7 as seed from customer where c_custkey % 3 = 0 union select 2000000 + (c_custkey % 60) * 10000 + c_custkey % 5 from customer union select 3000000 + (c_custkey % 5) * 10000 + 40 + c_custkey % 90 from customer where c_custkey % 2 = 0"


def spark_sql(t, text):
    return t.sql(text.replace('"case"', "`case`"))


def targets(t):
    return spark_sql(t, TARGETS)


def existing(t):
    return spark_sql(t, EXISTING)


def buckets(t):
    return planning.bucket_index(spark_sql(t, PAIRS))


def served(t):
    return spark_sql(t, SERVED).withColumn("seed", F.col("seed").cast("long"))


BUCKETS = f"bk as (select \"case\", stage, row_number() over (order by \"case\", stage) - 1 as bucket from ({PAIRS}) p)"
NEED = f"""tg as ({TARGETS}), ex as ({EXISTING}), hv as (select "case", count(*) as have from ex group by "case"),
nd as (select *, row_number() over (order by deficit desc, "case") - 1 as pos from (select tg."case", target - coalesce(have, 0) as deficit, coalesce(have, 0) as have from tg left join hv on hv."case" = tg."case") q where deficit > 0)"""


def seeds_sql(demand: str, base: int) -> str:
    """it: (case, item, stage, seed) for demand(case, n)."""
    return f"""sv as (select distinct seed from ({SERVED}) s), sg as (select *, row_number() over (partition by "case" order by bucket) - 1 as stage_no, count(*) over (partition by "case") as n_stages from bk),
it0 as (select d."case", unnest(range(0, d.n)) as item from {demand} d where d.n > 0), it1 as (select distinct it0."case", item, item % n_stages as stage_no, item // n_stages + 1 as k from it0 join sg on sg."case" = it0."case"),
fr as (select "case", stage_no, stage, seed, row_number() over (partition by bucket order by seed) as k from (select sg.*, {base} + bucket * 10000 + unnest(range(0, 3000)) as seed from sg) q where seed not in (select seed from sv)),
it as (select it1."case", item, stage, seed from it1 join fr on fr."case" = it1."case" and fr.stage_no = it1.stage_no and fr.k = it1.k)"""


@query(f"with {BUCKETS} select \"case\", stage, cast(bucket as int) as bucket from bk")
def w13_bucket_index(t):
    return buckets(t)


@query(f"with {NEED} select \"case\", cast(deficit as bigint) as deficit, cast(pos as int) as pos from nd")
def t03_deficits(t):
    return planning.deficits(targets(t), existing(t)).select("case", F.col("deficit").cast("long").alias("deficit"), "pos")


@query(f"select \"case\", count(*) as n from ({EXISTING}) e group by \"case\"")
def a24_existing_counts(t):
    return existing(t).groupBy("case").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BUCKETS}, {NEED}, dm as (select \"case\", deficit as n from nd), {seeds_sql('dm', 1000000)} select \"case\", cast(item as int) as item, stage, cast(seed as bigint) as seed from it")
def w12_seed_allocation(t):
    need = planning.deficits(targets(t), existing(t)).select("case", F.col("deficit").alias("n"))
    return planning.allocate_seeds(need, buckets(t), served(t), "eval")


@query(f"with {BUCKETS}, {NEED}, dm as (select \"case\", deficit as n from nd), {seeds_sql('dm', 1000000)} select cast(row_number() over (order by nd.pos, item) - 1 as int) as pos, it.\"case\", stage, cast(seed as bigint) as seed from it join nd on nd.\"case\" = it.\"case\"")
def c01_eval_worklist(t):
    return planning.eval_worklist(targets(t), existing(t), buckets(t), served(t))


METRICS = """select n_name as "case", case when n_nationkey % 7 = 0 then null else (n_nationkey % 10) / 10.0 end as row_acc, (n_nationkey % 4) / 4.0 as col_acc, (n_nationkey % 5) / 5.0 as kind_acc, case when n_nationkey % 6 = 0 then null else 0.5 end as label_acc from nation where n_nationkey % 8 <> 3"""
CAPS = 'select n_name as "case", cast(n_nationkey % 9 * 4 as int) as cap from nation'
WEAK = f"""wk as (select c."case", c.cap, 3.0 * coalesce(1 - row_acc, 1.0) + 3.0 * coalesce(1 - col_acc, 1.0) + 2.0 * coalesce(1 - kind_acc, 1.0) + coalesce(1 - label_acc, 1.0) as weakness from ({CAPS}) c left join ({METRICS}) m on m."case" = c."case" where cap > 0)"""


def alloc_sql(budget: int) -> str:
    return f"""{WEAK}, b0 as (select *, greatest(0, least(2, cap)) as base from wk), b1 as (select *, {budget} - sum(base) over () as rest, sum(weakness) over () as total, cap - base as room from b0),
b2 as (select *, rest * (weakness / total) as raw, least(floor(rest * (weakness / total)), room) as part from b1), b3 as (select *, rest - sum(part) over () as left_over, row_number() over (order by raw - floor(raw) desc, "case") as turn from b2),
un as (select "case", turn, left_over, unnest(range(1, cast(room - part as bigint) + 1)) as pass_no from b3), wn as (select "case", count(*) as extra from (select *, row_number() over (order by pass_no, turn) as n from un) q where n <= left_over group by "case"),
al as (select b3."case", weakness, cap, cast(base + part + coalesce(extra, 0) as bigint) as alloc from b3 left join wn on wn."case" = b3."case")"""


def weak(t):
    return spark_sql(t, CAPS).where("cap > 0").join(spark_sql(t, METRICS), "case", "left").select("case", "cap", planning.weakness().alias("weakness"))


@query(f"with {WEAK} select \"case\", cap, round(cast(weakness as double), 6) as weakness from wk")
def c02_weakness(t):
    return weak(t).withColumn("weakness", F.round(F.col("weakness").cast("double"), 6))


@query(f"with {alloc_sql(200)} select \"case\", alloc from al")
def w14_allocation(t):
    return planning.allocate(weak(t), 200).select("case", "alloc")


@query(f"with {BUCKETS}, {alloc_sql(150)}, dm as (select \"case\", alloc as n from al), {seeds_sql('dm', 2000000)}, od as (select *, row_number() over (order by alloc desc, weakness desc, \"case\") as cp from al where alloc > 0) select cast(row_number() over (order by cp, item) - 1 as int) as pos, it.\"case\", stage, cast(seed as bigint) as seed from it join od on od.\"case\" = it.\"case\"")
def c03_train_worklist(t):
    return planning.train_worklist(spark_sql(t, CAPS), spark_sql(t, METRICS), 150, buckets(t), served(t))


KINDS = "select kind, 'case of ' || kind as \"case\", row_number() over (order by kind) - 1 as kind_no from (select distinct c_mktsegment as kind from customer) k"
ERRORS = f"""kd as ({KINDS}), hk as (select c_mktsegment as kind, count(*) as have from customer where c_custkey % 5 = 0 group by 1), ek as (select kd.*, coalesce(have, 0) as have, 40 + 7 * kind_no - coalesce(have, 0) as deficit from kd left join hk on hk.kind = kd.kind),
ef as (select kind, "case", seed, deficit, row_number() over (partition by kind order by seed) - 1 as item from (select *, 3000000 + kind_no * 10000 + have + unnest(range(0, 2000)) as seed from ek where deficit > 0) q where seed not in (select seed from ({SERVED}) s)),
er as (select kind, "case", seed, item from ef where item < deficit)"""


def errors(t):
    cases = spark_sql(t, KINDS)
    goal = cases.select("kind", (F.lit(40) + 7 * F.col("kind_no")).alias("target"))
    have = t.customer.where("c_custkey % 5 = 0").select(F.col("c_mktsegment").alias("kind"))
    return planning.error_items(goal, have, served(t), cases, "eval_error")


@query(f"with {ERRORS} select kind, \"case\", cast(seed as bigint) as seed, cast(item as int) as item from er")
def c04_error_items(t):
    return errors(t)


@query(f"""with {BUCKETS}, {NEED}, dm as (select "case", deficit as n from nd), {seeds_sql('dm', 1000000)}, {ERRORS}, u as (select 0 as b, nd.pos * 100000 + item as n, it."case", stage, seed, 'draw' as directive from it join nd on nd."case" = it."case"
union all select 1, row_number() over (order by kind, item), "case", 'full', seed, 'error' from er) select "case", stage, cast(seed as bigint) as seed, directive, cast(row_number() over (order by b, n) - 1 as int) as pos from u""")
def u06_with_error_items(t):
    return planning.with_error_items(c01_eval_worklist(t), errors(t))


LIST = "select c_nationkey as list_id, c_mktsegment as {0}, case when c_acctbal > 2000 then 'done' else 'open' end as status, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos from customer"


@query(f"""with l as ({LIST.format('"case"')}) select coalesce("case", 'all') as "case", count(*) as total, count(*) filter (where status = 'done') as done, count(*) filter (where status <> 'done') as pending, round(100.0 * count(*) filter (where status = 'done') / count(*), 6) as percent from l group by rollup ("case")""")
def a25_list_progress(t):
    return planning.list_progress(t.sql(LIST.format("`case`"))).withColumn("percent", F.round("percent", 6))


@query(f"""with l as ({LIST.format('"case"')}), f as (select list_id, min(pos) as first_open from l where status <> 'done' group by list_id) select l.list_id, "case", status, cast(row_number() over (partition by l.list_id order by pos) - 1 as int) as pos from l join f on f.list_id = l.list_id where pos >= first_open""")
def w15_trimmed(t):
    return planning.trimmed(t.sql(LIST.format("`case`")), "list_id").withColumn("pos", F.col("pos").cast("int"))


@query("select seed, min(ts) as ts from (select event_id % 1000 as seed, ts from events) e group by seed")
def r05_fresh_seeds(t):
    from ..streaming import streams

    return streams.fresh_seeds(t.events.select((F.col("event_id") % 1000).alias("seed"), "ts"))


@query("""select n_name as "case", stage from nation n, lateral (select c_mktsegment as stage from customer where c_nationkey = n_nationkey group by 1) s where not exists (select 1 from customer c join orders o on o.o_custkey = c.c_custkey where c.c_nationkey = n.n_nationkey and c.c_mktsegment = s.stage and o.o_orderdate > (select max(o_orderdate) from orders) - interval '5 days')""")
def a34_case_coverage(t):
    have = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("case"), F.col("c_mktsegment").alias("stage"), "c_custkey")
    last = t.orders.agg(F.max("o_orderdate").alias("last"))
    fresh = t.orders.join(F.broadcast(last)).where(F.expr("o_orderdate > last - interval 5 days"))
    made = have.join(fresh, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("case", "stage")
    return have.select("case", "stage").distinct().join(made, ["case", "stage"], "left_anti")


@query("select n_name as \"case\", c_mktsegment as stage, min(c_custkey) as first_key from customer join nation on n_nationkey = c_nationkey group by all")
def w17_first_of_bucket(t):
    have = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return have.groupBy(F.col("n_name").alias("case"), F.col("c_mktsegment").alias("stage")).agg(F.min("c_custkey").alias("first_key"))


SESSIONS = "select n_nationkey as list_id, cast(n_nationkey * 7 % 60 - 2 as int) as cursor from nation"


@query(f"""with l as ({LIST.format('"case"')}), s as ({SESSIONS}) select l.list_id, "case", case when l.pos = s.cursor then 'done' else status end as status, cast(l.pos as int) as pos from l left join s on s.list_id = l.list_id""")
def c05_advanced(t):
    return planning.advanced(t.sql(LIST.format("`case`")).withColumn("pos", F.col("pos").cast("int")), t.sql(SESSIONS), "list_id")[0].select("list_id", "case", "status", "pos")


@query(f"""with l as ({LIST.format('"case"')}), k as (select list_id, count(*) as n from l group by list_id), s as ({SESSIONS}) select s.list_id, cast(case when cursor >= 0 and cursor < coalesce(n, 0) then cursor + 1 else cursor end as int) as cursor from s left join k on k.list_id = s.list_id""")
def c05_cursors(t):
    return planning.advanced(t.sql(LIST.format("`case`")).withColumn("pos", F.col("pos").cast("int")), t.sql(SESSIONS), "list_id")[1].select("list_id", F.col("cursor").cast("int").alias("cursor"))


@query(f"select seed from ({SERVED}) a union select 1000000 + o_custkey % 5000 as seed from orders")
def c05_served_seeds(t):
    return planning.with_served(served(t), t.orders.select((1000000 + F.col("o_custkey") % 5000).alias("seed")))
