"""Queries over files: tables are written in the files' own formats to the shared folder and read back through the readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..streaming import streams
from .registry import query

_local: list[str] = []


def folder(t, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, as in local tests, in a temporary folder of this session."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-files-"))
        shared = "file://" + _local[0]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_text(t, df, name: str, column: str = "value") -> str:
    path = folder(t, name)
    df.select(F.col(column).alias("value")).write.text(path)
    return path


@query("""select cast(c.scene_id as varchar) as key, has_symbols, cast(row_number() over (partition by c.scene_id order by gt_id) - 1 as int) as gt_id, label, x0, y0, x1, y1 from scenes c join gt_symbols s on s.scene_id = c.scene_id where has_symbols
union all select cast(c.scene_id as varchar), has_symbols, null, null, null, null, null, null from scenes c where not has_symbols or not exists (select 1 from gt_symbols s where s.scene_id = c.scene_id)""")
def s03_sidecars(t):
    """Label sidecars written as JSON lines and read with the sidecars' schema; the sample names the scene."""
    path = written_text(t, sinks.sidecar_json(t.scenes, t.gt_symbols), "sidecars", "json")
    read = t.spark.read.schema(readers.SIDECAR).json(path).withColumn("key", F.col("sample"))
    return readers.sidecar_symbols(read)


@query("""select 'eval' as mode, 'scene_cases' as block, n_name as key, cast(n_nationkey * 3 + 5 as int) as target from nation union all select 'eval', 'error_cases', r_name, cast(r_regionkey + 1 as int) from region
union all select 'train', 'scene_cases', n_name, cast(n_nationkey * 4 + 1 as int) from nation union all select 'train', 'error_cases', r_name, cast(r_regionkey + 2 as int) from region""")
def s04_quotas(t):
    entries = lambda df, k, v: df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(k), v))).alias("m"))
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    parts = [entries(t.nation, "n_name", n * 3 + 5), entries(t.region, "r_name", r + 1), entries(t.nation, "n_name", n * 4 + 1), entries(t.region, "r_name", r + 2)]
    one = parts[0].toDF("a")
    for name, p in zip("bcd", parts[1:], strict=True):
        one = one.join(F.broadcast(p.toDF(name)))
    doc = one.select(F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.struct(F.col("a").alias("scene_cases"), F.col("b").alias("error_cases")).alias("eval"), F.struct(F.col("c").alias("scene_cases"), F.col("d").alias("error_cases")).alias("train"),
    )).alias("value"))
    long, found = readers.quotas(t.spark, written_text(t, doc, "quotas"))
    return long.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("issues")))).where("issues = 0").drop("issues")


STEMS = "select 'pool/' || l_orderkey || '-' || l_linenumber || case l_partkey % 3 when 0 then '.png' when 1 then '.gt.json' else '.txt' end as path from lineitem union all select 'pool/' || o_orderkey || '-1.png' from orders"


@query(f"""with f as (select distinct path, split_part(split_part(path, '/', 2), '.', 1) as stem, case when path like '%.png' then 'png' when path like '%.gt.json' then 'gt' else 'txt' end as k from ({STEMS}) q),
w as (select stem, count(*) filter (where k = 'png') > 0 as p, count(*) filter (where k = 'gt') > 0 as g, count(*) filter (where k = 'txt') > 0 as x from f group by stem)
select stem as path, 'missing_companion' as kind, 'gt' as detail, 'warning' as severity from w where p and not g union all select stem, 'missing_companion', 'txt', 'warning' from w where p and not x""")
def s06_missing_companions(t):
    return readers.real_samples(t.sql(STEMS).distinct())[1]


@query("""select cast(scene_id as varchar) as path, cast(gt_id % 6 as int) as class_id, round(x0, 2) as x0, round(y0, 2) as y0, round(x1, 2) as x1, round(y1, 2) as y1 from gt_symbols""")
def s07_box_labels(t):
    """Box-label texts written in scene buckets, read and turned into boxes again."""
    path = folder(t, "boxes")
    sinks.write_box_lines(t.gt_symbols.withColumn("class_id", F.col("gt_id") % 6), path)
    found = readers.boxes(readers.bucketed_box_lines(t.spark, path))
    return found.select("path", "class_id", *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""select source || '/' || doc_id as image, lang as label, source || '/' || doc_id as path, sha256(text) as sha256 from documents""")
def s08_manifest(t):
    path = folder(t, "manifest")
    rows = t.assets.select(F.col("path").alias("image"), "label", "path", F.sha2("text", 256).alias("sha256"))
    rows.write.option("header", True).csv(path)
    return readers.manifest(t.spark, path)


@query("""select cast(c_custkey as varchar) as run_id, c_mktsegment as stage, timestamp '2026-01-01' + to_seconds(c_custkey) as created_utc, round(c_acctbal, 2) as val, case when c_custkey % 3 = 0 then 'best of ' || c_nationkey end as label from customer""")
def s09_run_registry(t):
    stamp = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("c_custkey")), "yyyyMMdd'T'HHmmss'Z'")
    run = F.struct(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_mktsegment").alias("stage"), stamp.alias("created_utc"), F.create_map(F.lit("val"), F.col("c_acctbal")).alias("metrics"))
    # A line is an index of its own: the runs of one nation.
    index = t.customer.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(run).alias("runs"))).alias("value"))
    names = t.customer.where("c_custkey % 3 = 0").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("run_id"), F.concat(F.lit("best of "), "c_nationkey").alias("label"))).alias("value"))
    found = readers.run_registry(t.spark, written_text(t, index, "runs"), written_text(t, names, "run-names"), multi_line=False)
    return found.select("run_id", "stage", "created_utc", F.round(F.col("metrics")["val"], 2).alias("val"), "label")


@query("select o_orderkey as run, round(o_totalprice, 2) as acc, 2 as schema_version from orders union all select o_orderkey, round(o_totalprice + 1, 2), 2 from orders")
def s11_history_log(t):
    """Run records appended twice under the version guard, read without header lines."""
    path = folder(t, "history")
    records = lambda plus: t.orders.select(F.col("o_orderkey").alias("run"), F.round(F.col("o_totalprice") + plus, 2).alias("acc"))
    sinks.append_history(records(0), path, 2)
    sinks.append_history(records(1), path, 2)
    return readers.history(t.spark, path, "run long, acc double, schema_version int")


@query("select o_orderstatus as split, count(*) as n, count(distinct o_orderkey) as keys from orders group by 1")
def s12_manifests(t):
    path = folder(t, "manifests")
    sinks.write_manifests(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("split")), path)
    return t.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"))


LOG = "select event_id, ts, user_id as sample, event_type as event, case when value > 150 then 'error' else 'ok' end as status, value as latency_ms from events"


@query(f"select event_id, sample, event, status, round(latency_ms, 6) as latency_ms from ({LOG}) l")
def s15_event_log(t):
    """The event log appended by a stream that tails another log, both JSON lines (R01)."""
    source, target = folder(t, "events"), folder(t, "event-log")
    t.sql(LOG).write.json(source)
    streams.append_log(streams.tail(t.spark, source), target, folder(t, "event-checkpoint")).awaitTermination()
    return t.spark.read.schema(streams.EVENTS).json(target).select("event_id", "sample", "event", "status", F.round("latency_ms", 6).alias("latency_ms"))


HEADERS = "select o_orderkey as id, cast(case when o_custkey % 5 = 0 then 14 else 28 end as bigint) as w, cast(28 as bigint) as h, o_custkey % 7 = 0 as broken from orders"


@query(f"""with p as ({HEADERS}) select cast(id as varchar) as path, 'corrupt_image' as kind, 'no PNG header' as detail, 'error' as severity from p where broken
union all select cast(id as varchar), 'invalid_size', w || 'x' || h, 'error' from p where not broken and w <> 28""")
def s02_image_issues(t):
    """Sizes out of PNG headers, held as binary content."""
    number = lambda c: F.unhex(F.lpad(F.hex(F.col(c)), 8, "0"))
    good = F.concat(F.unhex(F.lit(readers.PNG + "0000000D49484452")), number("w"), number("h"))
    files = t.sql(HEADERS).select(F.col("id").cast("string").alias("path"), F.when(F.col("broken"), F.lit("text").cast("binary")).otherwise(good).alias("content"))
    return readers.asset_issues(files.select("path", *readers.png_header(F.col("content"))))
