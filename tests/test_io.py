import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillframe.operators import quality
from quillframe.sources import readers, sinks
from quillframe.streaming import streams


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IEND", b"")


def test_asset_pool(spark, tmp_path):
    for name, data in (("one/a.png", png(28, 28)), ("one/b.png", png(14, 28)), ("two/c.png", b"not an image")):
        p = tmp_path / "pool" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    assets = readers.asset_pool(spark, str(tmp_path / "pool"))
    assert {(r.path, r.label, r.width) for r in assets.collect()} == {("one/a.png", "one", 28), ("one/b.png", "one", 14), ("two/c.png", "two", None)}
    assert {(r.kind, r.path) for r in readers.asset_issues(assets).collect()} == {("invalid_size", "one/b.png"), ("corrupt_image", "two/c.png")}


def test_sidecars_keep_null_apart_from_empty(spark, tmp_path):
    (tmp_path / "a.label.json").write_text('{"schema_version": 1, "sample": "a", "symbols": []}')
    (tmp_path / "b.label.json").write_text('{"schema_version": 1, "sample": "b"}')
    (tmp_path / "c.label.json").write_text('{"schema_version": 1, "sample": "c", "symbols": [{"flattened": "main_1", "bbox_px": [1, 2, 3, 4]}]}')
    got = {r.key: (r.has_symbols, r.label, r.x1) for r in readers.sidecar_symbols(readers.label_sidecars(spark, str(tmp_path))).collect()}
    assert got == {"a": (True, None, None), "b": (False, None, None), "c": (True, "main_1", 3.0)}


def test_quotas(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"schema_version": 2, "eval": {"scene_cases": {"x": 3}}}')
    long, found = readers.quotas(spark, str(tmp_path / "q.json"))
    assert [(r.mode, r.block, r.key, r.target) for r in long.collect()] == [("eval", "scene_cases", "x", 3)]
    assert {r.kind for r in found.collect()} == {"invalid_version", "missing_block"}


def test_history_and_version_guard(spark, tmp_path):
    log = str(tmp_path / "log")
    records = spark.createDataFrame([(1, 0.5)], "run int, acc double")
    sinks.append_history(records, log, 2)
    sinks.append_history(records, log, 2)
    with pytest.raises(ValueError):
        sinks.append_history(records, log, 3)
    (tmp_path / "log" / "part-x.json").write_text('{"record_type": "schema"}\nbroken\n{"run": 9, "acc": 1.0}\n')
    assert sorted(r.run for r in readers.history(spark, log, "run int, acc double").collect()) == [1, 1, 9]


def test_real_samples(spark):
    files = spark.createDataFrame([("d/a.png",), ("d/a.gt.json",), ("d/a.txt",), ("d/b.png",)], "path string")
    whole, found = readers.real_samples(files)
    assert [r.stem for r in whole.collect()] == ["a"]
    assert {(r.path, r.detail) for r in found.collect()} == {("b", "gt"), ("b", "txt")}


def test_box_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, 10.0, 20.0, 30.0, 60.0), (2, 0, 5.0, 5.0, 5.0, 6.0)], "scene_id long, class_id int, x0 double, y0 double, x1 double, y1 double")
    sinks.write_box_lines(df, str(tmp_path / "out"))
    back = readers.boxes(readers.bucketed_box_lines(spark, str(tmp_path / "out")))
    assert {(r.class_id, round(r.x0, 2), round(r.y1, 2)) for r in back.collect()} == {(3, 10.0, 60.0), (0, 5.0, 6.0)}


def test_box_line_issues(spark):
    rows = [("a", "0 0.5 0.5 0.1"), ("b", "6 0.5 0.5 0.1 0.1"), ("c", "0 0.5 0.5 0 0.1"), ("d", "")]
    got = {(r.path, r.kind, r.severity) for r in quality.box_line_issues(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("a:1", "field_count", "error"), ("b:1", "class_range", "error"), ("c:1", "w_range", "error"), ("d", "empty_file", "warning")}


def test_manifests_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "val")], "path string, split string")
    sinks.write_manifests(df, str(tmp_path / "m"))
    plan = df.repartition("split", F.pmod(F.xxhash64(*df.columns), F.lit(64)))._jdf.queryExecution().toString()
    assert "hashpartitioning(split" in plan and "xxhash64" in plan  # a split is no single task
    assert spark.read.parquet(str(tmp_path / "m")).where("split = 'val'").first().path == "b"
    (tmp_path / "index.json").write_text('{"runs": [{"run_id": "r1", "stage": "g", "created_utc": "20260101T000000Z", "metrics": {"val/a": 1.0}}]}')
    r = readers.run_registry(spark, str(tmp_path / "index.json")).first()
    assert (r.run_id, r.created_utc.year, r.metrics) == ("r1", 2026, {"val/a": 1.0})


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts string, sample long, event string, status string, latency_ms double").withColumn("ts", F.to_timestamp("ts"))


ROWS = [(1, "2026-01-01 00:00:00", 1, "predict", "ok", 10.0), (2, "2026-01-01 00:01:00", 1, "feedback", "error", 20.0), (3, "2026-01-01 00:12:00", 2, "predict", "ok", 30.0), (4, "2026-01-01 00:13:00", 1, "feedback", "ok", 5.0)]


def test_streams_equal_batches(spark, tmp_path):
    log = str(tmp_path / "log")
    events(spark, ROWS).coalesce(1).write.json(log)
    tail = streams.tail(spark, log)
    q = streams.rolling(tail).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(streams.rolling(events(spark, ROWS)).collect())
    assert sorted(spark.table("rolled").collect()) == want
    q = streams.keep_last_feedback(streams.tail(spark, log).where("event = 'feedback'"), str(tmp_path / "last"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [r.event_id for r in streams.kept_feedback(spark, str(tmp_path / "last")).collect()] == [4]
    events(spark, [(9, "2026-01-01 00:20:00", 1, "feedback", "ok", 5.0)]).coalesce(1).write.mode("append").json(log)
    streams.keep_last_feedback(streams.tail(spark, log).where("event = 'feedback'"), str(tmp_path / "last"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.event_id for r in streams.kept_feedback(spark, str(tmp_path / "last")).collect()] == [9]
    assert [r.event_id for r in streams.compact_feedback(spark, str(tmp_path / "last"), str(tmp_path / "small")).collect()] == [9]
    q = streams.append_log(streams.tail(spark, log), str(tmp_path / "copy"), str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert spark.read.schema(streams.EVENTS).json(str(tmp_path / "copy")).count() == 5


def test_predict_feedback(spark):
    log = events(spark, ROWS)
    got = {(r.sample, r.feedback) for r in streams.predict_feedback(log.where("event = 'predict'"), log.where("event = 'feedback'"), "5 minutes").collect()}
    assert got == {(1, "error"), (2, None)}


def test_splits_are_numbered_in_ranges(spark):
    df = spark.createDataFrame([(f"p{i}", "only", f"{i:064x}") for i in range(500)], "path string, label string, sha256 string")
    split = quality.stratified_split(df)
    windows = [x for x in split._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number()" in x]
    assert windows and all("__range" in x or "sha256" in x for x in windows)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 400, "val": 50, "test": 50}


def test_plans_push_down_and_broadcast(spark, sf):
    import contextlib
    import io

    import __spark_entry__ as entry

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        entry.queries()["s17_latest_run"](spark, sf).explain("formatted")
    assert "PushedFilters: [IsNotNull(o_orderdate), EqualTo" in out.getvalue()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in out.getvalue()
