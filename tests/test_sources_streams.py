"""Files in and out, and streams against their batch forms."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallywright.operators import curate, jobs
from tallywright.sources import files
from tallywright.streaming import jobs as streams

EVENTS = "/root/testdata/sf0.001/event[s].parquet"


def test_json_arrays(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps([{"file": "u/1", "name": "Ä"}, {"file": "u/2", "products": [{"product_code": "3"}]}], ensure_ascii=False))
    rows = files.json_array(spark, str(tmp_path / "gold.json")).orderBy("golden_index").collect()
    assert [(r["golden_index"], r["file"], r["name"]) for r in rows] == [(0, "u/1", "Ä"), (1, "u/2", None)] and rows[1]["products"][0]["product_code"] == "3"


def test_dictionaries(spark, tmp_path):
    names = curate.name_dictionary(spark.createDataFrame([("b ",), ("a",), ("b",), ("é",)], "n string"), "n")
    files.write_dictionary(names, str(tmp_path / "d"))
    assert [r["canonical"] for r in files.dictionary(spark, str(tmp_path / "d")).orderBy("pos").collect()] == ["a", "b", "é"]
    assert files.dictionary(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "odd.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="JSON array"):
        files.dictionary(spark, str(tmp_path / "odd.json")).collect()


def test_reports_and_prompts(spark, tmp_path):
    accuracy = spark.createDataFrame([("overall", None, "date", 1, 2, 50.0), ("by_type", "x", "date", 1, 2, 50.0)], "scope string, type string, field string, correct long, total long, pct double")
    content = files.report(spark.createDataFrame([(2, 1)], "n_total long, n_success long"), accuracy, spark.createDataFrame([(50.0,)], "macro_avg double"), "v1", "dev", "2026-01-01T00:00:00".replace(":", ""))
    path = files.write_report(spark, content, str(tmp_path))
    assert json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))["field_accuracy"]["date"]["pct"] == 50.0
    assert files.newest_file(spark, path, "*.txt").endswith(".txt")
    assert files.prompt(spark, path).startswith("{")
    with pytest.raises(FileNotFoundError, match="prompt_missing"):
        files.prompt(spark, str(tmp_path / "none.txt"))


def test_queue(spark, tmp_path):
    good = "0b8e2f4e-0d0c-4c56-8a2f-6a1d2f3b4c5d"
    folder = str(tmp_path / "queue")
    streams.enqueue(spark.createDataFrame([(good, "u/1"), ("bad", "u/2")], "job_id string, image_url string"), folder)
    (tmp_path / "queue" / "x.txt").write_text("not json\n")
    assert [tuple(r) for r in streams.drained(streams.messages(spark, folder)).collect()] == [(good, "u/1")]


def test_requeue_equals_batch(spark):
    rows = spark.read.parquet(EVENTS).filter("event_type = 'error'").withColumn("job_id", F.col("user_id").cast("string"))
    batch = {(r["event_id"], r["requeue_count"], r["outcome"]) for r in jobs.requeues(rows, "job_id", ["ts", "event_id"]).collect()}
    assert {(r["event_id"], r["requeue_count"], r["outcome"]) for r in streams.run_requeue(spark, EVENTS).collect()} == batch
    assert {o for _, n, o in batch if n > 3} <= {"orphan_requeue_cap"}


def test_bucket_equals_batch(spark):
    rows = spark.read.parquet(EVENTS).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    batch = {(r["event_id"], r["granted"]) for r in jobs.token_grants(rows, "user_id", "at", "event_id", 0.0001, 2.0).collect()}
    assert {(r["event_id"], r["granted"]) for r in streams.run_token_bucket(spark, EVENTS, 0.0001, 2.0).collect()} == batch


def test_cache_equals_batch(spark):
    rows = spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 700).alias("phash"))
    batch = {(r["event_id"], r["hit"]) for r in jobs.cached_by_order(rows, "phash", "ts", "event_id").collect()}
    assert {(r["event_id"], r["hit"]) for r in streams.run_ttl_cache(spark, EVENTS).collect()} == batch


def test_sweeping(spark, tmp_path):
    table = spark.createDataFrame([("a", "PROCESSING"), ("b", "SUCCEEDED")], "job_id string, status string").select("job_id", "status", F.lit("").alias("error_code"), F.lit("2020-01-01").cast("timestamp").alias("created_at"), F.lit("2020-01-01").cast("timestamp").alias("updated_at"))
    found = []
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    run = streams.sweeping(ticks, lambda: table, lambda df: found.append({r["job_id"]: r["status"] for r in df.collect()})).start()
    try:
        for _ in range(100):
            if found or run.awaitTermination(0.2):
                break
    finally:
        run.stop()
    assert found[0] == {"a": "FAILED_TRANSIENT", "b": "SUCCEEDED"}


def run_until(writer, done):
    run = writer.start()
    try:
        for _ in range(100):
            if done() or run.awaitTermination(0.2):
                break
    finally:
        run.stop()


def test_depth_and_purge_on_ticks(spark):
    """The sampler counts what waits, not what a batch brings; only the leader purges, once for each night."""
    queue = spark.range(300).select(F.col("id").cast("string").alias("job_id"), F.lit(1).alias("enqueued_at"))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    told = []
    run_until(streams.sampling_depth(ticks, lambda: queue, lambda: queue.filter("job_id < '2'"), lambda n, level: told.append((n, level))), lambda: told)
    assert told[0] == (queue.filter("job_id >= '2'").count(), "ok")
    old = spark.createDataFrame([("a", "SUCCEEDED"), ("b", "PENDING")], "job_id string, status string").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    left = []
    run_until(streams.purging(ticks, lambda: old, lambda df: left.append([r["job_id"] for r in df.collect()]), "w1", "w1", datetime(2020, 1, 1)), lambda: left)
    assert left == [["b"]]


def test_bad_messages_are_told(spark):
    raw = spark.createDataFrame([("not json",), ('{"job_id": "x", "image_url": "u"}',), ('{"job_id": "0b8e2f4e-0d0c-4c56-8a2f-6a1d2f3b4c5d", "image_url": "u"}',)], "value string")
    assert [r["valid"] for r in streams.parsed_messages(raw).collect()] == [False, False, True]


def test_markdown(spark, tmp_path):
    for n in (1, 2):
        files.append_markdown(spark.createDataFrame([(n, 50.0)], "run int, pct double"), str(tmp_path / "log"), ["run", "pct"])
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert lines == ["| 1 | 50.0 |", "| 2 | 50.0 |", "| run | pct |", "|-|-|"]


def test_streams_that_forget_nothing_count_rows_in_any_order(spark, tmp_path):
    """Five batches out of time order, weeks apart: without a lateness none is dropped."""
    days = [20, 1, 25, 3, 40]
    for i, day in enumerate(days):
        spark.createDataFrame([("a", 86_400.0 * day, i)], "job_id string, at double, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, at double, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = streams.drained(streams.bounded_requeues(stream, streams.Settings(requeue_ttl_s=None), lateness=None)).collect()
    assert sorted(r["requeue_count"] for r in rows) == [1, 2, 3, 4, 5]
