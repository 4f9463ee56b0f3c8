"""Timers, rates and the consumer as streams: out of order, late, restarted."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators import jobs, metrics
from tallywright.operators.job_table import JobTable
from tallywright.sources.shared import delete
from tallywright.streaming import jobs as streams
from tallywright.streaming import timed
from tallywright.streaming.consumer import Consumer

END = 4_000_000_000.0


def run(spark, folder, batches, schema, operator):
    """A file of rows after the other, each a batch of its own."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with timed.timed_state(spark):
        return streams.drained(operator(stream))


LOG = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("at", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType())])


def test_jobs_time_out_by_themselves(spark, tmp_path):
    """Batches out of time order within the lateness; the first event at exactly the limit keeps a job alive; ended jobs ignore what comes."""
    rnd, rows = random.Random(7), []
    for job in range(12):
        at = rnd.randrange(3000)
        for _ in range(rnd.randint(1, 9)):
            rows.append((f"j{job}", float(at), len(rows), rnd.choice(["PENDING", "PROCESSING", "PROCESSING", "PROCESSING", "SUCCEEDED", "FAILED_PERMANENT"])))
            at += rnd.choice([0, 60, 899, 900, 901, 1800, 1801, 2500])
    mixed = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 1500))
    batches = [mixed[i : i + 9] for i in range(0, len(mixed), 9)] + [[("~", END, 0, "PENDING")]]
    got = run(spark, str(tmp_path / "in"), batches, LOG, lambda s: timed.timed_out_jobs(s, lateness="30 minutes")).filter("job_id <> '~'").collect()
    assert not any(r["late"] for r in got) and len([r for r in got if r["event_id"] is not None]) == len(rows)
    ends = {r["job_id"]: (r["status"], r["error_code"], r["at"]) for r in got if not r["ignored"] and r["status"] in ("SUCCEEDED", "FAILED_PERMANENT", "FAILED_TRANSIENT")}
    want = timed.timed_out_by_scan(spark.createDataFrame(rows, LOG)).collect()
    assert ends == {r["job_id"]: (r["status"], r["error_code"], r["ended_at"]) for r in want}
    ignored = {r["job_id"]: r["n_ignored"] for r in want if r["n_ignored"]}
    assert {j: sum(r["ignored"] for r in got if r["job_id"] == j) for j in ignored} == ignored


def test_late_rows_have_an_output_of_their_own(spark, tmp_path):
    batches = [[("a", 1000.0, 1, "PROCESSING")], [("b", 9000.0, 2, "PROCESSING")], [("a", 1100.0, 3, "SUCCEEDED"), ("b", 9100.0, 4, "SUCCEEDED")], [("~", END, 0, "PENDING")]]
    rows = run(spark, str(tmp_path / "in"), batches, LOG, lambda s: timed.timed_out_jobs(s, lateness="10 seconds"))
    assert {(r["job_id"], r["event_id"]) for r in timed.late_rows(rows).collect()} == {("a", 3)}
    assert {(r["job_id"], r["status"], r["error_code"]) for r in timed.on_time(rows).filter("at < 10000 AND status <> 'PROCESSING'").collect()} == {("a", "FAILED_TRANSIENT", "stale_timeout"), ("b", "SUCCEEDED", None)}


def test_many_events_of_a_job_are_few_rows_of_state(spark, tmp_path):
    """Neither the operator nor its state has a row for each event: they grow with jobs and packs."""
    folder, n = str(tmp_path / "in"), 2_000
    for part in range(2):
        rows = spark.range(part * 3 * n, (part + 1) * 3 * n).select(F.concat(F.lit("j"), F.col("id") % 3).alias("job_id"), (F.col("id") / 100).alias("at"), F.col("id").alias("seq"), F.lit("PROCESSING").alias("status"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("~", END, 0, "PENDING")], LOG).coalesce(1).write.mode("append").parquet(folder)
    stream = timed.timed_out_jobs(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder))
    with timed.timed_state(spark):
        query = stream.writeStream.format("memory").queryName("few_rows").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sum(o.numRowsUpdated for p in query.recentProgress for o in p.stateOperators) < 100
    ends = {f"j{j}": (n + n, 6 * n / 100 - (3 - j) / 100 + 900) for j in range(3)}
    got = spark.table("few_rows").filter("job_id <> '~'").groupBy("job_id").agg(F.count("event_id").alias("n"), F.max(F.when(F.col("error_code") == "stale_timeout", F.col("at"))).alias("at"))
    assert {r["job_id"]: (r["n"], pytest.approx(r["at"])) for r in got.collect()} == ends


@pytest.mark.parametrize("most", [1, 3, 1 << 16])
def test_packs_keep_every_event(monkeypatch, most):
    """Without a job, a number or a state, with states that nobody knows, cut where a pack is full."""
    monkeypatch.setattr(timed, "PACK", most)
    rnd = random.Random(most)
    rows = [{"job_id": rnd.choice(["a", "b", "", None]), "at": rnd.uniform(-9, 9), "seq": rnd.choice([None, i, -(2**62) - i]), "status": rnd.choice(["PENDING", 'o"dd\n', None])} for i in range(40)]
    schema = pa.schema([("job_id", pa.string()), ("at", pa.float64()), ("seq", pa.int64()), ("status", pa.string())])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    packs = [p for b in timed._packed(iter([batch.slice(0, 11), batch.slice(11, 0), batch.slice(11)])) for p in b.to_pylist()]
    assert all(len(p["events"]) <= most * timed._EVENT.itemsize for p in packs)
    rest = pa.schema([("job_id", pa.string()), ("events", pa.binary()), ("names", pa.string()), ("status", pa.string()), ("error_code", pa.string()), ("ignored", pa.bool_()), ("late", pa.bool_())])
    out = [r for b in timed._unpacked(iter([pa.RecordBatch.from_pylist(packs, rest)])) for r in b.to_pylist()]
    assert sorted(map(repr, rows)) == sorted(repr({"job_id": r["job_id"], "at": r["at"], "seq": r["event_id"], "status": r["status"]}) for r in out)
    events, names = timed._in_order([(p["events"], p["names"]) for p in packs])
    assert [e["at"] for e in events] == sorted(r["at"] for r in rows) and names == [None, "PENDING", 'o"dd\n']
    assert {s for p in packs for s in json.loads(p["names"])} == set(names)
    with pytest.raises(ValueError, match="no time"):
        list(timed._packed(iter([pa.RecordBatch.from_pylist([{**rows[0], "at": None}], schema)])))


COUNTER = T.StructType([T.StructField("series", T.StringType()), T.StructField("at", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType())])


def test_increases_are_put_right(spark, tmp_path):
    """Samples out of order, restarts between batches, a late sample: sums by time equal the batch form's."""
    rnd = random.Random(3)
    rows = [(s, float(60 * i + rnd.randrange(60)), 0, float(v)) for s in "xy" for v, i in zip([rnd.choice([5, 8, 13, 2, 40]) for _ in range(60)], range(60))]
    mixed = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 500))
    batches = [mixed[i : i + 20] for i in range(0, len(mixed), 20)] + [[("~", END, 0, 0.0)], [("x", 30.5, 9, 1.0), ("~", END + 5, 0, 1.0)]]
    got = run(spark, str(tmp_path / "in"), batches, COUNTER, lambda s: timed.increases(s, ["series"], lateness="10 minutes")).filter("series <> '~'")
    assert [(r["series"], r["at"]) for r in timed.late_rows(got).collect()] == [("x", 30.5)]
    sums = {(r["series"], r["at"]): r["s"] for r in timed.on_time(got).groupBy("series", "at").agg(F.sum("increase").alias("s")).collect()}
    want = metrics.increases(spark.createDataFrame(rows, COUNTER), ["series"], "at").filter("increase IS NOT NULL").collect()
    assert sums == {(r["series"], r["at"]): r["increase"] for r in want}


def test_quantile_of_an_array(spark):
    rnd = random.Random(5)
    les = [1.0, 2.0, 5.0, float("inf")]
    groups = [[0.0] * 4, [0, 0, 0, 3], [4, 4, 4, 4]] + [sorted(rnd.randrange(20) for _ in les) for _ in range(40)]
    long = spark.createDataFrame([(g, le, float(n)) for g, ns in enumerate(groups) for le, n in zip(les, ns)], "g int, le double, n double")
    for q in (0.5, 0.95, 1.0):
        batch = {r["g"]: r["quantile"] for r in metrics.histogram_quantile(long, q, ["g"]).collect()}
        arrays = long.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b")).select("g", metrics.quantile_of(F.col("b"), q).alias("quantile"))
        assert {r["g"]: r["quantile"] for r in arrays.collect() if r["quantile"] is not None} == batch


UUIDS = [f"0b8e2f4e-0d0c-4c56-8a2f-{i:012d}" for i in range(12)]


@pytest.mark.parametrize("crash", ["none", "verdict", "change", "whole"])
def test_a_batch_run_again_changes_nothing(spark, tmp_path, crash):
    """The driver is lost after the verdict, after the change or after the whole batch: the end is the same."""
    folder = str(tmp_path)
    table = JobTable(spark, f"{folder}/jobs", 2)
    table.insert(jobs.new_jobs(spark.createDataFrame([(u, "u") for u in UUIDS[:10]], "job_id string, image_url string"), F.lit("2024-01-01").cast("timestamp")))
    key = F.right("job_id", F.lit(12)).cast("int")
    work = lambda m: m.withColumn("extract", F.when(key == 1, "exhausted").when((key == 2) & (F.col("requeue_count") == 0), "exhausted").when(key == 3, "extractor_invalid_json").when((key == 4) & F.lit(False), "throttled"))
    consumer = Consumer(table, work, f"{folder}/consumer", f"{folder}/queue")
    streams.enqueue(spark.createDataFrame([(u, "u") for u in [*UUIDS, UUIDS[5]]] + [("odd", "u")], "job_id string, image_url string"), f"{folder}/queue")
    now = lambda: F.lit("2024-01-02").cast("timestamp")

    def drain():
        consumer.consuming(streams.messages(spark, f"{folder}/queue"), now).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    drain()
    if crash != "none":
        delete(spark, f"{folder}/state/commits/0")
        delete(spark, f"{folder}/state/commits/.0.crc")
    if crash in ("verdict", "change"):
        delete(spark, f"{folder}/queue/again-0")
    if crash == "verdict":
        delete(spark, f"{folder}/jobs/log/change=2")
    for _ in range(6):
        drain()
    got = {r["job_id"]: (r["status"], r["error_code"]) for r in table.read().collect()}
    want = {u: ("SUCCEEDED", None) for u in UUIDS[:10]} | {UUIDS[1]: ("FAILED_PERMANENT", "orphan_requeue_cap"), UUIDS[3]: ("FAILED_PERMANENT", "extractor_invalid_json")}
    assert got == want
    ends = {r["job_id"]: r["n"] for r in table.history().filter("kind = 'update'").groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    assert ends == dict.fromkeys(UUIDS[:10], 1)
    assert {r["job_id"] for r in consumer.verdicts().filter("action = 'drop_unknown'").collect()} == set(UUIDS[10:])
    assert consumer.verdicts().filter(F.col("job_id") == UUIDS[1]).count() == 4
