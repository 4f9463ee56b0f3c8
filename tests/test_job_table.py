"""The job table as a change log: against a plain table, with steps cut off and repeated."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import job_table, jobs
from tallywright.operators.job_table import JobTable
from tallywright.streaming.consumer import Consumer


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def told(table):
    return {r["job_id"]: (r["status"], r["phash"], r["error_code"], str(r["updated_at"])[:10]) for r in table.read().collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_rounds_against_a_plain_table(spark, tmp_path):
    rnd, plain, table = random.Random(1), {}, JobTable(spark, str(tmp_path / "t"), 4)
    for day in range(1, 13):
        ids = [f"j{rnd.randrange(12)}" for _ in range(4)]
        what = rnd.choice(["insert", "insert", "update", "update", "delete"])
        if what == "insert":
            table.insert(jobs.new_jobs(spark.createDataFrame([(i, "u") for i in ids], "job_id string, image_url string"), at(day)))
            for i in ids:
                plain.setdefault(i, ("PENDING", None, None, f"2024-01-{day:02d}"))
        elif what == "update":
            code = rnd.choice([None, f"e{day}"])
            table.update(spark.createDataFrame([(i, "PROCESSING", None, code) for i in ids], "job_id string, status string, phash string, error_code string"), at(day))
            for i in set(ids) & set(plain):
                plain[i] = ("PROCESSING", plain[i][1], code or plain[i][2], f"2024-01-{day:02d}")
        else:
            table.delete(spark.createDataFrame([(i,) for i in ids], "job_id string"))
            for i in ids:
                plain.pop(i, None)
        if day % 4 == 0:
            table.compact()
        assert told(table) == plain, day
    table.compact()
    assert told(table) == plain and table._changes() == [] and table.compact() == []


def test_small_changes_write_little(spark, tmp_path):
    """A change of a hundredth of the jobs writes about that much, and compaction leaves other buckets' files as they are."""
    folder = str(tmp_path / "t")
    table = JobTable(spark, folder, 16)
    rows = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("job_id"), F.concat(F.lit("https://h/"), "id").alias("image_url"))
    table.insert(jobs.new_jobs(rows, at(1)))
    table.compact()
    whole = size(f"{folder}/base")
    before = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{folder}/base") for f in names if f.endswith(".parquet")}
    hit = rows.filter(table.bucket(F.col("job_id")) < 2).limit(400)
    table.update(hit.select("job_id", F.lit("PROCESSING").alias("status")), at(2))
    assert size(f"{folder}/log") < 0.03 * whole
    met = table.compact()
    assert set(met) <= {0, 1}
    kept = [f for f in before if os.path.exists(f)]
    assert len(kept) == len(before) - len(met) and all(os.path.getmtime(f) == before[f] for f in kept)
    assert table.read().count() == 40_000 and table.read().filter("status = 'PROCESSING'").count() == 400


def test_steps_cut_off_and_repeated(spark, tmp_path):
    """A change without its mark of success is none; one that is sent again changes nothing; a log that was taken in but not dropped does no harm."""
    import shutil

    folder = str(tmp_path / "t")
    table = JobTable(spark, folder, 2)
    first = table.insert(jobs.new_jobs(spark.createDataFrame([("a", "u"), ("b", "u")], "job_id string, image_url string"), at(1)))
    table.delete(spark.createDataFrame([("b",)], "job_id string"))
    n = table.update(spark.createDataFrame([("a", "SUCCEEDED")], "job_id string, status string"), at(2))
    assert table.update(spark.createDataFrame([("a", "PENDING")], "job_id string, status string"), at(3), number=n) == n
    want = told(table)
    assert first == 1 and want == {"a": ("SUCCEEDED", None, None, "2024-01-02")}
    shutil.copytree(f"{folder}/log", f"{folder}/saved")
    table.compact()
    shutil.copytree(f"{folder}/saved", f"{folder}/log", dirs_exist_ok=True)
    assert told(table) == want
    table.compact()
    assert told(table) == want
    assert table.insert(jobs.new_jobs(spark.createDataFrame([("c", "u")], "job_id string, image_url string"), at(4))) == n + 1
    os.remove(f"{folder}/log/change={n + 1}/_SUCCESS")
    assert told(table) == want


def test_purge_and_constraints(spark, tmp_path):
    table = JobTable(spark, str(tmp_path / "t"), 2)
    table.insert(jobs.new_jobs(spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u")], "job_id string, image_url string"), at(1)))
    table.update(spark.createDataFrame([("a", "SUCCEEDED", None), ("b", "odd", None), ("c", "FAILED_PERMANENT", None)], "job_id string, status string, error_code string"), at(1))
    assert {(r["job_id"], r["violation"]) for r in table.violations().collect()} == {("b", "status_known"), ("c", "failure_has_code")}
    table.purge(F.lit("2024-12-01").cast("timestamp"))
    assert set(told(table)) == {"b"}
    table.compact()
    assert set(told(table)) == {"b"} and JobTable(spark, str(tmp_path / "none")).read().count() == 0


@pytest.mark.parametrize("rows", [[], [("x", "SUCCEEDED")]])
def test_changes_of_jobs_that_are_not_there(spark, tmp_path, rows):
    table = JobTable(spark, str(tmp_path / "t"), 2)
    table.update(spark.createDataFrame(rows, "job_id string, status string"), at(1))
    assert table.read().count() == 0
    table.compact()
    assert table.read().count() == 0


def test_batch_merges_its_own_jobs_only(spark, tmp_path, monkeypatch):
    """What a batch of the consumer merges follows its messages, not the table; what is read is what a whole read has."""
    table = JobTable(spark, str(tmp_path / "t"), 4)
    name = "0b8e2f4e-0d0c-4c56-8a2f-{:012d}".format
    table.insert(jobs.new_jobs(spark.createDataFrame([(name(i), "u") for i in range(60)], "job_id string, image_url string"), at(1)))
    table.compact()
    table.update(spark.createDataFrame([(name(i), "PROCESSING") for i in range(60)], "job_id string, status string"), at(2))
    table.delete(spark.createDataFrame([(name(3),)], "job_id string"))
    asked = spark.createDataFrame([(name(i),) for i in (1, 3, 5, 99)], "job_id string")
    assert sorted(table.read(asked).collect()) == sorted(r for r in table.read().collect() if r["job_id"] in (name(1), name(5)))
    merged, merge = [], job_table.merge
    monkeypatch.setattr(job_table, "merge", lambda base, log: merged.append(base.count() + log.count()) or merge(base, log))
    messages = asked.withColumn("image_url", F.lit("u"))
    consumer = Consumer(table, lambda m: m, str(tmp_path / "c"), str(tmp_path / "q"))
    assert {r["job_id"] for r in consumer.judged(messages, 0).collect()} == {name(i) for i in (1, 3, 5, 99)}
    assert merged == [3 * 2 + 1]
