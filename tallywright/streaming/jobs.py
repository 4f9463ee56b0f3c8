"""Stateful streams: bounded retries, token bucket, expiring cache, job states, and the periodic tasks.

Each stateful operator is a function of the stream, so it runs on any source;
the ``run_`` forms drive it over a folder of events with a bounded trigger.
Within a micro-batch a key's rows are put in order before they are folded into
its state, so the result equals the batch form as long as batches arrive in order.
A state that says no more than no state at all goes, by event time: an entry that
is over, a bucket that is full again, a job that ended long ago.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywright.operators.jobs import UUID, purge, purge_due, queue_depth, swept
from tallywright.schemas import DEFAULTS, MESSAGE, TERMINAL, Settings
from tallywright.sources.shared import shared_folder

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
#: Files that one micro-batch takes up at most.
FILES_AT_ONCE = 1_000
#: How late rows may come, against those that came before, and still be counted, where a stream forgets; None forgets nothing and counts all.
LATENESS = "1 day"


def _fold(stream: DataFrame, key: str, out: str, state: str, step: Callable[[tuple | None, object], tuple[tuple, tuple]], life: Callable[[tuple], float | None], lateness: str | None = None) -> DataFrame:
    """Rows of (key, at, seq) folded along each key: ``step(state, row)`` gives the new state and an output row.

    ``life(state)`` tells until when, in seconds of event time, the state is of
    use; None is for good. Only with ``lateness`` is a state dropped then, and are
    rows that come later than that dropped, which Spark does before a state can
    see them; without it all rows count, in whatever order batches bring them. Where
    late rows are to be told, take the operators of ``streaming.timed``.
    """

    def advance(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at", "seq"], kind="stable")
        now, made = (tuple(held.get) if held.exists else None), []
        for row in rows.itertuples(index=False):
            now, result = step(now, row)
            made.append((*keys, *result))
        held.update(now)
        until = life(now) if lateness else None
        if until is not None:
            held.setTimeoutTimestamp(max(int(until * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    if lateness is None:
        return stream.groupBy(key).applyInPandasWithState(advance, out, state, "append", GroupStateTimeout.NoTimeout)
    timed = stream.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", lateness)
    return timed.groupBy(key).applyInPandasWithState(advance, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def bounded_requeues(attempts: DataFrame, settings: Settings = DEFAULTS, lateness: str | None = LATENESS) -> DataFrame:
    """(job_id, at, seq) to job_id, event_id, requeue_count, outcome.

    The count lives for its time to live from the first attempt; then it starts anew, as the stored counter does.
    """
    ttl, cap = settings.requeue_ttl_s, settings.requeue_cap

    def step(now, row):
        alive = now is not None and (ttl is None or row.at - now[1] < ttl)
        count, since = (now[0] + 1, now[1]) if alive else (1, row.at)
        return (count, since), (row.seq, count, "orphan_requeue_cap" if count > cap else "requeue")

    return _fold(attempts, "job_id", "job_id string, event_id long, requeue_count int, outcome string", "n int, since double", step, lambda now: None if ttl is None else now[1] + ttl, lateness)


def token_bucket(requests: DataFrame, rate: float = DEFAULTS.rate_per_s, burst: float = DEFAULTS.burst, lateness: str | None = LATENESS) -> DataFrame:
    """(user_id, at, seq) to user_id, event_id, granted: refilled by elapsed time, never above the burst."""

    def step(now, row):
        tokens = float(burst) if now is None else min(float(burst), now[0] + (row.at - now[1]) * float(rate))
        granted = tokens >= 1
        return (tokens - 1 if granted else tokens, row.at), (row.seq, granted)

    return _fold(requests, "user_id", "user_id long, event_id long, granted boolean", "tokens double, at double", step, lambda now: now[1] + (float(burst) - now[0]) / float(rate), lateness)


def ttl_cache(requests: DataFrame, settings: Settings = DEFAULTS, lateness: str | None = LATENESS) -> DataFrame:
    """(phash, at, seq) to phash, event_id, hit: a miss writes the entry, which lives for its time to live."""
    ttl = settings.cache_ttl_s

    def step(now, row):
        hit = now is not None and row.at < now[0] + ttl
        return (now if hit else (row.at,)), (row.seq, hit)

    return _fold(requests, "phash", "phash long, event_id long, hit boolean", "written double", step, lambda now: now[0] + ttl, lateness)


def job_states(log: DataFrame, settings: Settings = DEFAULTS, keep_terminal: bool = False, lateness: str | None = LATENESS) -> DataFrame:
    """(job_id, at, seq, status) to a row for each event with the job's state before and after it, its number of events, and whether it was ignored.

    With ``keep_terminal`` a job that is over stays as it ended: events that come
    later are ignored, for as long as ended jobs are retained.
    """
    retained = settings.retention_days * 86_400

    def step(now, row):
        last, n, _ = now or (None, 0, 0.0)
        ignored = keep_terminal and last in TERMINAL
        status = last if ignored else row.status
        return (status, n + 1, row.at), (row.seq, status, last, n + 1, ignored)

    out = "job_id string, event_id long, status string, before string, n_events int, ignored boolean"
    return _fold(log, "job_id", out, "status string, n int, at double", step, lambda now: now[2] + retained if keep_terminal and now[0] in TERMINAL else None, lateness)


def parsed_messages(raw: DataFrame) -> DataFrame:
    """JSON lines (``value``) as messages; ``valid`` tells those with a UUID and a URL, the others are to be logged."""
    parsed = raw.select("value", F.from_json("value", MESSAGE).alias("m")).select("value", "m.*")
    return parsed.withColumn("valid", F.coalesce(F.col("job_id").rlike(UUID) & (F.col("image_url") != ""), F.lit(False)))


def messages(spark: SparkSession, folder: str, files_at_once: int = FILES_AT_ONCE) -> DataFrame:
    """The queue as a stream of JSON lines, without corrupt and invalid messages: see :func:`bad_messages`. Folders in the queue are read as well."""
    return parsed_messages(spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").load(folder)).filter("valid").drop("value", "valid")


def bad_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the queue that :func:`messages` leaves out, as a stream for the log."""
    return parsed_messages(spark.readStream.format("text").load(folder)).filter("not valid").select("value")


def enqueue(frame: DataFrame, folder: str) -> None:
    """Appends messages (job_id, image_url) to the queue folder."""
    frame.select(F.to_json(F.struct("job_id", "image_url")).alias("value")).write.mode("append").text(folder)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream. A path with a wildcard may name a single file."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", FILES_AT_ONCE).parquet(path)


def _seconds() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")


def drained(stream: DataFrame, longest_s: float | None = None) -> DataFrame:
    """What the stream makes of all that is there now, through a parquet sink; with ``longest_s`` it fails if that takes longer."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    if longest_s is None:
        run.awaitTermination()
    elif not run.awaitTermination(longest_s):
        run.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_requeue(spark: SparkSession, path: str) -> DataFrame:
    """Bounded retries over a table's errors, counts kept for good."""
    attempts = events(spark, path).filter(F.col("event_type") == "error").select(F.col("user_id").cast("string").alias("job_id"), _seconds(), F.col("event_id").alias("seq"))
    return drained(bounded_requeues(attempts, Settings(requeue_ttl_s=None), lateness=None))


def run_token_bucket(spark: SparkSession, path: str, rate: float = DEFAULTS.rate_per_s, burst: float = DEFAULTS.burst) -> DataFrame:
    """Token bucket over a table of requests."""
    return drained(token_bucket(events(spark, path).select("user_id", _seconds(), F.col("event_id").alias("seq")), rate, burst, lateness=None))


def run_ttl_cache(spark: SparkSession, path: str) -> DataFrame:
    """Expiring cache over a table of requests."""
    return drained(ttl_cache(events(spark, path).select((F.col("event_id") % 700).alias("phash"), _seconds(), F.col("event_id").alias("seq")), lateness=None))


def run_job_states(spark: SparkSession, path: str) -> DataFrame:
    """Last state of each job after the whole log."""
    log = events(spark, path).select(F.col("user_id").cast("string").alias("job_id"), _seconds(), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return drained(job_states(log, lateness=None)).groupBy("job_id").agg(F.max_by("status", "n_events").alias("status"), F.count("*").alias("n_events"))


def run_state_machine(spark: SparkSession, path: str, status: Column) -> DataFrame:
    """job_id, status, n_events, n_ignored of each job after the whole log, ended jobs staying as they ended."""
    log = events(spark, path).select(F.col("user_id").cast("string").alias("job_id"), _seconds(), F.col("event_id").alias("seq"), status.alias("status"))
    return drained(job_states(log, keep_terminal=True, lateness=None)).groupBy("job_id").agg(F.max_by("status", "n_events").alias("status"), F.count("*").alias("n_events"), F.count_if("ignored").alias("n_ignored"))


def run_queue(spark: SparkSession, messages_: DataFrame) -> DataFrame:
    """What comes out of a queue that a table of messages (job_id, image_url) went into."""
    folder = f"{shared_folder(spark)}/queue"
    enqueue(messages_, folder)
    return drained(messages(spark, folder))


def sweeping(ticks: DataFrame, read_jobs: Callable[[], DataFrame], write_jobs: Callable[[DataFrame], None], settings: Settings = DEFAULTS):
    """A stream writer that sweeps stale jobs at every batch of ``ticks`` (timestamp); start it with a trigger."""

    def sweep(batch: DataFrame, _: int) -> None:
        latest = batch.agg(F.max("timestamp").alias("t")).first()["t"]
        if latest is not None:
            write_jobs(swept(read_jobs(), F.lit(latest), settings))

    return ticks.writeStream.foreachBatch(sweep)


def purging(ticks: DataFrame, read_jobs: Callable[[], DataFrame], write_jobs: Callable[[DataFrame], None], worker: str, leader: str, since: datetime, settings: Settings = DEFAULTS):
    """A stream writer that purges old jobs once for every nightly hour that passes after ``since``; only the leader does."""
    last = [since]

    def purge_(batch: DataFrame, _: int) -> None:
        latest = batch.agg(F.max("timestamp").alias("t")).first()["t"] if worker == leader else None
        if latest is not None:
            if batch.sparkSession.range(1).select(purge_due(F.lit(last[0]), F.lit(latest))).first()[0]:
                write_jobs(purge(read_jobs(), F.lit(latest), settings)[0])
            last[0] = latest

    return ticks.writeStream.foreachBatch(purge_)


def sampling_depth(ticks: DataFrame, read_enqueued: Callable[[], DataFrame], read_taken: Callable[[], DataFrame], report: Callable[[int, str], None], settings: Settings = DEFAULTS):
    """A stream writer that reports, at every batch of ``ticks``, how many messages wait in the queue and the backpressure level that means."""

    def sample(_: DataFrame, __: int) -> None:
        row = queue_depth(read_enqueued(), read_taken(), settings).first()
        report(row["depth"], row["level"])

    return ticks.writeStream.foreachBatch(sample)


def refreshed_bucket(requests: DataFrame, read_config: Callable[[], DataFrame], apply: Callable[[DataFrame, float, float], None], settings: Settings = DEFAULTS):
    """A stream writer that reads the rate configuration (rps, burst) anew for each batch; a missing field has its default."""

    def refresh(batch: DataFrame, _: int) -> None:
        row = read_config().agg(F.max("rps").alias("rps"), F.max("burst").alias("burst")).first()
        apply(batch, settings.rate_per_s if row["rps"] is None else row["rps"], settings.burst if row["burst"] is None else row["burst"])

    return requests.writeStream.foreachBatch(refresh)
