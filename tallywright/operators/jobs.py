"""The job table: lifecycle filters, status maps, updates, caches, batch state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywright.functions.text import host_allowed, text
from tallywright.schemas import DEFAULTS, ERRORS, FAILED_PERMANENT, FAILED_TRANSIENT, PENDING, PROCESSING, STATUSES, SUCCEEDED, TERMINAL, Settings

#: Characters of a URL that the job table holds.
LONGEST_URL = 512
UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    """The job's row, or none; the filter reaches the scan."""
    return jobs.filter(F.col("job_id") == job_id)


def storable(url: Column) -> Column:
    """Whether the job table can hold the URL: it is never cut."""
    return F.coalesce(F.char_length(url) <= LONGEST_URL, F.lit(False))


def new_jobs(requests: DataFrame, now: Column) -> DataFrame:
    """Rows of fresh jobs from (job_id, image_url); a URL that the table can't hold fails the write, as its column type does."""
    empty = lambda name: F.lit(None).cast("string").alias(name)
    url = F.when(F.assert_true(F.col("image_url").isNull() | storable(F.col("image_url")), F.lit("image_url is too long")).isNull(), F.col("image_url"))
    return requests.select("job_id", F.lit(PENDING).alias("status"), empty("phash"), url.alias("image_url"), empty("error_code"), empty("error_message"), now.alias("created_at"), now.alias("updated_at"))


def submitted(requests: DataFrame, depth: Column, now: Column, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a batch of requests (job_id, image_url) leads to: answers, rows for the job table, messages for the queue.

    Backpressure comes first, then the host, then the row, then the message. A
    URL that the table can't hold is an internal error, of which nothing is stored.
    """
    judged = admitted(requests, depth, settings)
    fits = storable(F.col("image_url"))
    http = F.when(F.col("accepted") & ~fits, 500).otherwise(F.col("http_status"))
    error = F.when(http == 429, "backpressure").when(http == 400, "disallowed_domain").when(http == 500, "internal_error")
    answers = judged.select("job_id", http.alias("http_status"), error.alias("error_code"), F.when(http == 202, PENDING).otherwise(payload_status(http)).alias("status"))
    stored = judged.filter(F.col("accepted") & fits)
    return answers, new_jobs(stored, now), stored.select("job_id", "image_url")


def yielded(jobs: DataFrame, messages: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs that go back to the queue: ``jobs`` with their update times moved, and the messages (job_id, image_url, enqueued_at) for its tail.

    The times keep the sweeper away. How many there are, the count of the messages tells.
    """
    return touch(jobs, messages.select("job_id"), now), messages.select("job_id", "image_url", now.alias("enqueued_at"))


def waiting(enqueued: DataFrame, taken: DataFrame) -> DataFrame:
    """Messages of the queue that no worker has taken yet, by job and time of arrival."""
    gone = taken.select("job_id", "enqueued_at").distinct()
    return enqueued.join(gone, ["job_id", "enqueued_at"], "left_anti")


def queue_depth(enqueued: DataFrame, taken: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: the number of waiting messages and the level it means."""
    return waiting(enqueued, taken).agg(F.count("*").alias("depth")).select("depth", backpressure(F.col("depth"), settings)["level"].alias("level"))


def stale(now: Column, settings: Settings = DEFAULTS) -> Column:
    """Processing untouched for too long, or pending since too long; strictly."""
    before = lambda minutes: now - F.expr(f"INTERVAL {minutes} MINUTES")
    return ((F.col("status") == PROCESSING) & (F.col("updated_at") < before(settings.processing_stale_min))) | ((F.col("status") == PENDING) & (F.col("created_at") < before(settings.pending_stale_min)))


def expired(now: Column, settings: Settings = DEFAULTS) -> Column:
    """Terminal and untouched for longer than jobs are retained."""
    return F.col("status").isin(*TERMINAL) & (F.col("updated_at") < now - F.expr(f"INTERVAL {settings.retention_days} DAYS"))


def swept(jobs: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """``jobs`` with stale ones failed as transient."""
    hit = stale(now, settings)
    changes = {"error_code": F.lit("stale_timeout"), "updated_at": now, "status": F.lit(FAILED_TRANSIENT)}
    marked = jobs.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return marked.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("__hit")


def purge(jobs: DataFrame, now: Column, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the number deleted by status."""
    gone = F.coalesce(expired(now, settings), F.lit(False))
    return jobs.filter(~gone), jobs.groupBy("status").agg(F.count_if(gone).alias("deleted"))


def update(jobs: DataFrame, changes: DataFrame, now: Column, strict_terminal: bool = False, order: str | None = None) -> DataFrame:
    """``jobs`` after ``changes`` (job_id, status and any of phash, error_code, error_message): null keeps what was there.

    So an error of an earlier try survives a later success. Of several changes to
    a job, each column has its last one that is not null, by the column
    ``order``, or, without it, by the changes' own columns. With
    ``strict_terminal``, jobs that are over don't change.
    """
    optional = [c for c in changes.columns if c not in ("job_id", "status", order)]
    turn = F.struct(*([order] if order else []), *[c for c in changes.columns if c not in ("job_id", order)])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(f"__{c}")
    new = changes.groupBy(F.col("job_id").alias("__id")).agg(*[last(c) for c in ("status", *optional)])
    joined = jobs.join(new, F.col("job_id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    if strict_terminal:
        hit = hit & ~F.col("status").isin(*TERMINAL)
    values = {c: F.when(hit, F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)) for c in optional}
    return joined.withColumn("__hit", hit).withColumns({**values, "updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at")), "status": F.when(F.col("__hit"), F.coalesce("__status", "status")).otherwise(F.col("status"))}).select(*jobs.columns)


def touch(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with a new update time for ``ids``."""
    marked = jobs.join(ids.select(F.col("job_id").alias("__id")).distinct(), F.col("job_id") == F.col("__id"), "left")
    return marked.withColumn("updated_at", F.when(F.col("__id").isNotNull(), now).otherwise(F.col("updated_at"))).select(*jobs.columns)


def phash_changes(jobs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(job_id, phash) that differ from the stored hash, null counting as different."""
    return hashes.select("job_id", F.col("phash").alias("__new")).join(jobs.select("job_id", "phash"), "job_id").filter(~F.col("__new").eqNullSafe(F.col("phash"))).select("job_id", F.col("__new").alias("phash"))


def backpressure(depth: Column, settings: Settings = DEFAULTS) -> Column:
    """Level, HTTP status and Retry-After by queue depth; an unknown depth is let through."""
    level = F.when(depth >= settings.reject_depth, "reject").when(depth >= settings.warn_depth, "warn").otherwise("ok")
    return F.struct(level.alias("level"), F.when(level == "reject", 429).otherwise(202).alias("http_status"), F.when(level == "reject", settings.retry_after_s).alias("retry_after"))


def http_answer() -> Column:
    """HTTP status and error code of a job row; a row without status is a missing job."""
    status, code = F.col("status"), F.col("error_code")
    http = F.when(status.isNull(), 404).when(status == SUCCEEDED, 200).when(status.isin(PENDING, PROCESSING), 202).when(status == FAILED_PERMANENT, 422).when(status == FAILED_TRANSIENT, 503).otherwise(500)
    given = F.when(code != "", code)
    error = F.when(status == FAILED_PERMANENT, F.coalesce(given, F.lit("failed_permanent"))).when(status == FAILED_TRANSIENT, F.coalesce(given, F.lit("failed_transient")))
    return F.struct(http.alias("http_status"), error.alias("error_code"))


def payload_status(http_status: Column) -> Column:
    """Job status that a rejected request is reported with."""
    return F.when(http_status.isin(400, 413, 415, 422), FAILED_PERMANENT).otherwise(FAILED_TRANSIENT)


def exception_status(error: Column) -> Column:
    """HTTP status of an unhandled error class."""
    return F.when(error.isin("DatabaseUnavailable", "StorageTransient"), 503).otherwise(500)


def download_outcome(http_status: Column, size: Column, timed_out: Column, settings: Settings = DEFAULTS) -> Column:
    """Error code and permanence of a download; null code if it is fine."""
    code = F.when(timed_out | (http_status >= 500), "storage_transient").when(http_status >= 400, "image_download_failed").when(size > settings.max_image_bytes, "image_too_large")
    return F.struct(code.alias("error_code"), F.when(code.isNotNull(), code != "storage_transient").alias("permanent"))


def errors(spark) -> DataFrame:
    """error_code, permanent, status: how each error ends a job."""
    rows = [(code, permanent, FAILED_PERMANENT if permanent else FAILED_TRANSIENT) for code, permanent in ERRORS]
    return spark.createDataFrame(rows, T.StructType([T.StructField("error_code", T.StringType()), T.StructField("permanent", T.BooleanType()), T.StructField("status", T.StringType())]))


def violations(jobs: DataFrame, result: str = "result") -> DataFrame:
    """Rows that break a constraint of the table, with its name."""
    broken = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status_known").when((F.col("status") == SUCCEEDED) & F.col(result).isNull(), "succeeded_has_result")
    return jobs.withColumn("violation", broken).filter(F.col("violation").isNotNull())


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages with a UUID and a URL."""
    return messages.filter(F.col("job_id").rlike(UUID) & (text(F.col("image_url")) != ""))


def runnable(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages whose job is known and not over."""
    return messages.join(jobs.select("job_id", "status"), "job_id").filter(~F.col("status").isin(*TERMINAL))


def orphans(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages without a job."""
    return messages.join(jobs.select("job_id"), "job_id", "left_anti")


def fifo(queue: DataFrame) -> DataFrame:
    """In order of arrival."""
    return queue.orderBy("enqueued_at", "seq")


def popped(queue: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The ``count`` messages that came first, and the rest; an empty queue gives none, as a pop that timed out does."""
    first = queue.orderBy("enqueued_at", "seq").limit(count)
    return first, queue.join(first.select("seq"), "seq", "left_anti")


def admitted(requests: DataFrame, depth: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Requests with their verdict: backpressure first, then the host; (level, http_status, accepted)."""
    pressed = backpressure(depth, settings)
    allowed = host_allowed(F.col("image_url"), F.array(*map(F.lit, settings.allowed_domains)))
    status = F.when(pressed["level"] == "reject", 429).when(~allowed, 400).otherwise(202)
    return requests.withColumns({"level": pressed["level"], "http_status": status, "accepted": status == 202})


def cache_lookup(lookups: DataFrame, cache: DataFrame, now: Column, valid: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """``lookups`` (phash, psv) with the cached payload and outcome: hit, miss, or drift (which is a miss, too)."""
    live = cache.filter(F.col("written_at") > now - F.expr(f"INTERVAL {settings.cache_ttl_s} SECONDS"))
    last = live.groupBy("phash", "psv").agg(F.max_by("payload", "written_at").alias("payload"))
    joined = lookups.join(last, ["phash", "psv"], "left")
    outcome = F.when(F.col("payload").isNull(), "miss").when(F.coalesce(valid, F.lit(False)), "hit").otherwise("drift")
    return joined.withColumn("outcome", outcome)


def cache_write(cache: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """``cache`` (phash, psv, payload, written_at) after ``entries`` (phash, psv, payload) are written at ``now``.

    An entry replaces the one of its key and starts its life anew; of several for
    a key in ``entries`` the greatest payload stays, so that reruns agree.
    """
    fresh = entries.groupBy("phash", "psv").agg(F.max("payload").alias("payload")).withColumn("written_at", now)
    return cache.join(fresh, ["phash", "psv"], "left_anti").select("phash", "psv", "payload", "written_at").unionByName(fresh)


def flagged_in_order(rows: DataFrame, key: str, at: str, seq: str, output: str, step: Callable[[object, float], tuple[object, bool]]) -> DataFrame:
    """``rows`` (key, at, seq) with a flag that a walk along each key's rows, by (at, seq), sets.

    ``step(state, at)`` gives the next state and the flag; a key starts with no
    state. Each task sorts its rows and holds one state and one batch, so a key
    may have any number of rows.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_, state, begun = None, None, False
        for one in batches:
            flags = []
            for own, when in zip(one.column(0).to_pylist(), one.column(1).to_pylist()):
                if not begun or own != key_:
                    key_, state, begun = own, None, True
                state, flag = step(state, when)
                flags.append(flag)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array(flags, pa.bool_())], names=[*one.schema.names, output])

    ordered = rows.select(key, at, seq).repartition(key).sortWithinPartitions(key, at, seq)
    return ordered.mapInArrow(walk, T.StructType([*ordered.schema.fields, T.StructField(output, T.BooleanType())]))


def cached_by_order(requests: DataFrame, key: str, at: str, seq: str, ttl_s: int = DEFAULTS.cache_ttl_s) -> DataFrame:
    """Batch form of the expiring cache: (key, seq, hit), whether each request finds an entry that an earlier miss wrote, still alive.

    An entry lives for the TTL from the miss that wrote it, so the state of a key
    is one time stamp.
    """
    ttl = ttl_s * 1_000_000

    def step(written: int | None, at: int) -> tuple[int, bool]:
        hit = written is not None and at < written + ttl
        return (written if hit else at), hit

    rows = requests.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), seq)
    return flagged_in_order(rows, key, "__at", seq, "hit", step).drop("__at")


def requeues(attempts: DataFrame, key: str, order: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Each attempt's running count and whether it is requeued or, beyond the cap, orphaned."""
    count = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return attempts.withColumn("requeue_count", count).withColumn("outcome", F.when(F.col("requeue_count") > settings.requeue_cap, "orphan_requeue_cap").otherwise("requeue"))


def latest_state(log: DataFrame, key: str, status: str, at: str, seq: str) -> DataFrame:
    """Each job's last status of an event log: the last writer wins."""
    return log.groupBy(key).agg(F.max_by(F.col(status), F.struct(at, seq)).alias("status"), F.max(at).alias("updated_at"), F.count("*").alias("n_events"))


def token_grants(events: DataFrame, key: str, at: str, seq: str, rate: float = DEFAULTS.rate_per_s, burst: float = DEFAULTS.burst) -> DataFrame:
    """Token bucket in batch: (key, seq, granted), which requests of a key get a token.

    Refill is clamped to the burst, which no window function expresses: the state
    of a key is its tokens and the time they were counted at. ``at`` is in seconds.
    """

    def step(state: tuple[float, float] | None, at: float) -> tuple[tuple[float, float], bool]:
        have = float(burst) if state is None else min(float(burst), state[0] + (at - state[1]) * float(rate))
        granted = have >= 1
        return (have - 1 if granted else have, at), granted

    return flagged_in_order(events.select(key, F.col(at).cast("double").alias("__at"), seq), key, "__at", seq, "granted", step).drop("__at")


def retry_plan(outcomes: Column, settings: Settings = DEFAULTS) -> Column:
    """Calls made, seconds slept and end of an extraction, from the HTTP status of each call in order (0: timeout).

    A 429 yields at once, another 4xx is permanent, the rest is retried up to
    the number of retries, with a longer wait each time.
    """
    waits = F.array(*map(F.lit, settings.backoff_s))

    def step(a: Column, x: Column) -> Column:
        over = a["result"].isNotNull() | (a["calls"] > settings.retries)
        result = F.when(x == 429, "yield").when((x >= 400) & (x < 500), "permanent").when((x >= 200) & (x < 300), "ok").when(a["calls"] >= settings.retries, "gemini_exhausted")
        slept = F.when(result.isNull(), F.element_at(waits, (a["calls"] + 1).cast("int"))).otherwise(0.0)
        return F.when(over, a).otherwise(F.struct((a["calls"] + 1).alias("calls"), (a["slept"] + slept).alias("slept"), result.alias("result")))

    return F.aggregate(outcomes, F.struct(F.lit(0).alias("calls"), F.lit(0.0).alias("slept"), F.lit(None).cast("string").alias("result")), step)


#: Outcomes of the stages of a job in their order, null being fine; each with what follows from it.
#: Any other outcome of a stage that can fail for good is the code of that failure.
STAGES = (
    ("check", {"unavailable": "yield"}, False), ("mark", {"unavailable": "yield"}, False), ("download", {"transient": "retry"}, True), ("preprocess", {}, True),
    ("detect", {"unavailable": "retry"}, True), ("bucket", {"empty": "yield"}, False), ("extract", {"throttled": "yield", "exhausted": "retry"}, True), ("persist", {"unavailable": "yield"}, False),
)
#: Before the code of an outcome that is permanent whatever the code.
PERMANENT = "permanent:"
#: Stages that a valid cached extraction makes needless.
EXTRACTION = ("detect", "bucket", "extract")


def lifecycle(attempts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``attempts`` with ``action``, ``stage``, ``new_status`` and ``new_code``: how one try at a job ends.

    A row has the job's ``status`` (null: no such job), ``requeue_count`` so far,
    ``cached`` (whether the cache holds a valid extraction) and the outcome of
    each stage of ``STAGES``, null where it went well or was not reached. The
    first stage that did not go well decides. Jobs that are unknown or over are
    dropped. A ``yield`` puts the message back, a ``retry`` counts before that
    and, beyond the cap, orphans the job, which fails for good. A code fails the
    job, for good unless the code's class is transient; a code of no class is an
    error that nobody caught, unless it is told as ``permanent:`` and the code.
    Without any, the job succeeds.
    """
    cached = F.coalesce(F.col("cached"), F.lit(False))
    transient = [code for code, permanent in ERRORS if not permanent]
    known = [code for code, _ in ERRORS]
    action = F.when(F.col("status").isNull() & ~F.col("check").eqNullSafe(F.lit("unavailable")), "drop_unknown").when(F.col("status").isin(*TERMINAL) & ~F.col("check").eqNullSafe(F.lit("unavailable")), "drop_terminal")
    stage, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, follows, fails in STAGES:
        reached = ~cached if name in EXTRACTION else F.lit(True)
        for outcome, what in follows.items():
            action = action.when(reached & (F.col(name) == outcome), what)
        if fails:
            action = action.when(reached & F.col(name).isNotNull(), "fail")
        met = reached & F.col(name).isNotNull()
        stage, code = F.coalesce(stage, F.when(met, name)), F.coalesce(code, F.when(met, F.col(name)))
    dropped = F.col("action").startswith("drop")
    judged = attempts.withColumns({"action": action.otherwise("succeed"), "stage": stage, "__code": code})
    judged = judged.withColumn("action", F.when((F.col("action") == "retry") & (F.coalesce("requeue_count", F.lit(0)) + 1 > settings.requeue_cap), "orphan").when(F.col("action") == "retry", "requeue").otherwise(F.col("action")))
    judged = judged.withColumn("__told", F.coalesce(F.col("__code").startswith(PERMANENT), F.lit(False)))
    judged = judged.withColumn("__code", F.when(F.col("__told"), F.substring("__code", len(PERMANENT) + 1, 1 << 20)).otherwise(F.col("__code")))
    uncaught = ~F.col("__told") & ~F.col("__code").isin(*known)
    ended = F.when(F.col("action") == "succeed", SUCCEEDED).when(F.col("action") == "orphan", FAILED_PERMANENT).when((F.col("action") == "fail") & ((~F.col("__told") & F.col("__code").isin(*transient)) | uncaught), FAILED_TRANSIENT).when(F.col("action") == "fail", FAILED_PERMANENT)
    error = F.when(F.col("action") == "orphan", "orphan_requeue_cap").when((F.col("action") == "fail") & uncaught, "lifecycle_uncaught").when(F.col("action") == "fail", F.col("__code"))
    return judged.withColumns({"stage": F.when(~dropped, F.col("stage")), "new_status": ended, "new_code": error}).drop("__code", "__told")


def state_machine(log: DataFrame, key: str, status: str, at: str, seq: str) -> DataFrame:
    """key, status, n_events, n_ignored: each job's state after its log, a job that is over keeping the state it ended in.

    The first terminal event in order ends a job; what comes after it is ignored.
    Both come from aggregates, so a job may have any number of events.
    """
    turn = F.struct(F.col(at), F.col(seq))
    over = F.col(status).isin(*TERMINAL)
    ended = F.min_by(F.col(status), F.when(over, turn))
    last = log.groupBy(key).agg(F.coalesce(ended, F.max_by(F.col(status), turn)).alias("status"), F.count("*").alias("n_events"), F.min(F.when(over, turn)).alias("__end"))
    after = log.join(last.select(F.col(key).alias("__key"), F.col("__end").alias("__ended")), F.col(key) == F.col("__key")).groupBy("__key").agg(F.count_if(turn > F.col("__ended")).alias("n_ignored"))
    return last.join(after, F.col(key) == F.col("__key")).select(key, "status", "n_events", "n_ignored")


def purge_due(before: Column, now: Column, hour: int = 2) -> Column:
    """Whether the nightly hour came between two moments, the later one included."""
    today = F.date_trunc("day", now) + F.expr(f"INTERVAL {hour} HOURS")
    last = F.when(now >= today, today).otherwise(today - F.expr("INTERVAL 1 DAY"))
    return before < last


def to_download(files: DataFrame, present: DataFrame) -> DataFrame:
    """Files (file_name) that are not there yet."""
    return files.join(present.select("file_name").distinct(), "file_name", "left_anti")
