"""Streams with timers of their own: jobs that time out by themselves, and rates of counters.

A job's row waits in its state until the watermark has passed it. Then all that wait
are taken in order; a counter's sample counts at once and is put right later. So the
result is that of the batch form, whatever the order in which rows came, as long as
none comes later than allowed. A row that does is not dropped: it comes out at once,
marked as ``late``, and changes nothing else.

State lies in RocksDB, so a task holds the keys of a batch in memory, not all keys. A
job's events move and wait in packs, many to a row, as state is read and written row
by row; so a task holds the waiting events of one job, at 21 bytes each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tallywright.operators.metrics import quantile_of
from tallywright.schemas import DEFAULTS, FAILED_TRANSIENT, PENDING, PROCESSING, TERMINAL, Settings

#: How late rows may come and still be counted in order, by default.
LATENESS = "1 hour"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within have the state store that timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _ms(seconds: float) -> int:
    return int(seconds * 1000)


#: An event as it is packed: ``known`` tells that it has a ``seq``, ``status`` is a place in the pack's names.
_EVENT = np.dtype([("at", "<f8"), ("seq", "<i8"), ("known", "?"), ("status", "<i4")])
#: Events of a pack at most.
PACK = 1 << 16
_PACKED = "job_id string, events binary, names string"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a task as packs: a row for each job among some of them, with its events in one piece and the names of their states as JSON.

    So the operator with state, which Spark feeds row by row, has a row for many events.
    """

    def folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        jobs, states = (rows[c].combine_chunks().dictionary_encode("encode") for c in ("job_id", "status"))
        events = np.empty(len(rows), _EVENT)
        events["at"], events["seq"], events["known"] = rows["at"].to_numpy(), pc.fill_null(rows["seq"], 0).to_numpy(), pc.is_valid(rows["seq"]).to_numpy()
        events["status"] = states.indices.to_numpy()
        if not np.isfinite(events["at"]).all():
            raise ValueError("an event has no time")
        codes = jobs.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = (np.append(starts, len(codes)) * _EVENT.itemsize).astype("<i4")
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(events[order].tobytes())])
        names = pa.array([json.dumps(states.dictionary.to_pylist())] * len(starts), pa.string())
        return pa.RecordBatch.from_arrays([jobs.dictionary.take(pa.array(codes[starts])), pieces, names], names=["job_id", "events", "names"])

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            part = batch.slice(at, PACK)
            if n + part.num_rows > PACK:
                yield folded(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield folded(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs that came out, as rows: ``status``, where a pack has one, is that of all its events."""
    for batch in batches:
        sizes = pc.binary_length(batch["events"]).to_numpy() // _EVENT.itemsize
        for group in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PACK)) + 1):
            packs = batch.take(pa.array(group))
            events = np.frombuffer(b"".join(packs["events"].to_pylist()), _EVENT)
            of = np.repeat(np.arange(len(group)), sizes[group])
            names = [json.loads(n) for n in packs["names"].to_pylist()]
            first = np.cumsum([0, *map(len, names)])[of]
            own = pa.array([s for ns in names for s in ns], pa.string()).take(pa.array(first + events["status"]))
            spread = lambda c: packs[c].take(pa.array(of))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [spread("job_id"), pa.array(np.ascontiguousarray(events["at"])), pa.array(np.ascontiguousarray(events["seq"]), mask=~events["known"]), pc.coalesce(spread("status"), own), spread("error_code"), spread("ignored"), spread("late")],
                names=["job_id", "at", "event_id", "status", "error_code", "ignored", "late"],
            )


def _in_order(packs: list[tuple[bytes, str]]) -> tuple[np.ndarray, list]:
    """Events of packs in order of ``at``, ``seq`` and ``status``, and the names of their states, in order as well."""
    parts = [(np.frombuffer(events, _EVENT).copy(), json.loads(names)) for events, names in packs]
    names = sorted({s for _, own in parts for s in own}, key=lambda s: (s is not None, s or ""))
    for events, own in parts:
        events["status"] = np.array([names.index(s) for s in own], "<i4")[events["status"]]
    events = np.concatenate([np.empty(0, _EVENT), *(e for e, _ in parts)])
    return events[np.lexsort((events["status"], events["seq"], events["known"], events["at"]))], names


def _all_ms(at: np.ndarray) -> np.ndarray:
    return (at * 1000).astype("<i8")


class _Timeouts(StatefulProcessor):
    """Holds a job's events, in packs, until the watermark has passed them, then takes them in order.

    A job has one timer at a time, the earliest that is due; ``alarm`` has its moment.
    """

    def __init__(self, settings: Settings) -> None:
        self.limits = {PROCESSING: settings.processing_stale_min * 60, PENDING: settings.pending_stale_min * 60}
        self.retained = settings.retention_days * 86_400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packs = handle.getListState("waiting", "events binary, names string")
        self.own = handle.getValueState("own", "status string, created double, updated double, alarm long")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        fresh, first = [], None
        for pack in rows:
            events = np.frombuffer(pack.events, _EVENT)
            moments = _all_ms(events["at"])
            late = moments < passed
            if late.any():
                yield from _told(key, events[late], pack.names, ignored=True, late=True)
            if not late.all():
                fresh.append((events[~late].tobytes(), pack.names))
                earliest = int(moments[~late].min())
                first = earliest if first is None else min(first, earliest)
        if fresh:
            self.packs.appendList(fresh)
            *job, alarm = self.own.get() if self.own.exists() else (None, None, None, None)
            due = max(first, passed + 1)
            if alarm is None or due < alarm:
                if alarm is not None:
                    self.handle.deleteTimer(alarm)
                self.handle.registerTimer(due)
                self.own.update((*job, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        events, names = _in_order(list(self.packs.get()) if self.packs.exists() else [])
        n = int(np.searchsorted(_all_ms(events["at"]), passed))
        own = self.own.get() if self.own.exists() else None
        job, made, until = self.step(key, None if own is None or own[0] is None else own[:3], events[:n], names, passed)
        rest = events[n:]
        if not len(rest):
            self.packs.clear()
        elif n:
            self.packs.put([(rest[i : i + PACK].tobytes(), json.dumps(names)) for i in range(0, len(rest), PACK)])
        coming = [_ms(float(rest["at"][0]))] if len(rest) else []
        if until is not None:
            coming.append(until)
        alarm = max(min(coming), passed + 1) if coming else None
        if alarm is not None:
            self.handle.registerTimer(alarm)
        if job is None and alarm is None:
            self.own.clear()
        else:
            self.own.update((*(job or (None, None, None)), alarm))
        yield from made

    def step(self, key, job: tuple | None, due: np.ndarray, names: list, passed: int):
        """The job after the events ``due``, the packs that come out, and when it is to be looked at again."""
        made = []

        def timed_out(created: float, deadline: float) -> tuple:
            made.extend(_told(key, np.array([(deadline, 0, False, 0)], _EVENT), json.dumps([FAILED_TRANSIENT]), code="stale_timeout"))
            return (FAILED_TRANSIENT, created, deadline)

        moments = np.append(_all_ms(due["at"]), passed)
        if job is not None and (deadline := self._deadline(job)) is not None and _ms(deadline) < moments[0]:
            job = timed_out(job[1], deadline)
        if len(due) and (job is None or job[0] not in TERMINAL):
            at, created = due["at"], float(due["at"][0]) if job is None else job[1]
            of = lambda kinds: np.isin(due["status"], [i for i, s in enumerate(names) if s in kinds])
            deadlines = np.full(len(due), np.inf)
            for status, limit in self.limits.items():
                deadlines = np.where(of((status,)), np.maximum(at, (at if status == PROCESSING else created) + limit), deadlines)
            stale = np.isfinite(deadlines)
            stale[stale] = _all_ms(deadlines[stale]) < moments[1:][stale]
            ends = stale | of(TERMINAL)
            last = int(ends.argmax()) if ends.any() else len(due) - 1
            made.extend(_told(key, due[: last + 1], json.dumps(names)))
            job = timed_out(created, float(deadlines[last])) if stale[last] else (names[due["status"][last]], created, float(at[last]))
            due = due[last + 1 :]
        if len(due):
            made.extend(_told(key, due, json.dumps(names), status=job[0], ignored=True))
        if job is None:
            return None, made, None
        if job[0] in TERMINAL:
            gone = _ms(job[2] + self.retained)
            return (None, made, None) if gone < passed else (job, made, gone)
        return job, made, None if (deadline := self._deadline(job)) is None else _ms(deadline) + 1

    def _deadline(self, job: tuple) -> float | None:
        """When the job, as it stands, has stayed too long: never before it came to stand so."""
        status, created, updated = job
        return None if status not in self.limits else max(updated, (updated if status == PROCESSING else created) + self.limits[status])

    def close(self) -> None:
        pass


def _told(key, events: np.ndarray, names: str, status: str | None = None, code: str | None = None, ignored: bool = False, late: bool = False) -> Iterator[Row]:
    for i in range(0, len(events), PACK):
        yield Row(job_id=key[0], events=events[i : i + PACK].tobytes(), names=names, status=status, error_code=code, ignored=ignored, late=late)


def timed_out_jobs(log: DataFrame, settings: Settings = DEFAULTS, lateness: str = LATENESS) -> DataFrame:
    """(job_id, at, seq, status) to job_id, at, event_id, status, error_code, ignored, late: the sweeper without a sweep.

    A job that is processed and not touched for too long, or pending since too long
    after its first event, fails by its own timer, at the moment it has
    (``event_id`` null, ``stale_timeout``). A job that is over stays as it ended, and
    later events are ignored, for as long as ended jobs are retained.
    """
    rest = "status string, error_code string, ignored boolean, late boolean"
    kinds = {"job_id": "string", "at": "double", "seq": "long", "status": "string"}
    packs = _watched(log, lateness).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).mapInArrow(_packed, _PACKED)
    done = packs.groupBy("job_id").transformWithState(_Timeouts(settings), f"{_PACKED}, {rest}", "Append", "EventTime")
    return done.mapInArrow(_unpacked, f"job_id string, at double, event_id long, {rest}")


def _watched(rows: DataFrame, lateness: str) -> DataFrame:
    """``rows`` with a watermark over ``at``, whose column is taken off again: late rows are told by the operator, not dropped before it."""
    return rows.withColumn("__ts", F.timestamp_seconds("at")).withWatermark("__ts", lateness).drop("__ts")


def timed_out_by_scan(log: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Batch form: job_id, status, error_code, ended_at, n_ignored of each job of a whole log (job_id, at, seq, status)."""
    order = Window.partitionBy("job_id").orderBy("at", "seq")
    at, status = F.col("at"), F.col("status")
    limit = F.when(status == PROCESSING, at + settings.processing_stale_min * 60).when(status == PENDING, F.min("at").over(Window.partitionBy("job_id")) + settings.pending_stale_min * 60)
    rows = log.withColumns({"i": F.row_number().over(order), "next": F.lead("at").over(order), "deadline": F.greatest(at, limit)})
    stale = status.isin(PROCESSING, PENDING) & (F.col("next").isNull() | (F.col("deadline") < F.col("next")))
    rows = rows.withColumn("stale", stale).withColumn("ends", F.col("stale") | status.isin(*TERMINAL))
    last = F.min_by(F.struct("status", "stale", "deadline", "at", "i"), F.when(F.col("ends"), F.col("i")))
    found = rows.groupBy("job_id").agg(last.alias("e"), F.count("*").alias("n"))
    return found.select("job_id", F.when(F.col("e.stale"), FAILED_TRANSIENT).otherwise(F.col("e.status")).alias("status"), F.when(F.col("e.stale"), "stale_timeout").alias("error_code"), F.when(F.col("e.stale"), F.col("e.deadline")).otherwise(F.col("e.at")).alias("ended_at"), (F.col("n") - F.col("e.i")).alias("n_ignored"))


class _Increases(StatefulProcessor):
    """Increases of a counter as soon as its samples come, put right where an earlier sample comes later.

    The state has the samples that the watermark has not passed and the last one
    before them, by which the next is measured.
    """

    def __init__(self, series: list[str]) -> None:
        self.series = series

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "at double, seq long, value double")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for row in rows:
            if _ms(row.at) > passed:
                fresh.append((row.at, row.seq, row.value))
            else:
                # Windows take rows that are later than the watermark only: a late row's own time stands beside.
                yield self._row(key, (passed + 1) / 1000, row.at, None, True)
        if not fresh:
            return
        held = sorted(self.samples.get())
        merged = sorted([*held, *fresh])
        before = dict(zip(held[1:], held))
        for last, sample in zip(merged, merged[1:]):
            was, now = before.get(sample), _rise(last, sample)
            if was is None or was != last:
                yield self._row(key, sample[0], sample[0], now - (0.0 if was is None else _rise(was, sample)), False)
        old = sum(_ms(s[0]) <= passed for s in merged)
        self.samples.put(merged[max(0, old - 1) :])

    def _row(self, key, ts, at, increase, late):
        return Row(**dict(zip(self.series, key)), ts=_moment(ts), at=at, increase=increase, late=late)

    def close(self) -> None:
        pass


def _rise(before: tuple, sample: tuple) -> float:
    return sample[2] if sample[2] < before[2] else sample[2] - before[2]


def _moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def increases(samples: DataFrame, series: list[str], lateness: str = LATENESS) -> DataFrame:
    """(series, at, seq, value) to series, ts, at, increase, late: by how much a counter rose since its sample before, over batches too.

    A fall is a restart from zero; a series' first sample gives no row. Where a
    sample comes after a later one, the later one has a second row that takes off
    what was too much, so sums by time are right. Samples of one key are told apart
    by ``at``, ``seq`` and ``value``. A row that is too late has no increase.
    """
    kinds = [samples.schema[c] for c in series]
    more = (("ts", T.TimestampType()), ("at", T.DoubleType()), ("increase", T.DoubleType()), ("late", T.BooleanType()))
    out = T.StructType([*kinds, *(T.StructField(n, t) for n, t in more)])
    return _watched(samples, lateness).groupBy(*series).transformWithState(_Increases(series), out, "Append", "EventTime", eventTimeColumnName="ts")


def stream_rates(samples: DataFrame, series: list[str], by: list[str], window: str = "5 minutes", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """window_start, ``by``, increase, rate as ``operators.metrics.rates`` gives them, each window once it can change no more."""
    rows = increases(samples, series, lateness).filter(~F.col("late"))
    summed = rows.groupBy(F.window("ts", window, slide or window).alias("w"), *by).agg(F.sum("increase").alias("increase"))
    span = F.col("w.end").cast("double") - F.col("w.start").cast("double")
    return summed.select(F.col("w.start").alias("window_start"), *by, "increase", (F.col("increase") / span).alias("rate"))


def stream_quantiles(buckets: DataFrame, q: float, bounds: tuple[float, ...], by: list[str], window: str = "5 minutes", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """window_start, ``by``, quantile of histogram counters (``by``, le, at, seq, value), each bucket being a counter up to its bound ``le``.

    ``bounds`` names the bounds, infinity after them; they are summed side by side, so one aggregation does.
    """
    rows = increases(buckets, [*by, "le"], lateness).filter(~F.col("late"))
    les = (*bounds, float("inf"))
    sums = [F.coalesce(F.sum(F.when(F.col("le") == b, F.col("increase"))), F.lit(0.0)).alias(f"b{i}") for i, b in enumerate(les)]
    summed = rows.groupBy(F.window("ts", window, slide or window).alias("w"), *by).agg(*sums)
    held = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(les)])
    return summed.select(F.col("w.start").alias("window_start"), *by, quantile_of(held, q).alias("quantile"))


def on_time(stream: DataFrame) -> DataFrame:
    """What came in time."""
    return stream.filter(~F.col("late"))


def late_rows(stream: DataFrame) -> DataFrame:
    """What came too late, for an output of its own."""
    return stream.filter(F.col("late"))


def seconds(at: Column) -> Column:
    """Seconds since 1970, as streams here take them."""
    return (F.unix_micros(at.cast("timestamp")) / 1e6).alias("at")


def replayed(rows: DataFrame, folder: str, end: DataFrame, parts: int = 4, files_at_once: int = 4) -> DataFrame:
    """``rows`` (with ``at``) as a stream of files, written to ``folder`` in ``parts`` stretches of time one after another, and ``end`` after all of them.

    Within a stretch rows are in no order. ``end`` has a row that is later than all
    by more than any lateness: with it the watermark passes the others.
    """
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    edges = [first + (last - first) * k / parts for k in range(parts)] if first is not None else []
    for k, edge in enumerate(edges):
        inside = (F.col("at") >= edge) & (F.col("at") < edges[k + 1] if k + 1 < parts else F.lit(True))
        rows.filter(inside).write.mode("append").parquet(folder)
    end.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]).coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
