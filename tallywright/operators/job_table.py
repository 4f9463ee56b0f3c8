"""The job table as a change log over a bucketed base: writing a change costs what the change holds, not what the table holds.

Below one folder lie ``base`` (generations of the table, partitioned by the bucket of
the job's id) and ``log`` (one folder a change, partitioned in the same way). A
reader merges both: of each column the last change that names it. Compaction
writes anew the buckets that changes have met, and those only, by a dynamic overwrite
of their partitions, and drops the log that it took in. Every step is safe to
repeat: a change has a number, and a bucket tells up to which number it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.schemas import DEFAULTS, FAILED_PERMANENT, STATUSES, TERMINAL, Settings

#: What a change does to the jobs it names.
INSERT, UPDATE, DELETE = "insert", "update", "delete"
#: Columns of a job that a change can set; null keeps what is there.
OPTIONAL = ("phash", "error_code", "error_message")
_COLUMNS = ("job_id", "status", "phash", "image_url", "error_code", "error_message", "created_at", "updated_at")


def _schema(*more: T.StructField) -> T.StructType:
    kinds = {"created_at": T.TimestampType(), "updated_at": T.TimestampType()}
    return T.StructType([*(T.StructField(c, kinds.get(c, T.StringType())) for c in _COLUMNS), *more])


_LONG, _BUCKET = T.LongType(), T.StructField("bucket", T.IntegerType())
_BASE, _LOG = _schema(T.StructField("upto", _LONG), _BUCKET), _schema(T.StructField("kind", T.StringType()), T.StructField("seq", _LONG), _BUCKET)


@dataclass(frozen=True)
class JobTable:
    """The table below ``folder``, which driver and executors share; its jobs are spread over ``buckets``, a number that stays.

    One writer at a time, as for any table without a lock service: the numbers of
    changes are given out by it.
    """

    spark: SparkSession
    folder: str
    buckets: int = 64

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _changes(self) -> list[int]:
        """Numbers of the changes that were written whole and not taken in yet."""
        root = self._path("log")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = [str(s.getPath().getName()) for s in files.listStatus(root) if files.exists(self._path("log", str(s.getPath().getName()), "_SUCCESS"))]
        return sorted(int(name.split("=")[1]) for name in done if name.startswith("change="))

    def last(self) -> int:
        """Number of the last change, 0 before any."""
        base = self._base().agg(F.max("upto")).first()[0] or 0
        return max([base, *self._changes()])

    def _base(self) -> DataFrame:
        root = self._path("base")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], _BASE)
        return self.spark.read.schema(_BASE).parquet(f"{self.folder}/base")

    def _log(self, changes: list[int]) -> DataFrame:
        if not changes:
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).option("basePath", f"{self.folder}/log").parquet(*[f"{self.folder}/log/change={n}" for n in changes]).drop("change")

    def history(self) -> DataFrame:
        """Changes that were not taken in yet: ``kind``, ``seq`` and the job's columns."""
        return self._log(self._changes()).drop("bucket")

    def bucket(self, job_id: Column) -> Column:
        """Bucket of a job."""
        return F.pmod(F.xxhash64(job_id), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, number: int | None) -> int:
        """Appends a change; one that has this number already is left as it is."""
        known = self._changes()
        seq = max(known, default=self.last()) + 1 if number is None else number
        if seq in known:
            return seq
        given = rows.withColumns({"kind": F.lit(kind), "seq": F.lit(seq).cast("long"), "bucket": self.bucket(F.col("job_id"))})
        typed = given.select(*[(F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _LOG])
        # Rows of a bucket stand in one file of the change, so a change has as many files as buckets at most.
        typed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/log/change={seq}")
        return seq

    def insert(self, jobs: DataFrame, number: int | None = None) -> int:
        """Adds fresh jobs (see ``operators.jobs.new_jobs``); a job that is there stays as it is. Gives the change's number."""
        return self._write(jobs, INSERT, number)

    def update(self, changes: DataFrame, now: Column, number: int | None = None) -> int:
        """Changes jobs: (job_id, status and any of ``OPTIONAL``); null keeps what is there, a job that is not there stays away.

        A job that several rows name has the greatest value of each column; give
        changes that follow one another as changes of their own.
        """
        one = changes.groupBy("job_id").agg(*[F.max(c).alias(c) for c in changes.columns if c != "job_id"])
        return self._write(one.withColumn("updated_at", now), UPDATE, number)

    def delete(self, ids: DataFrame, number: int | None = None) -> int:
        """Removes jobs by ``job_id``."""
        return self._write(ids.select("job_id").distinct(), DELETE, number)

    def purge(self, now: Column, settings: Settings = DEFAULTS, number: int | None = None) -> int:
        """Removes jobs that ended longer ago than they are retained: the change holds their ids only."""
        old = F.col("status").isin(*TERMINAL) & (F.col("updated_at") < now - F.expr(f"INTERVAL {settings.retention_days} DAYS"))
        return self.delete(self.read().filter(old), number)

    def read(self, ids: DataFrame | None = None) -> DataFrame:
        """The table as it is now, or those of its jobs that are in ``ids`` (``job_id``).

        Buckets that no change has met are read as they lie; the others are merged.
        Jobs that are not asked for are left out before the merge, so it costs what
        is asked, not what the table holds.
        """
        return self._merged(self._changes(), only_met=False, ids=ids).select(*_COLUMNS)

    def _merged(self, changes: list[int], only_met: bool, ids: DataFrame | None = None) -> DataFrame:
        base, log = self._base(), self._log(changes)
        if ids is not None:
            asked = ids.select("job_id")
            base, log = (rows.join(asked, "job_id", "left_semi").select(*rows.columns) for rows in (base, log))
        if not changes:
            return base
        met = sorted(r["bucket"] for r in self._log(changes).select("bucket").distinct().collect())
        untouched, touched = base.filter(~F.col("bucket").isin(*met)), base.filter(F.col("bucket").isin(*met))
        merged = merge(touched, log).select(*base.columns)
        return merged if only_met else untouched.unionByName(merged)

    def compact(self) -> list[int]:
        """Takes the changes into the base, and gives the buckets that were written anew: those that changes have met."""
        changes = self._changes()
        if not changes:
            return []
        # The rows lie in the shared folder before any partition is replaced: the plan must not read what it overwrites.
        ready = f"{self.folder}/ready/{changes[-1]}"
        self._merged(changes, only_met=True).withColumn("upto", F.lit(changes[-1]).cast("long")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(ready)
        fresh = self.spark.read.schema(_BASE).parquet(ready)
        met = sorted(r["bucket"] for r in self._log(changes).select("bucket").distinct().collect())
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/base")
        files = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        # Dynamic overwrite leaves a partition alone that has no rows any more.
        full = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        for bucket in set(met) - full:
            files.delete(self._path("base", f"bucket={bucket}"), True)
        for n in changes:
            files.delete(self._path("log", f"change={n}"), True)
        files.delete(self._path("ready"), True)
        return met

    def violations(self) -> DataFrame:
        """Rows that break a constraint of the table, with its name."""
        broken = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status_known").when((F.col("status") == FAILED_PERMANENT) & F.col("error_code").isNull(), "failure_has_code")
        return self.read().withColumn("violation", broken).filter(F.col("violation").isNotNull())


def merge(base: DataFrame, log: DataFrame) -> DataFrame:
    """``base`` (with ``upto``) after ``log``, in the order of ``seq``.

    A row of the base counts as the insertion it came from; changes that its bucket
    has taken in are passed over, so a log that was taken in but not dropped yet does
    no harm. A job lives from an insertion that finds none; a deletion ends it, and
    only changes after it count. All of it is one aggregation by job: the last
    deletion, then the first insertion after it, then each column's last value.
    """
    rows = base.withColumns({"kind": F.lit(INSERT), "seq": F.col("upto")}).unionByName(log.withColumn("upto", F.lit(None).cast("long")))
    held = rows.groupBy("bucket", "job_id").agg(F.max("upto").alias("upto"), F.collect_list(F.struct("seq", F.col("upto").isNull().alias("late"), "kind", "status", *OPTIONAL, "image_url", "created_at", "updated_at")).alias("events"))
    return held.select("bucket", "job_id", "upto", _folded(F.array_sort(_pending(F.col("events"), F.col("upto")))).alias("j")).filter("j.alive").select("job_id", "j.status", "j.phash", "j.image_url", "j.error_code", "j.error_message", "j.created_at", "j.updated_at", "upto", "bucket")


def _pending(events: Column, upto: Column) -> Column:
    return F.filter(events, lambda e: ~e["late"] | upto.isNull() | (e["seq"] > upto))


def _folded(events: Column) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(F.lit(False).alias("alive"), *[none("string").alias(c) for c in ("status", *OPTIONAL, "image_url")], none("timestamp").alias("created_at"), none("timestamp").alias("updated_at"))

    def step(j: Column, e: Column) -> Column:
        fresh = F.struct(F.lit(True).alias("alive"), *[e[c].alias(c) for c in ("status", *OPTIONAL, "image_url", "created_at", "updated_at")])
        changed = F.struct(F.lit(True).alias("alive"), *[F.coalesce(e[c], j[c]).alias(c) for c in ("status", *OPTIONAL)], j["image_url"].alias("image_url"), j["created_at"].alias("created_at"), F.coalesce(e["updated_at"], j["updated_at"]).alias("updated_at"))
        return F.when(e["kind"] == DELETE, start).when((e["kind"] == INSERT) & ~j["alive"], fresh).when((e["kind"] == UPDATE) & j["alive"], changed).otherwise(j)

    return F.aggregate(events, start, step)
