"""The queue's consumer as one stream: messages meet the job table, tries end, the table changes, and what has to come again goes back.

A batch's verdicts are written before anything follows from them, in a folder of the
batch's number. A batch that is run again, because the driver was lost before
Spark noted it as done, finds them there, and so does again what it did: its
change of the job table has a number that the table knows, and the messages that
it puts back replace those it had put back. So no job ends twice and no message is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators.job_table import JobTable
from tallywright.operators.jobs import STAGES, lifecycle, valid_messages
from tallywright.schemas import DEFAULTS, Settings

_VERDICT = T.StructType([T.StructField(c, T.StringType()) for c in ("job_id", "image_url", "action", "stage", "new_status", "new_code")])
#: Actions after which a message comes again.
AGAIN = ("yield", "requeue")


@dataclass(frozen=True)
class Consumer:
    """``work`` adds to messages (job_id, image_url, status, requeue_count) what came of each stage of ``operators.jobs.STAGES``, and ``cached``.

    Columns that it leaves out are null. ``folder`` holds the verdicts, ``queue`` is
    the folder that messages come from. While it runs, the consumer gives out the
    numbers of the table's changes.
    """

    table: JobTable
    work: Callable[[DataFrame], DataFrame]
    folder: str
    queue: str
    settings: Settings = DEFAULTS

    def _there(self, path: str) -> bool:
        spark = self.table.spark
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    def verdicts(self) -> DataFrame:
        """Every try so far, with ``batch``."""
        spark = self.table.spark
        if not self._there(f"{self.folder}/verdicts"):
            return spark.createDataFrame([], _VERDICT).withColumn("batch", F.lit(0).cast("long"))
        return spark.read.schema(T.StructType([*_VERDICT.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.folder}/verdicts")

    def _start(self) -> int:
        """The number that the table had when the consumer first ran, noted once."""
        path = f"{self.folder}/start"
        if not self._there(f"{path}/_SUCCESS"):
            self.table.spark.range(1).select(F.lit(self.table.last()).alias("n")).write.mode("overwrite").json(path)
        return self.table.spark.read.schema("n long").json(path).first()["n"]

    def judged(self, messages: DataFrame, batch: int) -> DataFrame:
        """The verdict on each message of a batch; of a job that has several there is one."""
        one = valid_messages(messages).groupBy("job_id").agg(F.min("image_url").alias("image_url"))
        tries = self.verdicts().filter((F.col("batch") < batch) & (F.col("action") == "requeue")).groupBy("job_id").agg(F.count("*").alias("requeue_count"))
        met = one.join(self.table.read(one).select("job_id", "status"), "job_id", "left").join(tries, "job_id", "left").withColumn("requeue_count", F.coalesce("requeue_count", F.lit(0)))
        worked = self.work(met)
        given = worked.withColumns({c: F.lit(None).cast("boolean" if c == "cached" else "string") for c in ("cached", *(s for s, _, _ in STAGES)) if c not in worked.columns})
        return lifecycle(given, self.settings).select(*_VERDICT.names)

    def take(self, messages: DataFrame, batch: int, now: Column) -> None:
        """One batch, from verdict to queue. Every step that was done already is left, or done again to the same end."""
        path = f"{self.folder}/verdicts/batch={batch}"
        if not self._there(f"{path}/_SUCCESS"):
            self.judged(messages, batch).write.mode("overwrite").parquet(path)
        said = self.table.spark.read.schema(_VERDICT).parquet(path)
        ended = said.filter(F.col("new_status").isNotNull()).select("job_id", F.col("new_status").alias("status"), F.col("new_code").alias("error_code"))
        self.table.update(ended, now, number=self._start() + batch + 1)
        if not self._there(f"{self.queue}/again-{batch}/_SUCCESS"):
            again = said.filter(F.col("action").isin(*AGAIN)).select(F.to_json(F.struct("job_id", "image_url")).alias("value"))
            again.write.mode("overwrite").text(f"{self.queue}/again-{batch}")

    def consuming(self, messages: DataFrame, now: Callable[[], Column] = F.current_timestamp):
        """A stream writer over ``messages`` (job_id, image_url); give it a checkpoint and a trigger."""
        return messages.writeStream.foreachBatch(lambda batch, number: self.take(batch, number, now()))
