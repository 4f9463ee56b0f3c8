"""Sources and sinks: JSON arrays, dictionaries, reports, splits, queues, images by name."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.text import basename
from tallywright.operators.match import SENT_ENTRIES
from tallywright.schemas import GOLD, INVOICE
from tallywright.sources import json_arrays


def json_array(spark: SparkSession, path: str, schema: T.StructType = GOLD, position: str = "golden_index", by_ranges: bool = False) -> DataFrame:
    """Records of a JSON array file with their place in it; a record that doesn't parse has null fields.

    A JSON array is one document, so one task reads each file; its elements are
    spread out after that. A file that is long for one task (2 GB are the most
    it takes) is read ``by_ranges``: see ``json_arrays.elements``.
    """
    if by_ranges:
        items = json_arrays.elements(spark, path).select(F.col("place").cast("int").alias(position), "raw")
    else:
        raw = spark.read.text(path, wholetext=True)
        items = raw.select(F.posexplode(F.from_json("value", "array<string>")).alias(position, "raw"))
    return items.select(position, F.from_json("raw", schema, {"mode": "PERMISSIVE"}).alias("r")).select(position, "r.*")


def json_array_raw(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a JSON array file as text, with their place."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("golden_index", "raw"))


def dictionary(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """pos, canonical of a JSON array of strings. No file gives an empty dictionary; anything but an array fails."""
    empty = spark.createDataFrame([], "pos int, canonical string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as error:  # noqa: BLE001
        if missing_ok and "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    checked = raw.select(F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.lit("a dictionary must be a JSON array"))).alias("value"))
    return checked.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "canonical"))


def records_of_reports(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records of JSON lines, unknown keys dropped; check them with ``closed_schema_valid`` first."""
    return spark.read.schema(INVOICE).json(path)


def newest_file(spark: SparkSession, folder: str, pattern: str) -> Column | str | None:
    """Path of the file matching ``pattern`` that was changed last, or None."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    row = found.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"]


def images(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, length, content of image files; only the name and length are read unless the content is asked for."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content")


def download_names(urls: DataFrame, column: str = "file") -> DataFrame:
    """``urls`` with the local file name each is stored under."""
    return urls.withColumn("file_name", basename(F.col(column), image_suffix=True))


def prompt(spark: SparkSession, path: str) -> str:
    """A text file's content; fails with ``prompt_missing`` if it isn't there."""
    try:
        return spark.read.text(path, wholetext=True).first()["value"]
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError("prompt_missing") from error
        raise


def write_split(split: DataFrame, folder: str) -> None:
    """JSON lines of the split's parts, a folder for each."""
    split.write.mode("overwrite").partitionBy("split").json(f"{folder}/split")


def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_dictionary(names: DataFrame, path: str, most: int = SENT_ENTRIES) -> None:
    """One JSON array of the names in order, as text, which readers want in one piece.

    It is one value of one task; a dictionary of more than ``most`` names is
    refused: write its rows as a table instead.
    """
    if len(names.select(F.lit(1)).take(most + 1)) > most:
        raise ValueError(f"a dictionary of more than {most} names has to be a table")
    names.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical"))), lambda x: x["canonical"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report(summary: DataFrame, accuracy: DataFrame, macro: DataFrame, psv: str, split: str, at: str) -> dict:
    """The evaluation report out of small roll-ups (one row per field and type)."""
    rows = accuracy.collect()
    tell = lambda r: {"correct": r["correct"], "total": r["total"], "pct": r["pct"]}
    kinds = sorted({r["type"] for r in rows if r["scope"] == "by_type"})
    return {
        "prompt_version": psv, "split": split, "timestamp": at, **summary.first().asDict(), **macro.first().asDict(),
        "field_accuracy": {r["field"]: tell(r) for r in sorted(rows, key=lambda r: r["field"]) if r["scope"] == "overall"},
        "by_type": {k: {r["field"]: tell(r) for r in sorted(rows, key=lambda r: r["field"]) if r["type"] == k and r["scope"] == "by_type"} for k in kinds},
    }


def write_report(spark: SparkSession, content: dict, folder: str) -> str:
    """Writes the report below its name and gives the path; one line per line of the indented JSON."""
    path = f"{folder}/eval_report_{content['prompt_version']}_{content['split']}_{content['timestamp']}.json"
    lines = json.dumps(content, ensure_ascii=False, indent=2).split("\n")
    spark.createDataFrame(list(enumerate(lines)), "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)
    return path


def markdown_row(row: Column | list[Column]) -> Column:
    """Columns as one row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in row]), F.lit(" |"))


def append_markdown(rows: DataFrame, folder: str, header: list[str]) -> None:
    """Appends rows to a folder of text that makes up one Markdown table; the header is written when it is empty."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        lines = ["| " + " | ".join(header) + " |", "|" + "-|" * len(header)]
        spark.createDataFrame([(x,) for x in ("\n".join(lines),)], "value string").coalesce(1).write.mode("append").text(folder)
    rows.select(markdown_row([F.col(c) for c in header]).alias("value")).coalesce(1).write.mode("append").text(folder)
