"""JSON arrays read by byte ranges, however long: an array is one document, but no task has to read all of it.

Spark's text source, told that records end at commas, cuts a file into ranges
and a range into pieces. Where a range begins in the document (within a string or
not, how deep, at which element) only what lies before it tells, so it is read
twice. The first pass sums a range up for both cases, a start within a string and
one outside; running sums over the ranges, a row each, then tell how each begins.
The second pass gives the elements that lie within a range as they are, and what
ranges share of an element is put together by its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.sources.shared import kept

#: Ranges whose starts are sent to all tasks (under 50 MB); those of more meet them in a shuffle.
SENT_RANGES = 262_144
NO_ARRAY = "not one whole JSON array"
_SUMMARY = "range long, parity int, depth_0 long, depth_1 long, level_0 long, level_1 long, commas_0 long, commas_1 long"
#: A level that no comma has.
_NONE = 1 << 62


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """range, file, start of the range, value: the text between commas, in the order of the file within a range.

    Pieces are many and short, so what goes with each of them to Python is one number of its range.
    """
    text = spark.read.option("lineSep", ",").text(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return text.select(F.xxhash64(file, start).alias("range"), file.alias("file"), start.alias("start"), "value")


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the strings in one array, and where each ends."""
    wide = isinstance(values, pa.LargeStringArray)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets[1:] - offsets[0]


def _at_ends(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quotes seen up to each piece's end, modulo 2, and the depth gained there if the first piece begins (outside, within) a string.

    No escape crosses a comma, so what a backslash escapes lies in its piece.
    """
    data, ends = _flat(values)
    slash = data == 0x5C
    quote = data == 0x22
    if slash.any():
        # A quote is text if the backslashes right before it are odd in number.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], slash.view(np.int8), [0]))))
        first, after = edges[0::2], edges[1::2]
        escaped = after[(after - first) % 2 == 1]
        quote[escaped[escaped < len(data)]] = False
    seen = np.concatenate(([0], np.cumsum(quote, dtype=np.int32))) & 1
    # Brackets differ from braces in one bit: 5B 5D, 7B 7D.
    folded = data | 0x20
    step = (folded == 0x7B).astype(np.int8) - (folded == 0x7D).astype(np.int8)
    within = seen[1:].astype(bool)
    gained = [np.concatenate(([0], np.cumsum(np.where(within == side, step, 0), dtype=np.int32)))[ends] for side in (False, True)]
    return seen[ends], np.stack(gained)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range of a task: quotes modulo 2 and, for both starts, the depth gained, the lowest level of commas and their number there.

    Commas that separate elements have the lowest level that commas can have, so
    the lowest is all that has to be known of them.
    """
    rows: list[list] = []
    for one in batches:
        for number, at, stop in _ranges(one):
            if not rows or rows[-1][0] != number:
                rows.append([number, 0, 0, 0, _NONE, _NONE, 0, 0])
            row = rows[-1]
            odd, gained = _at_ends(one.column(1).slice(at, stop - at))
            before = row[1]
            for side in (0, 1):
                # Within the batch, a start on this side is one on the other side if quotes before it are odd in number.
                depths = row[2 + side] + gained[side ^ before]
                level = depths[(odd ^ before ^ side) == 0]
                if len(level):
                    low = int(level.min())
                    commas = int((level == low).sum())
                    if low < row[4 + side]:
                        row[4 + side], row[6 + side] = low, commas
                    elif low == row[4 + side]:
                        row[6 + side] += commas
                row[2 + side] = int(depths[-1])
            row[1] = before ^ int(odd[-1])
    if rows:
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _SUMMARY.split(", ")])


def _ranges(one: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """Number, first and end row of each range within a batch."""
    numbers = one.column(0).to_numpy()
    edges = np.flatnonzero(np.diff(numbers)) + 1
    if len(numbers):
        for at, stop in zip([0, *edges], [*edges, len(numbers)]):
            yield int(numbers[at]), int(at), int(stop)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """range, file, start, inside, depth, element: how each range begins; last: whether it is its file's last one; whole: whether the file is one array.

    Windows over the ranges of a file, a row for each (of 128 MB, by Spark's
    default), so what they hold is a millionth of the file.
    """
    pieces = _pieces(spark, path)
    named = pieces.select("range", "file", "start").distinct()
    # Two ranges of one number would be taken for one: there is none of those, or the read fails.
    sure = F.when(F.count("*").over(Window.partitionBy("range")) == 1, F.col("range")).otherwise(F.raise_error(F.lit("two ranges have one number")).cast("long"))
    ranges = kept(pieces.select("range", "value").mapInArrow(_summed, _SUMMARY).join(named.withColumn("range", sure), "range"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("file")
    sum_of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    side = lambda name: F.when(F.col("inside") == 1, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    chosen = ranges.withColumn("inside", (sum_of("parity") % 2).cast("int")).select("range", "file", "start", "parity", "inside", side("depth").alias("gain"), side("level").alias("level"), side("commas").alias("n"))
    # The end of a file counts as a comma, at level 0 if the array is closed there; no other comma is as low.
    deep = chosen.withColumn("depth", sum_of("gain")).withColumn("level", F.col("depth") + F.col("level")).withColumn("last", F.col("start") == F.max("start").over(everything))
    fits = F.when(F.col("last"), (F.col("level") == 0) & (F.col("n") == 1)).otherwise(F.col("level") >= 1)
    closed = (F.sum("gain").over(everything) == 0) & (F.sum("parity").over(everything) % 2 == 0) & F.min(fits).over(everything)
    counted = deep.withColumn("whole", closed).withColumn("n", F.when(F.col("level") == 1, F.col("n")).otherwise(F.lit(0)))
    return counted.select("range", "file", "start", "inside", "depth", sum_of("n").alias("element"), "last", "whole")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """range, place, shared, ends, raw: each element's text, or a range's part of one that it may share with others.

    ``ends`` marks the part that a file ends with. Batches have range,
    value, inside, depth, element, last.
    """
    names = ["range", "place", "shared", "ends", "raw"]
    now: int | None = None
    inside = depth = place = 0
    first, last = True, False
    open_parts: list[str] = []

    def rows(number: int, at: int, shared: list[bool], raw: pa.Array, ends: bool = False) -> pa.RecordBatch:
        n = len(raw)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int64()), pa.array(np.arange(at, at + n), pa.int64()), pa.array(shared, pa.bool_()), pa.array([ends] * n, pa.bool_()), raw.cast(pa.string())], names=names)

    for one in batches:
        for number, at, stop in _ranges(one):
            if now != number:
                if now is not None and open_parts:
                    yield rows(now, place, [True], pa.array([",".join(open_parts)]), last)
                now, first, open_parts = number, True, []
                inside, depth, place, last = (one.column(i)[at].as_py() for i in (2, 3, 4, 5))
            values = one.column(1).slice(at, stop - at)
            odd, gained = _at_ends(values)
            closes = np.flatnonzero(((odd ^ inside) == 0) & (depth + gained[inside] == 1)) + 1
            depth, inside = depth + int(gained[inside][-1]), inside ^ int(odd[-1])
            if len(closes):
                bounds = np.concatenate(([0], closes)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), values.slice(0, int(closes[-1])).cast(pa.string()))
                raw = pc.binary_join(lists, ",")
                if open_parts:
                    raw = pa.concat_arrays([pa.array([",".join([*open_parts, raw[0].as_py()])]), raw.slice(1)])
                yield rows(number, place, [first, *[False] * (len(closes) - 1)], raw)
                place, first = place + len(closes), False
            tail = int(closes[-1]) if len(closes) else 0
            # What is open is joined at once, so a long element is a few parts and not its many pieces.
            open_parts = ([] if len(closes) else open_parts) + ([",".join(values.slice(tail).to_pylist())] if tail < len(values) else [])
    if now is not None and open_parts:
        yield rows(now, place, [True], pa.array([",".join(open_parts)]), last)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """file, place, raw: the text of each element of the JSON arrays at ``path`` (files or folders), with its place in its file.

    The same rows wherever Spark cuts the files; white space around elements
    goes. An empty array or file gives none; a file that holds anything but one
    array, or ends within it, fails; whether an element's own text is sound, its
    parser tells. One element is one value of one task. What
    both passes find is written to the shared folder.

    Both passes have to cut alike, so where executors come and go between them
    ``spark.sql.files.minPartitionNum`` has to be set; a file that is cut
    otherwise fails, and no element is lost.
    """
    starts = kept(_starts(spark, path))
    pieces = _pieces(spark, path)
    few = len(starts.select(F.lit(1)).take(SENT_RANGES + 1)) <= SENT_RANGES
    if not few:
        pieces = pieces.withColumn("__at", F.monotonically_increasing_id())
    begun = starts.select("range", "inside", "depth", "element", "last", "whole")
    met = pieces.drop("file", "start").join(F.broadcast(begun) if few else begun, "range", "left")
    if not few:
        met = met.repartition("range").sortWithinPartitions("range", "__at")
    same = lambda c, error: F.when(c, F.col("inside")).otherwise(F.raise_error(F.lit(error)).cast("int"))
    sure = F.when(F.col("depth").isNull(), same(F.lit(False), "the file was cut in other ranges than before")).otherwise(same(F.col("whole"), NO_ARRAY))
    found = met.select("range", "value", sure.alias("inside"), "depth", "element", "last").mapInArrow(_elements, "range long, place long, shared boolean, ends boolean, raw string")
    where = starts.select("range", "file", "start")
    written = kept(found).join(F.broadcast(where) if few else where, "range")
    whole = written.filter(~F.col("shared")).select("file", "place", F.lit(False).alias("ends"), "raw")
    # An element's parts are of ranges in a row; each but the last one ends at a comma.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "raw"))), lambda p: p["raw"])
    put_together = written.filter("shared").groupBy("file", "place").agg(F.bool_or("ends").alias("ends"), F.array_join(parts, ",").alias("raw"))
    open_, close = r"^[\x{FEFF}\s]*\[", r"\][\s]*$"
    without = lambda text, bracket: F.when(F.rlike(text, F.lit(bracket)), F.regexp_replace(text, bracket, "")).otherwise(F.raise_error(F.lit(NO_ARRAY)))
    opened = whole.unionByName(put_together).withColumn("raw", F.when(F.col("place") == 0, without(F.col("raw"), open_)).otherwise(F.col("raw")))
    closed = opened.withColumn("raw", F.regexp_replace(F.when(F.col("ends"), without(F.col("raw"), close)).otherwise(F.col("raw")), r"^\s+|\s+$", ""))
    return closed.filter((F.col("place") > 0) | ~F.col("ends") | (F.col("raw") != "")).select("file", "place", "raw")
