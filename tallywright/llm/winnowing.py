"""Document fingerprints by winnowing.

The hashes of all ``k``-grams of code points are cut into windows of ``w`` in a
row, and each window's smallest hash is kept, the rightmost of equal ones, with
its position. Any run of ``w + k - 1`` characters that two texts share holds a
whole window, so both keep the same hash for it; runs below ``k`` characters are
never matched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import cut, give_back, mix64, partitions, sliced, text_pass

#: Characters of a gram, and grams of a window: runs of 31 characters are always found.
GRAM, WINDOW = 16, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, k: int = GRAM) -> np.ndarray:
    """The 64-bit hash of each ``k``-gram; a shorter text has the hash of all of it, an empty one none."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(units):
        return units
    # The gram of 2n characters from those of n: the binary digits of k, highest first.
    hashes, have = mix64(units + _ODD), 1
    size = min(k, len(units))
    single = hashes
    for digit in bin(size)[3:]:
        factor = np.uint64(pow(int(_ODD), have, 1 << 64))
        hashes = hashes[:-have] * factor + hashes[have:]
        have *= 2
        if digit == "1":
            hashes = hashes[:-1] * _ODD + single[have:]
            have += 1
    return mix64(hashes + np.uint64(size))


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, by position. With fewer than ``w`` grams, they are one window."""
    hashes = gram_hashes(text, k)
    n = len(hashes)
    if n == 0:
        return hashes, np.zeros(0, np.int64)
    size = min(w, n)
    # Position of the rightmost minimum of each window: windows of doubled width,
    # then two that overlap.
    place, span = np.arange(n), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] <= hashes[a], b, a)

    while span * 2 <= size:
        place = lower(place[:-span], place[span:])
        span *= 2
    if span < size:
        place = lower(place[: n - size + 1], place[size - span :])
    kept = place[np.concatenate(([True], place[1:] != place[:-1]))]
    return hashes[kept], kept


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of kept hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """128 bits of SHA-256 of the kept hashes and positions, as hex."""
    return hashlib.sha256(hashes.astype("<u8").tobytes() + places.astype("<i8").tobytes()).hexdigest()[:32]


def fingerprints(docs: DataFrame, text: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``docs`` with ``hashes`` (array<bigint>, two's complement) and ``places`` (array<bigint>) of each text.

    A null or empty text has empty arrays. Columns of those names are replaced.
    Equal texts, repeated rows among them, have equal arrays; a very long text
    is worked out as a whole.
    """
    outputs = [(T.StructField(c, T.ArrayType(T.LongType())), pa.list_(pa.int64())) for c in ("hashes", "places")]

    def work():
        def marked(texts: list[str]) -> list[list]:
            found = [winnow(t, k, w) for t in texts]
            return [[h.view(np.int64) for h, _ in found], [p for _, p in found]]

        return marked

    return text_pass(docs, text, None, outputs, work)


def with_edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as much of the start of ``following``."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and text in the order of the key (null first), then of a 64-bit hash of the text: ranges of about equal counts, one a task, each sorted.

    Any type that Spark sorts is a key. One key, null too, or one text that very
    many rows share spreads over tasks: rows that agree in both are told apart
    by where they were read, which no result depends on.
    """
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.col("hash"), F.col("row")]
    told = named.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    return told.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("key", "text")


def compared_with_follower(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, kept (hashes kept). A null text is empty. Keys of any
    type that can be sorted; null keys come first, equal keys follow by a hash of
    the text. Likeness is Jaccard's of the kept hashes, 1 for two empty texts. A
    table of one row is its own follower; an empty one gives no rows.

    Texts are shuffled once, in order. A task's last row has its follower in the
    next task that has rows, so each task tells its first and last text, and a
    small join brings these together. Only the numbers of tasks that have rows
    come to the driver.
    """
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("kept", T.LongType()),
    ])
    border = T.StructType([T.StructField("key", schema[0].dataType), *schema.fields[1:], T.StructField("place", T.StringType()), T.StructField("task", T.IntegerType()), T.StructField("text", T.StringType())])
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def figures(one: str, marks: tuple, after: str, after_marks: tuple) -> tuple:
        edited = with_edited(one, after)
        edited_marks = winnow(edited, k, w)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return len(one), sha, digest(*marks), digest(*edited_marks), likeness(marks[0], edited_marks[0]), likeness(marks[0], after_marks[0]), len(marks[0])

    def out(found: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [kind, *types])], names=names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, kind = TaskContext.get().partitionId(), None, None
        for one in batches:
            kind = one.schema.field(0).type
            for part in sliced(one, 1):
                found = []
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    now = name, value or "", winnow(value or "", k, w)
                    if before is None:
                        found.append((None, *[None] * 7, "first", task, now[1]))
                    else:
                        found.append((before[0], *figures(*before[1:], *now[1:]), None, None, None))
                    before = now
                if found:
                    yield out(found, kind, border.names)
        if before is not None:
            yield out([(before[0], *[None] * 7, "last", task, before[1])], kind, border.names)
        give_back()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for part in sliced(one, 1):
                found = [(name, *figures(text, winnow(text, k, w), after, winnow(after, k, w))) for name, text, after in zip(*(part.column(i).to_pylist() for i in range(3)))]
                yield out(found, one.schema.field(0).type, schema.names)

    done = cut(in_order(docs, key, text).mapInArrow(within, border))
    firsts, lasts = (done.filter(F.col("place") == place).select("task", "key", "text") for place in ("first", "last"))
    tasks = sorted(r["task"] for r in firsts.select("task").collect())
    following = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, next int")
    pairs = lasts.join(F.broadcast(following), "task").join(firsts.select(F.col("task").alias("next"), F.col("text").alias("after")), "next").select("key", "text", "after")
    return done.filter(F.col("place").isNull()).select(F.col("key").alias(key), *schema.names[1:]).unionByName(pairs.mapInArrow(across, schema))
