"""Audit of how filters interact: what each removes, in every order in which they can stand.

A document's failures are one mask of five bits. Texts are counted where they lie,
in the buffers of Arrow batches: byte classes as NumPy masks, and prefix sums over
them, give words, capitals, symbols and code points of all documents of a slice at
once. Distinct words come from sorted hashes of a document's words; words of equal
hashes are compared by their bytes, so a collision cannot change a count. After
that only masks are shuffled: 32 counts a part tell all of the 120 orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import give_back, runs, sliced, span_hashes

#: The filters, by the bit of the mask.
FILTERS = "ABCDE"
#: Bounds of the filters (fixed values): words at least; distinct words in percent at least; capitals in percent at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = b"#$%&*|"
#: Words of more bytes are compared one by one.
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("words", "distinct", "capitals", "symbols", "points")])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes, and where each text starts and the last one ends; a null is empty. Bytes aren't copied but for nulls."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word ends where its text does."""
    inside = ~_SPACE[data]
    starts, ends = runs(inside)
    # Borders between texts that a run of word bytes crosses.
    cuts = np.unique(at[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends


def unlike(data: np.ndarray, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which pairs of words, from ``first`` and ``second`` on and of the same ``lengths``, differ in a byte."""
    found = np.zeros(len(first), bool)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        a, b, n = int(first[i]), int(second[i]), int(lengths[i])
        found[i] = not np.array_equal(data[a : a + n], data[b : b + n])
    left = np.flatnonzero(lengths <= LONG_WORD)
    first, second, lengths = first[left], second[left], lengths[left]
    for k in range(LONG_WORD):
        more = lengths > k
        if not more.all():
            left, first, second, lengths = left[more], first[more], second[more], lengths[more]
        if not len(left):
            break
        found[left[data[first + k] != data[second + k]]] = True
    return found


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distinct words of each text, whose words are ``of[i]`` to ``of[i + 1]``.

    The hashes are put in order within each text; a word counts if its hash
    differs from the one before it, once equal hashes are seen to be equal words.
    A text where they are not is counted by its words themselves.
    """
    counts = np.diff(of)
    place = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    bits = np.uint64(max(1, len(counts).bit_length()))
    # The text's number above the hash's upper bits: one sort orders the words of all texts.
    keys = (place << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(keys)
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    a, b = order[:-1][equal], order[1:][equal]
    lengths = ends - starts
    wrong = lengths[a] != lengths[b]
    wrong |= unlike(data, starts[a], starts[b], np.where(wrong, 0, lengths[a]))
    distinct = counts - np.bincount(place[a].astype(np.int64), minlength=len(counts))
    for i in np.unique(place[a[wrong]]).astype(np.int64).tolist():
        distinct[i] = len({data[s:e].tobytes() for s, e in zip(starts[of[i] : of[i + 1]].tolist(), ends[of[i] : of[i + 1]].tolist())})
    return distinct


def counted(column: pa.Array, hashed=span_hashes) -> tuple[np.ndarray, ...]:
    """words, distinct words, capitals, symbols and code points of each text."""
    data, at = buffers(column)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[at])
    starts, ends = word_spans(data, at)
    of = np.searchsorted(starts, at)
    distinct = distinct_words(data, starts, ends, hashed(data, starts, ends), of) if len(starts) else np.zeros(len(column), np.int64)
    return np.diff(of), distinct, total((data >= 0x41) & (data <= 0x5A)), total(_SYMBOL[data]), total((data & 0xC0) != 0x80)


def text_counts(docs: DataFrame, keep: list[str], text: str = "__text") -> DataFrame:
    """``keep`` and words, distinct, capitals, symbols, points of ``text``: one pass over the buffers, in slices, without a shuffle."""
    sent = docs.select(*keep, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for part in sliced(one, len(keep)):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in counted(part.column(len(keep))))], names=[*keep, *_COUNTS.names])
        give_back()

    return sent.mapInArrow(scan, T.StructType([*(sent.schema[c] for c in keep), *_COUNTS.fields]))


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """key, part, mask of each row: bit 0 to 4 tell whether it fails A to E.

    E, a text that a smaller key has already, is found by the texts' SHA-256: the
    smallest key of each is told first, and a row fails unless it is that one.
    Both shuffles spread a text with any number of copies: the first has a row for
    each task, the second goes by text and key. Rows that share key and text count
    each; one without a key never fails E, and no text is a copy of its.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("__part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__digest", F.unhex(F.sha2("__text", 256)))
    found = text_counts(rows, ["__key", "__part", "__digest"])
    tests = (F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"), 100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), F.col("symbols") > 0)
    bits = F.lit(0)
    for bit, test in enumerate(tests):
        bits = bits.bitwiseOR(F.when(test, 1 << bit).otherwise(0))
    narrow = found.select("__key", "__part", "__digest", bits.alias("__bits"))
    # Keys and digests are worked out from the table itself here, so no text goes to Python for them.
    first = rows.filter(F.col("__key").isNotNull()).groupBy("__digest").agg(F.min("__key").alias("__first")).withColumnRenamed("__digest", "__of")
    joined = narrow.join(first, (F.col("__digest") == F.col("__of")) & (F.col("__key") == F.col("__first")), "left")
    copy = F.col("__key").isNotNull() & F.col("__first").isNull()
    return joined.select(F.col("__key").alias("key"), F.col("__part").alias("part"), F.col("__bits").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame, label_key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask, n, good, toxic: documents by their mask, and how many of them are labelled good and toxic.

    A key that is labelled several times is good, or toxic, if one of its labels says so.
    """
    said = lambda c: F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("int"))
    known = labels.filter(F.col(f"`{label_key}`").isNotNull()).groupBy(F.col(f"`{label_key}`").alias("__label")).agg(said(quality).alias("__good"), said(toxic).alias("__toxic"))
    joined = failed.join(known, F.col("key") == F.col("__label"), "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("__good", F.lit(0))).alias("good"), F.sum(F.coalesce("__toxic", F.lit(0))).alias("toxic"))


def interactions(masks: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, out of :func:`mask_counts`: 600 rows a part.

    ``shapley`` needs no walk through the orders: of the filters that a mask
    fails, each is the first in equally many of them.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    spread = masks.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - F.lit(ord(FILTERS[0])))
    own, before = bit(F.expr("substring(filter_order, step, 1)")), F.expr("substring(filter_order, 1, step - 1)")
    earlier = sum((F.when(F.contains(before, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    marked = spread.withColumns({"__own": own, "__before": earlier})
    fails, gone = F.col("mask").bitwiseAND(F.col("__own")) != 0, F.col("mask").bitwiseAND(F.col("__before")) != 0
    over = lambda test, value="n": F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0).cast("long"))
    share = F.coalesce(F.sum(F.when(fails, F.expr("n * (120 div greatest(bit_count(mask), 1))"))), F.lit(0).cast("long"))
    return marked.groupBy("part", "filter_order", "step").agg(
        over(~fails & ~gone).alias("kept"), over(fails & ~gone).alias("removed"), over(fails & gone).alias("redundant"), over(F.col("mask") == F.col("__own")).alias("unique_fails"),
        over(fails & ~gone, "good").alias("good_lost"), over(fails & ~gone, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of all orders of the five filters.

    Null texts are empty; documents without a language are the part ``''``; an
    empty table has no parts. Documents and labels may hold repeated rows.
    """
    return interactions(mask_counts(failures(docs), labels))
