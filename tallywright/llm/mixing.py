"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target number of words. Every document of a source is
expected ``target / source size`` times; the expected copies are summed up along
the source's documents, one offset per source is added, and a document is
emitted once for each integer that its stretch of that sum crosses. So a
document comes ``floor`` or ``ceil`` of the expected times, never more than the
repeat limit, and, as the documents of a source go by size, the words taken miss
the target by no more than about the largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import cut, partitions
from tallywright.operators.curate import spread_rank

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times over at most.
MOST_REPEATS = 3
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): source, source_size, target.

    All sizes are shared out by weight; a target stops at ``most`` times its
    source's size and what is over goes to the others by weight, until none is
    above. That fixed point is ``min(most * size, weight * level)``, and the
    level follows from sums along the sources by ``most * size / weight``: the
    sources capped are those below the level. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    ranked = sizes.select("source", "source_size", weight.cast("long").alias("w"))
    everything = Window.partitionBy()
    along = Window.orderBy((cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    # The level if all sources before this one are capped; it is the true one at the first source that it doesn't cap.
    level = (F.col("total") - F.col("capped")) / F.col("w_left")
    found = summed.select("*", level.alias("level"), (cap / F.col("w") >= level).alias("open"))
    final = F.min(F.when(F.col("open"), F.struct(cap / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return found.select("source", "source_size", F.when(final.isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("w") * final)).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's offset in [0, 1), from the first 32 bits of an MD5."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _crossed(rank: Column, each: Column, shift: Column) -> Column:
    """Integers that the sum of expected copies has crossed up to ``rank``."""
    return F.floor(each * rank + shift)


def _ranked(docs: DataFrame, key: str, text: str, source: str, seed: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """key, source, size, source_size, target, each (expected copies), shift (the source's offset), rank of each row of ``docs``."""
    wide = partitions(docs.sparkSession)
    own_source = F.col(f"`{source}`")
    rows = docs.select(F.col(f"`{key}`").alias("key"), own_source.alias("source"), F.coalesce(F.concat(F.lit("="), own_source), F.lit("")).alias("named"), word_count(F.col(f"`{text}`")).alias("size"))
    # The ranges come from a sample; they must not be drawn twice, hence the cut.
    placed = cut(rows.repartitionByRange(wide, "named", "size", "key").select("*", F.spark_partition_id().alias("part")))
    parts = placed.groupBy("named", "part").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("named").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("named", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    sizes = parts.groupBy("named").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, most).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named"), "source_size", "target")
    ahead = shifts.join(targets, "named")
    own = Window.partitionBy("named", "part").orderBy("size", "key")
    joined = placed.withColumn("own", F.row_number().over(own)).join(ahead, ["named", "part"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.select("key", "source", "size", "source_size", "target", each.alias("each"), offset(F.col("source"), seed).alias("shift"), (F.col("ahead") + F.col("own")).alias("rank"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """How often each document is taken: key, source, size, source_size, target, copies, taken.

    One row per row of ``docs``. Documents are ranked within their source by
    (size, key). Ranks come from a range partitioning by (source, size, key), so
    that a hot source is spread over many tasks: each task numbers its own rows
    and the counts of the tasks before it are added.

    A null text has size 0; a null source is a source of its own, last in
    order; a null key ranks first. Rows of equal source, size and key may swap
    places, which their results do not show. A source of size 0 has target 0
    and no copies. An empty table gives an empty one.
    """
    ranked = _ranked(docs, key, text, source, seed, weights, most)
    copies = (_crossed(F.col("rank"), F.col("each"), F.col("shift")) - _crossed(F.col("rank") - 1, F.col("each"), F.col("shift"))).cast("int")
    return ranked.select("key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as it is taken, with all its columns.

    Rows alike in key, source and size, repeated rows among them, have ranks in a
    row; they are numbered, and each comes as often as its rank does. Which of
    them has which number is open, so of rows with one key but other texts of the
    same size it is open which is taken.
    """
    # One row for each key, source and size, with the first rank.
    ranked = _ranked(docs, key, text, source, seed, weights, most).groupBy("key", "source", "size")
    groups = cut(ranked.agg(F.min("rank").alias("__low"), F.count("*").alias("__rows"), F.first("each").alias("__each"), F.first("shift").alias("__shift")).select(F.col("key").alias("__key"), F.col("source").alias("__source"), F.col("size").alias("__words"), "__low", "__rows", "__each", "__shift"))
    sized = docs.withColumn("__size", word_count(F.col(f"`{text}`")))
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & F.col(f"`{source}`").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__words"))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def copied(rows: DataFrame, rank: Column) -> DataFrame:
        times = (_crossed(rank, F.col("__each"), F.col("__shift")) - _crossed(rank - 1, F.col("__each"), F.col("__shift"))).cast("int")
        return rows.withColumn("__times", times).filter(F.col("__times") > 0).select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")

    low = F.col("__low")
    taken = _crossed(low, F.col("__each"), F.col("__shift")) > _crossed(low - 1, F.col("__each"), F.col("__shift"))
    found = copied(sized.join(groups.filter((F.col("__rows") == 1) & taken), same), low)
    many = groups.filter(F.col("__rows") > 1)
    if many.isEmpty():
        return found
    # Written, so that the rows keep the numbers they get; ids go by partition, so a large group is numbered by many tasks.
    again = cut(sized.join(many, same).withColumn("__row", F.monotonically_increasing_id()))
    numbered = spread_rank(again, ["__key", "__source", "__words"], F.shiftright("__row", 33), [F.col("__row")], "__no")
    return found.unionByName(copied(numbered, low + F.col("__no") - 1))
