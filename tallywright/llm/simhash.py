"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Each text has a 64-bit fingerprint of its word shingles. Two fingerprints that
differ in at most three bits agree in one of four 16-bit blocks, so fingerprints
meet in the buckets of their blocks' values. A bucket is sorted by Gray rank,
where neighbours share long runs of bits, and cut into a tree by Gray prefix.
Every node keeps the bits that all below it share, as a mask and a pattern.
Going down the tree with itself, two nodes whose shared bits already differ more
often than allowed are dropped with all they hold. A large bucket is cut into
tiles along its Gray order, with a tree of tiles above them that is gone down in
the same way, so that only tiles meet whose shared bits are near enough. What is
linked is merged to a spanning forest right there, and the forests' components
are found together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import cut, drop_cut, partitions, text_pass
from tallywright.llm.components import connected_components, local_forest
from tallywright.operators.curate import spread_rank

SHINGLE, SEED, RADIUS, BLOCKS = 3, 42, 3, 4
BLOCK_BITS = 64 // BLOCKS
#: Prefix lengths of the tree's levels below the block.
LEVELS = (24, 32, 40, 48, 56, 64)
#: Fingerprints of a bucket that one unit of work takes; larger buckets become tiles of as many. Tiles, and nodes of them, below one node.
TILE, FAN = 2048, 32
#: Pairs of nodes looked at together.
PAIRS_AT_ONCE = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint; 0 without words. Words go by ASCII white space, A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", output: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the fingerprint as a bigint (two's complement); a column of that name is replaced.

    A null text counts as empty. Equal texts, repeated rows among them, have
    equal fingerprints; a very long text is worked through by portions of hashes.
    """
    work = lambda: lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]
    return text_pass(docs, text, keep, [(T.StructField(output, T.LongType()), pa.int64())], work)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in Gray order: every bit summed with all above it."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


def turned(codes: np.ndarray, block: np.ndarray | int) -> np.ndarray:
    """Codes rotated so that the given block comes first."""
    by = np.asarray(block, np.uint64) * np.uint64(BLOCK_BITS)
    return np.where(by == 0, codes, (codes << by) | (codes >> ((np.uint64(64) - by) & np.uint64(63))))


class GrayTree:
    """Trees over sorted fingerprints: one for each unit, by Gray prefix, each node with its shared bits.

    ``units`` tells the tree of each code; codes are distinct within a unit and
    sorted by (unit, Gray rank).
    """

    def __init__(self, units: np.ndarray, codes: np.ndarray, ranks: np.ndarray) -> None:
        self.codes = codes
        self.first, self.mask, self.pattern = [], [], []
        border = np.concatenate(([True], units[1:] != units[:-1])) if len(units) else np.zeros(0, bool)
        for bits in (0, *LEVELS):
            if bits:
                prefix = ranks >> np.uint64(64 - bits)
                border = border | np.concatenate(([True], prefix[1:] != prefix[:-1]))
            start = np.flatnonzero(border)
            every, some = np.bitwise_and.reduceat(codes, start), np.bitwise_or.reduceat(codes, start)
            shared = ~(every ^ some)
            self.first.append(start)
            self.mask.append(shared)
            self.pattern.append(every & shared)
        # A node's children are the next level's nodes that start within it.
        self.below = [np.searchsorted(lower, np.append(upper, len(codes))) for upper, lower in zip(self.first, self.first[1:])]

    def links(self, radius: int, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of all pairs within ``radius``, in portions. With ``sides``, only pairs of different sides."""
        roots = np.arange(len(self.first[0]))
        stack = [(0, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if level == len(LEVELS):
                apart = a != b
                if sides is not None:
                    apart &= sides[a] != sides[b]
                yield a[apart], b[apart]
                continue
            below = self.below[level]
            many_a, many_b = below[a + 1] - below[a], below[b + 1] - below[b]
            made = many_a * many_b
            total = np.cumsum(made)
            if total[-1] > PAIRS_AT_ONCE and len(a) > 1:
                half = min(max(int(np.searchsorted(total, total[-1] // 2)), 1), len(a) - 1)
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            pair = np.repeat(np.arange(len(a)), made)
            place = np.arange(len(pair)) - np.repeat(total - made, made)
            left = below[a][pair] + place // many_b[pair]
            right = below[b][pair] + place % many_b[pair]
            mask, pattern = self.mask[level + 1], self.pattern[level + 1]
            differ = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
            kept = (left <= right) & (differ <= radius)
            if kept.any():
                stack.append((level + 1, left[kept], right[kept]))


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bucket, i, j, tile, fp), sorted by unit, to the edges of a spanning forest of each unit."""

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        block, value, i, j, tile, fp = rows
        codes = turned(fp.view(np.uint64), block)
        ranks = gray_rank(codes)
        unit = np.cumsum(np.concatenate(([0], (np.diff(block) != 0) | (np.diff(value) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))))
        order = np.lexsort((ranks, unit))
        codes, ranks, unit, side = codes[order], ranks[order], unit[order], np.where(i == j, np.arange(len(fp)), tile)[order]
        least = np.arange(len(codes))
        for a, b in GrayTree(unit, codes, ranks).links(RADIUS, side):
            least = local_forest(len(codes), np.concatenate((np.arange(len(codes)), a)), np.concatenate((least, b)))
        linked = np.flatnonzero(least != np.arange(len(codes)))
        fp = fp[order]
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[least[linked]])], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for one in batches:
        rows = [one.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        # The last unit may go on in the next batch.
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]) | (rows[3] != rows[3][-1]))
        stop = int(last[-1]) + 1 if len(last) else 0
        held = [x[stop:] for x in rows]
        if stop:
            yield solve([x[:stop] for x in rows])
    if held is not None and len(held[0]):
        yield solve(held)


def _turned(fp: Column, bucket: Column) -> Column:
    """The fingerprint rotated so that the bucket's block comes first."""
    block = F.shiftright(bucket, BLOCK_BITS)
    by = lambda k: F.when(block == k, F.shiftleft(fp, k * BLOCK_BITS).bitwiseOR(F.shiftrightunsigned(fp, 64 - k * BLOCK_BITS)))
    return F.coalesce(*[by(k) for k in range(1, BLOCKS)], fp)


def _rank(code: Column) -> Column:
    """:func:`gray_rank` natively. Within a bucket the sign is the same, so the order is that of unsigned numbers."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _tile_units(large: DataFrame) -> DataFrame:
    """(bucket, i, j, tile, fp): units of large buckets (bucket, fp), a tile with itself or two whose shared bits differ little enough.

    Tiles are stretches of the bucket's Gray order. Going down the tree of tiles,
    pairs of nodes are dropped whose shared bits differ more often than allowed.
    """
    coded = large.withColumn("code", _turned(F.col("fp"), F.col("bucket")))
    # Each bucket is ranked in parts, by the dozen bits behind its own.
    ranked = coded.select("bucket", "fp", "code", _rank(F.col("code")).alias("rank"))
    placed = cut(spread_rank(ranked, ["bucket"], F.shiftrightunsigned("rank", 64 - BLOCK_BITS - 12), [F.col("rank")], "place").select("bucket", "fp", "code", F.floor((F.col("place") - 1) / TILE).cast("int").alias("tile")))
    levels = [cut(placed.groupBy("bucket", F.col("tile").alias("node")).agg(F.bit_and("code").alias("every"), F.bit_or("code").alias("some")))]
    while levels[-1].agg(F.max("node").alias("most")).first()["most"] >= FAN:
        levels.append(cut(levels[-1].groupBy("bucket", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some"))))
    shared = [level.select("bucket", "node", F.floor(F.col("node") / FAN).cast("int").alias("above"), F.bitwise_not(F.col("every").bitwiseXOR(F.col("some"))).alias("mask"), F.col("every").alias("bits")) for level in levels]
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask_"))) <= RADIUS
    second = lambda nodes: nodes.select(F.col("bucket").alias("bucket_"), F.col("node").alias("j"), F.col("above").alias("above_"), F.col("mask").alias("mask_"), F.col("bits").alias("bits_"))
    first = shared[-1].withColumnRenamed("node", "i")
    pairs = first.join(second(shared[-1]), (F.col("bucket") == F.col("bucket_")) & (F.col("i") <= F.col("j")) & near).select("bucket", "i", "j")
    for nodes in reversed(shared[:-1]):
        pairs = cut(pairs.select("bucket", F.col("i").alias("above"), F.col("j").alias("with")).join(nodes.withColumnRenamed("node", "i"), ["bucket", "above"])).join(second(nodes), (F.col("bucket") == F.col("bucket_")) & (F.col("with") == F.col("above_")) & (F.col("i") <= F.col("j")) & near).select("bucket", "i", "j")
    pairs = cut(pairs)
    both = pairs.select("bucket", F.col("i").alias("tile"), "i", "j").unionByName(pairs.filter("i < j").select("bucket", F.col("j").alias("tile"), "i", "j"))
    return placed.join(both, ["bucket", "tile"]).select("bucket", "i", "j", "tile", "fp")


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all links, from distinct fingerprints ``fp``.

    Every bucket becomes units of bounded size: one, or, if it holds more than
    ``TILE`` fingerprints, those pairs of its tiles that may hold links. The sizes
    sent to all tasks are at most 4 * 65536 rows.
    """
    spark = fingerprints.sparkSession
    value = lambda k: F.shiftrightunsigned("fp", 64 - BLOCK_BITS * (k + 1)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    # Block and value in one number, so that the sizes are sent as a compact table.
    keyed = fingerprints.select("fp", F.explode(F.array(*[(value(k) + F.lit(k << BLOCK_BITS)).cast("long") for k in range(BLOCKS)])).alias("bucket"))
    sizes = cut(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    of = lambda which: keyed.join(F.broadcast(sizes.filter(which).select("bucket")), "bucket")
    none = F.lit(0)
    units = of(F.col("n") <= TILE).select("bucket", none.alias("i"), none.alias("j"), none.alias("tile"), "fp")
    if not sizes.filter(F.col("n") > TILE).isEmpty():
        units = units.unionByName(_tile_units(of(F.col("n") > TILE)))
    units = units.select(F.shiftright("bucket", BLOCK_BITS).cast("int").alias("block"), "bucket", "i", "j", "tile", "fp")
    unit = ["block", "bucket", "i", "j"]
    return units.repartition(partitions(spark), *unit).sortWithinPartitions(*unit).mapInArrow(_unit_links, "a long, b long")


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of each row, and (fp_, component, component_id) of each fingerprint."""
    marks = cut(with_fingerprints(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), keep=["key"]))
    single = cut(marks.groupBy("fp").agg(F.min("key").alias("least")))
    found = connected_components(links(single.select("fp")))
    grouped = cut(single.join(found, single["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(grouped.join(ids, "component").select(F.col("fp").alias("fp_"), "component", "component_id"))
    drop_cut(single, found, grouped)
    return marks, named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` (bigint) and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest key that links lead to, the row's own
    included. A null or empty text has fingerprint 0, which links like any
    other. Null keys are passed over when the smallest is looked for; a group
    of none but null keys has a null id. Copies share a fingerprint, so they
    count once in the search, however many there are.
    """
    marks, named = _grouped(docs, key, text)
    return marks.join(named, marks["fp"] == named["fp_"]).select(F.col("key").alias(key), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``docs``: one whose key is the group's id or, in a group without any key, one of its rows.

    Where rows share that key, repeated rows among them, one stays: the least by
    the text's hash; of rows with equal texts any. Most keys occur once, and
    their rows are only looked up; those of keys that repeat and those without a
    key are reduced to one by hash.
    """
    marks, named = _grouped(docs, key, text)
    met = marks.join(named, marks["fp"] == named["fp_"])
    heads = cut(met.filter(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").alias("__kept"), "n"))
    one = docs.join(heads.filter("n = 1").select("__kept"), docs[key] == F.col("__kept"), "left_semi")
    columns = docs.columns
    groups = named.select(F.col("fp_").alias("__of"), F.col("component").alias("__group"), F.col("component_id").alias("__id"))
    least = lambda rows, by: rows.groupBy(by).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(F.col(f"`{text}`"))).alias("__row")).select("__row.*")
    repeated = heads.filter("n > 1").select("__kept")
    found = one
    if not repeated.isEmpty():
        # A key's rows may be of more groups than its own.
        several = with_fingerprints(docs.join(repeated, docs[key] == F.col("__kept"), "left_semi").withColumn("__text", F.col(f"`{text}`")), "__text", "__fp")
        own = several.join(groups, (F.col("__fp") == F.col("__of")) & (F.col(f"`{key}`") == F.col("__id")))
        found = found.unionByName(least(own, "__group"))
    unknown = docs.filter(F.col(f"`{key}`").isNull())
    if not met.filter(F.col("key").isNull() & F.col("component_id").isNull()).isEmpty():
        without = with_fingerprints(unknown.withColumn("__text", F.col(f"`{text}`")), "__text", "__fp").join(groups.filter(F.col("__id").isNull()), F.col("__fp") == F.col("__of"))
        found = found.unionByName(least(without, "__group"))
    return found
