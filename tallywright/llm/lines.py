"""Line dedup: near-equal lines by MinHash, one line of each group stays.

Lines are compared by their sets of character shingles. MinHash signatures cut
into bands bring similar lines together. Each band's lines are tied to its first
one, and every tie is checked by the exact Jaccard similarity of the shingles.
What passes is joined by union-find; where a band's lines are then still apart,
those that are not yet known to belong together are compared with each other, in
tiles, and no other lines are. Each component keeps the line that comes first by
(document, line number).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import SLICE_BYTES, code_points, cut, drop_cut, give_back, mix64, partitions, sliced
from tallywright.llm.components import connected_components

SHINGLE, SIMILARITY = 10, 0.8
#: At similarity 0.8 a pair shares one of 15 bands of 3 minima with probability 0.99998.
BANDS, ROWS = 15, 3
#: Lines of a band that one unit of work takes; larger bands become pairs of tiles.
TILE = 1024
#: Line numbers of 8 bytes sent to all tasks, at most; beyond it they meet the texts' lines in a shuffle join.
SENT_LINES = 1_000_000
#: Rows (band, line) that a task gathers before it deals them out, and buckets of bands for each task.
GATHERED, BUCKETS_PER_TASK = 1_000_000, 4
#: Lines that a task remembers, so as not to work out copies again.
REMEMBERED = 200_000
#: Places of a table of lines and shingles that is worked out at once.
DENSE = 4_000_000
BLANK = r"^[\x20\x09-\x0D]*$"
#: Put before a line for the second half of its identity.
_AGAIN = "\n"
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A band (40 bits; the bucket has the rest) and a line, as they are dealt out.
_DEALT = np.dtype([("low", "<u4"), ("high", "u1"), ("line", "<i8")])
_FACTORS = (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes by position, and each line's first and last (exclusive) position; a line below ``k`` characters is one shingle."""
    units, begins, ends = code_points(lines)
    wide = np.concatenate((units, np.zeros(k, np.uint32))).astype(np.uint64)
    wide += np.uint64(1)
    # The shingle of 2n characters from those of n: the binary digits of k, highest first.
    hashes, have = wide, 1
    for digit in bin(k)[3:]:
        hashes = hashes[:-have] * np.uint64(pow(int(_ODD), have, 1 << 64)) + hashes[have:]
        have *= 2
        if digit == "1":
            hashes = hashes[:-1] * _ODD + wide[have : have + len(hashes) - 1]
            have += 1
    hashes = hashes[: len(units)]
    short = np.flatnonzero(ends - begins < k)
    for i in short.tolist():
        part = 0
        for c in units[begins[i] : ends[i]].tolist():
            part = (part * int(_ODD) + c + 1) & 0xFFFFFFFFFFFFFFFF
        hashes[begins[i]] = part
    return mix64(hashes), begins, np.maximum(ends - k + 1, begins + 1)


def _short_hashes(units: np.ndarray, ends: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the shingles by position, a line below ``k`` characters being one: enough to draw minima by."""
    wide = np.concatenate((units, np.zeros(k, np.uint32))) + np.uint32(1)
    factor = int(_ODD) >> 32 | 1
    hashes, have = wide, 1
    for digit in bin(k)[3:]:
        hashes = hashes[:-have] * np.uint32(pow(factor, have, 1 << 32)) + hashes[have:]
        have *= 2
        if digit == "1":
            hashes = hashes[:-1] * np.uint32(factor) + wide[have : have + len(hashes) - 1]
            have += 1
    hashes = hashes[: len(units) + 1]
    for i in np.flatnonzero(ends - begins < k).tolist():
        part = 0
        for c in units[begins[i] : ends[i]].tolist():
            part = (part * factor + c + 1) & 0xFFFFFFFF
        hashes[begins[i]] = part
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        hashes ^= hashes >> np.uint32(shift)
        hashes *= np.uint32(by)
    hashes ^= hashes >> np.uint32(16)
    return hashes


def band_hashes(lines: list[str]) -> np.ndarray:
    """[line, band]: a 64-bit hash of the band's minima and number."""
    units, begins, ends = code_points(lines)
    small = _short_hashes(units, ends, begins, SHINGLE)
    edges, turned = np.stack((begins, np.maximum(ends - SHINGLE + 1, begins + 1)), 1).ravel(), np.empty_like(small)
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    for row, factor in enumerate(_FACTORS):
        np.multiply(small, factor, out=turned)
        least[row] = np.minimum.reduceat(turned, edges)[::2]
    mixed = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for row in range(ROWS):
        mixed = mix64(mixed * _ODD + least[row::ROWS])
    return mixed.T


def line_id(line: Column) -> Column:
    """The first 64 bits of a line's identity: XXH64 with seed 42."""
    return F.xxhash64(line)


def line_check(line: Column) -> Column:
    """The other 64 bits: XXH64 of the line with a line end before it. Lines are equal if both halves are."""
    return F.xxhash64(F.concat(F.lit(_AGAIN), line))


def _row_key(key: str, text: str) -> Column:
    """What tells documents apart: the key; without one, the text's hash. Those with a key come first."""
    return F.struct(F.when(F.col(f"`{key}`").isNull(), F.xxhash64(F.col(f"`{text}`"))).alias("text"), F.col(f"`{key}`").alias("key"))


def _ties(band: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (band, line, least line of the band) where the two differ, and the distinct bands with their least lines."""
    order = np.argsort(band)
    band, line = band[order], line[order]
    start = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
    least = np.minimum.reduceat(line, start)
    first = np.repeat(least, np.diff(np.append(start, len(band))))
    apart = line != first
    return np.stack((band[apart].view(np.int64), line[apart], first[apart]), 1), band[start], least


def _packed(buckets: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to the bands of their lines that are not blank, dealt out to buckets.

        A band's lines that one task has gathered are tied to the least of them
        here: only that one goes to the band's bucket (rows of band, line), and
        the ties (rows of band, line, least line) to any. So a band that very
        many lines share sends a line for each portion to its bucket.
        """
        met: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, turn = 0, 0

        def dealt() -> pa.RecordBatch:
            ties, band, least = _ties(*(np.concatenate(x) for x in zip(*held)))
            # The bucket follows the band's upper half, so sorted bands are sorted buckets.
            place = ((band >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            heads = np.empty(len(band), _DEALT)
            heads["low"], heads["high"], heads["line"] = band & np.uint64(0xFFFFFFFF), band >> np.uint64(32) & np.uint64(0xFF), least
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            blobs = [heads[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(heads)))]
            where, tied = place[starts].tolist(), [False] * len(blobs)
            if len(ties):
                whole = ties[:, 0].view(np.uint64)
                ties[:, 0] = (((whole >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(40) | whole & np.uint64(0xFFFFFFFFFF)).view(np.int64)
                blobs.append(ties.tobytes())
                where.append(turn % buckets)
                tied.append(True)
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(tied), pa.array(blobs, pa.binary())], names=["bucket", "tied", "rows"])

        for one in batches:
            if not turn and one.num_rows:
                # Any start will do, as long as a task that is run again takes the same.
                turn = xxhash.xxh32_intdigest((one.column(0)[0].as_py() or "").encode("utf-8", "surrogatepass"))
            for part in sliced(one, 0, SLICE_BYTES // 2):
                fresh, ids = [], []
                for text in part.column(0).to_pylist():
                    for line in (text or "").split("\n"):
                        data = line.encode("utf-8", "surrogatepass")
                        if data.strip():
                            digest = xxhash.xxh64_intdigest(data, 42)
                            if digest not in met:
                                met.add(digest)
                                fresh.append(line)
                                ids.append(digest)
                if len(met) > REMEMBERED:
                    met.clear()
                if fresh:
                    held.append((band_hashes(fresh).ravel(), np.repeat(np.array(ids, np.uint64).view(np.int64), BANDS)))
                    size += len(ids) * BANDS
                if size >= GATHERED:
                    yield dealt()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield dealt()
            held = []
        give_back()

    return packed


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tied, rows), sorted by bucket, to ties (band, a, b) of each band's lines to its least."""

    def tied(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["band", "a", "b"])

    def solved(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(blobs), _DEALT)
        band = np.uint64(bucket << 40) | rows["high"].astype(np.uint64) << np.uint64(32) | rows["low"].astype(np.uint64)
        return tied(_ties(band, rows["line"])[0])

    bucket, blobs = None, []
    for one in batches:
        for place, ready, rows in zip(*(one.column(i).to_pylist() for i in range(3))):
            if ready:
                yield tied(np.frombuffer(rows, np.int64).reshape(-1, 3))
                continue
            if place != bucket and blobs:
                yield solved(bucket, blobs)
                blobs = []
            bucket = place
            blobs.append(rows)
    if blobs:
        yield solved(bucket, blobs)


def _sets(lines: list[str]) -> list[np.ndarray]:
    """Each line's distinct shingles, sorted."""
    hashes, begins, stops = shingle_hashes(lines)
    found = []
    for a, b in zip(begins.tolist(), stops.tolist()):
        part = hashes[a:b]
        part.sort()
        fresh = part[1:] != part[:-1]
        found.append(part if fresh.all() else part[np.append(True, fresh)])
    return found


def _similar_pairs(similarity: float):
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, a_check, a_line, b, b_check, b_line) to those pairs that are similar enough."""
        for one in batches:
            for part in sliced(one, 2):
                sides = [part.column(i).to_pylist() for i in (2, 5)]
                each = dict.fromkeys(chain(*sides))
                each = dict(zip(each, _sets(list(each))))
                left, right = ([each[line] for line in side] for side in sides)
                near = np.zeros(part.num_rows, bool)
                for i, (x, y) in enumerate(zip(left, right)):
                    if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                        both = np.concatenate((x, y))
                        both.sort()
                        shared = np.count_nonzero(both[1:] == both[:-1])
                        near[i] = shared >= similarity * (len(both) - shared) - 1e-9
                nodes = [pa.StructArray.from_arrays([pa.array(part.column(i + j).to_numpy()[near]) for j in (0, 1)], names=["id", "check"]) for i in (0, 3)]
                yield pa.RecordBatch.from_arrays(nodes, names=["a", "b"])

    return checked


def similar_links(lines: list[str], groups: list[int], similarity: float = SIMILARITY, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of groups (given by number) that exact Jaccard similarity of lines joins; a forest of them.

    Each line is compared with those behind it that are of another group, as far
    as known by then. With ``sides``, lines of the same side are not compared.
    """
    sets = _sets(lines)
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every)
    number = np.empty(len(every), np.int64)
    number[order] = np.cumsum(np.concatenate(([True], every[order][1:] != every[order][:-1]))) - 1
    offset, width = np.concatenate(([0], np.cumsum(size))), int(number.max()) + 1
    group, found = np.array(groups), []
    side = np.arange(len(lines)) if sides is None else np.array(sides)

    def joined(x: int, y: int) -> None:
        if group[y] != group[x]:
            found.append((int(group[x]), int(group[y])))
            group[group == group[y]] = group[x]

    if len(lines) * width <= DENSE:
        table = np.zeros((len(lines), width), np.float32)
        table[np.repeat(np.arange(len(lines)), size), number] = 1
        both = table @ table.T
        near = (both >= similarity * (size[:, None] + size - both) - 1e-9) & (group[:, None] != group) & (side[:, None] != side)
        for x, y in zip(*(p.tolist() for p in np.nonzero(np.triu(near, 1)))):
            joined(x, y)
        return found
    mark = np.zeros(width, bool)
    for x in range(len(lines) - 1):
        rest = x + 1 + np.flatnonzero((group[x + 1 :] != group[x]) & (side[x + 1 :] != side[x]))
        rest = rest[np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]) - 1e-9]
        if not len(rest):
            continue
        own = number[offset[x] : offset[x + 1]]
        mark[own] = True
        starts = np.cumsum(size[rest]) - size[rest]
        places = np.repeat(offset[rest] - starts, size[rest]) + np.arange(size[rest].sum())
        both = np.add.reduceat(mark[number[places]].astype(np.int32), starts)
        mark[own] = False
        for y in rest[both >= similarity * (size[x] + size[rest] - both) - 1e-9].tolist():
            joined(x, y)
    return found


def _verified(similarity: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (band, i, j, tile, group id, group check, line), sorted by unit, to pairs of groups that a unit joins."""

        def solve(rows: list[tuple]) -> list[tuple]:
            names = list(dict.fromkeys(r[4:6] for r in rows))
            number = {name: k for k, name in enumerate(names)}
            sides = None if rows[0][1] == rows[0][2] else [r[3] for r in rows]
            return [(*names[a], *names[b]) for a, b in similar_links([r[6] for r in rows], [number[r[4:6]] for r in rows], similarity, sides)]

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array([x[k + j] for x in found], pa.int64()) for j in (0, 1)], names=["id", "check"]) for k in (0, 2)], names=["a", "b"])

        unit, rows, found = None, [], []
        for one in batches:
            for row in zip(*(one.column(k).to_pylist() for k in range(7))):
                if row[:3] != unit:
                    if rows:
                        found.extend(solve(rows))
                    unit, rows = row[:3], []
                rows.append(row)
            if len(found) > 10_000:
                yield out(found)
                found = []
        if rows:
            found.extend(solve(rows))
        yield out(found)

    return verified


_NODE = ["id", "check"]
_PAIR = "a struct<id:bigint,check:bigint>, b struct<id:bigint,check:bigint>"


def _heads(firsts: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(id, check, head): of every line that is near another, the first line of its component, from (doc, no) of each distinct line."""
    wide = partitions(texts.sparkSession)
    buckets = wide * BUCKETS_PER_TASK
    packed = texts.select("text").mapInArrow(_packed(buckets), "bucket int, tied boolean, rows binary")
    ties = cut(packed.repartition(wide, "bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "band long, a long, b long"))
    edges = cut(ties.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    nodes = cut(nodes)
    if nodes.count() <= SENT_LINES:
        nodes = F.broadcast(nodes)
    wanted = cut(firsts.join(nodes, "id", "left_semi").select(*_NODE, "doc", "no"))
    fetched = cut(_identified(texts.select(F.explode(F.split("text", "\n", -1)).alias("line"))).join(nodes, "id", "left_semi").dropDuplicates(_NODE))
    left, right = (fetched.select(*[F.col(c).alias(n) for c, n in zip(("id", "check", "line"), names)]) for names in (("a", "a_check", "a_line"), ("b", "b_check", "b_line")))
    near = edges.join(left, "a").join(right, "b").select("a", "a_check", "a_line", "b", "b_check", "b_line").mapInArrow(_similar_pairs(similarity), _PAIR)
    joined = connected_components(near)

    # Where a band of three lines or more is not one component, its components are compared.
    own = F.struct(*_NODE)
    grouped = cut(wanted.join(joined, own == F.col("node"), "left").select("doc", "no", *_NODE, F.coalesce("component", own).alias("group")))
    several = ties.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("band")
    # Written, as it is read twice below: the ties would meet their bands four times.
    both = ties.join(several, "band", "left_semi").select("band", F.explode(F.array("a", "b")).alias("id"))
    members = cut(both.distinct().join(grouped.select(*_NODE, "group"), "id"))
    mark = F.xxhash64(*_NODE)
    open_ = members.groupBy("band").agg(F.count("*").alias("n"), F.min("group").alias("least"), F.max("group").alias("most"), F.sum(F.shiftright(mark, 20)).alias("sum"), F.bit_xor(mark).alias("xor"))
    # Bands of the same lines are one.
    once = open_.filter(F.col("least") != F.col("most")).groupBy("n", "sum", "xor").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    spread = members.join(once, "band").join(fetched, _NODE).withColumn("tile", F.pmod(mark, F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = ["band", "i", "j"]
    units = spread.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", F.col("group.id").alias("g_id"), F.col("group.check").alias("g_check"), "line")
    late = units.repartition(wide, *unit).sortWithinPartitions(*unit, "g_id", "g_check").mapInArrow(_verified(similarity), _PAIR)
    later = connected_components(late)
    merged = later.withColumnsRenamed({"node": "group_", "component": "merged"})

    final = cut(grouped.join(merged, F.col("group") == F.col("group_"), "left").withColumn("whole", F.coalesce("merged", "group")).select("doc", "no", *_NODE, "whole"))
    heads = final.groupBy("whole").agg(F.min(F.struct("doc", "no")).alias("head"), F.count("*").alias("n")).filter(F.col("n") > 1).select("whole", "head")
    found = cut(final.join(heads, "whole").select(*_NODE, "head"))
    drop_cut(ties, edges, nodes, wanted, fetched, joined, grouped, members, later, final)
    return found


def _identified(lines: DataFrame) -> DataFrame:
    """Rows with a ``line`` that is not blank, and both halves of its identity."""
    known = lines.filter(~F.col("line").rlike(BLANK))
    return known.withColumns({"id": line_id(F.col("line")), "check": line_check(F.col("line"))})


def _line_groups(texts: DataFrame, similarity: float) -> DataFrame:
    """(doc, no, id, check, first_doc, first_no, kept) of every line that is not blank, from (doc, text)."""
    places = cut(_identified(texts.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))).select("doc", "no", *_NODE))
    firsts = cut(places.groupBy(*_NODE).agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("n")).select(*_NODE, F.col("first.doc").alias("doc"), F.col("first.no").alias("no"), "n"))
    heads = _heads(firsts, texts, similarity)
    # A line that occurs once and is near no other is its own first.
    named = firsts.join(heads, _NODE, "left").filter((F.col("n") > 1) | F.col("head").isNotNull())
    named = cut(named.select(*_NODE, F.coalesce("head.doc", "doc").alias("first_doc"), F.coalesce("head.no", "no").alias("first_no")))
    found = places.join(named, _NODE, "left").select("doc", "no", *_NODE, F.coalesce("first_doc", "doc").alias("first_doc"), F.coalesce("first_no", "no").alias("first_no"))
    return found.withColumn("kept", (F.col("doc") == F.col("first_doc")) & (F.col("no") == F.col("first_no")))


def line_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every line that is not blank: ``key``, ``no``, ``line_id``, ``line_check``, ``first_key``, ``first_no``, ``kept``.

    ``first_key`` and ``first_no`` tell the line that its component keeps, and
    ``kept`` whether it is this one. Equal lines (by 128 bits) are one node, so
    copies cost nothing beyond their rows. Blank lines, and rows whose text is
    null, have no lines. Rows that share a key count as one document: where they
    have the same line at the same place, all of them keep it or none. Rows
    without a key count as one document if their texts are equal, and come
    behind all others. An empty table gives no rows.
    """
    found = _line_groups(docs.select(_row_key(key, text).alias("doc"), F.col(f"`{text}`").alias("text")), similarity)
    return found.select(F.col("doc.key").alias(key), "no", F.col("id").alias("line_id"), F.col("check").alias("line_check"), F.col("first_doc.key").alias("first_key"), "first_no", "kept")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that their components don't keep.

    Documents that lose nothing come through as they are, null and empty texts
    among them; a document that loses every line that is not blank goes. Which
    rows count as one document, :func:`line_groups` tells.
    """
    groups = _line_groups(docs.select(_row_key(key, text).alias("doc"), F.col(f"`{text}`").alias("text")), similarity)
    lost = groups.groupBy("doc").agg(F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("no")))).alias("lost"), F.count_if("kept").alias("stay")).filter(F.size("lost") > 0)
    # By line number, whether the line goes: looking one up takes the same time however many there are.
    runs = F.transform("lost", lambda no, i: F.concat(F.repeat(F.lit("0"), no - F.coalesce(F.get("lost", i - 1), F.lit(-1)) - 1), F.lit("1")))
    lost = cut(lost.select(F.col("doc").alias("__doc"), F.transform(F.split(F.array_join(runs, ""), ""), lambda c: c == "1").alias("__goes"), "stay").withColumnRenamed("stay", "__stay"))
    found = docs.withColumn("__of", _row_key(key, text)).join(lost, F.col("__of") == F.col("__doc"), "left")
    remaining = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda _, i: ~F.coalesce(F.get("__goes", i), F.lit(False))), "\n")
    columns = [F.when(F.col("__goes").isNull(), F.col(f"`{c}`")).otherwise(remaining).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return found.filter(F.col("__goes").isNull() | (F.col("__stay") > 0)).select(*columns)
