"""How many sales of a nation are open at every moment, and what they are worth: a sweep over interval trees.

Time is cut into chunks of half a day. An interval leaves one piece in the chunk
of its start and one in that of its end; the chunks that it covers from end to end
know of it by sums only. Equal pieces are added up before they are shuffled, and a
chunk has 720 minutes, so a chunk's pieces are bounded by its minutes, however many
intervals there are. Of each nation's chunk a static centred interval tree is made:
a piece lies at the topmost node whose centre it holds, and a node has its pieces'
starts, and their ends, in order with running counts and cents. Each moment of change
walks down from the root and adds what one search in a list of each node on its
way tells. What is open through a whole chunk, the largest values so far and the
next moment of change come from the chunks' summaries, which are scanned by
groups of at most 256, so that no task has a nation's whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from tallywright.llm.common import cut

#: Seconds to which moments are rounded down, and minutes of a chunk.
GRAIN_S, CHUNK = 60, 720
#: Days that a sale stays open after the first of its lines is shipped (fixed value).
OPEN_DAYS = 7
#: Nation of a client without one or of no known client, and of all sales together (fixed values).
UNKNOWN, ALL = -1, -2
#: A client with more than one in so many sales is frequent: there are fewer such clients than this.
FREQUENT = 1_000
#: Chunks that a task of the scan has in a row, as a power of two: three levels hold 2**24 chunks, which is 22,000 years.
FAN = 8
#: Levels of a chunk's tree: its centres are the numbers 1 to 1023.
LEVELS = CHUNK.bit_length()
#: Keys that a node of a tree has for its endpoints: their minutes and, the other way round, those of the ends.
_SPAN = 4 << LEVELS
#: Pieces that a task takes up at a time, if a chunk does not have more.
ROWS_AT_ONCE = 1 << 16

_LONGS = pa.list_(pa.int64())
#: One row a chunk: its moments of change (minutes from its start), what is open then by the tree, and the largest n of it so far;
#: by how much the chunk changes what is open (d), and what of earlier intervals ends in it (x).
_CHUNK = pa.schema([
    ("nation", pa.int32()), ("chunk", pa.int64()), ("moments", pa.list_(pa.int32())), ("n", _LONGS), ("cents", _LONGS), ("highest", _LONGS), ("top_n", pa.int64()), ("top_cents", pa.int64()), ("first", pa.int32()),
    ("d_n", pa.int64()), ("d_cents", pa.int64()), ("x_n", pa.int64()), ("x_cents", pa.int64()),
])


def _div(value: Column, by: int) -> Column:
    """Whole parts, rounded down."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def grain_of(df: DataFrame, column: str) -> Column:
    """Minutes since 1970 of a time stamp, rounded down; one without a zone is UTC."""
    zoned = df.schema[column].dataType.typeName() == "timestamp"
    micros = F.unix_micros(column) if zoned else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return _div(micros, GRAIN_S * 1_000_000)


def _frequent(sales: DataFrame, nations: DataFrame) -> DataFrame:
    """``nations`` of the clients that more than one in ``FREQUENT`` sales have, which fewer than ``FREQUENT`` clients can."""
    least = sales.count() // FREQUENT
    often = sales.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return often.join(nations, F.col("client_id") == F.col("__client")).select(F.col("__client").alias("__often"), F.col("__nation").alias("__of_often"))


def _with_nation(rows: DataFrame, nations: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` (client_id, start, end, ...) with ``__nation``.

    Frequent clients' nations are sent to the tasks. In the join with the others,
    their rows, and those without a client, have keys of many kinds that no client
    has, so that no task gets all of them.
    """
    known = rows.join(F.broadcast(frequent), F.col("client_id") == F.col("__often"), "left")
    kind = F.when(F.col("client_id").isNull() | F.col("__often").isNotNull(), F.pmod(F.xxhash64("start", "end"), F.lit(1 << 20)) + 1).otherwise(0)
    # Zero, but no literal: that would be taken out of the join's key.
    joined = known.withColumn("__kind", kind).join(nations.withColumn("__own", F.pmod("__client", F.lit(1))), (F.col("client_id") == F.col("__client")) & (F.col("__kind") == F.col("__own")), "left")
    return joined.withColumn("__nation", F.coalesce("__of_often", "__nation"))


def sale_intervals(sales: DataFrame, sale_lines: DataFrame, clients: DataFrame) -> DataFrame:
    """nation, start, end, n, cents: open sales by nation and minute, each as of its nation and of ``ALL``; a null end is never."""
    lines = sale_lines.select("sale_id", grain_of(sale_lines, "shipped_at").alias("shipped"))
    shipped = lines.filter(F.col("sale_id").isNotNull() & F.col("shipped").isNotNull()).groupBy(F.col("sale_id").alias("__sale")).agg(F.min("shipped").alias("shipped"))
    worth = F.coalesce(F.when(F.isnan("total") | (F.abs("total") == float("inf")), F.lit(None)).otherwise(F.floor(100 * F.col("total") + 0.5)), F.lit(0)).cast("long")
    sold = sales.select("sale_id", "client_id", grain_of(sales, "sold_at").alias("start"), worth.alias("cents")).filter(F.col("start").isNotNull())
    dated = sold.join(shipped, F.col("sale_id") == F.col("__sale"), "left").withColumn("end", F.col("shipped") + OPEN_DAYS * 1440)
    alive = dated.filter(F.col("end").isNull() | (F.col("end") > F.col("start")))
    # A client's equal intervals are one before they meet the client.
    merged = alive.groupBy("client_id", "start", "end").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    nations = clients.filter(F.col("client_id").isNotNull()).groupBy(F.col("client_id").alias("__client")).agg(F.min("nation_id").alias("__nation"))
    placed = _with_nation(merged, nations, _frequent(sales, nations))
    each = F.explode(F.array(F.coalesce(F.col("__nation").cast("int"), F.lit(UNKNOWN)), F.lit(ALL))).alias("nation")
    return placed.select(each, "start", "end", "n", "cents")


def pieces(intervals: DataFrame) -> DataFrame:
    """nation, chunk, lo, hi, starts, ends, n, cents: what intervals leave in the chunks of their start and end, equal pieces added up.

    ``lo`` and ``hi`` are minutes of the chunk; ``starts`` and ``ends`` tell
    whether the interval itself does there. An interval that ends with a chunk's
    first minute leaves a piece without length in it.
    """
    chunk = lambda c: _div(F.col(c), CHUNK)
    at = lambda c: F.pmod(F.col(c), F.lit(CHUNK)).cast("int")
    one = F.col("end").isNotNull() & (chunk("start") == chunk("end"))
    row = lambda c, lo, hi, starts, ends: F.struct(c.alias("chunk"), lo.alias("lo"), hi.alias("hi"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"))
    begun = row(chunk("start"), at("start"), F.lit(CHUNK), True, False)
    made = F.when(one, F.array(row(chunk("start"), at("start"), at("end"), True, True))).when(F.col("end").isNull(), F.array(begun)).otherwise(F.array(begun, row(chunk("end"), F.lit(0), at("end"), False, True)))
    spread = intervals.select("nation", F.explode(made).alias("p"), "n", "cents").select("nation", "p.*", "n", "cents")
    return spread.groupBy("nation", "chunk", "lo", "hi", "starts", "ends").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


class IntervalForest:
    """Static centred interval trees over weighted pieces [lo, hi) of the minutes 0 to CHUNK - 1, any number of trees in one set of arrays.

    Minutes count from 1 here, and the node of a piece is the number within it
    that has the most zeros at its binary end: the topmost centre that it holds.
    """

    def __init__(self, tree: np.ndarray, lo: np.ndarray, hi: np.ndarray, weights: list[np.ndarray]) -> None:
        has = hi > lo
        tree, lo, last, weights = tree[has], lo[has].astype(np.int64) + 1, hi[has].astype(np.int64), [w[has] for w in weights]
        # The highest bit in which the number before the piece differs from its last: below it, zeros are free to choose.
        height = np.frexp(((lo - 1) ^ last).astype(np.float64))[1] - 1
        node = tree << LEVELS | (last >> height) << height
        self.by_start, self.starts = self._list(node, lo, weights)
        self.by_end, self.ends = self._list(node, -last, weights)

    @staticmethod
    def _list(node: np.ndarray, at: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Endpoint lists of all nodes in one array of keys, each with the running sums of the weights."""
        keys = node * _SPAN + at
        order = np.argsort(keys, kind="stable")
        return keys[order], [np.concatenate(([0], np.cumsum(w[order]))) for w in weights]

    def stab(self, tree: np.ndarray, moments: np.ndarray) -> list[np.ndarray]:
        """Sums of the weights of the pieces of ``tree`` that hold each of ``moments``."""
        at = moments.astype(np.int64) + 1
        found = [np.zeros(len(at), np.int64) for _ in self.starts]
        walking = np.arange(len(at))
        for height in range(LEVELS - 1, -1, -1):
            # The moment's own node, or the one above it, at this height.
            node = (at[walking] >> height | 1) << height
            left = at[walking] < node
            # Left of a centre a node's pieces count that have begun, right of it those that have not ended.
            for side, keys, sums, sign in ((left, self.by_start, self.starts, 1), (~left, self.by_end, self.ends, -1)):
                who = walking[side]
                base = (tree[who] << LEVELS | node[side]) * _SPAN
                begin, stop = np.searchsorted(keys, base - _SPAN // 2, "left"), np.searchsorted(keys, base + sign * at[who], "right")
                for out, s in zip(found, sums):
                    out[who] += s[stop] - s[begin]
            walking = walking[at[walking] != node]
        return found


def swept_chunks(of: pa.Table) -> pa.RecordBatch:
    """The row of each nation's chunk, out of its pieces, which stand together."""
    nation, chunk, lo, hi, starts, ends, n, cents = (of.column(c).to_numpy() for c in ("nation", "chunk", "lo", "hi", "starts", "ends", "n", "cents"))
    fresh = np.concatenate(([True], (nation[1:] != nation[:-1]) | (chunk[1:] != chunk[:-1])))
    tree, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    places, place = np.unique(np.concatenate((tree[starts] * CHUNK + lo[starts], tree[ends] * CHUNK + hi[ends])), return_inverse=True)
    whole, changed = [], np.zeros(len(places), bool)
    for w in (n, cents):
        moved = np.zeros(len(places), np.int64)
        np.add.at(moved, place, np.concatenate((w[starts], -w[ends])))
        changed |= moved != 0
        for at, by in ((places // CHUNK, moved), (tree[ends & ~starts], w[ends & ~starts])):
            whole.append(np.zeros(len(heads), np.int64))
            np.add.at(whole[-1], at, by)
    own, moments = places[changed] // CHUNK, places[changed] % CHUNK
    open_n, open_cents = IntervalForest(tree, lo, hi, [n, cents]).stab(own, moments)
    # The largest so far within each chunk: a chunk's numbers lie above all of those before it.
    over = own * (int(open_n.max(initial=0)) + 1)
    highest = np.maximum.accumulate(open_n + over) - over
    edges = np.searchsorted(own, np.arange(len(heads) + 1))
    none = edges[:-1] == edges[1:]
    tops = [np.maximum.reduceat(np.append(v, 0), np.minimum(edges[:-1], len(v))) for v in (open_n, open_cents)]
    first = np.append(moments, 0)[np.minimum(edges[:-1], len(moments))]
    lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v, f.type.value_type)) for v, f in zip((moments, open_n, open_cents, highest), list(_CHUNK)[2:6])]
    told = [pa.array(v, f.type, mask=none) for v, f in zip((*tops, first), list(_CHUNK)[6:9])]
    return pa.RecordBatch.from_arrays([pa.array(nation[heads], pa.int32()), pa.array(chunk[heads], pa.int64()), *lists, *told, *(pa.array(whole[i], pa.int64()) for i in (0, 2, 1, 3))], schema=_CHUNK)


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of (nation, chunk) out of rows in that order, about ``ROWS_AT_ONCE`` at a time."""
    done: list[pa.RecordBatch] = []
    going: list[pa.RecordBatch] = []
    rows = 0
    for one in batches:
        if not one.num_rows:
            continue
        nation, chunk = one.column("nation").to_numpy(), one.column("chunk").to_numpy()
        changes = np.flatnonzero((nation[1:] != nation[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        same = bool(going) and (going[-1].column("nation")[-1].as_py(), going[-1].column("chunk")[-1].as_py()) == (int(nation[0]), int(chunk[0]))
        if same and not len(changes):
            going.append(one)
            continue
        last = int(changes[-1]) if len(changes) else 0
        done += [*going, one.slice(0, last)]
        going = [one.slice(last)]
        rows = sum(b.num_rows for b in done)
        if rows >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(done)
            done = []
    if done or going:
        yield pa.Table.from_batches([*done, *going])


def swept(rows: DataFrame) -> DataFrame:
    """``_CHUNK`` rows of :func:`pieces`: each task has whole chunks, in order, and sweeps many of them at a time."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _complete(batches):
            yield swept_chunks(groups)

    return rows.repartition("nation", "chunk").sortWithinPartitions("nation", "chunk").mapInArrow(sweep, from_arrow_schema(_CHUNK))


def scanned(chunks: DataFrame) -> DataFrame:
    """nation, chunk, cover_n, cover_cents (open through the whole chunk), before (largest n of earlier chunks), next_first, peak of each row of ``_CHUNK``.

    Sums and maxima go up three levels of groups of 256 and come down again.
    """
    rows = chunks.select("nation", "chunk", "d_n", "d_cents", "x_n", "x_cents", (F.col("top_n") - F.col("x_n")).alias("m_n"), (F.col("top_cents") - F.col("x_cents")).alias("m_cents"), (F.col("chunk") * CHUNK + F.col("first")).alias("begins"))
    levels, at = [], "chunk"
    for level in range(3):
        above = f"g{level + 1}"
        grouped = rows.withColumn(above, F.shiftright(at, FAN) if level < 2 else F.lit(0).cast("long"))
        window = Window.partitionBy("nation", above).orderBy(at)
        before, after = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(1, Window.unboundedFollowing)
        summed = grouped.withColumns({"p_n": F.coalesce(F.sum("d_n").over(before), F.lit(0)), "p_cents": F.coalesce(F.sum("d_cents").over(before), F.lit(0)), "next": F.min("begins").over(after)})
        summed = summed.withColumn("high", F.max(F.col("p_n") + F.col("m_n")).over(before))
        levels.append(summed)
        rows = summed.groupBy("nation", above).agg(
            F.sum("d_n").alias("d_n"), F.sum("d_cents").alias("d_cents"), F.max(F.col("p_n") + F.col("m_n")).alias("m_n"), F.max(F.col("p_cents") + F.col("m_cents")).alias("m_cents"), F.min("begins").alias("begins"),
        )
        at = above
    # The one group of the third level holds the nation's largest value.
    down = rows.select("nation", F.lit(0).cast("long").alias("g3"), F.col("m_cents").alias("peak"), F.lit(0).cast("long").alias("b_n"), F.lit(0).cast("long").alias("b_cents"), F.lit(None).cast("long").alias("b_high"), F.lit(None).cast("long").alias("b_next"))
    for level in (2, 1, 0):
        above, at = f"g{level + 1}", "chunk" if level == 0 else f"g{level}"
        joined = levels[level].join(down, ["nation", above])
        start = {"b_high": F.greatest("b_high", F.col("high") + F.col("b_n")), "b_next": F.coalesce("next", "b_next"), "b_n": F.col("b_n") + F.col("p_n"), "b_cents": F.col("b_cents") + F.col("p_cents")}
        down = joined.select("nation", at, "peak", *[v.alias(c) for c, v in start.items()], *(["x_n", "x_cents"] if level == 0 else []))
    return down.select("nation", "chunk", (F.col("b_n") - F.col("x_n")).alias("cover_n"), (F.col("b_cents") - F.col("x_cents")).alias("cover_cents"), F.col("b_high").alias("before"), F.col("b_next").alias("next_first"), "peak")


def concurrency(intervals: DataFrame) -> DataFrame:
    """A row for each nation and moment at which what is open changes: nation, start, end, n, cents, high, is_peak, in minutes.

    ``intervals`` has nation, start, end (null: never), n and cents, the end after
    the start. A moment at which starts and ends cancel out in both sums is none.
    ``end`` is the nation's next moment, null for its last; ``high`` the largest n
    so far. Repeated rows count each; an empty table gives none.
    """
    # Each chunk's row is written once and read for the scan and for the result.
    chunks = cut(swept(pieces(intervals)))
    whole = chunks.join(scanned(chunks), ["nation", "chunk"])
    following = F.slice("moments", 2, CHUNK)
    each = F.inline(F.arrays_zip("moments", F.col("n").alias("n"), "cents", "highest", following.alias("following"))).alias("moment", "n", "cents", "highest", "following")
    minute = lambda c: F.col("chunk") * CHUNK + F.col(c)
    return whole.select("nation", "chunk", "cover_n", "cover_cents", "before", "next_first", "peak", each).select(
        "nation", minute("moment").alias("start"), F.coalesce(minute("following"), "next_first").alias("end"), (F.col("n") + F.col("cover_n")).alias("n"), (F.col("cents") + F.col("cover_cents")).alias("cents"),
        F.greatest("before", F.col("highest") + F.col("cover_n")).alias("high"), (F.col("cents") + F.col("cover_cents") == F.col("peak")).alias("is_peak"),
    )


def sales_concurrency(sales: DataFrame, sale_lines: DataFrame, clients: DataFrame) -> DataFrame:
    """nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak: :func:`concurrency` of sales, in seconds.

    Each row of ``sales`` is a sale, repeated ones too; one without a start, or
    that ends before or with it, takes no part, one without a shipped line never
    ends. A total that is null or not finite counts nothing. A client named by
    several rows has the smallest of their nations.
    """
    seconds = lambda c: (F.col(c) * GRAIN_S).alias("s")
    rows = concurrency(sale_intervals(sales, sale_lines, clients))
    return rows.select(F.col("nation").alias("nation_id"), seconds("start").alias("from_s"), seconds("end").alias("to_s"), F.col("n").alias("n_open"), F.col("cents").alias("open_cents"), F.col("high").alias("high_open"), "is_peak")
