"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are held out of training.
FOLDS = 5
#: Bytes of text that an operator takes up at a time: what it works out of them leaves before it goes on.
SLICE_BYTES = 1 << 18
#: The same where texts step on together, word by word or line by line, and a step should have many.
STEPPED_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only in local mode, where there is one machine, may it be unset: then it is a
    folder below the warehouse. On a cluster that would be a folder of one of many.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


#: Tables that are written within a :func:`scratch`, innermost last.
_WRITTEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what :func:`cut` has written within: results that are read after it have to be written before.

    Operators give their results as plans that read such tables, so they can't
    delete them themselves.
    """
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it from there.

    A table, not ``checkpoint()``: that keeps the plan's estimate of its size,
    and through rounds of joins the estimates multiply until the numbers alone
    fill the driver and the tasks. A table is planned by the size it has.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever the cluster's file systems have it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_cut(*frames: DataFrame) -> None:
    """Deletes tables that :func:`cut` wrote, when nothing reads them any more."""
    for df in frames:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            delete(df.sparkSession, path)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_rows(df: DataFrame, keys: list[str], rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, the first in the order of a seeded hash of ``keys``.

    A top-k, so each task keeps ``rows`` at most and no full sort is made.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), *keys).limit(rows)


def sliced(one: pa.RecordBatch, at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``one``, without a copy, of about ``most`` bytes in the column ``at``, and of a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(one.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    start = 0
    while start < one.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield one.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Spark keeps its Python workers for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_pass(docs: DataFrame, text: str, keep: list[str] | None, outputs: list[tuple[T.StructField, pa.DataType]], work: Callable[[], Callable[[list[str]], Sequence]], most: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with ``outputs`` made from ``text``, in one pass without a shuffle.

    ``work`` is called once in a task and gives what turns texts (a null is '')
    into the columns of the outputs. ``keep`` names the columns that stay (all by
    default); one that has the name of an output is replaced. The text is sent
    once, stays or not, and is taken up by slices of ``SLICE_BYTES``, so what a
    task holds besides an Arrow batch does not grow with the batch; a longer
    text is a slice of its own.
    """
    names = [f.name for f, _ in outputs]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    sent = kept if text in kept else [*kept, text]
    at = sent.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = work()
        for one in batches:
            for part in sliced(one, at, most):
                found = of([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *(pa.array(c, t) for c, (_, t) in zip(found, outputs))], names=[*kept, *names])
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(made, T.StructType([docs.schema[c] for c in kept] + [f for f, _ in outputs]))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads every input bit over 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_POWERS["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``units[starts:ends]``; equal spans have equal hashes wherever they lie."""
    up, down = _powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def code_points(texts: Iterable[str], joint: str = "\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' code points in one array, ``joint`` after each, with each text's start and end."""
    texts = list(texts)
    units = np.frombuffer((joint.join(texts) + joint).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + len(joint), out=starts[1:])
    return units, starts, starts + lengths


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[0::2], edges[1::2]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of ``columns`` (arrays or sequences) as ``schema`` types them."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, f in zip(columns, schema)], schema=schema)
