"""What the training-data operators share: staged tables, tasks in Python workers, slicing of Arrow batches, hashes."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexitide.sources.shared import stage, unstage

_ROOT = str(Path(__file__).resolve().parents[2])

#: Rows and bytes of one Arrow batch sent to a Python worker; a row longer than that is a batch of its own. Buffers are
#: allocated by many threads of an executor, each of which keeps about as much as its largest batch took.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small, in rows and in bytes."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, noting that it is read from staged tables: unstage(df) deletes them."""
    df._staged_at = [p for t in tables for p in getattr(t, "_staged_at", [])]
    return df


def settle(df: DataFrame, name: str, *tables: DataFrame) -> DataFrame:
    """df as a staged table, with the staged tables that it was made from deleted."""
    out = stage(df, name)
    unstage(*tables)
    return out


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They go as Arrow: rows of Python objects are unpickled by executors, each
    with Python workers and a daemon beside those of Arrow tasks."""
    kinds = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow), kinds)


#: Numbers that rows are sifted by.
SIFT_NUMBERS = 1 << 20


def sift(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of wanted, rows that surely have none), told apart before any shuffle by the keys modulo
    SIFT_NUMBERS: a table of at most so many numbers is broadcast, whatever the number of keys. Keys are long."""
    number = lambda c: F.pmod(F.coalesce(c, F.lit(0)), F.lit(SIFT_NUMBERS)).cast("int")
    numbers = F.broadcast(wanted.select(number(wanted_key).alias("_number")).distinct())
    on = number(key) == F.col("_number")
    return rows.join(numbers, on, "left_semi"), rows.join(numbers, on, "left_anti")


def named(df: DataFrame, *made: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """df without columns of the names (in any case) that an operator gives to its own: its column takes the place of
    one that the input brings. It is an error if the operator needs such a column."""
    mine = {m.lower() for m in made}
    if clash := [c for c in needs if c.lower() in mine]:
        raise ValueError(f"the columns {clash} have names of the result; rename them")
    return df.drop(*[c for c in df.columns if c.lower() in mine])


def apart(df: DataFrame, *wanted: str) -> tuple[str, ...]:
    """Names for helper columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from the hash of cols and seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)).cast("double") / F.lit(float(1 << 53))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as held out, so that nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(True))


def runs(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes of a string or binary column."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column without nulls, in its data buffer."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(column.buffers()[1], dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as uint8, and the offsets of its rows in them. Nulls must be filled before."""
    off = offsets_of(column)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_holders: dict[str, Callable[[], None]] = {}


def only(name: str, clear: Callable[[], None] | None = None) -> None:
    """A Python worker, which Spark uses again for other tasks, keeps the caches of one operator at a time; clear empties
    those of this one when another takes over."""
    others = [k for k in _holders if k != name]
    for k in others:
        _holders.pop(k)()
    if others:
        gc.enable()
        trim()
    if clear is not None:
        _holders[name] = clear


def trim() -> None:
    """Give freed memory back to the system; workers that wait for other tasks would keep it, and so would the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: freed memory stays with the worker
        pass


Batches = Iterator[pa.RecordBatch]


def task(name: str, run: Callable[[Batches], Batches], clear: Callable[[], None] | None = None) -> Callable[[Batches], Batches]:
    """run as the tasks of an operator: each begins by emptying the caches that other operators left in its worker, and
    ends by giving freed memory back. clear empties what run itself keeps from task to task."""

    def whole(batches: Batches) -> Batches:
        only(name, clear)
        try:
            yield from run(batches)
        finally:
            gc.enable()
            trim()

    return whole
