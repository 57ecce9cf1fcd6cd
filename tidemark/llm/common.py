"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals and their small letters, for F.translate.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Set where spark.checkpoint.dir is not and the master is one machine, as in tests.
LOCAL_DIR = "/tmp/tidemark-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. One of our own only where none is set and the master is
    this machine, as in tests; elsewhere that is an error, as executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = LOCAL_DIR
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_cleared: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of this application that goes when the driver ends (see clear)."""
    top = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if top not in _cleared:
        _cleared.add(top)
        atexit.register(clear, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession, top: str | None = None) -> None:
    """Deletes what this application stored in the shared folder; frames that still read it can't be used any more."""
    with suppress(Exception):  # at the driver's end the context may be gone
        top = top or f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Runs the plan once into a Parquet table in the shared folder and returns that: a lost executor recomputes nothing above
    it, and columns can be pruned when it is read again.

    Rows are counted as they are written; `rows_of` then needs no job of its own. A table's statistics are its files'
    sizes; those of a checkpoint are its plan's estimates, which grow as products from join to join until planning stops.
    """
    path, seen = scratch(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rows_written = seen.get["n"]
    return out


def materialise(df: DataFrame) -> DataFrame:
    """stored, for a step of a plan."""
    return stored(df, "step")


def rows_of(df: DataFrame) -> int | None:
    """The rows of what stored returned; None for other frames."""
    return getattr(df, "_rows_written", None)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows for what runs meanwhile: for rows of long texts, or of two."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


#: Bytes of an Arrow batch that goes to a Python worker, and of the rows that are worked on at a time, from which on no row
#: is added; rows of these at most.
BATCH_BYTES, PART_BYTES, PART_ROWS = 4 << 20, 2 << 20, 1024


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold at most BATCH_BYTES bytes, unless a lower bound is set already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with suppress(Exception):  # a Spark without that setting bounds rows only
        if not 0 < int(str(spark.conf.get(name)).rstrip("bB")) <= BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most PART_ROWS rows, and some PART_BYTES bytes or one row."""
    sizes = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, min(at + PART_ROWS, int(np.searchsorted(ends, before + PART_BYTES, "right"))))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Hands freed memory back to the system: Python workers live on after a task, and so would what they once held."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[list], list]], schema: str) -> DataFrame:
    """Arrow batches of `columns` through make()(lists of their values) -> lists (or Arrow arrays) of the output's columns.

    make runs once per task, on the executor: models and vocabularies are loaded there. Batches are bounded by rows and
    bytes and worked on in parts; nothing outlives a part but what make keeps.
    """
    target = _arrow_schema(df.sparkSession, schema)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            for part in _parts(batch):
                out = f(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in zip(out, target, strict=True)], schema=target)
        del f
        give_back()

    return df.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def lowered(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column that is computed once a row, however often later expressions refer to it.

    Catalyst may copy a projected expression into each use, lambdas included; it doesn't copy one through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Rows, and elements or characters in rows of varying size, of a key table that are broadcast at most: some 20 MB.
#: Beyond either, joins shuffle.
BROADCAST_ROWS, BROADCAST_WEIGHT = 200_000, 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> bool:
    """Whether a materialised table has at most so many rows, and those a total weight within BROADCAST_WEIGHT."""
    known = rows_of(df)
    if known is not None and (known > rows or weight is None):
        return known <= rows
    r = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(weight if weight is not None else F.lit(0)).alias("w")).first()
    return r["n"] <= rows and (r["w"] or 0) <= BROADCAST_WEIGHT


def joined(df: DataFrame, keys: DataFrame, on: list[str], how: str, weight: Column | None = None) -> DataFrame:
    """df joined with a materialised key table on columns that may be null (null equals null).

    The key table is broadcast if a count finds it small, so that df stays where it is; else both sides are shuffled,
    and Spark splits the tasks of hot keys. weight: of a row of keys, where rows hold arrays.
    """
    right = keys.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        match = same if match is None else match & same
    out = df.join(F.broadcast(right) if small(keys, weight=weight) else right, match, how)
    return out.drop(*[f"_r_{c}" for c in on]) if how in ("inner", "left") else out


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """_row, all of df's columns in a struct, beside new columns, whose names then can't clash with df's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, as an array."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
