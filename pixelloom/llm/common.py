"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a Java/Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``. A file of few row groups gives fewer tasks than there are cores; its rows are then dealt to all."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between runs of space characters; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where none is."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not path:
        path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="shared-")
    return path.rstrip("/")


#: Paths of the tables that each open ``settled`` has staged, the innermost last.
_open: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and any executor can go.

    The files are removed when the ``settled`` around ends, else when the session's JVM does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop, files = _file_system(spark, path)
    files.deleteOnExit(hadoop)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make, tag: str) -> DataFrame:
    """``make()`` staged; the tables that were staged on the way are removed once it is written."""
    _open.append([])
    try:
        df = make()
        held = _open.pop()
    except BaseException:
        _open.pop()
        raise
    try:
        return staged(df, tag)
    finally:
        for path in held:
            hadoop, files = _file_system(spark, path)
            files.delete(hadoop, True)


#: Above so many rows a small side is no longer broadcast but shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (a staged table) with a broadcast hint if its row count allows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spans_of_bytes(texts: pa.Array, most: int = 8 << 20) -> list[tuple[int, int]]:
    """(start, stop) of runs of texts that hold about ``most`` bytes, one text at least; nulls have none."""
    if not len(texts):
        return []
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.searchsorted(ends, np.arange(most, int(ends[-1]) + 1, most), side="left") + 1).tolist()
    cuts = [0, *(c for c in cuts if c < len(texts)), len(texts)]
    return list(zip(cuts, cuts[1:], strict=False))


#: Text that goes to a Python worker at once.
BATCH_BYTES = 8 << 20


def in_arrow(rows: DataFrame, run, schema) -> DataFrame:
    """``rows.mapInArrow`` for long texts: small batches, and memory given back when a task ends.

    The session's bound on the bytes of an Arrow batch is lowered to ``BATCH_BYTES`` where it is higher.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(name)).lower().rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return rows.mapInArrow(_lean(run), schema)


def _lean(run):
    @functools.wraps(run)
    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean


def give_back() -> None:
    """Returns freed memory to the system; Python workers are used again and would hold it through all later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
