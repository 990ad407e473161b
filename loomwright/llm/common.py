"""Shared pieces of the training-data operators: table reads, scratch tables, fixed predicates."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words everywhere in this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
#: The ASCII capitals and their small letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomwright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then renamed, so that no reader meets half of it."""
    store, where = _store(spark, path)
    beside = where.suffix(f".{uuid.uuid4().hex}")
    out = store.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    store.delete(where, False)
    if not store.rename(beside, where):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's content, None if there is no such file."""
    store, where = _store(spark, path)
    if not store.exists(where):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def _remove(spark: SparkSession, path: str) -> None:
    store, where = _store(spark, path)
    store.delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now; the folder is scratch
            continue


def thrifty(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on Arrow batches, after which the Python worker, which lives on, gives the memory that it freed back to the system."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)

    return done


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    _remove(spark, path)
    _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes a query's shuffle files as soon as the query has ended; what follows reads what it wrote."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def saved(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    with tidy(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables made by `saved` whose every use has been written."""
    for df in frames:
        drop_scratch(df.sparkSession, df._scratch)
