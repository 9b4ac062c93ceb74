"""Shared pieces of the corpus operators: the shared folder, written tables and word rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a local
    session gets a fresh temporary folder; on a cluster an unset folder is an
    error, since a machine's own disk is invisible to the other machines.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files: else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage
    ends there, and a lost executor costs no recomputation of what came before.
    ``held`` gets the table's place, for ``released``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if held is not None:
        held.append(path)
    with shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, held: list[str]) -> None:
    """Delete the tables at these places, which nothing reads any more, and forget the places."""
    context = spark.sparkContext
    while held:
        path = context._jvm.org.apache.hadoop.fs.Path(held.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text) -> F.Column:
    """Words of a text column as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> str:
    """The columns of ``df`` as the start of a schema, whatever their names."""
    return "".join(f"{quoted(c)} {t}, " for c, t in df.dtypes)


#: Most bytes of rows that a Python worker is handed at once.
BATCH_BYTES = "1m"


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python workers by ``BATCH_BYTES``, unless it has a bound
    of its own: else 10,000 long texts lie in the worker at once and twice in its executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


#: How to free what the tasks of a module keep in a worker for later ones, by module.
KEPT: dict[str, Callable[[], None]] = {}


def free_others(module: str) -> None:
    for name, free in KEPT.items():
        if name != module:
            free()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which frees what other modules' tasks kept when a task begins, and gives
    what it no longer needs back to the machine when it ends: a Python worker lives on for other
    stages, beside others."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_others(run.__module__)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task
