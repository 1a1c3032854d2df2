"""Helpers shared by the training-data operators.

Tables that cut a plan (materialised intermediates) are written as Parquet below the
folder named by ``spark.checkpoint.dir``, which all executors share, so a lost executor
costs a re-read and not a recomputation from lost local state.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a side of a join may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: White space of word splitting: space, and the control characters 0x09 to 0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or where that is
    unset the warehouse on a cluster and a temporary folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="kinfold-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinfold"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The planner knows the size of a written table, so whether a later join broadcasts it
    is decided by ``spark.sql.autoBroadcastJoinThreshold`` and not by the caller.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialise` wrote and that no plan to come reads."""
    for df in tables:
        if path := getattr(df, "_written", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows; looks at no more than ``limit + 1``."""
    return df.limit(limit + 1).count() <= limit


def without(docs: DataFrame, removed: DataFrame, on: list[tuple[Column, str]]) -> DataFrame:
    """Rows of ``docs`` that have no partner in ``removed``.

    ``on`` pairs an expression over ``docs`` with a column of ``removed``; null equals
    null. ``removed`` is broadcast only if it was counted to be within
    ``BROADCAST_ROWS``; else both sides are shuffled. Column names cannot clash, since
    the removed side is renamed and only its keys are read.
    """
    return _semi(docs, removed, on, "left_anti")


def within(docs: DataFrame, wanted: DataFrame, on: list[tuple[Column, str]]) -> DataFrame:
    """Rows of ``docs`` that have a partner in ``wanted``; see :func:`without`."""
    return _semi(docs, wanted, on, "left_semi")


def _semi(docs: DataFrame, other: DataFrame, on: list[tuple[Column, str]], how: str) -> DataFrame:
    side = other.select(*[F.col(name).alias(f"__key_{i}") for i, (_, name) in enumerate(on)])
    small = bounded(side)
    if small:
        side = F.broadcast(side)
    condition = None
    for i, (left, _) in enumerate(on):
        one = left.eqNullSafe(F.col(f"__key_{i}"))
        condition = one if condition is None else condition & one
    return docs.join(side, condition, how)


def keep_marked(docs: DataFrame, marks: DataFrame, id_key: Column, text_key: Column) -> DataFrame:
    """``docs`` without the rows that ``marks`` (id, text_key, kept; a row per row of
    ``docs``) does not keep, in their own columns.

    Which rows go was decided on narrow rows; here the documents are read once more and
    filtered, so texts move only where the dropped rows are too many to broadcast. Of
    rows alike in id and text of which some are kept, as many as one stays.
    """
    seen = marks.groupBy("id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    seen = materialise(seen.filter("not kept or times > 1"), "marks")
    on = [(id_key, "id"), (text_key, "text_key")]
    left = without(docs, seen.filter("not kept"), on)
    repeated = seen.filter("kept")
    if repeated.isEmpty():
        return left
    once = within(left, repeated, on).withColumns({"__id": id_key, "__text": text_key}).dropDuplicates(["__id", "__text"]).drop("__id", "__text")
    return without(left, repeated, on).unionByName(once)


def release() -> None:
    """Give freed memory of a Python worker back: workers stay between stages, and what
    their allocators hold counts against the executor while others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    Inside a lambda Spark would evaluate an outer expression again for each element; a
    one-element array binds it to a lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
