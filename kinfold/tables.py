"""Written intermediates and files on the store that driver and executors share.

Everything goes through the Hadoop file system, so a folder may be on any store that Spark
reads: no local path is assumed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order numbers of a bucket in which rows are ranked at once.
SPAN = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that
    is unset the warehouse on a cluster and one temporary folder a session in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="kinfold-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinfold"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str = "table") -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written to the shared folder, and read again: plans over it are cut there,
    its size is known to the planner, and a lost executor costs a re-read."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that no plan to come reads."""
    for df in tables:
        if path := getattr(df, "_written", None):
            Store(df.sparkSession).delete(path)


class Store:
    """Small files and folders by their path or URI."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, folder: str) -> list[tuple[str, bool]]:
        """Name and whether it is a folder of what a folder holds; of one that is not there, nothing."""
        fs, at = self._at(folder)
        return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file; one that is there is an error."""
        fs, at = self._at(path)
        fs.setWriteChecksum(False)  # of a local store: no side file beside each
        try:
            stream = fs.create(at, False)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
        finally:
            fs.setWriteChecksum(True)

    def copy(self, old: str, new: str) -> None:
        """A file to a new place, on the same store or another."""
        (fs, at), (other, to) = self._at(old), self._at(new)
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, other, to, False, False, self.conf):
            raise OSError(f"{new} was not written")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def make(self, folder: str) -> None:
        fs, at = self._at(folder)
        fs.mkdirs(at)

    def qualified(self, path: str) -> str:
        """The path as the store's own URI, as file scans report it."""
        fs, at = self._at(path)
        return fs.makeQualified(at).toString()


def numbered(df: DataFrame, order: list[str], out: str, label: str = "numbered") -> DataFrame:
    """``df`` written in the order of some columns, with a number that rises with it."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(spread.withColumn(out, F.monotonically_increasing_id()), label)


def placed(df: DataFrame, by: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """``df`` with the place (from 0) of each row within ``by`` by a whole number that has
    no ties: rows are ranked in buckets of ``span`` numbers, and the buckets' counts summed."""
    bucket = F.floor(F.col(order) / span).cast("long")
    counts = df.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by], bucket.alias("__in")).agg(F.count(F.lit(1)).alias("__n"))
    lower = Window.partitionBy(*[f"__of_{c}" for c in by]).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(lower), F.lit(0))).drop("__n")
    inside = df.withColumn("__bucket", bucket)
    inside = inside.withColumn("__place", F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(order)) - 1)
    same = F.col("__bucket") == F.col("__in")
    for c in by:
        same = same & (F.col(c) == F.col(f"__of_{c}"))
    return inside.join(starts, same).withColumn(out, F.col("__place") + F.col("__start")).select(*df.columns, out)
