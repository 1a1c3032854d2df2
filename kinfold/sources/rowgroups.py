"""Listed row groups of Parquet files as a Spark data source: ``format("row_groups")``.

An index names the row groups that hold a cluster. A partition of the source is one listed
row group, and nothing else of the files is read: not even a footer's statistics decide, so
the index may be of tables that are not sorted by cluster. Equality and membership filters
are pushed to the reader, which drops other rows before they reach Spark. Groups are
numbered over all files of a folder in the order of their names. Stores are those that
pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..errors import InputError, IntegrityError
from ..operators.imports import row_groups

#: The column that says which row group a row is from.
GROUP = "_row_group"
#: Clusters that one extraction may ask for.
MOST_CLUSTERS = 1_000


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[object, list[str]]:
    from pyarrow import fs

    store, place = _store(path)
    if store.get_file_info(place).type == fs.FileType.File:
        return store, [place]
    found = [i.path for i in store.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File and i.base_name.endswith(".parquet")]
    if not found:
        raise InputError(f"{path}: no Parquet file")
    return store, sorted(found)


class _Group(InputPartition):
    def __init__(self, file: str, at: int, number: int) -> None:
        self.file, self.at, self.number = file, at, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.asked, self.columns = options["path"], options.get("groups", ""), [f.name for f in schema.fields]
        self.filters: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] != GROUP:
                self.filters.append((f.attribute[0], (f.value,)))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] != GROUP:
                self.filters.append((f.attribute[0], tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[_Group]:
        store, files = _files(self.path)
        every, n = [], 0
        for file in files:
            with store.open_input_file(file) as stream:
                count = pq.ParquetFile(stream).num_row_groups
            every += [_Group(file, k, n + k) for k in range(count)]
            n += count
        if not self.asked:
            return every
        wanted = row_groups(self.asked)
        if wanted and wanted[-1] >= n:
            raise InputError(f"{self.path} has {n} row groups, not {wanted[-1] + 1}")
        return [every[k] for k in wanted]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as stream:
            own = [c for c in self.columns if c != GROUP]
            for batch in pq.ParquetFile(stream).iter_batches(batch_size=8192, row_groups=[partition.at], columns=own):
                for name, values in self.filters:
                    column = batch.column(batch.schema.names.index(name))
                    batch = batch.filter(pc.is_in(column, value_set=pa.array(values, column.type)))
                group = pa.array([partition.number] * batch.num_rows, pa.int32())
                columns = {c: batch.column(batch.schema.names.index(c)) for c in own} | {GROUP: group}
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], names=self.columns)


class RowGroupSource(DataSource):
    """Options: path (a file or a folder); groups, a list with commas, or all without it."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> StructType:
        store, files = _files(self.options["path"])
        with store.open_input_file(files[0]) as stream:
            own = from_arrow_schema(pq.ParquetFile(stream).schema_arrow)
        return StructType([*own.fields, StructField(GROUP, IntegerType())])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)


def read_groups(spark: SparkSession, path: str, groups: tuple[int, ...] | None = None) -> DataFrame:
    """Rows of the listed row groups (of all without a list), with their group's number."""
    spark.dataSource.register(RowGroupSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("row_groups")
    if groups is not None:
        if not groups:
            raise InputError("no row group is asked for")
        reader = reader.option("groups", ",".join(map(str, groups)))
    return reader.load(path)


def index_groups(spark: SparkSession, path: str, cluster: str) -> DataFrame:
    """cluster_id, member_count and row_groups (a list with commas) of a table's clusters."""
    per = read_groups(spark, path).groupBy(F.col(cluster).cast("string").alias("cluster_id"), GROUP).agg(F.count(F.lit(1)).alias("n"))
    groups = F.array_join(F.transform(F.array_sort(F.collect_list(GROUP)), lambda g: g.cast("string")), ",")
    return per.groupBy("cluster_id").agg(F.sum("n").alias("member_count"), groups.alias("row_groups"))


def extract_indexed(
    spark: SparkSession, path: str, index: DataFrame, cluster_ids: tuple[str, ...], cluster: str, identifier: str, most_members: int = 8_000_000
) -> DataFrame:
    """The members of whole clusters from the row groups that ``index`` (cluster_id,
    member_count, row_groups) names for them, with ``_row_group``.

    One to a thousand clusters, each once in the index with a count of 1 or more; counts
    that differ from the index and identifiers that come twice are errors.
    """
    wanted = sorted(set(cluster_ids))
    if not 1 <= len(wanted) <= MOST_CLUSTERS:
        raise InputError(f"between 1 and {MOST_CLUSTERS} clusters at once")
    rows = index.filter(F.col("cluster_id").isin(wanted)).select("cluster_id", "member_count", "row_groups").limit(2 * MOST_CLUSTERS + 1).collect()  # a row a cluster asked for
    if sorted(r["cluster_id"] for r in rows) != wanted:
        raise InputError("a cluster is not in the index, or more than once")
    if any(r["member_count"] is None or r["member_count"] < 1 for r in rows):
        raise IntegrityError("the index has counts that are none")
    if sum(r["member_count"] for r in rows) > most_members:
        raise InputError(f"more than {most_members} members; ask for fewer clusters")
    groups = sorted({g for r in rows for g in row_groups(r["row_groups"] or "")})
    if not groups:
        raise IntegrityError("the index names no row group")
    kind = dict(read_groups(spark, path, tuple(groups)).dtypes)[cluster]
    found = read_groups(spark, path, tuple(groups)).filter(F.col(cluster).isin([F.lit(w).cast(kind) for w in wanted] if kind != "string" else wanted))
    want = spark.createDataFrame([(r["cluster_id"], r["member_count"]) for r in rows], "cluster_id string, member_count long")
    have = found.groupBy(F.col(cluster).cast("string").alias("cluster_id")).agg(F.count(F.lit(1)).alias("have"), F.count_distinct(identifier).alias("distinct"))
    bad = want.join(have, "cluster_id", "left").filter("have is null or have != member_count or have != distinct").limit(1).collect()
    if bad:
        raise IntegrityError(f"cluster {bad[0]['cluster_id']} has {bad[0]['have']} rows and {bad[0]['distinct']} members of {bad[0]['member_count']}")
    return found
