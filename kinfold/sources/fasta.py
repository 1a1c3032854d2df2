"""FASTA files as a Spark data source: ``spark.read.format("fasta").load(path)``.

A file is a partition and is read as a stream, so no proteome is held in memory. Paths
may name a file, a folder or a pattern on any file system that pyarrow opens.
"""

from __future__ import annotations

import fnmatch
import gzip
import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InputError, IntegrityError
from ..tables import Store

SUFFIX = re.compile(r"\.(fa|faa|fasta|fas|pep)(\.gz)?$", re.IGNORECASE)
#: The file that makes a sidecar whole.
COMMITTED = "sequences.json"
PROTEIN, ALIGNED = re.compile(r"[A-Z]+"), re.compile(r"[A-Z\-.]+")


def records(lines: Iterator[str], name: str, check: str = "") -> Iterator[tuple[str, str, str]]:
    """(id, header, upper-case sequence); text before a header, an empty record, an id that
    comes twice, or with ``check`` a character outside the alphabet, are errors."""
    header, parts, seen = None, [], set()

    def done() -> tuple[str, str, str]:
        ident = header.split(maxsplit=1)[0] if header.strip() else ""
        sequence = re.sub(r"\s", "", "".join(parts)).upper()
        if not ident or not sequence:
            raise InputError(f"{name}: a record without an id or a sequence")
        if ident in seen:
            raise InputError(f"{name}: {ident} comes twice")
        seen.add(ident)
        if check:
            sequence = sequence.rstrip("*")
            if not (ALIGNED if check == "aligned" else PROTEIN).fullmatch(sequence):
                raise InputError(f"{name}: {ident} is no protein")
        return ident, header, sequence

    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if header is not None:
                yield done()
            header, parts = line[1:], []
        elif line.strip():
            if header is None:
                raise InputError(f"{name}: text before the first header")
            parts.append(line)
    if header is not None:
        yield done()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.check = options.get("path", ""), options.get("check", "")
        if not self.path:
            raise InputError("a FASTA source needs a path")

    def _store(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        folder, _, pattern = self.path.rpartition("/") if "*" in self.path else (self.path, "", "*")
        store, place = self._store(folder)
        info = store.get_file_info(place)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        found = [
            i.path for i in store.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File and SUFFIX.search(i.base_name) and fnmatch.fnmatch(i.base_name, pattern)
        ]
        prefix = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
        return [_File(prefix + p) for p in sorted(found)]

    def read(self, partition: _File) -> Iterator[tuple]:
        import io

        store, place = self._store(partition.path)
        name = place.rsplit("/", 1)[-1]
        with store.open_input_stream(place, compression=None) as raw:
            text = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, encoding="utf-8")
            for ident, header, sequence in records(text, name, self.check):
                yield name, ident, header, sequence


class FastaSource(DataSource):
    """Options: path; check = ``protein`` or ``aligned`` to hold sequences to an alphabet."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "source_fasta string, member_id string, raw_header string, sequence string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_fasta(spark: SparkSession, path: str, check: str = "") -> DataFrame:
    """source_fasta, member_id, raw_header, sequence of every record."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("check", check).load(path)


def write_fasta(rows: DataFrame, folder: str, width: int = 60) -> None:
    """FASTA files of ``raw_header`` and ``sequence``, one a partition, in a folder of any
    file system that pyarrow opens; a file is renamed when whole, so a task may run again."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, place = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(place, recursive=True)
        tried, n = f"{place}/_{task.partitionId()}-{task.taskAttemptId()}", 0
        with store.open_output_stream(tried) as out:
            for batch in batches:
                for header, sequence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lines = [sequence[k : k + width] for k in range(0, len(sequence), width)]
                    out.write("\n".join([f">{header}", *lines, ""]).encode())
                    n += 1
        store.move(tried, f"{place}/part-{task.partitionId():06d}.fa")
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    rows.select("raw_header", "sequence").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def reconcile(sequences: DataFrame, fasta: DataFrame) -> DataFrame:
    """Sequences of the identifier map (internal_id, ...) with their residues, each exactly
    once and none over; ``fasta`` names records by internal id."""
    f = fasta.select(F.col("member_id").alias("internal_id"), F.regexp_replace("sequence", r"\*+$", "").alias("sequence"))
    extra, lost = f.join(sequences, "internal_id", "left_anti").limit(1).collect(), sequences.join(f, "internal_id", "left_anti").limit(1).collect()
    double = f.groupBy("internal_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    for bad, what in ((extra, "is not in the map"), (lost, "has no sequence"), (double, "comes twice")):
        if bad:
            raise IntegrityError(f"sequence {bad[0]['internal_id']} {what}")
    return sequences.join(f, "internal_id")


def write_sidecar(spark: SparkSession, sequences: DataFrame, fasta: DataFrame, folder: str, rows_a_file: int = 25_000) -> int:
    """The reconciled sequences as a table under one name: Parquet files of at most
    ``rows_a_file`` rows, each committed by its task, then a file that names the whole;
    readers see nothing before it is there. The number of sequences, which was read back."""
    store, folder = Store(spark), folder.rstrip("/")
    if store.exists(f"{folder}/{COMMITTED}"):
        raise InputError(f"{folder} is there already")
    data = f"data-{uuid.uuid4().hex}"
    found = reconcile(sequences, fasta)
    found.write.option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(f"{folder}/{data}")
    n, wanted = spark.read.parquet(f"{folder}/{data}").count(), sequences.count()
    if n != wanted:
        raise IntegrityError(f"{folder}: {n} sequences were written of {wanted}")
    store.write(f"{folder}/{COMMITTED}", json.dumps({"data": data, "sequences": n}))
    return n


def read_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences that :func:`write_sidecar` committed."""
    store, folder = Store(spark), folder.rstrip("/")
    if not store.exists(f"{folder}/{COMMITTED}"):
        raise InputError(f"{folder} has no sequences")
    return spark.read.parquet(f"{folder}/{json.loads(store.read(f'{folder}/{COMMITTED}'))['data']}")
