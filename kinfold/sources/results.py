"""Completed result directories: layout, identifier files, group tables, trees."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..functions.text import species_label, strip
from ..operators.memberships import melt
from ..schemas import conform, struct
from ..tables import Store

#: Names in a result directory.
SPECIES_IDS, SEQUENCE_IDS = "WorkingDirectory/SpeciesIDs.txt", "WorkingDirectory/SequenceIDs.txt"
LEGACY, HOGS = "Orthogroups/Orthogroups.tsv", "Phylogenetic_Hierarchical_Orthogroups"
SPECIES_TREES, ALIGNMENTS = "Species_Tree", "MultipleSequenceAlignments"
TREES = {"GENE_TREE": "Gene_Trees", "RESOLVED_GENE_TREE": "Resolved_Gene_Trees"}


@dataclass(frozen=True)
class Layout:
    """Paths or URIs of what a result directory holds."""

    root: str
    version: str
    legacy: str | None
    hogs: tuple[str, ...]
    trees: dict[str, str]
    species_trees: str | None
    alignments: str | None

    @property
    def primary(self) -> str:
        """The authority that questions go to first."""
        return "HOG" if self.hogs or self.version.startswith("3") else "LEGACY_ORTHOGROUP"


def _name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def detect_version(spark: SparkSession, log: str) -> str:
    """Version from the first 500 lines of a log; majors 2 and 3 are known."""
    for row in spark.read.text(log).limit(500).collect():
        if m := re.search(r"version[\s:v]*(\d+)\.(\d+(?:\.\d+)*)", row["value"], re.IGNORECASE):
            if m[1] not in ("2", "3"):
                raise InputError(f"version {m[1]}.{m[2]} is not supported")
            return f"{m[1]}.{m[2]}"
    raise InputError(f"{log}: no version")


def discover(root, spark: SparkSession | None = None) -> Layout:
    """What a result directory holds, on any store; without identifiers or any group table
    it is an error."""
    spark, root = spark or SparkSession.active(), str(root).rstrip("/")
    store = Store(spark)
    for needed in ("Log.txt", SPECIES_IDS, SEQUENCE_IDS):
        if not store.exists(f"{root}/{needed}"):
            raise InputError(f"{root}/{needed} is missing")
    there = lambda p: f"{root}/{p}" if store.exists(f"{root}/{p}") else None
    found = [int(m[1]) for name, _ in store.names(f"{root}/{HOGS}") if (m := re.fullmatch(r"N(\d+)\.tsv", name))]
    hogs = [f"{root}/{HOGS}/N{k}.tsv" for k in sorted(found)]
    if not hogs and not there(LEGACY):
        raise InputError(f"{root} has no group table")
    trees = {k: f"{root}/{v}" for k, v in TREES.items() if there(v)}
    return Layout(root, detect_version(spark, f"{root}/Log.txt"), there(LEGACY), tuple(hogs), trees, there(SPECIES_TREES), there(ALIGNMENTS))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, line (from 1) of a text file; identifier files are one partition a file block."""
    lines = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
    per = lines.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    base = per.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return lines.withColumn("__p", F.shiftright("__at", 33)).join(base, "__p").select(
        "value", (F.col("base") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias("line")
    )


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = _numbered(spark, path).filter(strip(F.col("value")) != "")
    parts = F.split("value", ":", 2)
    out = rows.select(strip(F.get(parts, F.lit(0))).alias("k"), strip(F.get(parts, F.lit(1))).alias("v"), "line")
    bad = out.filter("k = '' or v is null or v = ''").limit(1).collect()
    if bad:
        raise InputError(f"{path}, line {bad[0]['line']}: not 'number: name'")
    twice = out.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise IntegrityError(f"{path}: {twice[0]['k']} comes twice")
    return out


def species(spark: SparkSession, layout: Layout, run_id: str) -> DataFrame:
    path = f"{layout.root}/{SPECIES_IDS}"
    rows = _pairs(spark, path)
    return conform(
        rows.select(
            F.lit(run_id).alias("run_id"), F.col("k").alias("species_index"), species_label(F.col("v")).alias("species_label"),
            F.col("v").alias("source_fasta"), F.lit(_name(path)).alias("source_file"), F.col("line").alias("source_line")
        ),
        "species"
    )


def sequences(spark: SparkSession, layout: Layout, run_id: str) -> DataFrame:
    path = f"{layout.root}/{SEQUENCE_IDS}"
    rows = _pairs(spark, path).withColumn("species_index", F.substring_index("k", "_", 1))
    known = species(spark, layout, run_id).select("species_index", "species_label", "source_fasta")
    lost = rows.join(known, "species_index", "left_anti").limit(1).collect()
    if lost:
        raise IntegrityError(f"sequence {lost[0]['k']} is of an unknown species")
    out = rows.join(known, "species_index")
    return conform(
        out.select(
            F.lit(run_id).alias("run_id"), F.col("k").alias("internal_id"), "species_index", "species_label", "source_fasta",
            F.col("v").alias("raw_header"), F.regexp_extract("v", r"^(\S+)", 1).alias("member_id"), F.lit(_name(path)).alias("source_file"),
            F.col("line").alias("source_line")
        ),
        "sequences"
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a heading, all text; a row of another width is an error."""
    return spark.read.csv(path, sep="\t", header=True, mode="FAILFAST", quote="", nullValue="\0", emptyValue="", enforceSchema=False)


def read_relation(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """A text table of a relation in its declared types; a heading that is not declared, or
    that comes twice, is an error, and one that lacks is a column of nulls."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise InputError(f"{path} has no heading")
    heads, known = first[0]["value"].rstrip("\r").split("\t"), set(struct(relation).fieldNames())
    twice = sorted({h for h in heads if heads.count(h) > 1})
    unknown = sorted(set(heads) - known)
    if twice or unknown:
        raise InputError(f"{path}: " + "; ".join([*(f"{h} comes twice" for h in twice), *(f"{h} is no column of {relation}" for h in unknown)]))
    return conform(read_tsv(spark, path), relation)


def memberships(spark: SparkSession, layout: Layout, run_id: str) -> tuple[DataFrame, DataFrame | None]:
    """Hierarchical and legacy memberships; files are melted apart and their rows united."""
    hogs = None
    for path in layout.hogs:
        one = melt(read_tsv(spark, path), run_id, "HOG", _name(path).removesuffix(".tsv"), _name(path))
        hogs = one if hogs is None else hogs.unionByName(one)
    legacy = melt(read_tsv(spark, layout.legacy), run_id, "LEGACY_ORTHOGROUP", "", _name(layout.legacy)) if layout.legacy else None
    return hogs, legacy


def tree_files(spark: SparkSession, layout: Layout, run_id: str) -> DataFrame:
    """Every gene tree's type, id, path, size, SHA-256 and text."""
    return _trees(spark, run_id, {k: (v, "*_tree.txt", r"([^/]+)_tree\.txt$") for k, v in layout.trees.items()})


def tree_inventory(spark: SparkSession, layout: Layout, run_id: str) -> DataFrame | None:
    """Type, id, group, path, size and SHA-256 of all trees, species trees included: the id
    of a species tree is its file's name without the suffix, and it has no group."""
    own = tree_files(spark, layout, run_id)
    out = None if own is None else own.withColumn("group_id", F.col("tree_id"))
    if layout.species_trees:
        more = _trees(spark, run_id, {"SPECIES_TREE": (layout.species_trees, "*.txt", r"([^/]+)\.txt$")}).withColumn("group_id", F.lit(""))
        out = more if out is None else out.unionByName(more)
    return out


def _trees(spark: SparkSession, run_id: str, folders: dict[str, tuple[str, str, str]]) -> DataFrame | None:
    out = None
    for kind, (folder, names, tree_id) in folders.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
        one = files.select(
            F.lit(run_id).alias("run_id"), F.lit(kind).alias("tree_type"), F.regexp_extract("path", tree_id, 1).alias("tree_id"), "path",
            F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("newick")
        )
        out = one if out is None else out.unionByName(one)
    return out


def alignments(spark: SparkSession, layout: Layout) -> DataFrame:
    """group_id, member_id, sequence of aligned files, one a group."""
    from .fasta import read_fasta

    return read_fasta(spark, layout.alignments, check="aligned").select(
        F.regexp_replace("source_fasta", r"(?i)\.(fa|faa|fasta|fas|pep)(\.gz)?$", "").alias("group_id"), "member_id", "sequence"
    )
