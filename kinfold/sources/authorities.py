"""Strict tables that users supply: taxonomy, focus proteins, markers, expression manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.text import strip
from .results import read_tsv

STATUSES = ("REVIEWED", "PENDING_REVIEW", "UNMAPPED", "AMBIGUOUS")
MARKER_CLASSES = ("HOUSEKEEPING", "R_NLR")


def _need(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputError(f"{what}: no column {', '.join(missing)}")
    return df.select(*[strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])


def _none(df: DataFrame, condition, what: str) -> None:
    bad = df.filter(condition).limit(1).collect()
    if bad:
        raise InputError(f"{what}: {bad[0].asDict()}")


def taxonomy(df: DataFrame) -> DataFrame:
    """species_label, taxon_id, mapping_status and aligned lineage lists; a reviewed species
    has a taxon, and a species comes once."""
    rows = _need(df, ("species_label", "taxon_id", "mapping_status", "lineage_taxon_ids", "lineage_names"), "taxonomy")
    _none(rows, ~F.col("mapping_status").isin(*STATUSES), "unknown mapping status")
    ids, names = F.split("lineage_taxon_ids", ";"), F.split("lineage_names", ";")
    _none(
        rows, (F.col("mapping_status") == "REVIEWED") & ((F.col("taxon_id") == "") | (F.size(ids) != F.size(names))),
        "a reviewed species needs a taxon and lineages of one length"
    )
    _none(rows.groupBy("species_label").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "a species comes twice")
    return rows.withColumn("lineage", F.transform(F.filter(ids, lambda x: x != ""), strip))


def focus_proteins(df: DataFrame, most: int = 100_000) -> DataFrame:
    """focus_identifier, enabled; ids are unique, without regard to case as well."""
    names = {c.strip().lower(): c for c in df.columns}
    column = next((names[c] for c in ("protein_identifier", "focus_identifier", "protein_id", "identifier", "accession") if c in names), None)
    if column is None:
        raise InputError("focus proteins: no identifier column")
    rows = df.select(
        strip(F.col(column)).alias("focus_identifier"),
        (~F.lower(strip(F.col(names["enabled"]))).isin("false", "0", "no") if "enabled" in names else F.lit(True)).alias("enabled")
    ).filter("focus_identifier is not null and focus_identifier != ''")
    _none(rows.groupBy(F.lower("focus_identifier").alias("id")).agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "an identifier comes twice")
    if not rows.limit(most + 1).count() <= most:
        raise InputError(f"more than {most} focus proteins")
    return rows


def markers(df: DataFrame, most: int = 10_000) -> DataFrame:
    """Benchmark markers of known classes, ids unique."""
    rows = _need(df, ("marker_id", "protein_identifier", "benchmark_class", "benchmark_subclass"), "markers")
    _none(rows, ~F.col("benchmark_class").isin(*MARKER_CLASSES), "unknown marker class")
    _none(rows.groupBy("marker_id").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "a marker comes twice")
    if not rows.limit(most + 1).count() <= most:
        raise InputError(f"more than {most} markers")
    return rows


def expression_sources(spark: SparkSession, manifest: str, verify: bool = True) -> tuple[DataFrame | None, DataFrame | None]:
    """Expression and metadata tables of a manifest (type, path, sha256, include), whose
    checksums are verified by a distributed scan."""
    rows = _need(read_tsv(spark, manifest), ("file_type", "path", "sha256", "include"), "manifest")
    _none(rows, ~F.col("file_type").isin("expression", "metadata"), "unknown file type")
    use = rows.filter(F.lower("include").isin("true", "1", "yes")).collect()  # a row a file, listed by hand
    base = manifest.rpartition("/")[0]
    paths = {
        k: [
            r["path"] if "://" in r["path"] or r["path"].startswith("/") else f"{base}/{r['path']}" for r in use if r["file_type"] == k
        ] for k in ("expression", "metadata")
    }
    if verify and use:
        want = {r["path"].rpartition("/")[2]: r["sha256"] for r in use}
        got = spark.read.format("binaryFile").load([*paths["expression"], *paths["metadata"]]).select(
            F.regexp_extract("path", r"([^/]+)$", 1).alias("n"), F.sha2("content", 256).alias("h")
        ).collect()
        for r in got:
            if want.get(r["n"]) != r["h"]:
                raise InputError(f"{r['n']} is not the file that the manifest names")
    return tuple(spark.read.parquet(*p) if p else None for p in paths.values())


def target_species(mapping: DataFrame, taxon_id: int) -> DataFrame:
    """species_label of the reviewed species at or below a taxon, of a mapping that
    :func:`taxonomy` read."""
    if taxon_id <= 0:
        raise InputError("a target taxon is a positive number")
    target = F.lit(str(taxon_id))
    below = (F.col("taxon_id") == target) | F.array_contains("lineage", target)
    return mapping.filter((F.col("mapping_status") == "REVIEWED") & below).select("species_label").distinct()
