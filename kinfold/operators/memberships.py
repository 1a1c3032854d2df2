"""Memberships: wide group tables to long rows, and the statistics of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..functions.text import sorted_list, strip
from ..schemas import KEY

#: Headings that are not species, without regard to case.
HEADINGS = {"hog": "group_id", "orthogroup": "group_id", "og": "legacy_orthogroup_id", "gene tree parent clade": "gene_tree_parent_clade"}


def melt(wide: DataFrame, run_id: str, group_type: str, hierarchy_node: str, source_file: str, row_col: str | None = None) -> DataFrame:
    """Long membership rows of a table with a column for each species, whose cells are
    lists separated by commas. Empty cells have no members."""
    names: dict[str, str] = {}
    species = []
    for c in wide.columns:
        if c == row_col:
            continue
        role = HEADINGS.get(c.strip().lower())
        if role is None:
            species.append(c)
        elif role in names:
            raise InputError(f"{source_file}: two columns for {role}")
        else:
            names[role] = c
    if "group_id" not in names and "legacy_orthogroup_id" in names and group_type == "LEGACY_ORTHOGROUP":
        names["group_id"] = names.pop("legacy_orthogroup_id")
    if "group_id" not in names:
        raise InputError(f"{source_file}: no group column")
    if not species:
        raise InputError(f"{source_file}: no species column")
    base = wide.select(
        F.col(f"`{names['group_id']}`").alias("group_id"),
        (F.col(f"`{names['legacy_orthogroup_id']}`") if "legacy_orthogroup_id" in names else F.col(f"`{names['group_id']}`") if group_type == "LEGACY_ORTHOGROUP" else F.lit("")).alias("legacy_orthogroup_id"),
        (F.col(f"`{names['gene_tree_parent_clade']}`") if "gene_tree_parent_clade" in names else F.lit("")).alias("gene_tree_parent_clade"),
        (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("source_row"),
        *[F.col(f"`{s}`").cast("string").alias(f"s{i}") for i, s in enumerate(species)],
    )
    stacked = F.explode(F.array(*[F.struct(F.lit(s).alias("species_label"), F.col(f"s{i}").alias("cell")) for i, s in enumerate(species)]))
    cells = base.select(
        "group_id", "legacy_orthogroup_id", "gene_tree_parent_clade", "source_row", stacked.alias("x")
    ).filter("x.cell is not null and x.cell != ''")
    members = cells.select(
        "group_id", "legacy_orthogroup_id", "gene_tree_parent_clade", "source_row", "x.species_label",
        F.explode(F.split("x.cell", ",")).alias("member_id")
    )
    return members.select(
        F.lit(run_id).alias("run_id"), F.lit(group_type).alias("group_type"), F.lit(hierarchy_node).alias("hierarchy_node"), "group_id",
        F.coalesce("legacy_orthogroup_id", F.lit("")).alias("legacy_orthogroup_id"), F.coalesce("gene_tree_parent_clade", F.lit("")).alias("gene_tree_parent_clade"),
        "species_label", strip(F.col("member_id")).alias("member_id"), F.lit(source_file).alias("source_file"), "source_row",
    ).filter("member_id != ''")


def species_counts(members: DataFrame) -> DataFrame:
    """Rows of each species in each group: one shuffle on the group's key, in which the
    statistics that follow are made as well."""
    return members.groupBy(*KEY, "species_label").agg(
        F.count(F.lit(1)).alias("species_member_count"), F.min("legacy_orthogroup_id").alias("legacy_orthogroup_id"),
        F.max("legacy_orthogroup_id").alias("__legacy"), F.min("gene_tree_parent_clade").alias("gene_tree_parent_clade"),
        F.min("source_file").alias("source_file")
    )


def group_statistics(members: DataFrame) -> DataFrame:
    """Sizes, species and copies of each group."""
    n = F.col("species_member_count")
    out = species_counts(members).groupBy(*KEY).agg(
        F.min("legacy_orthogroup_id").alias("legacy_orthogroup_id"),
        F.min("gene_tree_parent_clade").alias("gene_tree_parent_clade"),
        F.sum(n).alias("member_count"),
        F.count(F.lit(1)).alias("species_count"),
        F.count_if(n == 1).alias("single_copy_species_count"),
        F.max(n).alias("max_copies_per_species"),
        sorted_list(F.col("species_label")).alias("species_labels"),
        F.min("source_file").alias("source_file"),
    )
    return out.withColumn("mean_copies_per_species", F.col("member_count") / F.col("species_count")).withColumn("is_singleton", F.col("member_count") == 1)


def group_species_statistics(members: DataFrame) -> DataFrame:
    """Copies of each species in each group and their share of the group's members."""
    counts = species_counts(members).drop("__legacy")
    sizes = counts.groupBy(*KEY).agg(F.sum("species_member_count").alias("__total"))
    return counts.join(sizes, list(KEY)).withColumn("member_fraction", F.col("species_member_count") / F.col("__total")).drop("__total")


def check_consistent(members: DataFrame) -> None:
    """A group has one legacy id and one parent clade; raises where it has more."""
    bad = members.groupBy(*KEY).agg(
        F.min(F.struct("legacy_orthogroup_id", "gene_tree_parent_clade")).alias("a"),
        F.max(F.struct("legacy_orthogroup_id", "gene_tree_parent_clade")).alias("b")
    ).filter("a != b").limit(1).collect()
    if bad:
        raise IntegrityError(f"group {bad[0]['group_id']} has contradicting rows: {bad[0]['a']} and {bad[0]['b']}")


def overview(stats: DataFrame) -> DataFrame:
    """Groups and their sizes by kind and hierarchy node."""
    return stats.groupBy("group_type", "hierarchy_node").agg(
        F.count(F.lit(1)).alias("group_count"), F.min("member_count").alias("minimum_members"), F.median("member_count").alias("median_members"),
        F.max("member_count").alias("maximum_members"), F.avg("member_count").alias("mean_members")
    )


def totals(stats: DataFrame, species: DataFrame, distances: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: groups, species, groups with distances, sequences."""
    one = stats.agg(F.count(F.lit(1)).alias("group_count"))
    for df, name in (
        (species, "species_count"), (distances.filter("distance_pair_count > 0").select(*KEY).distinct(), "distance_group_count"),
        (sequences, "sequence_count")
    ):
        one = one.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one


def size_histogram(stats: DataFrame, column: str = "member_count") -> DataFrame:
    """Groups by binary order of magnitude of a size, with mean, minimum and maximum."""
    bins = stats.withColumn("bin", F.floor(F.log2(F.greatest(F.col(column), F.lit(1)).cast("double")) + 1e-12))
    return bins.groupBy("group_type", "hierarchy_node", "bin").agg(
        F.count(F.lit(1)).alias("group_count"), F.min(column).alias("minimum"), F.max(column).alias("maximum"), F.avg(column).alias("mean")
    )
