"""Group and protein search: filters become one plan of predicates and semi joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.text import contains_literal, pipe_part, sorted_list
from ..schemas import KEY

DISTANCE_COLUMNS = (
    "distance_method", "computation_status", "total_member_count", "sampled_member_count", "distance_pair_count", "minimum_distance", "q25_distance",
    "median_distance", "mean_distance", "q75_distance", "maximum_distance", "population_stddev_distance", "failure_reason"
)
GROUP_COLUMNS = (
    *KEY, "legacy_orthogroup_id", "gene_tree_parent_clade", "member_count", "species_count", "single_copy_species_count", "max_copies_per_species",
    "mean_copies_per_species", "is_singleton"
)


def _by(*columns: str) -> list[Column]:
    """Sort keys; ``-`` before a name sorts it down. Nulls always come last."""
    return [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in columns]


#: Named total orders.
ORDERS = {
    "MEMBER_COUNT_DESC": ("-member_count", "group_type", "hierarchy_node", "group_id"),
    "SPECIES_COUNT_DESC": ("-species_count", "-member_count", "group_id"),
    "GROUP_ID_ASC": ("group_type", "hierarchy_node", "group_id"),
    "MEAN_DISTANCE_ASC": ("mean_distance", "-member_count", "group_type", "hierarchy_node", "group_id"),
    "MEAN_DISTANCE_DESC": ("-mean_distance", "-member_count", "group_type", "hierarchy_node", "group_id"),
    "DISTANCE_SD_ASC": ("population_stddev_distance", "-member_count", "group_type", "hierarchy_node", "group_id"),
}


@dataclass(frozen=True)
class GroupFilters:
    group_type: str = ""
    hierarchy_node: str | None = None
    group_id: str = ""
    group_id_contains: str = ""
    member_id_contains: str = ""
    included_species: tuple[str, ...] = ()
    include_mode: str = "ALL"
    excluded_species: tuple[str, ...] = ()
    members: tuple[int | None, int | None] = (None, None)
    species: tuple[int | None, int | None] = (None, None)
    distance_availability: str = "ANY"
    maximum_mean_distance: float | None = None
    maximum_distance_sd: float | None = None
    sort: str = "MEMBER_COUNT_DESC"
    page_number: int = 1
    page_size: int = 50
    terms: tuple[str, ...] = field(default=(), repr=False)

    @property
    def selective(self) -> bool:
        """Whether anything but distances narrows the groups."""
        bounds = any(x is not None for x in (*self.members, *self.species, self.hierarchy_node))
        return bounds or any((self.group_type, self.group_id, self.group_id_contains, self.member_id_contains, self.included_species, self.excluded_species))

    def __post_init__(self) -> None:
        if self.include_mode not in ("ANY", "ALL", "EXACT_SET"):
            raise InputError(f"unknown species mode {self.include_mode}")
        if self.distance_availability not in ("ANY", "CALCULATED", "NOT_CALCULATED"):
            raise InputError(f"unknown distance availability {self.distance_availability}")
        if self.sort not in ORDERS:
            raise InputError(f"unknown order {self.sort}")
        if set(self.included_species) & set(self.excluded_species):
            raise InputError("a species is both included and excluded")
        if self.page_number < 1 or self.page_size < 1:
            raise InputError("pages count from 1")
        for low, high in (self.members, self.species):
            if low is not None and high is not None and low > high:
                raise InputError("a range ends before it begins")


def between(c: Column, bounds: tuple[float | None, float | None]) -> Column:
    """Inclusive, each end optional."""
    out = F.lit(True)
    if bounds[0] is not None:
        out = out & (c >= bounds[0])
    if bounds[1] is not None:
        out = out & (c <= bounds[1])
    return out


def preferred_distance(distances: DataFrame) -> DataFrame:
    """The summary of each group that a search shows: with pairs first, then by method."""
    order = Window.partitionBy(*KEY).orderBy(F.when(F.col("distance_pair_count") > 0, 0).otherwise(1), F.col("distance_method").asc_nulls_last())
    return distances.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def ranked_distance(distances: DataFrame) -> DataFrame:
    """The summary of each group that results show: whole matrices first, then larger samples."""
    order = Window.partitionBy(*KEY).orderBy(
        F.when(F.col("sampled_member_count") == F.col("total_member_count"), 0).otherwise(1),
        *_by("-sampled_member_count", "distance_method", "source_file")
    )
    return distances.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def with_species(groups: DataFrame, species: DataFrame, included: tuple[str, ...], mode: str, excluded: tuple[str, ...]) -> DataFrame:
    """Groups by the species they have: any, all or exactly ``included``, none of ``excluded``.

    Only rows of the named species are read (the filter reaches the scan), and the counts
    are combined before the shuffle; groups then meet them in semi and anti joins.
    """
    if included:
        wanted = species.filter(F.col("species_label").isin(*included))
        if mode != "ANY":
            wanted = wanted.groupBy(*KEY).agg(F.count_distinct("species_label").alias("__n")).filter(F.col("__n") == len(set(included)))
        groups = groups.join(wanted.select(*KEY), list(KEY), "left_semi")
        if mode == "EXACT_SET":
            groups = groups.filter(F.col("species_count") == len(set(included)))
    if excluded:
        groups = groups.join(species.filter(F.col("species_label").isin(*excluded)).select(*KEY), list(KEY), "left_anti")
    return groups


def search_groups(stats: DataFrame, species: DataFrame, members: DataFrame, distances: DataFrame, f: GroupFilters) -> DataFrame:
    """All groups that pass, with their preferred distance; unordered, see :func:`page`.

    A group without calculated pairs has null statistics and passes no distance bound.
    """
    groups = stats.filter(between(F.col("member_count"), f.members) & between(F.col("species_count"), f.species))
    if f.group_type:
        groups = groups.filter(F.col("group_type") == f.group_type)
    if f.hierarchy_node is not None:
        groups = groups.filter(F.col("hierarchy_node") == f.hierarchy_node)
    if f.group_id:
        groups = groups.filter(F.col("group_id") == f.group_id)
    elif f.group_id_contains.strip():
        groups = groups.filter(contains_literal(F.col("group_id"), f.group_id_contains))
    if f.member_id_contains.strip():
        groups = groups.join(members.filter(contains_literal(F.col("member_id"), f.member_id_contains)).select(*KEY), list(KEY), "left_semi")
    groups = with_species(groups, species, f.included_species, f.include_mode, f.excluded_species)
    groups = groups.select(*GROUP_COLUMNS)
    if f.selective:  # rank the distances of the groups that pass, not of all
        distances = distances.join(groups.select(*KEY), list(KEY), "left_semi")
    out = groups.join(preferred_distance(distances).select(*KEY, *DISTANCE_COLUMNS), list(KEY), "left")
    if f.distance_availability == "CALCULATED":
        out = out.filter("distance_pair_count > 0")
    elif f.distance_availability == "NOT_CALCULATED":
        out = out.filter("coalesce(distance_pair_count, 0) = 0")
    if f.maximum_mean_distance is not None:
        out = out.filter((F.col("distance_pair_count") > 0) & (F.col("mean_distance") <= f.maximum_mean_distance))
    if f.maximum_distance_sd is not None:
        out = out.filter((F.col("distance_pair_count") > 0) & (F.col("population_stddev_distance") <= f.maximum_distance_sd))
    return out


def page(rows: DataFrame, order: str | tuple[str, ...], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a total order: a distributed top-k, never a full sort on one task."""
    ordered = rows.orderBy(*_by(*(ORDERS[order] if isinstance(order, str) else order)))
    return ordered.offset((number - 1) * size).limit(size) if number > 1 else ordered.limit(size)


def distance_results(
    stats: DataFrame, distances: DataFrame, method: str = "", status: str = "", group_type: str = "", hierarchy_node: str | None = None
) -> DataFrame:
    """Groups with calculated distances: filtered by method and status before ranking, by
    kind and node after; with sampling fraction, quartile range and relative spread."""
    d = distances.filter("distance_pair_count > 0")
    if method:
        d = d.filter(F.col("distance_method") == method)
    if status:
        d = d.filter(F.col("computation_status") == status)
    g = stats
    if group_type:
        g = g.filter(F.col("group_type") == group_type)
    if hierarchy_node is not None:
        g = g.filter(F.col("hierarchy_node") == hierarchy_node)
    out = g.select(*GROUP_COLUMNS).join(ranked_distance(d), list(KEY))
    return with_spread(out)


def with_spread(rows: DataFrame) -> DataFrame:
    """Derived columns of a distance summary."""
    return rows.withColumns({
        "sampling_fraction": F.try_divide(F.col("sampled_member_count").cast("double"), F.col("total_member_count").cast("double")),
        "full_group_matrix": F.col("sampled_member_count") == F.col("total_member_count"),
        "interquartile_range": F.col("q75_distance") - F.col("q25_distance"),
        "relative_distance_spread": F.when(F.col("mean_distance") > 0, F.col("population_stddev_distance") / F.col("mean_distance")),
    })


def search_proteins(members: DataFrame, sequences: DataFrame | None, stats: DataFrame, distances: DataFrame, query: str, exact: bool = True) -> DataFrame:
    """Memberships of proteins found by member id, internal id, accession or entry, with
    what matched. Each side is filtered by itself, and only the proteins found on either
    take part in the joins."""

    def fits(c: Column) -> Column:
        return F.coalesce(c == query if exact else contains_literal(c, query), F.lit(False))

    member, internal = F.col("member_id"), F.col("internal_id")
    accession, entry = pipe_part(member, 2), pipe_part(member, 3)
    protein = ["run_id", "member_id", "species_label"]
    m = members.select(*KEY, "legacy_orthogroup_id", "gene_tree_parent_clade", "species_label", "member_id")
    own = fits(member) | fits(accession) | fits(entry)
    if sequences is None:
        m = m.filter(own).withColumn("internal_id", F.lit(None).cast("string"))
    else:
        named = sequences.select(*protein, "internal_id")
        keys = m.filter(own).select(*protein).unionByName(named.filter(fits(internal)).select(*protein)).distinct()
        m = m.join(keys, protein, "left_semi").join(named.join(keys, protein, "left_semi"), protein, "left")
    by = {
        "PROTEIN_ID": (fits(member), member), "INTERNAL_ID": (fits(internal), internal), "UNIPROT_ACCESSION": (fits(accession), accession),
        "UNIPROT_ENTRY": (fits(entry), entry)
    }
    order = [
        "PROTEIN_ID", "INTERNAL_ID", "UNIPROT_ACCESSION", "UNIPROT_ENTRY"
    ] if exact else ["INTERNAL_ID", "UNIPROT_ACCESSION", "UNIPROT_ENTRY", "PROTEIN_ID"]
    found = by["PROTEIN_ID"][0] | by["INTERNAL_ID"][0] | by["UNIPROT_ACCESSION"][0] | by["UNIPROT_ENTRY"][0]
    source, matched = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(order):
        source, matched = F.when(by[name][0], name).otherwise(source), F.when(by[name][0], by[name][1]).otherwise(matched)
    if exact:
        source = F.when(by["PROTEIN_ID"][0] & by["INTERNAL_ID"][0], "PROTEIN_AND_INTERNAL_ID").otherwise(source)
    hits = m.filter(found).withColumn("match_source", source).withColumn("matched_identifier", matched).withColumn(
        "internal_id", F.coalesce("internal_id", F.lit(""))
    ).distinct()
    sizes = stats.select(*KEY, "member_count", "species_count", "single_copy_species_count", "max_copies_per_species", "mean_copies_per_species")
    shown = ranked_distance(distances).select(
        *KEY, "distance_method", "computation_status", "sampled_member_count", "distance_pair_count", "mean_distance", "population_stddev_distance"
    )
    return hits.join(sizes, list(KEY)).join(shown, list(KEY), "left")


def identifier_aliases(rows: DataFrame) -> DataFrame:
    """run_id, member_id, species_label, alias, match_authority: a row an identifier."""
    member, internal = F.col("member_id"), F.col("internal_id") if "internal_id" in rows.columns else F.lit(None).cast("string")
    pairs = [
        (member, "PROTEIN_ID"), (F.nullif(internal, F.lit("")), "INTERNAL_ID"), (pipe_part(member, 2), "UNIPROT_ACCESSION"),
        (pipe_part(member, 3), "UNIPROT_ENTRY")
    ]
    stacked = F.explode(F.array(*[F.struct(c.alias("alias"), F.lit(a).alias("match_authority")) for c, a in pairs]))
    return rows.select(
        "run_id", "member_id", "species_label", stacked.alias("x")
    ).select("run_id", "member_id", "species_label", "x.*").filter("alias is not null")


def search_focus(members: DataFrame, aliases: DataFrame, stats: DataFrame, distances: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Groups that hold focus proteins, with counts and lists of what was found.

    ``identifiers`` has the column focus_identifier; whether it is broadcast is left to
    the planner's size threshold.
    """
    focus = identifiers.select("focus_identifier").distinct()
    found = aliases.join(focus, F.col("alias") == F.col("focus_identifier")).select(
        "run_id", "member_id", "species_label", "focus_identifier", "match_authority"
    ).distinct()
    hits = members.join(found, ["run_id", "member_id", "species_label"])
    groups = hits.groupBy(*KEY).agg(
        F.min("legacy_orthogroup_id").alias("legacy_orthogroup_id"),
        F.min("gene_tree_parent_clade").alias("gene_tree_parent_clade"),
        F.count_distinct("focus_identifier").alias("matched_focus_count"),
        F.count_distinct("member_id").alias("matched_protein_count"),
        sorted_list(F.col("focus_identifier")).alias("matched_focus_identifiers"),
        sorted_list(F.col("member_id")).alias("matched_member_ids"),
        sorted_list(F.col("species_label")).alias("matched_species_labels"),
        sorted_list(F.col("match_authority")).alias("match_authorities"),
    )
    sizes = stats.select(*KEY, "member_count", "species_count", "max_copies_per_species", "mean_copies_per_species")
    shown = ranked_distance(distances).select(
        *KEY, "distance_method", "computation_status", "sampled_member_count", "distance_pair_count", "mean_distance", "population_stddev_distance"
    )
    return groups.join(sizes, list(KEY)).join(shown, list(KEY), "left")


def focus_audit(focus: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per configured identifier (focus_identifier, enabled): MATCHED, UNMATCHED or
    DISABLED, with the groups and members it was found in."""
    found = hits.groupBy("focus_identifier").agg(
        F.count_distinct("group_id").alias("matched_group_count"), sorted_list(F.col("group_id")).alias("matched_group_ids"),
        F.count_distinct("member_id").alias("matched_member_count"), sorted_list(F.col("member_id")).alias("matched_member_ids")
    )
    out = focus.join(found, "focus_identifier", "left")
    status = F.when(~F.col("enabled"), "DISABLED").when(F.col("matched_group_count").isNotNull(), "MATCHED").otherwise("UNMATCHED")
    return out.select(
        "focus_identifier", "enabled", status.alias("match_status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched_group_count", "matched_member_count")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("matched_group_ids", "matched_member_ids")]
    )
