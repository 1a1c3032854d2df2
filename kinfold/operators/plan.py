"""The benchmark's plan and its records: targets, controls, marker audit, cluster results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..functions.text import sorted_list
from ..schemas import KEY
from .benchmark import match_controls, single_copy_fraction

SCALES = ("RAW", "MATCHED_RESIDUAL")


def select_by_alias(members: DataFrame, authority: DataFrame) -> DataFrame:
    """Members named by an authority (seed_id and, if it has it, species_label): by
    identifier, accession or entry; a row a group, member and seed with what matched."""
    member = F.col("member_id")
    parts = F.when(member.rlike(r"^(sp|tr)\|[^|\s]+\|[^|\s]+$"), F.split(member, r"\|"))
    pairs = ((member, "PROTEIN_ID"), (F.get(parts, F.lit(1)), "UNIPROT_ACCESSION"), (F.get(parts, F.lit(2)), "UNIPROT_ENTRY"))
    names = F.array(*[F.struct(c.alias("alias"), F.lit(a).alias("match_authority")) for c, a in pairs])
    aliases = members.select(
        *KEY, "legacy_orthogroup_id", "species_label", "member_id", F.explode(names).alias("x")
    ).select("*", "x.alias", "x.match_authority").drop("x").filter("alias is not null")
    seeds = authority.select(F.col("seed_id").alias("alias"), *[F.col(c).alias(f"seed_{c}") for c in ("species_label",) if c in authority.columns]).distinct()
    met = aliases.join(seeds, "alias")
    if "seed_species_label" in seeds.columns:
        met = met.filter(F.col("seed_species_label").isNull() | (F.col("seed_species_label") == F.col("species_label"))).drop("seed_species_label")
    return met.select(
        *KEY, "legacy_orthogroup_id", F.col("alias").alias("seed_id"), F.col("member_id").alias("matched_member_id"),
        F.col("species_label").alias("matched_species_label"), "match_authority"
    ).distinct()


def candidates(stats: DataFrame, targets: DataFrame, hierarchy_node: str = "N0") -> DataFrame:
    """Groups that may be controls: of the node, with two members or more, an original
    group's name, and no target."""
    able = stats.filter(
        (F.col("group_type") == "HOG") & (F.col("hierarchy_node") == hierarchy_node) & (F.col("member_count") >= 2) & (
            F.coalesce("legacy_orthogroup_id", F.lit("")) != ""
        )
    )
    return able.join(targets.select(*KEY), list(KEY), "left_anti")


def build_plan(stats: DataFrame, selections: list[DataFrame], controls: int, hierarchy_node: str = "N0") -> dict[str, DataFrame]:
    """targets (groups of any selection), links (a row a target and control, with both
    sides' structure) and selected (targets and controls with their role).

    Distances are never read. An error if no control is left.
    """
    if not 1 <= controls <= 50:
        raise InputError("a target has 1 to 50 controls")
    keys = selections[0].select(*KEY)
    for more in selections[1:]:
        keys = keys.unionByName(more.select(*KEY))
    targets = stats.join(keys.distinct(), list(KEY), "left_semi")
    able = candidates(stats, targets, hierarchy_node)
    if able.isEmpty():
        raise InputError("no group is left that could be a control")
    found = match_controls(targets, able, controls)
    shape = {
        "member_count": F.col("member_count"), "species_count": F.col("species_count"), "mean_copies_per_species": F.col("mean_copies_per_species"),
        "single_copy_fraction": single_copy_fraction({c: F.col(c) for c in ("single_copy_species_count", "species_count")})
    }
    links = found
    for side in ("anchor", "control"):
        own = stats.select("run_id", *[F.col(k).alias(f"{side}_{k}") for k in KEY[1:]], *[c.alias(f"{side}_{n}") for n, c in shape.items()])
        links = links.join(own, ["run_id", *[f"{side}_{k}" for k in KEY[1:]]])
    links = links.withColumn("control_reused", F.lit(False)).withColumn("matching_variables", F.lit(";".join(shape)))
    chosen = links.select("run_id", *[F.col(f"control_{k}").alias(k) for k in KEY[1:]]).distinct().withColumn("membership_role", F.lit("CONTROL"))
    return {"targets": targets, "links": links, "selected": targets.select(*KEY, F.lit("TARGET").alias("membership_role")).unionByName(chosen)}


def marker_matches(matches: DataFrame, authority: DataFrame) -> DataFrame:
    """Matches (seed_id) with what the authority (protein_identifier, ...) says of their marker."""
    return matches.join(authority, matches["seed_id"] == authority["protein_identifier"]).drop("seed_id")


def marker_audit(matches: DataFrame, authority: DataFrame) -> DataFrame:
    """Each marker of the authority: DISABLED, MATCHED or UNMATCHED, with groups and members."""
    found = matches.groupBy(F.col("seed_id").alias("protein_identifier")).agg(
        F.count_distinct("group_id").alias("matched_group_count"),
        sorted_list(F.col("group_id")).alias("matched_group_ids"),
        F.count_distinct("matched_member_id").alias("matched_member_count"),
        sorted_list(F.col("matched_member_id")).alias("matched_member_ids"),
    )
    out = authority.join(found, "protein_identifier", "left")
    status = F.when(~F.col("enabled"), "DISABLED").when(F.col("matched_group_count") > 0, "MATCHED").otherwise("UNMATCHED")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("matched_group_count", "matched_member_count")}
    lists = {c: F.coalesce(c, F.lit("")) for c in ("matched_group_ids", "matched_member_ids")}
    return out.withColumns(counts | lists).withColumn("match_status", status)


def focus_results(stats: DataFrame, matches: DataFrame, distances: DataFrame) -> DataFrame:
    """Selected groups with their matches and their distances; numbers of a group whose
    distances are unavailable are null and its status says so."""
    per = matches.groupBy(*KEY).agg(
        F.count_distinct("seed_id").alias("seed_count"), sorted_list(F.col("seed_id")).alias("seed_ids"),
        F.count_distinct("matched_member_id").alias("matched_member_count")
    )
    numbers = ("distance_pair_count", "minimum_distance", "median_distance", "mean_distance", "maximum_distance", "population_stddev_distance")
    have = F.coalesce(F.col("distance_pair_count") > 0, F.lit(False))
    out = stats.join(per, list(KEY)).join(distances.select(*KEY, "distance_method", "computation_status", *numbers), list(KEY), "left")
    return out.withColumns(
        {c: F.when(have, F.col(c)) for c in numbers} | {"computation_status": F.when(have, F.col("computation_status")).otherwise("UNAVAILABLE")}
    )


def cluster_results(selected: DataFrame, stats: DataFrame, profiles: DataFrame, summaries: DataFrame) -> DataFrame:
    """Structure, profiles and dispersion of each selected group; an error if one has no summary."""
    lacking = selected.join(summaries.select(*KEY), list(KEY), "left_anti").select("group_id").limit(20).collect()
    if lacking:
        raise IntegrityError("groups without a distance summary: " + ";".join(sorted(r["group_id"] for r in lacking)))
    lists = profiles.groupBy(*KEY).agg(
        *[sorted_list(F.col(c)).alias(f"{c}s" if not c.endswith("s") else f"{c}es") for c in ("profile_id", "profile_class", "profile_subclass", "membership_role")]
    )
    out = selected.join(stats, list(KEY)).join(lists, list(KEY), "left").join(summaries, list(KEY))
    mean, spread = F.col("mean_distance"), F.col("population_stddev_distance")
    return out.withColumns({
        "profile_ids": F.coalesce("profile_ids", F.lit("")),
        "distance_interquartile_range": F.col("q75_distance") - F.col("q25_distance"),
        "distance_coefficient_of_variation": F.when(mean > 0, spread / mean),
        "sampling_fraction": F.try_divide(F.col("sampled_member_count").cast("double"), F.col("total_member_count").cast("double")),
        "pairwise_rows_persisted": F.col("membership_role") == "TARGET",
    })


def profile_counts(profiles: DataFrame) -> DataFrame:
    """Groups of each profile."""
    group = F.struct("group_type", "hierarchy_node", "group_id")
    return profiles.groupBy("profile_id", "profile_class", "profile_subclass", "membership_role").agg(F.count_distinct(group).alias("group_count"))


def profile_group_total(profiles: DataFrame, profile_id: str) -> DataFrame:
    """One row: the groups of a profile over all its classes and roles."""
    return profile_counts(profiles).filter(F.col("profile_id") == profile_id).agg(F.coalesce(F.sum("group_count"), F.lit(0)).alias("group_count"))


def distribution(profiles: DataFrame, results: DataFrame, comparisons: DataFrame, metric: str, scale: str) -> DataFrame:
    """A metric of each group of each profile: as measured, or the first residual of the
    group by its background's name."""
    if scale not in SCALES:
        raise InputError(f"unknown scale {scale}")
    named = profiles.select("profile_id", *KEY)
    if scale == "RAW":
        return named.join(results.select(*KEY, F.col(metric).alias("metric_value")), list(KEY)).filter("metric_value is not null")
    own = comparisons.filter((F.col("comparison_scale") == scale) & (F.col("metric") == metric))
    first = own.groupBy(*KEY).agg(F.min_by("observed_value", "background_profile_id").alias("metric_value"))
    return named.join(first, list(KEY))


def profile_markers(profiles: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Markers of target profiles from all their sources (KEY, marker_id, ...), without repeats."""
    named = profiles.filter("membership_role = 'TARGET'").select("profile_id", *KEY, F.explode(F.split("marker_ids", ";")).alias("marker_id"))
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return named.join(rows, [*KEY, "marker_id"]).distinct()


def classes_with_profiles(classes: DataFrame, results: DataFrame) -> DataFrame:
    """Classifications with the profiles of their group."""
    return classes.join(results.select(*KEY, "profile_ids"), list(KEY))


def first_per_group(rows: DataFrame, order: list[str], keys: tuple[str, ...] = KEY) -> DataFrame:
    """The first row of each group in an order."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(rank)).filter("__k = 1").drop("__k")
