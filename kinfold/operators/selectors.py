"""What a user picks from: lists, single groups, bounded collections, filters of shown rows.

Bounds are guards of whoever shows the rows: a selection that exceeds one is refused, never
cut, unless the operator says that it shows the first rows of an order. Without a bound
there is none, since a table that stays in Spark may have any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.text import contains_literal
from ..schemas import KEY
from .search import GROUP_COLUMNS, preferred_distance, with_spread

#: Most identifiers that may be asked for at once as values; a table of them has no bound.
MOST_IDS = 100_000
ROLES = ("PRIMARY_ANALYSIS", "REQUIRED_COMPARISON", "EXCLUDED_COMPARISON", "OTHER_SAMPLED")
#: Columns that a distance table may show.
SHOWN = (
    *GROUP_COLUMNS,
    "distance_method", "computation_status", "member_identifier_resolution", "total_member_count", "sampled_member_count", "distance_pair_count",
    "minimum_distance", "q05_distance", "q25_distance", "median_distance", "mean_distance", "q75_distance", "q95_distance", "maximum_distance",
    "population_stddev_distance", "mean_comparable_sites", "source_file", "failure_reason",
    "sampling_fraction", "full_group_matrix", "interquartile_range", "relative_distance_spread",
)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column in their order, nulls left out."""
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def hierarchy_nodes(stats: DataFrame, group_type: str = "") -> DataFrame:
    """Hierarchy nodes, of all groups or of one kind of group."""
    return distinct_values(stats.filter(F.col("group_type") == group_type) if group_type else stats, "hierarchy_node")


def text_values(values: Sequence[str], label: str, most: int = MOST_IDS) -> tuple[str, ...]:
    """Trimmed values in their first order without repeats; empty, huge and too many are refused."""
    if isinstance(values, (str, bytes)):
        raise InputError(f"{label} are a sequence of texts, not one text")
    found = tuple(dict.fromkeys(str(v).strip() for v in values))
    if any(not v or len(v) > 512 or "\x00" in v for v in found):
        raise InputError(f"{label}: one is empty or unsafe")
    if len(found) > most:
        raise InputError(f"{label}: more than {most}")
    return found


def guarded(rows: DataFrame, most: int | None, label: str) -> DataFrame:
    """``rows``, or an error if there are more than ``most``; looks at one more than that."""
    if most is None:
        return rows
    if most < 1:
        raise InputError(f"{label}: a bound is 1 or more")
    if rows.limit(most + 1).count() > most:
        raise InputError(f"{label}: more than {most} rows; restrict the selection")
    return rows


def first_rows(rows: DataFrame, order: Sequence[str], most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` rows of an order, and whether there are more."""
    ordered = rows.orderBy(*order)
    return ordered.limit(most), rows.limit(most + 1).count() > most


def with_total(rows: DataFrame, name: str = "total_count") -> DataFrame:
    """``rows`` with their number beside each: counted once, not in a window over all rows."""
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row


def of_group(rows: DataFrame, key: Mapping[str, str]) -> DataFrame:
    """Rows of one group, named by all parts of its key."""
    if set(key) != set(KEY):
        raise InputError(f"a group is named by {', '.join(KEY)}")
    for part in KEY:
        rows = rows.filter(F.col(part) == key[part])
    return rows


def one_group(stats: DataFrame, distances: DataFrame, key: Mapping[str, str]) -> DataFrame:
    """The statistics of one group with its preferred distance; an error unless it is there once."""
    own = of_group(stats, key)
    found = own.limit(2).count()
    if found != 1:
        raise InputError(f"group {key['group_id']} is {'not there' if not found else 'there more than once'}")
    return own.join(preferred_distance(of_group(distances, key)), list(KEY), "left")


def group_species(species: DataFrame, key: Mapping[str, str]) -> DataFrame:
    """Species of one group with their members, in order of their names."""
    return of_group(species, key).orderBy("species_label")


def group_species_collection(species: DataFrame, group_type: str, hierarchy_node: str, group_ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Rows group x species of one kind and node, of all groups or of those in ``group_ids``
    (group_id), however many those are."""
    if group_type == "LEGACY_ORTHOGROUP" and hierarchy_node:
        raise InputError("original groups have no hierarchy node")
    rows = species.filter((F.col("group_type") == group_type) & (F.col("hierarchy_node") == hierarchy_node))
    if group_ids is not None:
        rows = rows.join(group_ids.select("group_id"), "group_id", "left_semi")
    return guarded(rows, most, "group collection").select(*KEY, "species_label", "species_member_count")


def first_members(members: DataFrame, key: Mapping[str, str], most: int) -> DataFrame:
    """The first ``most`` members of a group by species and identifier."""
    return of_group(members, key).orderBy("species_label", "member_id").limit(most)


def group_pairs(pairs: DataFrame, key: Mapping[str, str], method: str = "", most: int = 1_000_000) -> DataFrame:
    """All pairs of a group in their order, of one method if named; refused beyond ``most``."""
    own = of_group(pairs, key)
    own = own.filter(F.col("distance_method") == method) if method else own
    return guarded(own, most, "pairs").orderBy("member_a", "member_b")


def group_aliases(sequences: DataFrame, members: DataFrame, key: Mapping[str, str]) -> DataFrame:
    """member_id, species_label and internal_id of a group's members, without repeats."""
    own = of_group(members, key).select("run_id", "member_id", "species_label").distinct()
    return sequences.join(own, ["run_id", "member_id", "species_label"]).select("member_id", "species_label", "internal_id").distinct()


def shown_columns(rows: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Chosen columns of distance results; others than those of ``SHOWN`` are refused."""
    chosen = text_values(columns, "columns", len(SHOWN))
    unknown = [c for c in chosen if c not in SHOWN]
    if unknown or not chosen:
        raise InputError(f"unknown columns: {', '.join(unknown) or 'none chosen'}")
    return guarded(with_spread(rows) if "sampling_fraction" not in rows.columns else rows, most, "distance results").select(*chosen)


def reviewed_outside(reviewed: DataFrame, target: DataFrame) -> DataFrame:
    """Reviewed species that are not of the target."""
    return reviewed.select("species_label").distinct().join(target.select("species_label"), "species_label", "left_anti")


def species_roles(species: DataFrame, primary: DataFrame, required: DataFrame, excluded: DataFrame) -> DataFrame:
    """species_label and role, the first that holds of primary, required, excluded and other."""
    out = species.select("species_label").distinct()
    marks = []
    for name, rows in zip(ROLES, (primary, required, excluded), strict=False):
        marks.append(name)
        out = out.join(rows.select("species_label").distinct().withColumn(name, F.lit(True)), "species_label", "left")
    role = F.lit(ROLES[3])
    for name in reversed(marks):
        role = F.when(F.col(name), name).otherwise(role)
    return out.select("species_label", role.alias("role"))


def filter_members(
    rows: DataFrame, roles: DataFrame, state: str = "All proteins", chosen: Sequence[str] = ROLES, species: Sequence[str] = (), text: str = ""
) -> DataFrame:
    """Motif rows by match state, role, species and literal text of the member."""
    states = {
        "All proteins": F.lit(True), "Matching": F.col("motif_match"), "Not matching": F.col("sequence_available") & ~F.col("motif_match"),
        "Sequence unavailable": ~F.col("sequence_available")
    }
    if state not in states:
        raise InputError(f"unknown match state {state}")
    out = rows.join(roles, "species_label", "left").withColumn("role", F.coalesce("role", F.lit("UNRESOLVED")))
    out = out.filter(states[state] & F.col("role").isin(*chosen))
    out = out.filter(F.col("species_label").isin(*species)) if species else out
    return out.filter(contains_literal(F.col("member_id"), text)) if text.strip() else out


def filter_pairs(rows: DataFrame, text: str = "", species: Sequence[str] = (), scope: str = "All pairs") -> DataFrame:
    """Pairs (with species_a, species_b) by literal text of an end, species of an end, and scope."""
    same = F.col("species_a") == F.col("species_b")
    scopes = {"All pairs": F.lit(True), "Within species": same, "Between species": ~same}
    if scope not in scopes:
        raise InputError(f"unknown pair scope {scope}")

    def either(test) -> Column:
        return test("a") | test("b")

    out = rows.filter(scopes[scope])
    out = out.filter(either(lambda e: contains_literal(F.col(f"member_{e}"), text))) if text.strip() else out
    return out.filter(either(lambda e: F.col(f"species_{e}").isin(*species))) if species else out


def comparison(summaries: DataFrame, group_ids: Sequence[str]) -> DataFrame:
    """Two to twelve groups side by side, in the order of their labels."""
    ids = text_values(group_ids, "groups", 12)
    if len(ids) < 2:
        raise InputError("a comparison takes two groups at least")
    label = F.concat_ws(" / ", "group_type", F.nullif("hierarchy_node", F.lit("")), "group_id")
    columns = (
        "distance_pair_count", "minimum_distance", "q25_distance", "median_distance", "mean_distance", "q75_distance", "maximum_distance",
        "population_stddev_distance", "distance_method", "computation_status"
    )
    chosen = summaries.filter(F.col("group_id").isin(*ids)).withColumn("label", label)
    named = chosen.select(
        "label", "group_id", F.col("total_member_count").alias("analytical_members"), F.col("sampled_member_count").alias("displayed_members"),
        *columns
    )
    return named.orderBy("label", "distance_method")


def rank_species(rows: DataFrame) -> DataFrame:
    """Species by how many groups have observed expression in them, then by name."""
    seen = rows.filter("expression_observed_member_count > 0")
    return seen.groupBy("species_label").agg(F.count(F.lit(1)).alias("group_count")).orderBy(F.col("group_count").desc(), "species_label")
