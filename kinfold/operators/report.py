"""Report tables: dense histograms, the groups and members of a network, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_hash
from ..schemas import KEY

METRICS = ("member_count", "species_count", "max_copies_per_species")
#: Metrics that are counted by powers of two; the others by their value.
LOGARITHMIC = ("member_count", "max_copies_per_species")


def whole_number(value: Column) -> Column:
    """A count of 0 or more from a text or number, else null."""
    number = value.try_cast("long")
    return F.when(number >= 0, number)


def level_counts(stats: DataFrame) -> DataFrame:
    """Groups of each kind and node, and how many have one copy a species and how many more."""
    copies = whole_number(F.col("max_copies_per_species"))
    return stats.groupBy("group_type", "hierarchy_node").agg(
        F.count(F.lit(1)).alias("group_count"), F.count_if(copies <= 1).alias("single_copy_group_count"),
        F.count_if(copies > 1).alias("multicopy_group_count")
    )


def dense_histograms(stats: DataFrame) -> DataFrame:
    """Of each kind, node and metric a row for every bin from the least to the greatest,
    empty ones too: bin, label, group_count; and of the metric minimum, maximum and mean."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), whole_number(F.col(m)).alias("value")) for m in METRICS]))
    rows = stats.select("group_type", "hierarchy_node", long.alias("x")).select("group_type", "hierarchy_node", "x.*").filter("value is not null")
    by_power = F.col("metric").isin(*LOGARITHMIC)
    rows = rows.withColumn("bin", F.when(by_power, F.length(F.bin(F.greatest("value", F.lit(1)))) - 1).otherwise(F.col("value")).cast("long"))
    by = ["group_type", "hierarchy_node", "metric"]
    counts = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("group_count"))
    ends = rows.groupBy(*by).agg(
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"), F.min("bin").alias("low"),
        F.max("bin").alias("high")
    )
    dense = ends.withColumn("bin", F.explode(F.sequence("low", "high"))).join(counts, [*by, "bin"], "left")
    power = F.pow(F.lit(2), F.col("bin")).cast("long")
    label = F.when(~by_power, F.col("bin").cast("string")).when(F.col("bin") == 0, "1").otherwise(F.concat_ws("–", power, 2 * power - 1))
    return dense.select(*by, "bin", label.alias("label"), F.coalesce("group_count", F.lit(0)).alias("group_count"), "minimum", "maximum", "mean")


def network_groups(stats: DataFrame, distances: DataFrame, most: int) -> DataFrame:
    """The ``most`` groups of a network: those with distances first, then the largest, then by key.

    ``distances`` is any table with the keys of the groups that have some.
    """
    have = distances.select(*KEY).distinct().withColumn("has_distance", F.lit(True))
    rows = stats.join(have, list(KEY), "left").withColumn("has_distance", F.coalesce("has_distance", F.lit(False)))
    key = F.concat_ws("|", "group_type", "hierarchy_node", "group_id")
    return rows.orderBy(F.col("has_distance").desc(), F.col("member_count").desc(), key.desc()).limit(most)


def first_by_hash(rows: DataFrame, most: int, by: tuple[str, ...] = KEY, identifier: str = "member_id", order: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` rows of each ``by``, one an identifier, by a hash of both; of rows of
    one identifier the first in ``order`` (species if not named)."""
    order = order or tuple(c for c in ("species_label", "source_file") if c in rows.columns)
    own = Window.partitionBy(*by, identifier).orderBy(*[F.col(c).asc_nulls_last() for c in order] or [F.lit(0)])
    once = rows.withColumn("__k", F.row_number().over(own)).filter("__k = 1")
    rank = Window.partitionBy(*by).orderBy(stable_hash(*map(F.col, by), F.col(identifier)), F.col(identifier))
    return once.withColumn("__k", F.row_number().over(rank)).filter(F.col("__k") <= most).drop("__k")


def network_members(groups: DataFrame, members: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """Members to show of each network group: ends of its pairs if it has any, else a sample
    of its members; ends that are no members stay as unresolved."""
    keys = groups.select(*KEY)
    ends = pairs.join(keys, list(KEY), "left_semi").select(*KEY, F.explode(F.array("member_a", "member_b")).alias("member_id")).distinct()
    ends = first_by_hash(ends, most)
    own = members.join(keys, list(KEY), "left_semi").select(*KEY, "species_label", "member_id")
    named = own.groupBy(*KEY, "member_id").agg(F.min("species_label").alias("species_label"))
    paired = ends.join(named, [*KEY, "member_id"], "left").withColumn("species_label", F.coalesce("species_label", F.lit("unresolved_distance_identifier")))
    rest = first_by_hash(own.join(ends.select(*KEY).distinct(), list(KEY), "left_anti"), most)
    return paired.select(*KEY, "species_label", "member_id").unionByName(rest.select(*KEY, "species_label", "member_id"))


def of_selected(groups: DataFrame, rows: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Rows (nodes, edges, inventory, sequences) of the selected groups."""
    return rows.join(groups.select(*on).distinct(), list(on), "left_semi")


def matrix_rows(pairs: DataFrame, order: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The upper triangle of each group's distance matrix in a given order of members
    (keys, member_id, position): row, column and distance; a row per pair of placed members."""
    at = [order.select(*keys, F.col("member_id").alias(f"member_{e}"), F.col("position").alias(f"at_{e}")) for e in "ab"]
    placed = pairs.join(at[0], [*keys, "member_a"]).join(at[1], [*keys, "member_b"])
    return placed.select(*keys, F.least("at_a", "at_b").alias("row"), F.greatest("at_a", "at_b").alias("column"), "distance")
