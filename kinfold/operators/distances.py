"""Pairwise distances: samples, site differences, summaries, dispersion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ladder
from ..functions.text import stable_hash
from ..schemas import KEY

#: Fixed value: residues that take no part in a comparison.
UNKNOWN = ("-", ".", "X", "?", "*")


def member_sample(
    members: DataFrame, most: int, keys: tuple[str, ...] = KEY, member: str = "member_id", required: str | None = None,
    salt: tuple[str, ...] = ("run_id", "group_id")
) -> DataFrame:
    """At most ``most`` members of each group: required ones first, then by a hash of run,
    group and member. Adds computation_status (EXACT or DETERMINISTIC_MEMBER_SAMPLE).

    Hot groups: Spark cuts each partition's share of a group to ``most`` rows before the
    shuffle (a rank limit on a window), so none gathers a whole group.
    """
    first = F.when(F.col(required), 0).otherwise(1) if required else F.lit(0)
    order = Window.partitionBy(*keys).orderBy(first, stable_hash(*map(F.col, salt), F.col(member)), F.col(member))
    kept = members.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_member_count"))
    return kept.join(sizes, list(keys)).withColumn(
        "computation_status", F.when(F.col("total_member_count") <= most, "EXACT").otherwise("DETERMINISTIC_MEMBER_SAMPLE")
    )


def site_difference(a: Column, b: Column) -> Column:
    """Struct of comparable and mismatching sites and their ratio (null without comparable
    sites) of two aligned sequences."""
    unknown = F.array(*map(F.lit, UNKNOWN))
    sites = F.zip_with(
        F.split(F.upper(a), ""), F.split(F.upper(b), ""),
        lambda x, y: F.when(
            x.isNull() | y.isNull() | (x == "") | F.array_contains(unknown, x) | F.array_contains(unknown, y), F.lit(None)
        ).otherwise((x != y).cast("long"))
    )
    known = F.filter(sites, lambda x: x.isNotNull())
    wrong = F.aggregate(known, F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.size(known).cast("long")
    return F.struct(n.alias("comparable_sites"), wrong.alias("mismatch_sites"), F.try_divide(wrong.cast("double"), n.cast("double")).alias("distance"))


def pairs(rows: DataFrame, keys: tuple[str, ...], member: str, *carried: str) -> DataFrame:
    """Unordered pairs within groups of bounded size (take a :func:`member_sample` first)."""
    a = rows.select(*keys, F.col(member).alias("member_a"), *[F.col(c).alias(f"{c}_a") for c in carried])
    b = rows.select(*keys, F.col(member).alias("member_b"), *[F.col(c).alias(f"{c}_b") for c in carried])
    return a.join(b, list(keys)).filter("member_a < member_b")


def alignment_distances(aligned: DataFrame, most: int = 250, keys: tuple[str, ...] = KEY) -> DataFrame:
    """All pairs of sampled members (member_id, sequence) of each alignment."""
    sampled = member_sample(aligned, most, keys)
    both = pairs(sampled, keys, "member_id", "sequence", "computation_status")
    return both.withColumn("x", site_difference(F.col("sequence_a"), F.col("sequence_b"))).select(
        *keys, "member_a", "member_b", F.lit("p_distance").alias("distance_method"), "x.distance", "x.comparable_sites", "x.mismatch_sites",
        F.col("computation_status_a").alias("computation_status")
    )


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two number arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def summarise(rows: DataFrame, keys: tuple[str, ...] = KEY, distance: str = "distance") -> DataFrame:
    """Exact quantiles (linear interpolation), mean and population deviation of each
    group's resolved pairs; null statistics where no pair is resolved."""
    d = F.col(distance)
    q = F.percentile(d, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    out = rows.groupBy(*keys).agg(
        F.count(d).alias("distance_pair_count"), F.count_if(d.isNull()).alias("unresolved_pair_count"), F.min(d).alias("minimum_distance"),
        q.alias("__q"), F.avg(d).alias("mean_distance"), F.max(d).alias("maximum_distance"), F.stddev_pop(d).alias("population_stddev_distance")
    )
    named = zip(("q05_distance", "q25_distance", "median_distance", "q75_distance", "q95_distance"), range(5), strict=True)
    return out.withColumns({n: F.get("__q", F.lit(i)) for n, i in named}).drop("__q")


def both_ways(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Each pair from either end: member, other, distance; one scan, no union."""
    ends = F.explode(
        F.array(
            F.struct(F.col("member_a").alias("member"), F.col("member_b").alias("other")),
            F.struct(F.col("member_b").alias("member"), F.col("member_a").alias("other"))
        )
    )
    return rows.select(*keys, "distance", ends.alias("x")).select(*keys, "x.member", "x.other", "distance")


def member_dispersion(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Of each member: mean, median, deviation and range of its distances, its nearest
    other, and whether it is the medoid (least total, then least id)."""
    d = F.col("distance")
    out = both_ways(rows, keys).groupBy(*keys, "member").agg(
        F.count(d).alias("pair_count"), F.sum(d).alias("total_distance"), F.avg(d).alias("mean_distance"), F.median(d).alias("median_distance"),
        F.stddev_pop(d).alias("stddev_distance"), F.min(d).alias("minimum_distance"), F.max(d).alias("maximum_distance"),
        F.min(F.struct(d, F.col("other")))["other"].alias("nearest_member")
    )
    best = out.groupBy(*keys).agg(F.min(F.struct(F.round("total_distance", 9).alias("t"), F.col("member").alias("m")))["m"].alias("__medoid"))
    return out.join(best, list(keys)).withColumn("is_medoid", F.col("member") == F.col("__medoid")).drop("__medoid")


def class_pairs(rows: DataFrame, species: DataFrame) -> DataFrame:
    """Pairs with both ends' species (member_id, species_label) and pair_class."""
    out = rows.join(
        species.select(F.col("member_id").alias("member_a"), F.col("species_label").alias("species_a")), "member_a", "left"
    ).join(species.select(F.col("member_id").alias("member_b"), F.col("species_label").alias("species_b")), "member_b", "left")
    return out.withColumn("pair_class", F.when(F.col("species_a") == F.col("species_b"), "WITHIN_SPECIES").otherwise("BETWEEN_SPECIES"))


def species_dispersion(rows: DataFrame) -> DataFrame:
    """Statistics of pairs by unordered pair of species."""
    d = F.col("distance")
    return rows.groupBy(F.least("species_a", "species_b").alias("species_1"), F.greatest("species_a", "species_b").alias("species_2")).agg(
        F.count(d).alias("pair_count"), F.avg(d).alias("mean_distance"), F.median(d).alias("median_distance"),
        F.stddev_pop(d).alias("stddev_distance"), F.min(d).alias("minimum_distance"), F.max(d).alias("maximum_distance")
    )


def focused(rows: DataFrame, member: str) -> DataFrame:
    """Pairs of one member, nearest first."""
    hit = rows.filter((F.col("member_a") == member) | (F.col("member_b") == member))
    return hit.withColumn(
        "other_member", F.when(F.col("member_a") == member, F.col("member_b")).otherwise(F.col("member_a"))
    ).orderBy(F.col("distance").asc_nulls_last(), "other_member")


def histogram(rows: DataFrame, keys: tuple[str, ...] = KEY, bins: int = 20, value: str = "distance") -> DataFrame:
    """Counts in ``bins`` equal bins from least to greatest, the last one closed."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    width = F.col("__high") - F.col("__low")
    bin_ = F.when(width <= 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__low")) / width * bins))).cast("long")
    return rows.filter(F.col(value).isNotNull()).join(ends, list(keys)).withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("pair_count"))


def cumulative(rows: DataFrame, keys: tuple[str, ...], value: str = "distance") -> DataFrame:
    """Empirical distribution: the share of a group's pairs up to each."""
    return rows.filter(F.col(value).isNotNull()).withColumn("cumulative_fraction", F.cume_dist().over(Window.partitionBy(*keys).orderBy(F.col(value).asc())))


def nearest_neighbours(rows: DataFrame, k: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Undirected edges between each member and its k nearest (ties by id)."""
    order = Window.partitionBy(*keys, "member").orderBy(F.col("distance").asc_nulls_last(), F.col("other").asc())
    near = both_ways(rows.filter("distance is not null"), keys).withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= k)
    return near.select(*keys, F.least("member", "other").alias("member_a"), F.greatest("member", "other").alias("member_b"), "distance").distinct()


def stratified_quotas(counts: DataFrame, most: int, stratum: str, count: str) -> DataFrame:
    """Places of each stratum among ``most``: in proportion, at least one, by largest
    remainders (ties by name); a row a stratum."""
    total = F.sum(count).over(Window.partitionBy())
    share = F.col(count) * most / total
    base = counts.withColumn("__share", share).withColumn(
        "__floor", F.least(F.col(count).cast("double"), F.greatest(F.lit(1.0), F.floor("__share").cast("double")))
    )
    left = F.greatest(F.lit(0.0), most - F.sum("__floor").over(Window.partitionBy()))
    more = F.row_number().over(Window.orderBy((F.col("__share") - F.floor("__share")).desc(), F.col(stratum).asc()))
    return base.withColumn("quota", F.least(F.col(count), (F.col("__floor") + F.when(more <= left, 1).otherwise(0)).cast("long"))).drop("__share", "__floor")


def class_histogram(rows: DataFrame, bins: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of each pair class's distances in equal bins over all of them."""
    own = rows.filter(F.col("distance").isNotNull())
    ends = own.groupBy(*keys).agg(F.min("distance").alias("__low"), F.max("distance").alias("__high"))
    met = own.join(ends, list(keys)) if keys else own.crossJoin(F.broadcast(ends))  # one row
    width = F.col("__high") - F.col("__low")
    bin_ = F.when(width <= 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("distance") - F.col("__low")) / width * bins))).cast("long")
    counts = met.groupBy(*keys, "pair_class", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("pair_count"))
    sizes = own.groupBy(*keys, "pair_class").agg(F.count(F.lit(1)).alias("__n"))
    return counts.join(sizes, [*keys, "pair_class"]).withColumn("probability", F.col("pair_count") / F.col("__n")).drop("__n")


def class_cumulative(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Empirical distribution of each pair class at its distinct distances."""
    by = [*keys, "pair_class"]
    steps = ladder(rows.select(*by, "distance").withColumn("n", F.lit(1)), by, "distance", "n")
    sizes = rows.filter(F.col("distance").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    return steps.join(sizes, by).select(*by, "distance", ((F.col("below_n") + F.col("n")) / F.col("total")).alias("cumulative_fraction"))
