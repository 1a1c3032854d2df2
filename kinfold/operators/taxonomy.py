"""Taxonomy: closure, selectors, composition of groups, enrichment, coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..functions.stats import benjamini_hochberg, fisher_greater
from ..schemas import KEY
from ..tables import written
from .search import preferred_distance

SELECTORS = ("REQUIRED_EXACT", "INCLUDE_CLADE", "ONLY_IN_CLADE", "EXCLUDE_EXACT", "EXCLUDE_CLADE")


def closure(edges: DataFrame, most_depth: int = 200) -> DataFrame:
    """ancestor, descendant, depth for edges (child, parent): every node with itself (depth
    0) and all above it. Path doubling on tables: a round squares the paths known, so a
    tree of depth d takes log2 d rounds."""
    nodes = edges.select(F.col("child").alias("n")).unionByName(edges.select(F.col("parent").alias("n"))).filter("n is not null").distinct()
    paths = edges.filter("parent is not null").select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    reach = 1
    while True:
        far = paths.filter(F.col("depth") == reach)
        if far.isEmpty():
            break
        if reach > most_depth:
            raise IntegrityError("the taxonomy has a cycle, or is deeper than allowed")
        step = far.select(F.col("ancestor").alias("middle"), F.col("descendant").alias("d"))
        more = step.join(paths, step["middle"] == paths["descendant"]).select(
            F.col("d").alias("descendant"), "ancestor", (F.col("depth") + reach).alias("depth")
        )
        paths = paths.unionByName(more).distinct()
        reach *= 2
    own = nodes.select(F.col("n").alias("descendant"), F.col("n").alias("ancestor"), F.lit(0).alias("depth"))
    return paths.unionByName(own).select("ancestor", "descendant", "depth")


def graph_edges(lineages: DataFrame) -> DataFrame:
    """child, parent of rows with ``lineage`` (array of taxon ids from the root) and
    ``taxon_id``; a taxon with two parents is an error."""
    path = F.concat("lineage", F.array("taxon_id"))
    steps = F.explode(
        F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda i: F.struct(F.get(path, i).alias("child"), F.get(path, i - 1).alias("parent")))
    )
    edges = lineages.filter("taxon_id is not null").select(steps.alias("x")).select("x.*").filter(
        "child is not null and (parent is null or child != parent)"
    ).distinct()
    bad = edges.filter("parent is not null").groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if bad:
        raise IntegrityError(f"taxon {bad[0]['child']} has more than one parent")
    return edges


@dataclass(frozen=True)
class Selector:
    kind: str
    taxon_id: object

    def __post_init__(self) -> None:
        if self.kind not in SELECTORS:
            raise InputError(f"unknown selector {self.kind}")


def check_selection(selectors: list[Selector], closed: DataFrame) -> None:
    """Selectors that contradict each other fail before anything is planned."""
    wanted = [s.taxon_id for s in selectors]
    under = {(r["ancestor"], r["descendant"]) for r in closed.filter(F.col("ancestor").isin(wanted) & F.col("descendant").isin(wanted)).collect()}
    of = {k: [s.taxon_id for s in selectors if s.kind == k] for k in SELECTORS}
    for t in [*of["REQUIRED_EXACT"], *of["INCLUDE_CLADE"]]:
        if any((x, t) in under for x in of["EXCLUDE_CLADE"]) or t in of["EXCLUDE_EXACT"] and t in of["REQUIRED_EXACT"]:
            raise InputError(f"taxon {t} is both wanted and excluded")
    for t in of["REQUIRED_EXACT"]:
        if any((x, t) not in under for x in of["ONLY_IN_CLADE"]):
            raise InputError(f"required taxon {t} lies outside the only-in scope")


def select_groups(present: DataFrame, closed: DataFrame, selectors: list[Selector], keys: tuple[str, ...] = KEY) -> DataFrame:
    """Groups with ``passes`` and ``failures`` for rows (keys, taxon_id or null if unmapped).

    The taxa below each selector are flagged on the distinct taxa, once; groups then take
    one aggregation of flags. Unmapped members never prove absence: only-in fails with
    any, exclusion does not.
    """
    taxa = present.select("taxon_id").distinct().filter("taxon_id is not null")
    named = closed.filter(F.col("ancestor").isin([s.taxon_id for s in selectors]))
    under = taxa.join(named, taxa["taxon_id"] == named["descendant"], "left").groupBy("taxon_id").agg(F.collect_set("ancestor").alias("__over"))
    rows = present.join(under, "taxon_id", "left")
    mapped, unmapped = F.col("taxon_id").isNotNull(), F.count_if(F.col("taxon_id").isNull()) > 0
    only = [s.taxon_id for s in selectors if s.kind == "ONLY_IN_CLADE"]
    in_all = F.lit(True)
    for t in only:
        in_all = in_all & F.array_contains("__over", F.lit(t))
    checks = []
    for s in selectors:
        below, exact = F.coalesce(F.array_contains("__over", F.lit(s.taxon_id)), F.lit(False)), F.coalesce(F.col("taxon_id") == F.lit(s.taxon_id), F.lit(False))
        ok = {
            "REQUIRED_EXACT": F.bool_or(exact),
            "INCLUDE_CLADE": F.bool_or(below),
            "ONLY_IN_CLADE": (F.count_if(mapped) > 0) & F.bool_and(F.coalesce(in_all, F.lit(False)) | ~mapped) & ~unmapped,
            "EXCLUDE_EXACT": ~F.bool_or(exact),
            "EXCLUDE_CLADE": ~F.bool_or(below),
        }[s.kind]
        checks.append((f"{s.kind}:{s.taxon_id}", ok))
    out = rows.groupBy(*keys).agg(
        F.count_if(~mapped).alias("unmapped_count"), F.count_distinct("taxon_id").alias("taxon_count"),
        *[ok.alias(f"__c{i}") for i, (_, ok) in enumerate(checks)]
    )
    failed = F.filter(
        F.array(*[F.when(~F.col(f"__c{i}"), F.lit(n)) for i, (n, _) in enumerate(checks)]), lambda x: x.isNotNull()
    ) if checks else F.array().cast("array<string>")
    return out.withColumn("failures", F.array_join(failed, ";")).withColumn("passes", F.col("failures") == "").drop(*[f"__c{i}" for i in range(len(checks))])


def composition(stats: DataFrame, species: DataFrame, categories: DataFrame, target_species: int) -> DataFrame:
    """Target, outside and unresolved species and members of each group.

    ``categories`` (species_label, category) has a row a species; species without one are
    UNRESOLVED.
    """
    c = F.coalesce("category", F.lit("UNRESOLVED"))
    rows = species.join(categories.select("species_label", "category"), "species_label", "left").withColumn("category", c)
    counts = {}
    for name in ("TARGET", "OUTSIDE", "UNRESOLVED"):
        counts[f"{name.lower()}_species_count"] = F.count_if(F.col("category") == name)
        counts[f"{name.lower()}_member_count"] = F.sum(F.when(F.col("category") == name, F.col("species_member_count")))
    lists = {
        n: F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("category") == k, F.col("species_label")))), "; "
        ) for n, k in (("outsider_species_labels", "OUTSIDE"), ("unresolved_species_labels", "UNRESOLVED"))
    }
    per = rows.groupBy(*KEY).agg(*[v.alias(k) for k, v in (counts | lists).items()])
    out = stats.select(*KEY, "legacy_orthogroup_id", "member_count", "species_count").join(per, list(KEY))
    mapped = F.col("target_species_count") + F.col("outside_species_count")
    return out.withColumn("target_coverage", F.col("target_species_count") / F.lit(float(target_species))).withColumn(
        "mapped_target_fraction", F.when(mapped > 0, F.col("target_species_count") / mapped).otherwise(0.0)
    )


def search_composition(
    summary: DataFrame, mode: str, least_target: int = 1, least_coverage: float = 0.0, least_purity: float = 0.0, most_outside: int = 0,
    most_unresolved: int = 0
) -> DataFrame:
    """CONTAINS, SAMPLED_EXCLUSIVE (nothing outside, nothing unresolved) or NEAR_EXCLUSIVE."""
    out = summary.filter(
        (F.col("target_species_count") >= least_target) & (F.col("target_coverage") >= least_coverage) & (
            F.col("mapped_target_fraction") >= least_purity
        )
    )
    if mode == "SAMPLED_EXCLUSIVE":
        return out.filter("outside_species_count = 0 and unresolved_species_count = 0")
    if mode == "NEAR_EXCLUSIVE":
        return out.filter((F.col("outside_species_count") <= most_outside) & (F.col("unresolved_species_count") <= most_unresolved))
    if mode != "CONTAINS":
        raise InputError(f"unknown taxonomy mode {mode}")
    return out


def enrichment(summary: DataFrame, total_target: int, total_outside: int, most_q: float = 1.0, least_odds: float = 0.0) -> DataFrame:
    """Groups with their one-sided Fisher p, odds ratio and q-value over all groups tested."""
    tested = fisher_greater(
        summary.filter("target_species_count + outside_species_count > 0"), "target_species_count", "outside_species_count", total_target,
        total_outside
    )
    tested = written(tested, "tested")  # ranked by what it took two families of joins to make
    scored = benjamini_hochberg(tested, "fisher_p_value", ["group_type", "hierarchy_node", "group_id"])
    return scored.filter((F.col("fdr_q_value") <= most_q) & (F.col("odds_ratio") >= least_odds))


def with_distance(rows: DataFrame, distances: DataFrame) -> DataFrame:
    """Rows with their group's preferred distance."""
    return rows.join(
        preferred_distance(distances).select(
            *KEY, "distance_method", "computation_status", "sampled_member_count", "distance_pair_count", "mean_distance", "median_distance",
            "population_stddev_distance"
        ),
        list(KEY), "left"
    )


def coverage(closed: DataFrame, represented: DataFrame, expected: DataFrame, outside: DataFrame) -> DataFrame:
    """Every ancestor of an expected or represented taxon with its audit counts and its
    primary state, in order of precedence; inputs have the column taxon_id."""
    flags = [(represented, "represented"), (expected, "expected"), (outside, "outside")]
    marks = None
    for df, name in flags:
        one = df.select("taxon_id").distinct().withColumn("k", F.lit(name))
        marks = one if marks is None else marks.unionByName(one)
    up = marks.join(closed, marks["taxon_id"] == closed["descendant"])
    own = F.col("depth") == 0
    per = up.groupBy(F.col("ancestor").alias("node_id")).agg(
        F.count_distinct(F.when(F.col("k") == "represented", F.col("taxon_id"))).alias("represented_descendants"),
        F.count_distinct(F.when(F.col("k") == "expected", F.col("taxon_id"))).alias("expected_descendants"),
        *[F.bool_or(own & (F.col("k") == name)).alias(f"is_{name}") for _, name in flags],
    )
    state = F.when(F.col("is_outside"), "OUTSIDE_SELECTED_SCOPE_WITH_HITS").when(F.col("is_represented"), "REPRESENTED_IN_INPUT").when(F.col("is_expected"), "EXPECTED_NO_DATA").when(
        F.col("represented_descendants") > 0, "ANCESTOR_OF_REPRESENTED"
    ).otherwise("NOT_IN_EXPECTED_UNIVERSE")
    return per.withColumn("coverage_state", state)


def common_root(closed: DataFrame, terminals: DataFrame) -> DataFrame:
    """The deepest node above all of ``terminals`` (taxon_id)."""
    t = terminals.select("taxon_id").distinct()
    n = t.agg(F.count(F.lit(1)).alias("n"))
    over = t.join(closed, t["taxon_id"] == closed["descendant"]).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("below"))
    return over.join(n, "n").orderBy("below", "ancestor").limit(1).select(F.col("ancestor").alias("root_id"))
