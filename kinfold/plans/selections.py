"""Queries of what users pick, compare and report, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark, catalogue, distances, expression, memberships, motif, plan, report, search, selection, selectors
from ..operators.taxonomy import Selector
from ..schemas import KEY
from ..tables import written
from .bridge import RUN, Bridge, sql
from .queries import _BENCH, _SUMMARY, _VECTORS, _contexts, _links, _mapped, _motif_sql, _values, _vectors, query, r

#: The group that single-group queries show.
G7 = {"run_id": RUN, "group_type": "HOG", "hierarchy_node": "N0", "group_id": "G7"}
P7 = {"run_id": RUN, "group_type": "LEGACY_ORTHOGROUP", "hierarchy_node": "", "group_id": "P7"}
_SHOWN = """shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN distance_pair_count > 0 THEN 0 ELSE 1 END, distance_method) AS r FROM distances) WHERE r = 1)"""


# lists and single groups
@query(sql("lines members", "SELECT DISTINCT species_label FROM members"))
def list_species(b: Bridge) -> DataFrame:
    return selectors.distinct_values(b.species(), "species_label")


@query("SELECT unnest(['HOG', 'LEGACY_ORTHOGROUP']) AS group_type")
def list_group_types(b: Bridge) -> DataFrame:
    return selectors.distinct_values(memberships.group_statistics(b.all_members()), "group_type")


@query("SELECT 'N0' AS hierarchy_node")
def list_hierarchy_nodes(b: Bridge) -> DataFrame:
    return selectors.hierarchy_nodes(memberships.group_statistics(b.all_members()), "HOG")


@query(
    sql(
        "lines members species stats pairs distances",
        f", {_SHOWN} SELECT group_id, member_count, species_count, distance_method, distance_pair_count, round(mean_distance, 6) AS mean_distance FROM stats LEFT JOIN shown USING (group_id) WHERE group_id = 'G7'"
    )
)
def get_group(b: Bridge) -> DataFrame:
    found = selectors.one_group(b.stats(), b.distance_statistics(), G7)
    return found.select("group_id", "member_count", "species_count", "distance_method", "distance_pair_count", r("mean_distance"))


@query(sql("lines members species", "SELECT group_id, species_label, species_member_count FROM species WHERE group_id = 'G7'"))
def get_group_species(b: Bridge) -> DataFrame:
    return selectors.group_species(b.species(), G7).select("group_id", "species_label", "species_member_count")


@query(
    sql(
        "lines members species",
        "SELECT group_id, species_label, species_member_count FROM species JOIN orders ON group_id = 'G' || o_orderkey WHERE o_orderpriority = '1-URGENT'"
    )
)
def group_species_collection(b: Bridge) -> DataFrame:
    ids = _orders(b, "o_orderpriority = '1-URGENT'")
    return selectors.group_species_collection(b.species(), "HOG", "N0", ids).select("group_id", "species_label", "species_member_count")


@query(sql("lines legacy", "SELECT group_id, species_label, member_id FROM legacy WHERE group_id = 'P7' ORDER BY species_label, member_id LIMIT 5"))
def first_group_members(b: Bridge) -> DataFrame:
    return selectors.first_members(b.all_members(), P7, 5).select("group_id", "species_label", "member_id")


@query(sql("pairs", "SELECT member_a, member_b, round(distance, 6) AS distance FROM pairs WHERE group_id = 'G7'"))
def group_distances(b: Bridge) -> DataFrame:
    pairs = b.pair_distances().withColumn("distance_method", F.lit("price"))
    return selectors.group_pairs(pairs, G7, "price").select("member_a", "member_b", r("distance"))


@query(
    sql(
        "lines members",
        ", s AS (SELECT n_name AS species_label, l_partkey || '-' || l_linenumber AS member_id, l_orderkey || '_' || l_linenumber AS internal_id FROM lines) SELECT DISTINCT s.* FROM s JOIN (SELECT * FROM members WHERE group_id = 'G7') m USING (species_label, member_id)"
    )
)
def group_sequence_aliases(b: Bridge) -> DataFrame:
    return selectors.group_aliases(b.sequences(), b.members(), G7)


@query(
    sql(
        "lines members species stats pairs distances",
        "SELECT group_id, distance_method, round(sampled_member_count / total_member_count, 6) AS sampling_fraction, sampled_member_count = total_member_count AS full_group_matrix, round(q75_distance - q25_distance, 6) AS interquartile_range FROM stats JOIN distances USING (group_id) WHERE distance_method = 'price'"
    )
)
def chosen_distance_columns(b: Bridge) -> DataFrame:
    rows = search.distance_results(b.stats(), b.distance_statistics(), method="price")
    found = selectors.shown_columns(rows, ["group_id", "distance_method", "sampling_fraction", "full_group_matrix", "interquartile_range"])
    return found.withColumns({c: r(c) for c in ("sampling_fraction", "interquartile_range")})


@query(sql("lines members", "SELECT group_id, member_id, count(*) OVER () AS total_count FROM members WHERE contains(member_id, '77')"))
def member_hits_with_total(b: Bridge) -> DataFrame:
    hits = b.members().filter(F.contains("member_id", F.lit("77"))).select("group_id", "member_id")
    return selectors.with_total(hits)


@query("SELECT p_brand AS cluster_id, count(*) AS member_count, count(*) OVER () AS total_count FROM part GROUP BY ALL HAVING count(*) >= 10")
def cluster_browse_with_total(b: Bridge) -> DataFrame:
    index = b.table("part").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count(F.lit(1)).alias("member_count"))
    return selectors.with_total(catalogue.browse(index, least_members=10))


@query(sql("categories", "SELECT species_label FROM categories WHERE category = 'OUTSIDE'"))
def reviewed_outside(b: Bridge) -> DataFrame:
    c = b.categories()
    return selectors.reviewed_outside(c.filter("category != 'UNRESOLVED'"), c.filter("category = 'TARGET'"))


def _region(b: Bridge, name: str) -> DataFrame:
    return b.taxonomy().filter(F.col("parent") == f"R:{name}").select(F.col("child").alias("species_label"))


_ROLES = "CASE WHEN r_name = 'EUROPE' OR n_name = 'NATION_2' THEN 'PRIMARY_ANALYSIS' WHEN r_name = 'ASIA' THEN 'REQUIRED_COMPARISON' WHEN r_name = 'AFRICA' THEN 'EXCLUDED_COMPARISON' ELSE 'OTHER_SAMPLED' END"


@query(f"SELECT n_name AS species_label, {_ROLES} AS role FROM nation JOIN region ON n_regionkey = r_regionkey")
def species_roles(b: Bridge) -> DataFrame:
    nations = b.table("nation").select(F.col("n_name").alias("species_label"))
    primary = _region(b, "EUROPE").unionByName(nations.filter("species_label = 'NATION_2'"))
    return selectors.species_roles(nations, primary, _region(b, "ASIA").unionByName(_region(b, "EUROPE")), _region(b, "AFRICA"))


_LANG = "CASE lang WHEN 'en' THEN 'PRIMARY_ANALYSIS' WHEN 'de' THEN 'REQUIRED_COMPARISON' ELSE 'OTHER_SAMPLED' END"


@query(
    _motif_sql(
        "ends_with(clean, 'N')",
        f"SELECT group_id, species_label, member_id, {_LANG.replace('lang', 'species_label')} AS role FROM hits WHERE have AND NOT hit AND species_label IN ('en', 'fr', 'es') AND contains(member_id, '1') AND {_LANG.replace('lang', 'species_label')} != 'REQUIRED_COMPARISON'"
    )
)
def motif_members_by_role(b: Bridge) -> DataFrame:
    rows = motif.group_members(b.motif_members(), b.motif_sequences(), "N", "SUFFIX")
    langs = rows.select("species_label").distinct()
    roles = selectors.species_roles(langs, langs.filter("species_label = 'en'"), langs.filter("species_label = 'de'"), langs.limit(0))
    found = selectors.filter_members(rows, roles, "Not matching", ("PRIMARY_ANALYSIS", "OTHER_SAMPLED"), ("en", "fr", "es"), "1")
    return found.select("group_id", "species_label", "member_id", "role")


@query(
    f"{_VECTORS}, s AS (SELECT *, (member_a % 4)::VARCHAR AS species_a, (member_b % 4)::VARCHAR AS species_b FROM vp) SELECT group_id, member_a, member_b, species_a, species_b FROM s WHERE species_a != species_b AND (species_a = '1' OR species_b = '1') AND (contains(member_a::VARCHAR, '7') OR contains(member_b::VARCHAR, '7'))"
)
def pairs_between_species(b: Bridge) -> DataFrame:
    species = b.table("embeddings").select(F.col("vec_id").alias("member_id"), (F.col("vec_id") % 4).cast("string").alias("species_label"))
    rows = distances.class_pairs(_vectors(b), species)
    return selectors.filter_pairs(rows, "7", ["1"], "Between species").select("group_id", "member_a", "member_b", "species_a", "species_b")


@query(
    sql(
        "lines pairs distances",
        "SELECT 'HOG / N0 / ' || group_id AS label, group_id, total_member_count AS analytical_members, sampled_member_count AS displayed_members, distance_method, distance_pair_count, round(median_distance, 6) AS median_distance FROM distances WHERE group_id IN ('G1', 'G2', 'G3', 'G7')"
    )
)
def group_comparison(b: Bridge) -> DataFrame:
    found = selectors.comparison(b.distance_statistics(), ["G1", "G2", "G3", "G7"])
    return found.select("label", "group_id", "analytical_members", "displayed_members", "distance_method", "distance_pair_count", r("median_distance"))


# expression evidence
_EVIDENCE = "atlas preferred emembers mapping context"


@query(
    sql(
        _EVIDENCE,
        _SUMMARY + ", g AS (SELECT group_id, species_label FROM summary WHERE context_count > 0 GROUP BY ALL) SELECT species_label, count(*) AS group_count FROM g GROUP BY ALL"
    )
)
def expression_species_rank(b: Bridge) -> DataFrame:
    summary = expression.member_summary(_mapped(b), _contexts(b))
    rows = b.expression_groups().join(summary, list(expression.MEMBER)).groupBy(*KEY, "species_label")
    return selectors.rank_species(rows.agg(F.count_if(F.col("context_count") > 0).alias("expression_observed_member_count")))


@query(
    sql(
        _EVIDENCE,
        _SUMMARY + "SELECT group_id, species_label, member_id, mapping_status, matched_gene_ids, context_count, round(f, 6) AS positive_context_fraction FROM summary WHERE species_label IN ('S0', 'S1')"
    )
)
def expression_member_evidence(b: Bridge) -> DataFrame:
    mapped = _mapped(b)
    members = b.expression_groups().unionByName(b.expression_groups()).distinct()
    found = expression.evidence(members, mapped, expression.member_summary(mapped, _contexts(b)), species=("S0", "S1"))
    return found.select("group_id", "species_label", "member_id", "mapping_status", "matched_gene_ids", "context_count", r("positive_context_fraction"))


@query(
    sql(
        _EVIDENCE,
        _SUMMARY + "SELECT group_id, species_label, member_id, mapping_status FROM summary ORDER BY group_id, species_label, member_id LIMIT 100"
    )
)
def expression_evidence_page(b: Bridge) -> DataFrame:
    mapped = _mapped(b)
    rows = expression.evidence(b.expression_groups(), mapped, expression.member_summary(mapped, _contexts(b)))
    found, _ = selectors.first_rows(rows, ["group_id", "species_label", "member_id"], 100)
    return found.select("group_id", "species_label", "member_id", "mapping_status")


@query(
    sql(
        _EVIDENCE,
        "SELECT group_id, species_label, member_id, gene_id, experiment_accession, expression_context, round(expression_value, 6) AS expression_value FROM context WHERE species_label = 'S1'"
    )
)
def expression_context_records(b: Bridge) -> DataFrame:
    found = expression.context_records(b.expression_groups(), _contexts(b), species=("S1",))
    return found.select("group_id", "species_label", "member_id", "gene_id", "experiment_accession", "expression_context", r("expression_value"))


@query(
    "SELECT DISTINCT 'S' || (user_id % 3) AS species_label, 'm' || user_id AS member_id FROM events WHERE 'S' || (user_id % 3) IN (SELECT 'S' || (user_id % 3) FROM events WHERE value > 0)"
)
def assessed_memberships(b: Bridge) -> DataFrame:
    assessed = b.atlas().filter("expression_value > 0").select(F.col("species_column").alias("species_label"))
    parts = [b.expression_groups().filter("group_id < 'E2'"), b.expression_groups().filter("group_id >= 'E2'")]
    return expression.assessed_members(parts, assessed).select("species_label", "member_id").distinct()


# report tables
_METRIC_ROWS = "m AS (SELECT group_type, hierarchy_node, metric, value FROM (UNPIVOT (SELECT group_type, hierarchy_node, member_count, species_count, max_copies_per_species FROM stats) ON member_count, species_count, max_copies_per_species INTO NAME metric VALUE value))"


@query(sql("lines members species stats", f""", {_METRIC_ROWS}, k AS (SELECT *, CASE WHEN metric = 'species_count' THEN value ELSE length(bin(value)) - 1 END AS bin FROM m),
    e AS (SELECT group_type, hierarchy_node, metric, min(value) AS minimum, max(value) AS maximum, avg(value) AS mean, min(bin) AS low, max(bin) AS high FROM k GROUP BY ALL),
    d AS (SELECT *, unnest(range(low, high + 1)) AS bin FROM e), c AS (SELECT metric, bin, count(*) AS n FROM k GROUP BY ALL)
    SELECT group_type, hierarchy_node, metric, bin, CASE WHEN metric = 'species_count' THEN bin::VARCHAR WHEN bin = 0 THEN '1' ELSE (1 << bin) || '–' || ((1 << (bin + 1)) - 1) END AS label, coalesce(n, 0) AS group_count, minimum, maximum, round(mean, 6) AS mean FROM d LEFT JOIN c USING (metric, bin)"""))  # fmt: skip
def dense_histograms(b: Bridge) -> DataFrame:
    return report.dense_histograms(b.stats()).withColumn("mean", r("mean"))


@query(
    sql(
        "lines members species stats",
        "SELECT group_type, hierarchy_node, count(*) AS group_count, count(*) FILTER (max_copies_per_species <= 1) AS single_copy_group_count, count(*) FILTER (max_copies_per_species > 1) AS multicopy_group_count FROM stats GROUP BY ALL"
    )
)
def level_counts(b: Bridge) -> DataFrame:
    return report.level_counts(b.stats())


_NETWORK = "net AS (SELECT stats.*, group_id IN (SELECT group_id FROM pairs) AS has_distance FROM stats ORDER BY has_distance DESC, member_count DESC, 'HOG|N0|' || group_id DESC LIMIT 25)"


def _network(b: Bridge) -> DataFrame:
    return written(report.network_groups(b.stats(), b.paired_groups(), 25), "network")


@query(sql("lines members species stats pairs", f", {_NETWORK} SELECT group_id, member_count, has_distance FROM net"))
def network_groups(b: Bridge) -> DataFrame:
    return _network(b).select("group_id", "member_count", "has_distance")


@query(sql("lines members species stats pairs", f""", {_NETWORK}, ends AS (SELECT DISTINCT group_id, unnest([member_a, member_b]) AS member_id FROM pairs WHERE group_id IN (SELECT group_id FROM net)),
    k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sha256('run' || chr(0) || 'HOG' || chr(0) || 'N0' || chr(0) || group_id || chr(0) || member_id), member_id) AS k FROM ends)
    SELECT k.group_id, coalesce(min(species_label), 'unresolved_distance_identifier') AS species_label, k.member_id FROM k LEFT JOIN members m ON m.group_id = k.group_id AND m.member_id = k.member_id WHERE k <= 4 GROUP BY ALL"""))  # fmt: skip
def network_members(b: Bridge) -> DataFrame:
    groups = _network(b)
    return report.network_members(groups, b.members(), b.pair_distances(groups), 4).select("group_id", "species_label", "member_id")


@query(sql("lines members species stats pairs", f", {_NETWORK} SELECT group_id, member_a, member_b FROM pairs WHERE group_id IN (SELECT group_id FROM net)"))
def network_pairs(b: Bridge) -> DataFrame:
    groups = _network(b)
    return report.of_selected(groups, b.pair_distances(groups), KEY).select("group_id", "member_a", "member_b")


@query(
    f"{_VECTORS}, o AS (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY member_id) AS position FROM v) SELECT vp.group_id, least(a.position, b.position) AS row, greatest(a.position, b.position) AS \"column\", round(distance, 5) AS distance FROM vp JOIN o a ON a.group_id = vp.group_id AND a.member_id = member_a JOIN o b ON b.group_id = vp.group_id AND b.member_id = member_b"
)
def distance_matrix_rows(b: Bridge) -> DataFrame:
    from pyspark.sql import Window

    v = b.table("embeddings").select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("member_id"))
    sampled = distances.member_sample(v, 250, ("group_id",), salt=("group_id",))
    order = sampled.select("group_id", "member_id", F.row_number().over(Window.partitionBy("group_id").orderBy("member_id")).cast("long").alias("position"))
    return report.matrix_rows(_vectors(b), order, ("group_id",)).withColumn("distance", F.round("distance", 5))


# the benchmark's plan: urgent orders are one selection, those of high priority another
def _orders(b: Bridge, condition: str) -> DataFrame:
    return b.table("orders").filter(condition).select(F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("group_id"))


_FEW = "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000"
_MORE = "o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AND o_totalprice > 200000"


def _plan(b: Bridge) -> dict[str, DataFrame]:
    stats = b.stats()
    chosen = [stats.join(_orders(b, c), "group_id", "left_semi") for c in (_FEW, _MORE)]
    return plan.build_plan(stats, chosen, 2)


@query(sql("lines members species stats", f"SELECT group_id, member_count FROM stats JOIN orders ON group_id = 'G' || o_orderkey WHERE {_FEW} OR {_MORE}"))
def benchmark_targets(b: Bridge) -> DataFrame:
    return _plan(b)["targets"].select("group_id", "member_count")


@query(
    sql(
        "lines members species stats",
        f"SELECT group_id FROM stats JOIN orders ON group_id = 'G' || o_orderkey WHERE NOT ({_FEW}) AND NOT ({_MORE}) AND member_count >= 2"
    )
)
def benchmark_candidates(b: Bridge) -> DataFrame:
    stats = b.stats()
    targets = stats.join(_orders(b, f"{_FEW} OR {_MORE}"), "group_id", "left_semi")
    return plan.candidates(stats, targets).select("group_id")


@query()
def benchmark_controls(b: Bridge) -> DataFrame:
    """Greedy matching has no SQL; the tests hold it against plain loops."""
    return _plan(b)["links"].select(
        "anchor_group_id", "control_group_id", "control_rank", r("matching_score"), "anchor_member_count", "control_member_count",
        r("anchor_single_copy_fraction"), r("control_single_copy_fraction")
    )


_SEEDS = "seeds AS (SELECT p_partkey || '-1' AS protein_identifier, p_name AS marker_name, p_brand AS benchmark_class, p_size < 25 AS enabled FROM part WHERE p_brand IN ('Brand#11', 'Brand#12'))"
_MATCHES = "matches AS (SELECT DISTINCT group_id, protein_identifier AS seed_id, member_id AS matched_member_id, species_label AS matched_species_label FROM members JOIN seeds ON member_id = protein_identifier WHERE enabled)"


def _seeds(b: Bridge) -> DataFrame:
    part = b.table("part").filter(F.col("p_brand").isin("Brand#11", "Brand#12"))
    return part.select(
        F.concat(F.col("p_partkey").cast("string"), F.lit("-1")).alias("protein_identifier"), F.col("p_name").alias("marker_name"),
        F.col("p_brand").alias("benchmark_class"), (F.col("p_size") < 25).alias("enabled")
    )


def _matches(b: Bridge) -> DataFrame:
    return plan.select_by_alias(b.members(), _seeds(b).filter("enabled").select(F.col("protein_identifier").alias("seed_id")))


@query(
    sql(
        "lines members",
        f", {_SEEDS}, {_MATCHES} SELECT group_id, seed_id, matched_member_id, matched_species_label, 'PROTEIN_ID' AS match_authority FROM matches"
    )
)
def seed_matches(b: Bridge) -> DataFrame:
    return _matches(b).select("group_id", "seed_id", "matched_member_id", "matched_species_label", "match_authority")


@query(
    sql(
        "lines members",
        f", {_SEEDS}, {_MATCHES} SELECT group_id, protein_identifier, marker_name, benchmark_class, matched_member_id FROM matches JOIN seeds ON seed_id = protein_identifier"
    )
)
def marker_matches(b: Bridge) -> DataFrame:
    return plan.marker_matches(_matches(b), _seeds(b)).select("group_id", "protein_identifier", "marker_name", "benchmark_class", "matched_member_id")


@query(sql("lines members", f""", {_SEEDS}, {_MATCHES}, f AS (SELECT seed_id, count(DISTINCT group_id) AS n, string_agg(DISTINCT group_id, ';' ORDER BY group_id) AS ids, count(DISTINCT matched_member_id) AS k FROM matches GROUP BY ALL)
    SELECT protein_identifier, benchmark_class, CASE WHEN NOT enabled THEN 'DISABLED' WHEN n IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS match_status, coalesce(n, 0) AS matched_group_count, coalesce(ids, '') AS matched_group_ids, coalesce(k, 0) AS matched_member_count FROM seeds LEFT JOIN f ON seed_id = protein_identifier"""))  # fmt: skip
def marker_audit(b: Bridge) -> DataFrame:
    return plan.marker_audit(_matches(b), _seeds(b)).select(
        "protein_identifier", "benchmark_class", "match_status", "matched_group_count", "matched_group_ids", "matched_member_count"
    )


@query(sql("lines members species stats pairs distances", f""", {_SEEDS}, {_MATCHES}, p AS (SELECT group_id, count(DISTINCT seed_id) AS seed_count, string_agg(DISTINCT seed_id, ';' ORDER BY seed_id) AS seed_ids FROM matches GROUP BY ALL), q AS (SELECT * FROM distances WHERE distance_method = 'quantity')
    SELECT group_id, member_count, seed_count, seed_ids, CASE WHEN distance_pair_count > 0 THEN q.computation_status ELSE 'UNAVAILABLE' END AS computation_status, distance_pair_count, round(mean_distance, 6) AS mean_distance FROM stats JOIN p USING (group_id) LEFT JOIN q USING (group_id)"""))  # fmt: skip
def focus_results(b: Bridge) -> DataFrame:
    found = plan.focus_results(b.stats(), _matches(b), b.distance_statistics().filter("distance_method = 'quantity'"))
    return found.select("group_id", "member_count", "seed_count", "seed_ids", "computation_status", "distance_pair_count", r("mean_distance"))


_CLASS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'E3' WHEN '2-HIGH' THEN 'HOUSEKEEPING' WHEN '3-MEDIUM' THEN 'R_NLR' END"
_KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'E3_CATEGORY::' WHEN '2-HIGH' THEN 'HOUSEKEEPING_SUBCLASS::' WHEN '3-MEDIUM' THEN 'R_NLR_SUBCLASS::' END"
_PROFILES = f"profs AS (SELECT 'G' || o_orderkey AS group_id, unnest([{_CLASS} || '_ALL', {_KIND} || o_orderstatus]) AS profile_id, {_CLASS} AS profile_class, o_orderstatus AS profile_subclass FROM orders WHERE {_CLASS} IS NOT NULL)"


def _profiles(b: Bridge) -> DataFrame:
    """Orders of the three highest priorities stand for marker classes, their status for a category."""
    classes, kinds = F.expr(_CLASS), F.expr(_KIND)
    rows = b.table("orders").filter(classes.isNotNull())
    names = F.explode(F.array(F.concat(classes, F.lit("_ALL")), F.concat(kinds, F.col("o_orderstatus"))))
    return rows.select(
        *[F.lit(G7[k]).alias(k) for k in KEY[:3]], F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("group_id"),
        names.alias("profile_id"), classes.alias("profile_class"), F.col("o_orderstatus").alias("profile_subclass"),
        F.lit("TARGET").alias("membership_role"), F.concat_ws(";", F.lit("m1"), "o_orderstatus").alias("marker_ids")
    )


@query(
    f"WITH {_PROFILES} SELECT profile_id, profile_class, profile_subclass, 'TARGET' AS membership_role, count(DISTINCT group_id) AS group_count FROM profs GROUP BY ALL"
)
def profile_counts(b: Bridge) -> DataFrame:
    return plan.profile_counts(_profiles(b))


@query("SELECT count(*) AS group_count FROM orders WHERE o_orderpriority = '1-URGENT'")
def profile_group_total(b: Bridge) -> DataFrame:
    return plan.profile_group_total(_profiles(b), "E3_ALL")


@query(
    sql(
        "pairs",
        _BENCH + f", {_PROFILES} SELECT p.profile_id, group_id, round(value, 6) AS metric_value FROM profs p JOIN vals USING (group_id) WHERE metric = 'mean_distance'"
    )
)
def profile_distribution_raw(b: Bridge) -> DataFrame:
    results = b.distance_statistics().filter("distance_method = 'price'")
    found = plan.distribution(_profiles(b), results, results, "mean_distance", "RAW")
    return found.select("profile_id", "group_id", r(F.round("metric_value", 9), "metric_value"))


@query(sql("pairs", _BENCH + f""", {_PROFILES}, m AS MATERIALIZED (SELECT anchor_id AS group_id, median(value) AS mid FROM links JOIN vals ON control_id = group_id WHERE metric = 'mean_distance' GROUP BY ALL HAVING count(*) >= 3)
    SELECT p.profile_id, group_id, round(value - mid, 6) AS metric_value FROM profs p JOIN vals USING (group_id) JOIN m USING (group_id) WHERE metric = 'mean_distance'"""))  # fmt: skip
def profile_distribution_residual(b: Bridge) -> DataFrame:
    left = benchmark.residuals(_values(b).filter("metric = 'mean_distance'"), _links(b))
    rows = left.select(
        *[F.lit(G7[k]).alias(k) for k in KEY[:3]], "group_id", "metric", F.lit("MATCHED_RESIDUAL").alias("comparison_scale"),
        F.col("residual").alias("observed_value"), F.explode(F.array(F.lit("b1"), F.lit("b2"))).alias("background_profile_id")
    )
    return plan.distribution(_profiles(b), rows, rows, "mean_distance", "MATCHED_RESIDUAL").select("profile_id", "group_id", r("metric_value"))


@query(
    f"WITH {_PROFILES}, k AS (SELECT DISTINCT profile_id, group_id, unnest(['m1', profile_subclass]) AS marker_id FROM profs) SELECT k.profile_id, k.group_id, k.marker_id, o_orderstatus AS marker_name FROM k JOIN orders ON group_id = 'G' || o_orderkey"
)
def profile_markers(b: Bridge) -> DataFrame:
    orders = b.table("orders").select(
        *[F.lit(G7[k]).alias(k) for k in KEY[:3]], F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("group_id"),
        F.col("o_orderstatus").alias("marker_name")
    )
    sources = [orders.withColumn("marker_id", F.lit("m1")), orders.withColumn("marker_id", F.col("marker_name")), orders.withColumn("marker_id", F.lit("m1"))]
    return plan.profile_markers(_profiles(b), sources).select("profile_id", "group_id", "marker_id", "marker_name")


@query(sql("pairs", _BENCH + f""", {_PROFILES}, ids AS (SELECT group_id, string_agg(DISTINCT profile_id, ';' ORDER BY profile_id) AS profile_ids FROM profs GROUP BY ALL)
    SELECT group_id, coalesce(profile_ids, '') AS profile_ids, round(distance_interquartile_range, 6) AS distance_interquartile_range, round(distance_coefficient_of_variation, 6) AS distance_coefficient_of_variation FROM wide LEFT JOIN ids USING (group_id)"""))  # fmt: skip
def cluster_results(b: Bridge) -> DataFrame:
    summaries = b.distance_statistics().filter("distance_method = 'price'")
    selected = summaries.select(*KEY, F.lit("TARGET").alias("membership_role"))
    found = plan.cluster_results(selected, b.stats().drop("source_file"), _profiles(b), summaries)
    return found.select("group_id", "profile_ids", r("distance_interquartile_range"), r("distance_coefficient_of_variation"))


@query(sql("pairs", _BENCH + f""", {_PROFILES}, ids AS (SELECT group_id, string_agg(DISTINCT profile_id, ';' ORDER BY profile_id) AS profile_ids FROM profs GROUP BY ALL), w AS MATERIALIZED (SELECT group_id, metric, value, control_id FROM vals JOIN links ON anchor_id = group_id WHERE metric = 'mean_distance'),
    c AS (SELECT a.group_id, count(*) AS n, (count(*) FILTER (v.value < a.value) + 0.5 * count(*) FILTER (v.value = a.value)) / count(*) AS f FROM w a JOIN vals v ON v.group_id = a.control_id AND v.metric = a.metric GROUP BY a.group_id)
    SELECT group_id, profile_ids, CASE WHEN n < 3 THEN 'INSUFFICIENT' WHEN f <= 0.1 THEN 'COMPACT_OR_LOW' WHEN f >= 0.9 THEN 'DISPERSED_OR_HIGH' ELSE 'TYPICAL' END AS dispersion_class FROM c JOIN ids USING (group_id)"""))  # fmt: skip
def classes_with_profiles(b: Bridge) -> DataFrame:
    classes = benchmark.classify(_values(b).filter("metric = 'mean_distance'"), _links(b)).select(
        *[F.lit(G7[k]).alias(k) for k in KEY[:3]], "group_id", "dispersion_class"
    )
    lists = _profiles(b).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("profile_id")), ";").alias("profile_ids"))
    return plan.classes_with_profiles(classes, lists).select("group_id", "profile_ids", "dispersion_class")


_PLANNED = """names AS (SELECT DISTINCT profile_id FROM profs), planned AS (
    SELECT a.profile_id AS t, b.profile_id AS r FROM names a, names b WHERE (a.profile_id = 'E3_ALL' AND (b.profile_id IN ('HOUSEKEEPING_ALL', 'R_NLR_ALL') OR b.profile_id LIKE '%SUBCLASS::%'))
        OR (a.profile_id = 'R_NLR_ALL' AND b.profile_id = 'HOUSEKEEPING_ALL') OR (a.profile_id LIKE 'E3_CATEGORY::%' AND b.profile_id IN ('HOUSEKEEPING_ALL', 'R_NLR_ALL'))
    UNION ALL SELECT profile_id, 'E3_OTHER' FROM names WHERE profile_id LIKE 'E3_CATEGORY::%')"""  # fmt: skip


@query(f"WITH {_PROFILES}, {_PLANNED} SELECT t AS target_profile_id, r AS reference_profile_id FROM planned")
def planned_contrasts(b: Bridge) -> DataFrame:
    return benchmark.plan_contrasts(_profiles(b))


@query(sql("pairs", _BENCH + f""", {_PROFILES}, {_PLANNED}, own AS MATERIALIZED (SELECT p.profile_id AS pid, v.group_id, v.metric, v.value FROM profs p JOIN vals v USING (group_id)),
    side AS (SELECT t, r, metric, group_id, value, true AS is_t FROM planned JOIN own ON pid = t UNION ALL SELECT t, r, metric, group_id, value, false FROM planned JOIN own ON pid = r
        UNION ALL SELECT t, r, metric, group_id, value, false FROM planned JOIN own ON pid = 'E3_ALL' WHERE r = 'E3_OTHER' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.pid = t AND o.group_id = own.group_id AND o.metric = own.metric))
    SELECT t AS target_profile_id, r AS reference_profile_id, metric, count(*) FILTER (is_t) AS target_group_count, count(*) FILTER (NOT is_t) AS reference_group_count, round(median(value) FILTER (is_t), 6) AS target_median, round(median(value) FILTER (NOT is_t), 6) AS reference_median FROM side GROUP BY ALL"""))  # fmt: skip
def planned_contrast_medians(b: Bridge) -> DataFrame:
    profiles = _profiles(b).select("profile_id", "group_id")
    values = _values(b).drop("profile_id").join(profiles, "group_id")
    sides = benchmark.contrast_sides(values, benchmark.plan_contrasts(profiles))
    return benchmark.contrast_medians(sides).select(
        "target_profile_id", "reference_profile_id", "metric", "target_group_count", "reference_group_count", r("target_median"),
        r("reference_median")
    )


# taxonomic selections
CHOSEN = [Selector("INCLUDE_CLADE", "R:ASIA"), Selector("EXCLUDE_EXACT", "NATION_2"), Selector("EXCLUDE_CLADE", "R:EUROPE")]


@query(sql("lines members species taxa", "SELECT DISTINCT group_id, taxon_id FROM taxa WHERE taxon_id IS NOT NULL AND clade != 'R:ASIA'"))
def outside_scope_taxa(b: Bridge) -> DataFrame:
    return selection.outside_scope(b.taxa(), b.closure(), CHOSEN).select("group_id", "taxon_id")


_TREE = "n AS (SELECT n_name, 'R:' || r_name AS reg, n_name <= 'NATION_14' AS rep, n_name = 'NATION_2' OR r_name = 'EUROPE' AS exc FROM nation JOIN region ON n_regionkey = r_regionkey)"
_COUNTS = "count(*) FILTER (rep) AS represented_terminal_count, count(*) FILTER (NOT rep) AS expected_no_data_terminal_count, count(*) FILTER (exc) AS excluded_terminal_count"
_TREE_COLUMNS = [
    "taxon_id", "parent_taxon_id", "selection_state", "coverage_state", "represented_terminal_count", "expected_no_data_terminal_count",
    "excluded_terminal_count"
]


def _represented(b: Bridge) -> DataFrame:
    return b.table("nation").filter("n_name <= 'NATION_14'").select(F.col("n_name").alias("taxon_id"))


@query(f"""WITH {_TREE} SELECT n_name AS taxon_id, reg AS parent_taxon_id, CASE WHEN n_name = 'NATION_2' THEN 'EXCLUDED_EXACT' WHEN reg = 'R:EUROPE' THEN 'EXCLUDED_BY_CLADE' ELSE 'NEUTRAL' END AS selection_state, CASE WHEN rep THEN 'REPRESENTED_IN_INPUT' ELSE 'EXPECTED_NO_DATA' END AS coverage_state, {_COUNTS} FROM n GROUP BY ALL
    UNION ALL SELECT reg, 'ROOT', CASE reg WHEN 'R:ASIA' THEN 'INCLUDE_CLADE' WHEN 'R:EUROPE' THEN 'EXCLUDED_CLADE' ELSE 'NEUTRAL' END, CASE WHEN bool_or(rep) THEN 'ANCESTOR_OF_REPRESENTED' ELSE 'NOT_IN_EXPECTED_UNIVERSE' END, {_COUNTS} FROM n GROUP BY reg
    UNION ALL SELECT 'ROOT', NULL, 'NEUTRAL', 'ANCESTOR_OF_REPRESENTED', {_COUNTS} FROM n""")  # fmt: skip
def coverage_tree(b: Bridge) -> DataFrame:
    closed = b.closure()
    expected = selection.expected_taxa(b.table("nation").select(F.col("n_name").alias("taxon_id"), F.lit(True).alias("included")), closed)
    tree = selection.coverage_tree(closed, CHOSEN, _represented(b), expected, _represented(b).limit(0))
    selection.reconcile(tree)
    return tree.select(*_TREE_COLUMNS)


@query(f"""WITH {_TREE}, k AS (SELECT reg, count(*) FILTER (rep) AS c FROM n GROUP BY reg) SELECT n_name AS taxon_id, CASE WHEN c = 1 THEN 'ROOT' ELSE n.reg END AS parent_taxon_id, 'REPRESENTED_IN_INPUT' AS coverage_state FROM n JOIN k USING (reg) WHERE rep
    UNION ALL SELECT reg, 'ROOT', 'ANCESTOR_OF_REPRESENTED' FROM k WHERE c > 1 UNION ALL SELECT 'ROOT', NULL, 'ANCESTOR_OF_REPRESENTED'""")  # fmt: skip
def coverage_tree_compact(b: Bridge) -> DataFrame:
    closed, none = b.closure(), _represented(b).limit(0)
    tree = selection.coverage_tree(closed, [], _represented(b), none, none, compact=True)
    return tree.select("taxon_id", "parent_taxon_id", "coverage_state")
