"""Queries over the driver's tables, one or more for each family of operators, with the
SQL that must give the same rows. Numbers are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import benchmark, catalogue, distances, expression, geometry, memberships, motif, search, taxonomy
from ..schemas import KEY
from ..streaming import events as streaming
from ..tables import written
from .bridge import _QUANTILES, RUN, Bridge, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N = ["NATION_3", "NATION_8"]


def query(oracle: str | None = None):
    """Register a query of a Bridge under its function's name."""

    def wrap(f: Callable[[Bridge], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return wrap


def r(c: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


_STAT = "group_id, legacy_orthogroup_id, member_count, species_count, single_copy_species_count, max_copies_per_species, round(mean_copies_per_species, 6) AS mean_copies_per_species"
def _stat_columns() -> list:
    return [
        "group_id", "legacy_orthogroup_id", "member_count", "species_count", "single_copy_species_count", "max_copies_per_species",
        r("mean_copies_per_species")
    ]



@query(sql("lines members species stats", f"SELECT {_STAT}, is_singleton, species_labels FROM stats"))
def group_statistics(b: Bridge) -> DataFrame:
    return b.stats().select(*_stat_columns(), "is_singleton", "species_labels")


@query(
    sql(
        "lines members species",
        "SELECT group_id, species_label, species_member_count, round(species_member_count / sum(species_member_count) OVER (PARTITION BY group_id), 6) AS member_fraction FROM species"
    )
)
def group_species_statistics(b: Bridge) -> DataFrame:
    return b.species().select("group_id", "species_label", "species_member_count", r("member_fraction"))


@query(
    sql(
        "lines members legacy",
        "SELECT group_type, hierarchy_node, count(*) AS group_count, min(n) AS minimum_members, median(n) AS median_members, max(n) AS maximum_members, round(avg(n), 6) AS mean_members FROM (SELECT group_type, hierarchy_node, group_id, count(*) AS n FROM (SELECT group_type, hierarchy_node, group_id FROM members UNION ALL SELECT group_type, hierarchy_node, group_id FROM legacy) GROUP BY ALL) GROUP BY ALL"
    )
)
def overview_authorities(b: Bridge) -> DataFrame:
    return memberships.overview(memberships.group_statistics(b.all_members())).withColumn("mean_members", r("mean_members"))


@query(
    sql(
        "lines members species stats pairs distances",
        "SELECT (SELECT count(*) FROM stats) AS group_count, (SELECT count(DISTINCT n_name) FROM nation) AS species_count, (SELECT count(DISTINCT group_id) FROM distances) AS distance_group_count, (SELECT count(*) FROM lines) AS sequence_count"
    )
)
def overview_totals(b: Bridge) -> DataFrame:
    return memberships.totals(b.stats(), b.table("nation").select("n_name").distinct(), b.distance_statistics(), b.sequences())


@query(
    sql(
        "lines members species stats",
        "SELECT group_type, hierarchy_node, floor(log2(member_count) + 1e-12)::BIGINT AS bin, count(*) AS group_count, min(member_count) AS minimum, max(member_count) AS maximum, round(avg(member_count), 6) AS mean FROM stats GROUP BY ALL"
    )
)
def log2_histogram(b: Bridge) -> DataFrame:
    return memberships.size_histogram(b.stats()).withColumn("mean", r("mean"))


def _searched(b: Bridge, **f) -> DataFrame:
    return search.search_groups(b.stats(), b.species(), b.members(), b.distance_statistics(), search.GroupFilters(**f))


def _search_sql(condition: str) -> str:
    return sql("lines members species stats pairs distances", f"""
        , shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN distance_pair_count > 0 THEN 0 ELSE 1 END, distance_method) AS r FROM distances) WHERE r = 1)
        SELECT g.group_id, member_count, species_count, distance_method, distance_pair_count, round(mean_distance, 6) AS mean_distance, round(population_stddev_distance, 6) AS population_stddev_distance
        FROM stats g LEFT JOIN shown d USING (group_id) WHERE {condition}""")  # fmt: skip


def _found() -> list:
    return ["group_id", "member_count", "species_count", "distance_method", "distance_pair_count", r("mean_distance"), r("population_stddev_distance")]

_HAS = "(SELECT count(DISTINCT species_label) FROM species s WHERE s.group_id = g.group_id AND species_label IN ('NATION_3', 'NATION_8'))"


@query(_search_sql(f"{_HAS} = 2"))
def search_species_all(b: Bridge) -> DataFrame:
    return _searched(b, included_species=tuple(N)).select(*_found())


@query(_search_sql(f"{_HAS} >= 1"))
def search_species_any(b: Bridge) -> DataFrame:
    return _searched(b, included_species=tuple(N), include_mode="ANY").select(*_found())


@query(_search_sql(f"{_HAS} = 2 AND species_count = 2"))
def search_species_exact_set(b: Bridge) -> DataFrame:
    return _searched(b, included_species=tuple(N), include_mode="EXACT_SET").select(*_found())


@query(
    _search_sql(
        "NOT EXISTS (SELECT 1 FROM species s WHERE s.group_id = g.group_id AND species_label IN ('NATION_3', 'NATION_8')) AND member_count BETWEEN 3 AND 6"
    )
)
def search_species_exclude(b: Bridge) -> DataFrame:
    return _searched(b, excluded_species=tuple(N), members=(3, 6)).select(*_found())


@query(_search_sql("EXISTS (SELECT 1 FROM members m WHERE m.group_id = g.group_id AND contains(m.member_id, '99-')) AND contains(g.group_id, '1')"))
def search_member_contains(b: Bridge) -> DataFrame:
    return _searched(b, member_id_contains="99-", group_id_contains="1").select(*_found())


@query(_search_sql("distance_pair_count > 0 AND mean_distance <= 20000 AND population_stddev_distance <= 15000"))
def search_distance_bounds(b: Bridge) -> DataFrame:
    return _searched(b, distance_availability="CALCULATED", maximum_mean_distance=20000.0, maximum_distance_sd=15000.0).select(*_found())


@query(_search_sql("coalesce(distance_pair_count, 0) = 0"))
def search_not_calculated(b: Bridge) -> DataFrame:
    return _searched(b, distance_availability="NOT_CALCULATED").select(*_found())


@query(_search_sql("true") + " ORDER BY member_count DESC, group_type, hierarchy_node, g.group_id LIMIT 50 OFFSET 100")
def group_page(b: Bridge) -> DataFrame:
    return search.page(_searched(b), "MEMBER_COUNT_DESC", 3, 50).select(*_found())


@query(_search_sql("true") + " ORDER BY round(mean_distance, 9) DESC NULLS LAST, member_count DESC, g.group_id LIMIT 40")
def group_page_by_distance(b: Bridge) -> DataFrame:
    return search.page(_searched(b).withColumn("mean_distance", F.round("mean_distance", 9)), "MEAN_DISTANCE_DESC", 1, 40).select(*_found())


_RANKED = "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN sampled_member_count = total_member_count THEN 0 ELSE 1 END, sampled_member_count DESC, distance_method) AS r FROM distances) WHERE r = 1)"
_SPREAD = "distance_method, computation_status, total_member_count, sampled_member_count, distance_pair_count, round(minimum_distance, 6) AS minimum_distance, round(q05_distance, 6) AS q05_distance, round(q25_distance, 6) AS q25_distance, round(median_distance, 6) AS median_distance, round(mean_distance, 6) AS mean_distance, round(q75_distance, 6) AS q75_distance, round(q95_distance, 6) AS q95_distance, round(maximum_distance, 6) AS maximum_distance, round(population_stddev_distance, 6) AS population_stddev_distance"
def _spread_columns() -> list:
    return [
        "distance_method", "computation_status", "total_member_count", "sampled_member_count", "distance_pair_count",
        *[r(c) for c in ("minimum_distance", "q05_distance", "q25_distance", "median_distance", "mean_distance", "q75_distance", "q95_distance", "maximum_distance", "population_stddev_distance")]
    ]



@query(sql("lines pairs distances", f"SELECT group_id, {_SPREAD} FROM distances"))
def distance_summary(b: Bridge) -> DataFrame:
    return b.distance_statistics().select("group_id", *_spread_columns())


@query(sql("lines pairs distances", f", {_RANKED} SELECT group_id, {_SPREAD} FROM ranked"))
def ranked_distance(b: Bridge) -> DataFrame:
    return search.ranked_distance(b.distance_statistics()).select("group_id", *_spread_columns())


@query(
    sql(
        "lines members species stats pairs distances",
        f"SELECT group_id, member_count, species_count, {_SPREAD}, round(sampled_member_count / total_member_count, 6) AS sampling_fraction, sampled_member_count = total_member_count AS full_group_matrix, round(q75_distance - q25_distance, 6) AS interquartile_range, round(CASE WHEN mean_distance > 0 THEN population_stddev_distance / mean_distance END, 6) AS relative_distance_spread FROM stats JOIN distances USING (group_id) WHERE distance_method = 'quantity'"
    )
)
def all_distance_results(b: Bridge) -> DataFrame:
    found = search.distance_results(b.stats(), b.distance_statistics(), method="quantity", group_type="HOG", hierarchy_node="N0")
    return found.select(
        "group_id", "member_count", "species_count", *_spread_columns(), r("sampling_fraction"), "full_group_matrix", r("interquartile_range"),
        r("relative_distance_spread")
    )


@query(sql("lines members species stats pairs distances", f"""
    , {_RANKED}, hits AS (SELECT DISTINCT group_id, species_label, member_id, l_orderkey || '_' || l_linenumber AS internal_id FROM (SELECT 'G' || l_orderkey AS group_id, n_name AS species_label, l_partkey || '-' || l_linenumber AS member_id FROM lines) JOIN (SELECT n_name AS s, l_partkey || '-' || l_linenumber AS m, l_orderkey, l_linenumber FROM lines) ON s = species_label AND m = member_id)
    SELECT h.group_id, h.species_label, h.member_id, h.internal_id, CASE WHEN contains(internal_id, '77') THEN 'INTERNAL_ID' ELSE 'PROTEIN_ID' END AS match_source, CASE WHEN contains(internal_id, '77') THEN internal_id ELSE member_id END AS matched_identifier, member_count, distance_method
    FROM hits h JOIN stats USING (group_id) LEFT JOIN ranked USING (group_id) WHERE contains(internal_id, '77') OR contains(member_id, '77')"""))  # fmt: skip
def protein_search(b: Bridge) -> DataFrame:
    return search.search_proteins(b.members(), b.sequences(), b.stats(), b.distance_statistics(), "77", exact=False).select(
        "group_id", "species_label", "member_id", "internal_id", "match_source", "matched_identifier", "member_count", "distance_method"
    )


_FOCUS = "focus AS (SELECT p_partkey || '-1' AS focus_identifier, p_size < 25 AS enabled FROM part WHERE p_brand IN ('Brand#11', 'Brand#12'))"


@query(sql("lines members species stats", f"""
    , {_FOCUS}, hits AS (SELECT DISTINCT group_id, species_label, member_id, focus_identifier FROM members JOIN focus ON member_id = focus_identifier)
    SELECT group_id, count(DISTINCT focus_identifier) AS matched_focus_count, count(DISTINCT member_id) AS matched_protein_count, string_agg(DISTINCT member_id, ';' ORDER BY member_id) AS matched_member_ids, string_agg(DISTINCT species_label, ';' ORDER BY species_label) AS matched_species_labels, min('PROTEIN_ID') AS match_authorities, any_value(member_count) AS member_count FROM hits JOIN stats USING (group_id) GROUP BY group_id"""))  # fmt: skip
def focus_clusters(b: Bridge) -> DataFrame:
    focus = b.table("part").filter(F.col("p_brand").isin("Brand#11", "Brand#12")).select(
        F.concat(F.col("p_partkey").cast("string"), F.lit("-1")).alias("focus_identifier")
    )
    found = search.search_focus(
        b.members(), search.identifier_aliases(b.members().select("run_id", "member_id", "species_label").distinct()), b.stats(),
        b.distance_statistics(), focus
    )
    return found.select(
        "group_id", "matched_focus_count", "matched_protein_count", "matched_member_ids", "matched_species_labels", "match_authorities",
        "member_count"
    )


@query(sql("lines members", f"""
    , {_FOCUS}, hits AS (SELECT focus_identifier, count(DISTINCT group_id) AS n, string_agg(DISTINCT group_id, ';' ORDER BY group_id) AS ids FROM members JOIN focus ON member_id = focus_identifier GROUP BY ALL)
    SELECT focus_identifier, CASE WHEN NOT enabled THEN 'DISABLED' WHEN n IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS match_status, coalesce(n, 0) AS matched_group_count, coalesce(ids, '') AS matched_group_ids FROM focus LEFT JOIN hits USING (focus_identifier)"""))  # fmt: skip
def focus_audit(b: Bridge) -> DataFrame:
    focus = b.table("part").filter(F.col("p_brand").isin("Brand#11", "Brand#12")).select(
        F.concat(F.col("p_partkey").cast("string"), F.lit("-1")).alias("focus_identifier"), (F.col("p_size") < 25).alias("enabled")
    )
    hits = b.members().join(focus.select("focus_identifier"), F.col("member_id") == F.col("focus_identifier"))
    return search.focus_audit(focus, hits).select("focus_identifier", "match_status", "matched_group_count", "matched_group_ids")


_COMPOSITION = """, per AS (SELECT g.group_id, g.member_count, g.species_count, count(*) FILTER (category = 'TARGET') AS target_species_count, count(*) FILTER (category = 'OUTSIDE') AS outside_species_count, count(*) FILTER (category = 'UNRESOLVED') AS unresolved_species_count, (sum(species_member_count) FILTER (category = 'TARGET'))::BIGINT AS target_member_count, coalesce(string_agg(s.species_label, '; ' ORDER BY s.species_label) FILTER (category = 'OUTSIDE'), '') AS outsider_species_labels FROM stats g JOIN species s USING (group_id) JOIN categories USING (species_label) GROUP BY ALL),
    summary AS (SELECT *, target_species_count / (SELECT count(*) FROM categories WHERE category = 'TARGET') AS target_coverage, CASE WHEN target_species_count + outside_species_count > 0 THEN target_species_count / (target_species_count + outside_species_count) ELSE 0 END AS mapped_target_fraction FROM per)
    SELECT group_id, member_count, target_species_count, outside_species_count, unresolved_species_count, target_member_count, outsider_species_labels, round(target_coverage, 6) AS target_coverage, round(mapped_target_fraction, 6) AS mapped_target_fraction FROM summary WHERE """  # fmt: skip


def _composition(b: Bridge) -> tuple[DataFrame, int, int]:
    counts = {x["category"]: x["n"] for x in b.categories().groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    return taxonomy.composition(b.stats(), b.species(), b.categories(), counts.get("TARGET", 0)), counts.get("TARGET", 0), counts.get("OUTSIDE", 0)


def _composed() -> list:
    return [
        "group_id", "member_count", "target_species_count", "outside_species_count", "unresolved_species_count", "target_member_count",
        "outsider_species_labels", r("target_coverage"), r("mapped_target_fraction")
    ]

_BY_TAXON = "lines members species stats categories"


@query(sql(_BY_TAXON, _COMPOSITION + "target_species_count >= 2"))
def taxonomy_contains(b: Bridge) -> DataFrame:
    return taxonomy.search_composition(_composition(b)[0], "CONTAINS", least_target=2).select(*_composed())


@query(sql(_BY_TAXON, _COMPOSITION + "target_species_count >= 1 AND outside_species_count = 0 AND unresolved_species_count = 0"))
def taxonomy_sampled_exclusive(b: Bridge) -> DataFrame:
    return taxonomy.search_composition(_composition(b)[0], "SAMPLED_EXCLUSIVE").select(*_composed())


@query(sql(_BY_TAXON, _COMPOSITION + "target_species_count >= 1 AND outside_species_count <= 1 AND unresolved_species_count <= 1"))
def taxonomy_near_exclusive(b: Bridge) -> DataFrame:
    return taxonomy.search_composition(_composition(b)[0], "NEAR_EXCLUSIVE", most_outside=1, most_unresolved=1).select(*_composed())


@query(sql(_BY_TAXON, """, per AS (SELECT group_id, count(*) FILTER (category = 'TARGET') AS t, count(*) FILTER (category = 'OUTSIDE') AS o FROM species JOIN categories USING (species_label) GROUP BY ALL),
    n AS (SELECT (count(*) FILTER (category = 'TARGET'))::INT AS nt, (count(*) FILTER (category = 'OUTSIDE'))::INT AS no FROM categories),
    tail AS (SELECT group_id, t, o, nt, no, least(1, list_sum(list_transform(range(t, least(t + o, nt) + 1), lambda k: CASE WHEN t + o - k <= no THEN exp(lgamma(nt + 1) - lgamma(k + 1) - lgamma(nt - k + 1) + lgamma(no + 1) - lgamma(t + o - k + 1) - lgamma(no - t - o + k + 1) - lgamma(nt + no + 1) + lgamma(t + o + 1) + lgamma(nt + no - t - o + 1)) ELSE 0 END))) AS p FROM per, n WHERE t + o > 0),
    ranked AS (SELECT *, row_number() OVER (ORDER BY p, group_id) AS k, count(*) OVER () AS m FROM tail)
    SELECT group_id, round(p, 6) AS fisher_p_value, round(CASE WHEN o * (nt - t) > 0 THEN t * (no - o) / (o * (nt - t)) WHEN t * (no - o) > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS odds_ratio, round(least(1, min(p * m / k) OVER (ORDER BY k DESC)), 6) AS fdr_q_value FROM ranked"""))  # fmt: skip
def taxonomy_fisher_bh(b: Bridge) -> DataFrame:
    summary, target, outside = _composition(b)
    return taxonomy.enrichment(summary, target, outside).select("group_id", r("fisher_p_value"), r("odds_ratio"), r("fdr_q_value"))


@query(
    "SELECT c AS ancestor, c AS descendant, 0 AS depth FROM (SELECT n_name AS c FROM nation UNION SELECT 'R:' || r_name FROM region UNION SELECT 'ROOT') UNION ALL SELECT 'R:' || r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'ROOT', 'R:' || r_name, 1 FROM region UNION ALL SELECT 'ROOT', n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def lineage_closure(b: Bridge) -> DataFrame:
    return taxonomy.closure(b.taxonomy())


def _selected(b: Bridge, *selectors: tuple[str, str]) -> DataFrame:
    found = taxonomy.select_groups(b.taxa(), b.closure(), [taxonomy.Selector(*s) for s in selectors])
    return found.select("group_id", "unmapped_count", "taxon_count", "failures", "passes")


def _select_sql(*checks: tuple[str, str]) -> str:
    flags = ", ".join(f"{c} AS c{i}" for i, (_, c) in enumerate(checks))
    failures = " || ".join(f"CASE WHEN c{i} THEN '' ELSE ';{n}' END" for i, (n, _) in enumerate(checks))
    return sql(
        "lines members species taxa",
        f", flags AS (SELECT group_id, count(*) FILTER (taxon_id IS NULL) AS unmapped_count, count(DISTINCT taxon_id) AS taxon_count, {flags} FROM taxa GROUP BY group_id) SELECT group_id, unmapped_count, taxon_count, ltrim({failures}, ';') AS failures, ltrim({failures}, ';') = '' AS passes FROM flags"
    )


_IN = "coalesce(bool_or(clade = 'R:{0}') FILTER (taxon_id IS NOT NULL), false)"


@query(
    _select_sql(
        ("INCLUDE_CLADE:R:ASIA", _IN.format("ASIA")), ("EXCLUDE_EXACT:NATION_2", "NOT coalesce(bool_or(taxon_id = 'NATION_2'), false)"),
        ("EXCLUDE_CLADE:R:EUROPE", "NOT " + _IN.format("EUROPE"))
    )
)
def clade_selection(b: Bridge) -> DataFrame:
    return _selected(b, ("INCLUDE_CLADE", "R:ASIA"), ("EXCLUDE_EXACT", "NATION_2"), ("EXCLUDE_CLADE", "R:EUROPE"))


@query(
    _select_sql(
        ("REQUIRED_EXACT:NATION_3", "coalesce(bool_or(taxon_id = 'NATION_3'), false)"),
        (
            "ONLY_IN_CLADE:R:EUROPE",
            "count(taxon_id) > 0 AND coalesce(bool_and(clade = 'R:EUROPE') FILTER (taxon_id IS NOT NULL), true) AND count(*) = count(taxon_id)"
        )
    )
)
def clade_only_in(b: Bridge) -> DataFrame:
    return _selected(b, ("REQUIRED_EXACT", "NATION_3"), ("ONLY_IN_CLADE", "R:EUROPE"))


@query("""WITH n AS (SELECT n_name, 'R:' || r_name AS reg, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS rep, n_name = 'NATION_6' AS hit FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT n_name AS node_id, rep::BIGINT AS represented_descendants, 1::BIGINT AS expected_descendants, CASE WHEN hit THEN 'OUTSIDE_SELECTED_SCOPE_WITH_HITS' WHEN rep THEN 'REPRESENTED_IN_INPUT' ELSE 'EXPECTED_NO_DATA' END AS coverage_state FROM n
    UNION ALL SELECT reg, count(*) FILTER (rep), count(*), CASE WHEN count(*) FILTER (rep) > 0 THEN 'ANCESTOR_OF_REPRESENTED' ELSE 'NOT_IN_EXPECTED_UNIVERSE' END FROM n GROUP BY reg
    UNION ALL SELECT 'ROOT', count(*) FILTER (rep), count(*), CASE WHEN count(*) FILTER (rep) > 0 THEN 'ANCESTOR_OF_REPRESENTED' ELSE 'NOT_IN_EXPECTED_UNIVERSE' END FROM n""")  # fmt: skip
def coverage_states(b: Bridge) -> DataFrame:
    nation = b.table("nation").select(F.col("n_name").alias("taxon_id"), "n_nationkey")
    rich = b.table("supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    out = taxonomy.coverage(b.closure(), nation.join(rich, "n_nationkey", "left_semi"), nation, nation.filter("taxon_id = 'NATION_6'"))
    return out.select("node_id", "represented_descendants", "expected_descendants", "coverage_state")


@query("SELECT 'R:' || r_name AS root_id FROM region WHERE r_name = 'ASIA'")
def common_root(b: Bridge) -> DataFrame:
    asia = b.taxonomy().filter("parent = 'R:ASIA'").select(F.col("child").alias("taxon_id"))
    return taxonomy.common_root(b.closure(), asia)


def _motif_sql(match: str, tail: str) -> str:
    return sql(
        "motif",
        f", hits AS (SELECT *, coalesce(length(clean) > 0, false) AS have, coalesce(length(clean) > 0 AND {match}, false) AS hit FROM assessed) {tail}"
    )


_MOTIF_SUMMARY = "SELECT group_id, count(*) AS total_member_count, count(*) FILTER (have) AS sequence_count, count(DISTINCT species_label) FILTER (have) AS assessed_species_count, count(*) FILTER (hit) AS matching_sequence_count, string_agg(DISTINCT species_label, '; ' ORDER BY species_label) FILTER (hit) AS matching_species, round(count(*) FILTER (hit) / nullif(count(*) FILTER (have), 0), 6) AS matching_fraction FROM hits GROUP BY group_id HAVING count(*) FILTER (have) >= 2 AND count(DISTINCT species_label) FILTER (have) >= 2 AND count(*) FILTER (hit) / nullif(count(*) FILTER (have), 0) >= 0.01"
def _motifs() -> list:
    return ["group_id", "total_member_count", "sequence_count", "assessed_species_count", "matching_sequence_count", "matching_species", r("matching_fraction")]



@query(_motif_sql("ends_with(clean, 'N')", _MOTIF_SUMMARY))
def motif_suffix_summary(b: Bridge) -> DataFrame:
    return motif.group_summary(
        motif.group_members(b.motif_members(), b.motif_sequences(), "N", "SUFFIX"), least_species=2, least_proteins=2, threshold=0.01
    ).select(*_motifs())


@query(_motif_sql("regexp_matches(clean, '(?:[ST]H.{1,3})$')", _MOTIF_SUMMARY))
def motif_regex_summary(b: Bridge) -> DataFrame:
    return motif.group_summary(
        motif.group_members(b.motif_members(), b.motif_sequences(), "[ST]H.{1,3}", "C_TERMINAL_REGEX"), least_species=2, least_proteins=2,
        threshold=0.01
    ).select(*_motifs())


@query(
    _motif_sql(
        "regexp_matches(clean, 'TH[EA]R')",
        "SELECT group_id, species_label, member_id, have AS sequence_available, hit AS motif_match, CASE WHEN hit THEN regexp_extract(clean, 'TH[EA]R', 0) END AS matched_text FROM hits"
    )
)
def motif_members(b: Bridge) -> DataFrame:
    return motif.group_members(b.motif_members(), b.motif_sequences(), "TH[EA]R", "REGEX").select(
        "group_id", "species_label", "member_id", "sequence_available", "motif_match", "matched_text"
    )


@query(
    _motif_sql(
        "ends_with(clean, 'N')",
        "SELECT group_id, species_label, count(*) AS published, count(*) FILTER (have) AS assessed, count(*) FILTER (hit) AS matching, CASE WHEN count(*) FILTER (have) = 0 THEN 'Sequence unavailable' WHEN count(*) FILTER (hit) = 0 THEN 'Assessed; no match' WHEN count(*) FILTER (hit) = count(*) FILTER (have) THEN 'All assessed proteins match' ELSE 'Some assessed proteins match' END AS species_result FROM hits GROUP BY ALL"
    )
)
def motif_species_distribution(b: Bridge) -> DataFrame:
    return motif.species_distribution(motif.group_members(b.motif_members(), b.motif_sequences(), "N", "SUFFIX")).select(
        "group_id", "species_label", "published", "assessed", "matching", "species_result"
    )


@query(
    sql(
        "atlas preferred",
        "SELECT species_column, experiment_accession, selected_expression_unit, count(*) AS n, round(sum(expression_value), 4) AS total FROM preferred GROUP BY ALL"
    )
)
def unit_preference(b: Bridge) -> DataFrame:
    return expression.preferred_units(b.atlas()).groupBy("species_column", "experiment_accession", "selected_expression_unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("expression_value"), 4).alias("total")
    )


def _mapped(b: Bridge) -> DataFrame:
    return expression.map_members(b.expression_members(), b.expression_members(), b.atlas())


def _contexts(b: Bridge) -> DataFrame:
    return expression.contexts(_mapped(b), b.atlas(), b.expression_metadata())


@query(sql("atlas emembers mapping", "SELECT species_label, member_id, mapping_status, matched_gene_count, matched_gene_ids FROM mapped"))
def expression_mapping(b: Bridge) -> DataFrame:
    return _mapped(b).select("species_label", "member_id", "mapping_status", "matched_gene_count", "matched_gene_ids")


_SUMMARY = ", e AS (SELECT species_label, member_id, count(DISTINCT experiment_accession) AS experiment_count, count(*) AS context_count, count(*) FILTER (positive) AS positive_context_count, avg(CASE WHEN positive THEN 1.0 ELSE 0.0 END) AS f, min(expression_value) AS lo, max(expression_value) AS hi, median(expression_value) AS mid FROM context GROUP BY ALL), summary AS (SELECT m.*, CASE WHEN mapping_status = 'MAPPED_UNIQUE' THEN coalesce(experiment_count, 0) END AS experiment_count, CASE WHEN mapping_status = 'MAPPED_UNIQUE' THEN coalesce(e.context_count, 0) END AS context_count, f, lo, hi, mid, CASE WHEN f >= 0.5 THEN true WHEN e.context_count IS NOT NULL THEN false END AS broad FROM mapped m LEFT JOIN e USING (species_label, member_id)) "


@query(
    sql(
        "atlas preferred emembers mapping context",
        _SUMMARY + "SELECT species_label, member_id, mapping_status, experiment_count, context_count, round(f, 6) AS positive_context_fraction, lo AS minimum_context_expression_value, hi AS maximum_context_expression_value, round(mid, 6) AS median_context_expression_value, broad AS broad_expression_supported FROM summary"
    )
)
def expression_member_summary(b: Bridge) -> DataFrame:
    return expression.member_summary(_mapped(b), _contexts(b)).select(
        "species_label", "member_id", "mapping_status", "experiment_count", "context_count", r("positive_context_fraction"),
        "minimum_context_expression_value", "maximum_context_expression_value", r("median_context_expression_value"), "broad_expression_supported"
    )


@query(
    sql(
        "atlas preferred emembers mapping context",
        _SUMMARY + "SELECT group_id, count(*) AS member_count, count(*) FILTER (mapping_status = 'MAPPED_UNIQUE') AS unique_mapped_member_count, count(*) FILTER (mapping_status = 'AMBIGUOUS') AS ambiguous_member_count, count(*) FILTER (mapping_status = 'NOT_MAPPED') AS not_mapped_member_count, count(*) FILTER (context_count > 0) AS expression_observed_member_count, count(*) FILTER (broad) AS broad_expression_member_count, count(DISTINCT species_label) FILTER (context_count > 0) AS expression_observed_species_count, round(count(*) FILTER (mapping_status = 'MAPPED_UNIQUE') / count(*), 6) AS mapping_fraction FROM summary GROUP BY group_id"
    )
)
def expression_group_summary(b: Bridge) -> DataFrame:
    out = expression.group_summary(b.expression_groups(), expression.member_summary(_mapped(b), _contexts(b)))
    return out.select(
        "group_id", "member_count", "unique_mapped_member_count", "ambiguous_member_count", "not_mapped_member_count",
        "expression_observed_member_count", "broad_expression_member_count", "expression_observed_species_count", r("mapping_fraction")
    )


@query(
    sql(
        "atlas preferred emembers mapping context",
        "SELECT group_id, species_label, CASE WHEN organism_part = '' THEN 'Unknown' ELSE organism_part END AS context, round(median(expression_value), 6) AS median_value, min(expression_value) AS minimum_value, max(expression_value) AS maximum_value, count(*) AS record_count, count(DISTINCT member_id) AS member_count FROM context GROUP BY ALL"
    )
)
def expression_heatmap(b: Bridge) -> DataFrame:
    rows = _contexts(b).join(b.expression_groups(), expression.MEMBER)
    return expression.heatmap(rows, "organism_part", ("group_id",)).withColumn("median_value", r("median_value"))


@query(
    sql(
        "atlas preferred emembers mapping context",
        "SELECT expression_context, count(*) AS n, count(*) FILTER (positive) AS positive FROM context GROUP BY ALL"
    )
)
def expression_contexts(b: Bridge) -> DataFrame:
    return _contexts(b).groupBy("expression_context").agg(F.count(F.lit(1)).alias("n"), F.count_if("expression_positive").alias("positive"))


@query(
    sql(
        "lines members",
        "SELECT combination, count(*) AS item_count FROM (SELECT group_id, string_agg(DISTINCT species_label, ';' ORDER BY species_label) AS combination FROM members GROUP BY ALL) GROUP BY ALL"
    )
)
def upset_intersections(b: Bridge) -> DataFrame:
    return expression.intersections(b.members(), "group_id", "species_label")


@query("""SELECT r_name AS group_id, a.n AS member_a, b.n AS member_b, length(a.n)::BIGINT AS comparable_sites, list_sum(list_transform(range(1, length(a.n) + 1), lambda i: (substr(a.n, i, 1) != substr(b.n, i, 1))::BIGINT))::BIGINT AS mismatch_sites
    FROM (SELECT n_regionkey, rpad(upper(n_name), 12, 'Q') AS n FROM nation) a JOIN (SELECT n_regionkey, rpad(upper(n_name), 12, 'Q') AS n FROM nation) b ON a.n_regionkey = b.n_regionkey AND a.n < b.n JOIN region ON a.n_regionkey = r_regionkey""")  # fmt: skip
def site_differences(b: Bridge) -> DataFrame:
    rows = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit(RUN).alias("run_id"), F.lit("HOG").alias("group_type"), F.lit("N0").alias("hierarchy_node"), F.col("r_name").alias("group_id"),
        F.rpad(F.upper("n_name"), F.lit(12), F.lit("Q")).alias("member_id")
    ).withColumn("sequence", F.col("member_id"))
    return distances.alignment_distances(rows).select("group_id", "member_a", "member_b", "comparable_sites", "mismatch_sites")


def _vectors(b: Bridge) -> DataFrame:
    """Pairs of at most 250 members of each label, the bound of a distance matrix."""
    v = b.table("embeddings").select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("member_id"), "embedding")
    sampled = distances.member_sample(v, 250, ("group_id",), salt=("group_id",))
    pairs = distances.pairs(sampled, ("group_id",), "member_id", "embedding")
    return pairs.select("group_id", "member_a", "member_b", distances.euclidean(F.col("embedding_a"), F.col("embedding_b")).alias("distance"))


_VECTORS = """WITH v AS (SELECT * FROM (SELECT label::BIGINT AS group_id, vec_id AS member_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY sha256(label::BIGINT || chr(0) || vec_id), vec_id) AS k FROM embeddings) WHERE k <= 250),
    vp AS (SELECT a.group_id, a.member_id AS member_a, b.member_id AS member_b, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.group_id = b.group_id AND a.member_id < b.member_id)"""
_ENDS = ", ends AS (SELECT group_id, member_a AS member, member_b AS other, distance FROM vp UNION ALL SELECT group_id, member_b, member_a, distance FROM vp)"


@query(f"{_VECTORS} SELECT group_id, member_a, member_b, round(distance, 5) AS distance FROM vp")
def pairwise_distance(b: Bridge) -> DataFrame:
    return _vectors(b).withColumn("distance", F.round("distance", 5))


@query(
    f"{_VECTORS}{_ENDS}, m AS (SELECT group_id, member, count(*) AS pair_count, sum(distance) AS total, avg(distance) AS mean_distance, median(distance) AS median_distance, stddev_pop(distance) AS stddev_distance, min(distance) AS minimum_distance, max(distance) AS maximum_distance, arg_min(other, distance) AS nearest_member FROM ends GROUP BY ALL) SELECT group_id, member, pair_count, round(mean_distance, 5) AS mean_distance, round(median_distance, 5) AS median_distance, round(stddev_distance, 5) AS stddev_distance, round(minimum_distance, 5) AS minimum_distance, round(maximum_distance, 5) AS maximum_distance, nearest_member, row_number() OVER (PARTITION BY group_id ORDER BY round(total, 9), member) = 1 AS is_medoid FROM m"
)
def member_dispersion(b: Bridge) -> DataFrame:
    out = distances.member_dispersion(_vectors(b), ("group_id",))
    return out.select(
        "group_id", "member", "pair_count",
        *[F.round(c, 5).alias(c) for c in ("mean_distance", "median_distance", "stddev_distance", "minimum_distance", "maximum_distance")],
        "nearest_member", "is_medoid"
    )


@query(
    f"{_VECTORS}, s AS (SELECT least(member_a % 4, member_b % 4) AS species_1, greatest(member_a % 4, member_b % 4) AS species_2, distance FROM vp) SELECT species_1::VARCHAR AS species_1, species_2::VARCHAR AS species_2, count(*) AS pair_count, round(avg(distance), 5) AS mean_distance, round(median(distance), 5) AS median_distance, round(stddev_pop(distance), 5) AS stddev_distance FROM s GROUP BY ALL"
)
def species_pair_dispersion(b: Bridge) -> DataFrame:
    species = b.table("embeddings").select(F.col("vec_id").alias("member_id"), (F.col("vec_id") % 4).cast("string").alias("species_label"))
    return distances.species_dispersion(distances.class_pairs(_vectors(b), species)).select(
        "species_1", "species_2", "pair_count", *[F.round(c, 5).alias(c) for c in ("mean_distance", "median_distance", "stddev_distance")]
    )


@query(
    f"{_VECTORS} SELECT CASE WHEN member_a % 4 = member_b % 4 THEN 'WITHIN_SPECIES' ELSE 'BETWEEN_SPECIES' END AS pair_class, count(*) AS n FROM vp GROUP BY ALL"
)
def pair_classes(b: Bridge) -> DataFrame:
    species = b.table("embeddings").select(F.col("vec_id").alias("member_id"), (F.col("vec_id") % 4).cast("string").alias("species_label"))
    return distances.class_pairs(_vectors(b), species).groupBy("pair_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{_VECTORS}{_ENDS}, near AS (SELECT *, row_number() OVER (PARTITION BY group_id, member ORDER BY distance, other) AS k FROM ends) SELECT DISTINCT group_id, least(member, other) AS member_a, greatest(member, other) AS member_b, round(distance, 5) AS distance FROM near WHERE k <= 3"
)
def nearest_neighbours(b: Bridge) -> DataFrame:
    return distances.nearest_neighbours(_vectors(b), 3, ("group_id",)).withColumn("distance", F.round("distance", 5))


@query(
    f"{_VECTORS}, w AS (SELECT group_id, min(distance) AS lo, max(distance) AS hi FROM vp GROUP BY ALL) SELECT group_id, least(19, floor((distance - lo) / (hi - lo) * 20))::BIGINT AS bin, count(*) AS pair_count FROM vp JOIN w USING (group_id) GROUP BY ALL"
)
def distance_histogram(b: Bridge) -> DataFrame:
    return distances.histogram(_vectors(b), ("group_id",))


@query(
    sql(
        "pairs",
        "SELECT group_id, member_a, member_b, other AS distance, round(cume_dist() OVER (PARTITION BY group_id ORDER BY other), 6) AS cumulative_fraction FROM pairs"
    )
)
def ecdf(b: Bridge) -> DataFrame:
    pairs = b.pair_distances().select("group_id", "member_a", "member_b", F.col("other").alias("distance"))
    return distances.cumulative(pairs, ("group_id",)).withColumn("cumulative_fraction", r("cumulative_fraction"))


@query(
    sql(
        "lines members",
        "SELECT group_id, member_id FROM (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY sha256('run' || chr(0) || group_id || chr(0) || member_id), member_id) AS k FROM members) WHERE k <= 3"
    )
)
def hash_sample(b: Bridge) -> DataFrame:
    return distances.member_sample(b.members(), 3).select("group_id", "member_id")


@query("""WITH c AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT *, n * 100 / sum(n) OVER () AS share FROM c), f AS (SELECT *, least(n, greatest(1, floor(share))) AS base FROM s),
    k AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS rank, greatest(0, 100 - sum(base) OVER ()) AS spare FROM f) SELECT stratum, least(n, base + CASE WHEN rank <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM k""")  # fmt: skip
def stratified_sample(b: Bridge) -> DataFrame:
    counts = b.table("customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return distances.stratified_quotas(counts, 100, "stratum", "n").select("stratum", "quota")


@query(
    "WITH p AS (SELECT event_id, event_type, (event_id * 7919 % 10007 + 1) / 10008 AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM p) SELECT event_id, round(least(1, min(p * n / k) OVER (PARTITION BY event_type ORDER BY k DESC)), 6) AS q FROM k"
)
def bh_adjust(b: Bridge) -> DataFrame:
    rows = b.table("events").select("event_id", "event_type", ((F.col("event_id") * 7919 % 10007 + 1) / 10008).alias("p"))
    return S.benjamini_hochberg(rows, "p", ["event_id"], ["event_type"], "q").select("event_id", r("q"))


@query(
    "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS average_rank FROM part"
)
def rank_average_ties(b: Bridge) -> DataFrame:
    return S.average_ranks(b.table("part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "average_rank")


@query(
    "WITH r AS (SELECT p_brand, p_size > 25 AS t, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS k FROM part), s AS (SELECT p_brand, count(*) FILTER (t) AS n, count(*) FILTER (NOT t) AS m, sum(k) FILTER (t) AS ks FROM r GROUP BY ALL) SELECT p_brand, n AS target_n, m AS reference_n, round(ks - n * (n + 1) / 2, 6) AS mann_whitney_u, round(2 * (ks - n * (n + 1) / 2) / (n * m) - 1, 6) AS cliffs_delta FROM s"
)
def rank_test(b: Bridge) -> DataFrame:
    rows = b.table("part").select("p_brand", "p_retailprice", (F.col("p_size") > 25).alias("t"))
    return S.mann_whitney(rows, "p_retailprice", "t", ["p_brand"]).select("p_brand", "target_n", "reference_n", r("mann_whitney_u"), r("cliffs_delta"))


# the tail of the normal law as a series (z below 6 here), so six places agree
@query("""WITH r AS (SELECT p_brand, p_size > 25 AS t, p_retailprice AS v, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS k, count(*) OVER (PARTITION BY p_brand, p_retailprice) AS c FROM part),
    s AS (SELECT p_brand, count(*) FILTER (t)::DOUBLE AS n, count(*) FILTER (NOT t)::DOUBLE AS m, sum(k) FILTER (t) AS ks, sum(c * c - 1)::DOUBLE AS ties FROM r GROUP BY ALL),
    z AS (SELECT p_brand, greatest(0, abs(ks - n * (n + 1) / 2 - n * m / 2) - 0.5) / sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))) / sqrt(2) AS x FROM s)
    SELECT p_brand, round(least(1, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(greatest(x, 1e-300)) - lgamma(i + 1)) / (2 * i + 1)))), 6) AS p_value_two_sided FROM z""")  # fmt: skip
def rank_test_p_values(b: Bridge) -> DataFrame:
    rows = b.table("part").select("p_brand", "p_retailprice", (F.col("p_size") > 25).alias("t"))
    return S.mann_whitney(rows, "p_retailprice", "t", ["p_brand"]).select("p_brand", r("p_value_two_sided"))


# benchmark: an order priority is a profile, an order a group, its price summary the metrics
def _values(b: Bridge) -> DataFrame:
    orders = b.table("orders").select(F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("group_id"), F.col("o_orderpriority").alias("profile_id"))
    price = b.distance_statistics().filter("distance_method = 'price'")
    values = benchmark.metric_values(price, ("group_id",)).join(orders, "group_id").withColumn("value", F.round("value", 9))
    return written(values, "values")  # the plans over it read it many times


def _links(b: Bridge) -> DataFrame:
    """The controls of an order: the five that follow it by number."""
    o = b.table("orders").select(
        F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("anchor_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"),
        "o_orderkey"
    )
    return o.select("anchor_id", F.concat(F.lit("G"), (F.col("o_orderkey") + F.col("i")).cast("string")).alias("control_id"))


_BENCH = f""", price AS (SELECT group_id, {_QUANTILES} FROM (SELECT group_id, distance AS d FROM pairs) GROUP BY group_id), wide AS (SELECT group_id, mean_distance, median_distance, population_stddev_distance, q75_distance - q25_distance AS distance_interquartile_range, CASE WHEN mean_distance > 0 THEN population_stddev_distance / mean_distance END AS distance_coefficient_of_variation FROM price),
    vals AS MATERIALIZED (SELECT group_id, metric, round(value, 9) AS value, o_orderpriority AS profile_id FROM (UNPIVOT wide ON mean_distance, median_distance, population_stddev_distance, distance_interquartile_range, distance_coefficient_of_variation INTO NAME metric VALUE value) JOIN orders ON group_id = 'G' || o_orderkey),
    links AS (SELECT 'G' || o_orderkey AS anchor_id, 'G' || (o_orderkey + i) AS control_id FROM orders, range(1, 6) t(i)) """


@query(
    sql(
        "pairs",
        _BENCH + "SELECT profile_id, metric, count(*) AS eligible_group_count, round(min(value), 6) AS minimum_value, round(quantile_cont(value, 0.25), 6) AS q25_value, round(median(value), 6) AS median_value, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.75), 6) AS q75_value, round(max(value), 6) AS maximum_value, round(stddev_pop(value), 6) AS population_stddev_value FROM vals GROUP BY ALL"
    )
)
def profile_background(b: Bridge) -> DataFrame:
    return benchmark.background(_values(b)).select(
        "profile_id", "metric", "eligible_group_count",
        *[r(c) for c in ("minimum_value", "q25_value", "median_value", "mean_value", "q75_value", "maximum_value", "population_stddev_value")]
    )


@query(
    sql(
        "pairs",
        _BENCH + ", m AS MATERIALIZED (SELECT anchor_id AS group_id, metric, median(value) AS mid, count(*) AS n FROM links JOIN vals ON control_id = group_id GROUP BY ALL HAVING count(*) >= 3) SELECT group_id, metric, n AS control_count, round(mid, 6) AS control_median, round(value - mid, 6) AS residual FROM vals JOIN m USING (group_id, metric)"
    )
)
def matched_residuals(b: Bridge) -> DataFrame:
    return benchmark.residuals(_values(b), _links(b)).select("group_id", "metric", "control_count", r("control_median"), r("residual"))


@query(
    sql(
        "pairs",
        _BENCH + ", w AS MATERIALIZED (SELECT group_id, metric, value, control_id FROM vals JOIN links ON anchor_id = group_id), c AS (SELECT a.group_id, a.metric, a.value, count(*) AS n, median(v.value) AS mid, (count(*) FILTER (v.value < a.value) + 0.5 * count(*) FILTER (v.value = a.value)) / count(*) AS f FROM w a JOIN vals v ON v.group_id = a.control_id AND v.metric = a.metric GROUP BY ALL) SELECT group_id, metric, n AS control_count, round(CASE WHEN n >= 3 THEN mid END, 6) AS control_median, round(CASE WHEN n >= 3 THEN f END, 6) AS percentile, CASE WHEN n < 3 THEN 'INSUFFICIENT' WHEN f <= 0.1 THEN 'COMPACT_OR_LOW' WHEN f >= 0.9 THEN 'DISPERSED_OR_HIGH' ELSE 'TYPICAL' END AS dispersion_class FROM c"
    )
)
def classification(b: Bridge) -> DataFrame:
    return benchmark.classify(_values(b), _links(b)).select("group_id", "metric", "control_count", r("control_median"), r("percentile"), "dispersion_class")


@query(sql("pairs", _BENCH + """, p AS (SELECT DISTINCT profile_id AS background FROM vals),
    u AS (SELECT profile_id, metric, value, 1 AS w, NULL AS group_id, false AS own FROM vals UNION ALL SELECT background, metric, value, 0, group_id, profile_id = background FROM vals, p),
    c AS (SELECT *, sum(w) OVER (PARTITION BY profile_id, metric ORDER BY value) AS upto, sum(w) OVER (PARTITION BY profile_id, metric, value) AS tied, sum(w) OVER (PARTITION BY profile_id, metric) AS total FROM u),
    n AS (SELECT profile_id, metric, group_id, value, own, upto - tied AS lo, tied - own::INT AS eq, total - own::INT AS n FROM c WHERE w = 0)
    SELECT profile_id, metric, group_id, round(value, 6) AS observed_value, n::BIGINT AS background_group_count, round((lo + 0.5 * eq) / n, 6) AS empirical_percentile, round((lo + eq + 1) / (n + 1), 6) AS lower_tail_p_value, round((n - lo + 1) / (n + 1), 6) AS upper_tail_p_value, own AS leave_one_out FROM n WHERE n >= 3"""))  # fmt: skip
def individual_empirical(b: Bridge) -> DataFrame:
    out = benchmark.compare_to_all(_values(b)).filter("status = 'TESTED'")
    return out.select(
        "profile_id", "metric", "group_id", r("observed_value"), "background_group_count", r("empirical_percentile"), r("lower_tail_p_value"),
        r("upper_tail_p_value"), "leave_one_out"
    )


def _all_pairs(values: DataFrame) -> DataFrame:
    names = values.select(F.col("profile_id").alias("target_profile_id")).distinct()
    # ten pairs
    return names.crossJoin(
        F.broadcast(names.withColumnRenamed("target_profile_id", "reference_profile_id"))
    ).filter("target_profile_id < reference_profile_id")


@query()
def profile_contrasts(b: Bridge) -> DataFrame:
    values = _values(b)
    return benchmark.contrasts(values, _all_pairs(values))


@query(sql("pairs", _BENCH + """, names AS (SELECT DISTINCT profile_id FROM vals), planned AS (SELECT a.profile_id AS target_profile_id, b.profile_id AS reference_profile_id FROM names a JOIN names b ON a.profile_id < b.profile_id)
    SELECT target_profile_id, reference_profile_id, metric, count(*) FILTER (profile_id = target_profile_id) AS target_group_count, count(*) FILTER (profile_id = reference_profile_id) AS reference_group_count,
        round(median(value) FILTER (profile_id = target_profile_id), 6) AS target_median, round(median(value) FILTER (profile_id = reference_profile_id), 6) AS reference_median
    FROM planned JOIN vals ON profile_id IN (target_profile_id, reference_profile_id) GROUP BY ALL"""))  # fmt: skip
def contrast_medians(b: Bridge) -> DataFrame:
    """The sides of each contrast, without the resampled interval."""
    values = _values(b)
    sides = benchmark.contrast_sides(values, _all_pairs(values))
    return benchmark.contrast_medians(sides).select(
        "target_profile_id", "reference_profile_id", "metric", "target_group_count", "reference_group_count", r("target_median"),
        r("reference_median")
    )


@query()
def matched_controls(b: Bridge) -> DataFrame:
    """Anchors are the orders of the lowest priority that are partly shipped, one in fifteen."""
    stats = b.stats().filter("member_count > 1")
    partly = b.table("orders").filter("o_orderstatus = 'P' and o_orderpriority = '5-LOW'").select(
        F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("group_id")
    )
    return benchmark.match_controls(stats.join(partly, "group_id", "left_semi"), stats.join(partly, "group_id", "left_anti"), 3)


@query(
    sql(
        "lines members",
        ", m AS (SELECT group_id, species_label, member_id, l_returnflag AS id, l_linestatus || ';' || l_returnflag || ',' AS cat FROM (SELECT 'G' || l_orderkey AS group_id, n_name AS species_label, l_partkey || '-' || l_linenumber AS member_id, l_returnflag, l_linestatus FROM lines)), e AS (SELECT *, unnest(['F_ALL', 'F_CATEGORY::' || split_part(cat, ';', 1), 'F_CATEGORY::' || id]) AS profile_id FROM m) SELECT group_id, profile_id, count(DISTINCT id) AS marker_count, string_agg(DISTINCT id, ';' ORDER BY id) AS marker_ids, count(DISTINCT member_id) AS matched_member_count, string_agg(DISTINCT species_label, ';' ORDER BY species_label) AS matched_species_labels FROM e GROUP BY ALL"
    )
)
def group_profiles(b: Bridge) -> DataFrame:
    lines = b._lines().select(
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("group_id"), F.col("n_name").alias("species_label"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("member_id"),
        F.col("l_returnflag").alias("marker_id"), F.lit("F").alias("marker_class"),
        F.concat("l_linestatus", F.lit(";"), "l_returnflag", F.lit(",")).alias("marker_category")
    )
    return benchmark.profiles(lines, ("group_id",)).select(
        "group_id", "profile_id", "marker_count", "marker_ids", "matched_member_count", "matched_species_labels"
    )


# catalogue: a part is a sequence, its brand a cluster, orders' best lines are alignments
@query("""WITH ids AS (SELECT p_partkey::VARCHAR AS input_id FROM part WHERE p_size <= 20 UNION SELECT 'x' || p_partkey FROM part WHERE p_size = 50), map AS (SELECT DISTINCT p_partkey::VARCHAR AS sequence_id, p_brand AS cluster_id FROM part WHERE p_size > 8 UNION SELECT p_partkey::VARCHAR, 'extra' FROM part WHERE p_size = 15),
    idx AS (SELECT p_brand AS cluster_id, count(*) AS member_count FROM part WHERE p_brand NOT LIKE '%3' GROUP BY ALL), hits AS (SELECT i.input_id, m.* , member_count FROM ids i JOIN map m ON m.sequence_id = i.input_id LEFT JOIN idx USING (cluster_id)), n AS (SELECT input_id, count(DISTINCT cluster_id) AS k FROM hits GROUP BY ALL)
    SELECT i.input_id, h.cluster_id, h.member_count, coalesce(k, 0) AS global_cluster_count, CASE WHEN h.cluster_id IS NULL THEN 'UNMATCHED' WHEN h.member_count IS NULL THEN 'MAPPED_WITHOUT_ROW_GROUP_INDEX' WHEN k > 1 THEN 'MULTIPLE_GLOBAL_CLUSTERS' ELSE 'EXACT_ID' END AS mapping_status FROM ids i LEFT JOIN hits h USING (input_id) LEFT JOIN n USING (input_id)""")  # fmt: skip
def alias_resolution_states(b: Bridge) -> DataFrame:
    part = b.table("part").withColumn("k", F.col("p_partkey").cast("string"))
    ids = part.filter("p_size <= 20").select(F.col("k").alias("input_id")).unionByName(
        part.filter("p_size = 50").select(F.concat(F.lit("x"), "k").alias("input_id"))
    )
    mapping = part.filter("p_size > 8").select(F.col("k").alias("sequence_id"), F.col("p_brand").alias("cluster_id")).unionByName(
        part.filter("p_size = 15").select(F.col("k").alias("sequence_id"), F.lit("extra").alias("cluster_id"))
    )
    index = part.filter("p_brand not like '%3'").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count(F.lit(1)).alias("member_count"))
    return catalogue.resolve(ids, mapping, index).select("input_id", "cluster_id", "member_count", "global_cluster_count", "mapping_status")


@query(
    "SELECT p_brand AS cluster_id, p_size::BIGINT AS taxon_id, min(p_type) AS species, count(DISTINCT p_partkey) AS annotated_member_count FROM part WHERE p_size > 12 GROUP BY ALL"
)
def cluster_taxonomy(b: Bridge) -> DataFrame:
    p = b.table("part")
    tax = p.select(
        F.col("p_partkey").alias("sequence_id"), F.col("p_size").cast("long").alias("taxon_id"), F.col("p_type").alias("species"),
        F.when(F.col("p_size") > 12, "REVIEWED").otherwise("PENDING_REVIEW").alias("mapping_status")
    )
    return catalogue.cluster_taxonomy(p.select(F.col("p_partkey").alias("sequence_id"), F.col("p_brand").alias("cluster_id")), tax)


@query(
    "SELECT p_brand AS cluster_id, count(*) AS member_count FROM part GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT p_size) FILTER (p_size IN (1, 7)) = 2"
)
def cluster_browse_all_taxa(b: Bridge) -> DataFrame:
    p = b.table("part")
    by = p.select(F.col("p_brand").alias("cluster_id"), F.col("p_size").alias("taxon_id")).distinct()
    index = p.groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count(F.lit(1)).alias("member_count"))
    return catalogue.browse(index, by, least_members=10, taxa=(1, 7), all_taxa=True)


_ALIGNED = "al AS (SELECT l_partkey AS q, l_suppkey AS s, l_quantity AS nident, l_quantity + (l_linenumber % 3) * 20 AS length, l_extendedprice / 1000 AS bitscore, l_discount / 1e9 AS evalue, l_orderkey, l_linenumber FROM lineitem)"


def _alignment_rows(b: Bridge) -> DataFrame:
    li = b.table("lineitem")
    return li.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("qseqid"),
        F.concat(F.lit("s"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("sseqid"),
        F.col("l_quantity").cast("double").alias("nident"), (F.col("l_quantity") + (F.col("l_linenumber") % 3) * 20).cast("double").alias("length"),
        (F.col("l_extendedprice") / 1000).alias("bitscore"), (F.col("l_discount") / 1e9).alias("evalue"), F.lit(1.0).alias("qstart"),
        F.col("l_quantity").cast("double").alias("qend"), F.lit(50.0).alias("qlen"), F.lit(1.0).alias("sstart"),
        F.col("l_quantity").cast("double").alias("send"), F.lit(50.0).alias("slen"), F.lit(0.0).alias("pident")
    )


@query(
    "SELECT 'p' || l_partkey AS qseqid, 's' || l_partkey || '_' || l_suppkey AS sseqid, max(round(l_extendedprice / 1000, 6)) AS bitscore FROM lineitem GROUP BY ALL"
)
def best_alignment_per_pair(b: Bridge) -> DataFrame:
    return catalogue.best_alignments(_alignment_rows(b)).select("qseqid", "sseqid", r("bitscore"))


@query("""WITH mem AS (SELECT DISTINCT 'p' || l_partkey AS r, 's' || l_partkey || '_' || l_suppkey AS m FROM lineitem UNION SELECT 'p' || l_partkey, 'p' || l_partkey FROM lineitem),
    best AS (SELECT * FROM (SELECT 'p' || l_partkey AS r, 's' || l_partkey || '_' || l_suppkey AS m, l_quantity AS q, l_quantity + (l_linenumber % 3) * 20 AS len, l_extendedprice / 1000 AS bits, l_discount / 1e9 AS ev, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice / 1000 DESC, l_discount / 1e9) AS k FROM lineitem) WHERE k = 1),
    st AS (SELECT mem.*, CASE WHEN mem.r = mem.m THEN 'CENTROID_SELF' WHEN q IS NULL THEN 'NO_REALIGNMENT' WHEN 100 * q / len >= 70 AND 100 * q / 50 >= 80 AND ev <= 1e-10 AND bits > 20 THEN 'EXACT_THRESHOLDS_PASS' ELSE 'EXACT_THRESHOLDS_FAIL' END AS alignment_status FROM mem LEFT JOIN best USING (r, m))
    SELECT m AS sequence_id, r AS native_representative_id, alignment_status, 'sub_' || substr(sha256(CASE WHEN alignment_status IN ('CENTROID_SELF', 'EXACT_THRESHOLDS_PASS') THEN r ELSE m END), 1, 24) AS subcluster_id FROM st""")  # fmt: skip
def subcluster_audit(b: Bridge) -> DataFrame:
    rows = _alignment_rows(b)
    own = rows.select(F.col("qseqid").alias("representative_id"), F.col("sseqid").alias("sequence_id")).distinct()
    mem = own.unionByName(own.select("representative_id", F.col("representative_id").alias("sequence_id")).distinct())
    return catalogue.audit_subclusters(mem, rows).select("sequence_id", "native_representative_id", "alignment_status", "subcluster_id")


_NATIONS = "SELECT n_name AS id, rpad(translate(upper(n_name), '_0123456789', '-ACDEFGHIKL'), 12, '-') AS s FROM nation"


def _aligned(b: Bridge) -> DataFrame:
    return b.table("nation").select(
        F.col("n_name").alias("sequence_id"),
        F.rpad(F.translate(F.upper("n_name"), "_0123456789", "-ACDEFGHIKL"), F.lit(12), F.lit("-")).alias("sequence")
    )


@query(f"""WITH a AS ({_NATIONS}), c AS (SELECT id, i AS p, substr(s, i, 1) AS x FROM a, range(1, 13) t(i)), k AS (SELECT p, x, count(*) AS n FROM c GROUP BY ALL),
    t AS (SELECT p, sum(n) AS total, coalesce(sum(n) FILTER (x = '-'), 0) AS gaps, coalesce(sum(n) FILTER (contains('ACDEFGHIKLMNPQRSTVWY', x)), 0) AS known, arg_min(x, {{'c': -n, 'x': x}}) FILTER (contains('ACDEFGHIKLMNPQRSTVWY', x)) AS top, max(n) FILTER (contains('ACDEFGHIKLMNPQRSTVWY', x)) AS most FROM k GROUP BY ALL),
    h AS (SELECT p, -sum(n / known * log2(n / known)) AS e FROM k JOIN t USING (p) WHERE contains('ACDEFGHIKLMNPQRSTVWY', x) GROUP BY ALL)
    SELECT p::INT AS alignment_column, round(gaps / total, 6) AS gap_fraction, round(known / total, 6) AS canonical_residue_fraction, top AS consensus_residue, round(most / nullif(known, 0), 6) AS consensus_fraction_of_known, abs(round(e, 6)) AS shannon_entropy_bits FROM t LEFT JOIN h USING (p)""")  # fmt: skip
def column_entropy(b: Bridge) -> DataFrame:
    return catalogue.alignment_columns(_aligned(b), "NATION_0").select(
        "alignment_column", r("gap_fraction"), r("canonical_residue_fraction"), "consensus_residue", r("consensus_fraction_of_known"),
        F.abs(F.round("shannon_entropy_bits", 6)).alias("shannon_entropy_bits")
    )


@query(f"""WITH a AS ({_NATIONS}), p AS (SELECT a.id, i, substr(a.s, i, 1) AS x, substr(r.s, i, 1) AS y FROM a, (SELECT s FROM a WHERE id = 'NATION_0') r, range(1, 13) t(i)), k AS (SELECT *, contains('ACDEFGHIKLMNPQRSTVWY', x) AND contains('ACDEFGHIKLMNPQRSTVWY', y) AS pair FROM p)
    SELECT id AS sequence_id, count(*) FILTER (x != '-') AS sequence_length, count(*) FILTER (pair) AS comparable_residue_count, round(count(*) FILTER (pair AND x = y) / nullif(count(*) FILTER (pair), 0), 6) AS identity_to_reference_fraction, round(count(*) FILTER (x != '-' AND y != '-') / count(*) FILTER (y != '-'), 6) AS reference_overlap_fraction FROM k GROUP BY ALL""")  # fmt: skip
def alignment_members(b: Bridge) -> DataFrame:
    return catalogue.alignment_members(_aligned(b), "NATION_0").select(
        "sequence_id", "sequence_length", "comparable_residue_count", r("identity_to_reference_fraction"), r("reference_overlap_fraction")
    )


@query(
    "SELECT c_mktsegment AS cluster_id, count(*) AS member_count, min(length(c_name))::INT AS minimum_length, max(length(c_name))::INT AS maximum_length, round(avg(length(c_name)), 6) AS mean_length, median(length(c_name)) AS median_length, count(*) FILTER (c_acctbal > 0) AS annotated_member_count, count(DISTINCT c_nationkey) FILTER (c_acctbal > 0) AS taxon_count FROM customer GROUP BY ALL"
)
def cluster_statistics(b: Bridge) -> DataFrame:
    c = b.table("customer")
    members = c.select(F.col("c_mktsegment").alias("cluster_id"), F.col("c_custkey").alias("sequence_id"), F.col("c_name").alias("sequence"))
    tax = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("sequence_id"), F.col("c_nationkey").alias("taxon_id"))
    return catalogue.statistics(members, tax).withColumn("mean_length", r("mean_length"))


@query(
    "SELECT p_partkey, unnest(CASE WHEN p_name = '' THEN ['UNCLASSIFIED'] ELSE list_filter(list_transform(string_split_regex(p_brand || ';' || p_type || ', ' || p_brand, '[;,]'), lambda x: trim(x)), lambda x: x != '') END) AS category FROM part"
)
def category_lists(b: Bridge) -> DataFrame:
    return b.table("part").select("p_partkey", F.explode(X.categories(F.concat("p_brand", F.lit(";"), "p_type", F.lit(", "), "p_brand"))).alias("category"))


@query(
    "WITH h AS (SELECT p_partkey, 'sp|A' || p_partkey || '|E' || p_size || '.2' AS m, p_size FROM part) SELECT p_partkey, unnest([{'t': 'member_id', 'v': m, 'k': 1}, {'t': 'uniprot_accession', 'v': 'A' || p_partkey, 'k': 1}, {'t': 'uniprot_entry', 'v': 'E' || p_size || '.2', 'k': 2}, {'t': 'gn', 'v': 'G' || p_size || '.1', 'k': 1}, {'t': 'member_id_versionless', 'v': regexp_replace(m, '\\.\\d+$', ''), 'k': 2}, {'t': 'uniprot_entry_versionless', 'v': 'E' || p_size, 'k': 3}, {'t': 'gn_versionless', 'v': 'G' || p_size, 'k': 2}]).t AS alias_type, unnest([{'t': 'member_id', 'v': m, 'k': 1}, {'t': 'uniprot_accession', 'v': 'A' || p_partkey, 'k': 1}, {'t': 'uniprot_entry', 'v': 'E' || p_size || '.2', 'k': 2}, {'t': 'gn', 'v': 'G' || p_size || '.1', 'k': 1}, {'t': 'member_id_versionless', 'v': regexp_replace(m, '\\.\\d+$', ''), 'k': 2}, {'t': 'uniprot_entry_versionless', 'v': 'E' || p_size, 'k': 3}, {'t': 'gn_versionless', 'v': 'G' || p_size, 'k': 2}]).v AS alias_value FROM h"
)
def header_aliases(b: Bridge) -> DataFrame:
    p = b.table("part").select(
        "p_partkey", F.concat(F.lit("sp|A"), F.col("p_partkey").cast("string"), F.lit("|E"), F.col("p_size").cast("string"), F.lit(".2")).alias("m"),
        "p_size"
    )
    header = F.concat("m", F.lit(" a protein GN=G"), F.col("p_size").cast("string"), F.lit(".1 PE=1"))
    return p.select("p_partkey", F.explode(X.header_aliases(F.col("m"), header)).alias("a")).select("p_partkey", "a.alias_type", "a.alias_value")


@query()
def pcoa(b: Bridge) -> DataFrame:
    return geometry.pcoa(
        _vectors(b).withColumn("member_a", F.col("member_a").cast("string")).withColumn("member_b", F.col("member_b").cast("string")), ("group_id",)
    )


@query()
def connected_network(b: Bridge) -> DataFrame:
    return geometry.connected_network(
        _vectors(b).withColumn("member_a", F.col("member_a").cast("string")).withColumn("member_b", F.col("member_b").cast("string")), 2,
        ("group_id",)
    )


@query(
    "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM events GROUP BY ALL"
)
def event_windows(b: Bridge) -> DataFrame:
    return streaming.windowed_counts(b.table("events")).withColumn("total_value", F.round("total_value", 4)).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


from . import evidence, families, phylogenies, roundtrips, selections  # noqa: E402, F401  (they register their own)
