"""Ladders of ranks, selectors and their guards, selections and coverage trees, the benchmark's plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinfold.errors import InputError, IntegrityError
from kinfold.functions import stats
from kinfold.operators import benchmark, plan, report, selection, selectors, taxonomy
from kinfold.operators.taxonomy import Selector
from kinfold.plans import queries
from kinfold.schemas import KEY

G = ("run", "HOG", "N0")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_buckets_keep_the_order(spark):
    rng = random.Random(1)
    values = sorted({0.0, -1.0, 1.0, 2.0, 1 - 2**-53, 1e-300, 1e300, -1e-9, *[rng.gauss(0, 1) * 10 ** rng.randrange(-8, 8) for _ in range(2000)], *[2.0**k for k in range(-40, 40)], *[math.nextafter(2.0**k, 0) for k in range(-40, 40)]})
    got = [r["b"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").orderBy("k").select(stats.bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) > 500


def test_ladders_against_loops(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), round(rng.random() ** 3, rng.choice([1, 6])), rng.random() < 0.4, k) for k in range(900)] + [("c", 0.5, True, 900), ("a", None, True, 901), (None, 0.25, False, 902), (None, 0.75, True, 903)]
    df = spark.createDataFrame(data, "g string, p double, t boolean, k long")
    q = {r["k"]: r["q"] for r in stats.benjamini_hochberg(df, "p", ["k"], ["g"], "q").collect()}
    ranks = {r["k"]: (r["average_rank"], r["tie_count"]) for r in stats.average_ranks(df, "p", ["g"]).collect()}
    tests = {r["g"]: r for r in stats.mann_whitney(df, "p", "t", ["g"]).collect()}
    for g in ("a", "b", "c", None):
        own = sorted((p, k) for h, p, _, k in data if h == g and p is not None)
        least = 1.0
        for i in range(len(own) - 1, -1, -1):
            least = min(least, own[i][0] * len(own) / (i + 1))
            tied = [j for j, x in enumerate(own) if x[0] == own[i][0]]
            assert ranks[own[i][1]] == (sum(tied) / len(tied) + 1, len(tied))
            if i == tied[0]:
                assert all(q[own[j][1]] == pytest.approx(min(1.0, *[own[m][0] * len(own) / (m + 1) for m in range(tied[-1], len(own))])) for j in tied)
        t, r = [p for h, p, x, _ in data if h == g and x and p is not None], [p for h, p, x, _ in data if h == g and not x and p is not None]
        assert tests[g]["mann_whitney_u"] == sum((a > b) + 0.5 * (a == b) for a in t for b in r) and (tests[g]["target_n"], tests[g]["reference_n"]) == (len(t), len(r))
    assert q[901] is None and ranks[901] == (None, None)


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.1, 0.7, 1.3, 1.999, 2.0, 2.5, 4.0, 6.0, 9.0]
    got = [r["y"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, x double").orderBy("k").select(stats.erfc(F.col("x")).alias("y")).collect()]
    assert got == [pytest.approx(math.erfc(x), rel=1e-9, abs=1e-15) for x in xs]


def test_guards(spark):
    one = spark.createDataFrame([(*G, "g1", 3), (*G, "g2", 4), (*G, "g2", 5)], ", ".join(f"{k} string" for k in KEY) + ", member_count long")
    none = spark.createDataFrame([], ", ".join(f"{k} string" for k in KEY) + ", distance_pair_count long, distance_method string")
    key = dict(zip(KEY, (*G, "g1"), strict=True))
    assert selectors.one_group(one, none, key).first()["member_count"] == 3
    for wrong in ({**key, "group_id": "g2"}, {**key, "group_id": "g3"}, {"group_id": "g1"}):
        with pytest.raises(InputError):
            selectors.one_group(one, none, wrong)
    assert selectors.text_values([" a", "b", "a "], "ids") == ("a", "b")
    for bad in ("ab", ["a", " "], ["x" * 600], ["a", "b", "c"]):
        with pytest.raises(InputError):
            selectors.text_values(bad, "ids", 2)
    with pytest.raises(InputError):
        selectors.guarded(one, 2, "groups")
    assert selectors.guarded(one, 3, "groups").count() == 3 and selectors.first_rows(one, ["member_count"], 2)[1] and not selectors.first_rows(one, ["member_count"], 3)[1]
    with pytest.raises(InputError):
        selectors.shown_columns(one, ["member_count", "secret"], 10)
    with pytest.raises(InputError):
        selectors.comparison(one, ["g1"])
    assert [r[0] for r in spark.createDataFrame([("7",), ("-1",), ("x",), (None,), ("",)], "v string").select(report.whole_number(F.col("v"))).collect()] == [7, None, None, None, None]


def test_tables_of_any_size_are_not_refused(spark, sf_dir, monkeypatch):
    kind = "run_id string, group_type string, hierarchy_node string, group_id string, species_label string, species_member_count long"
    species = spark.createDataFrame([("r", "HOG", "N0", "7", "A", 1), ("r", "HOG", "N0", "x", "A", 1)], kind)
    ids = spark.range(selectors.MOST_IDS + 1).select(F.col("id").cast("string").alias("group_id"))
    assert [r["group_id"] for r in selectors.group_species_collection(species, "HOG", "N0", ids.union(ids)).collect()] == ["7"]
    with pytest.raises(InputError):
        selectors.group_species_collection(species, "HOG", "N0", most=1)
    bounds, guarded = [], selectors.guarded
    monkeypatch.setattr(selectors, "guarded", lambda rows, most, label: bounds.append(most) or guarded(rows, most, label))
    assert queries.QUERIES["chosen_distance_columns"](spark, sf_dir).count() > 0 and bounds == [None]


def test_comparison_with_all_backgrounds(spark, monkeypatch):
    rng = random.Random(4)
    own = [(f"g{k}", rng.choice("abc"), m, float(rng.choice([0, 0, 1, 2.5, -3]))) for k in range(60) for m in ("x", "y")]
    values = spark.createDataFrame([*own, ("g0", "d", "x", own[0][3]), ("h", "d", "x", None)], "group_id string, profile_id string, metric string, value double")
    targets = values.filter("value is not null").select("group_id", "metric", "value").distinct().crossJoin(values.select("profile_id").distinct())
    plain = benchmark.compare(targets, values.filter("value is not null"), ["profile_id", "metric"])
    found = benchmark.compare_to_all(values)
    want = sorted(map(str, plain.filter("status = 'TESTED'").select(*sorted(plain.columns)).collect()))
    assert len(want) == 360 and sorted(map(str, found.filter("status = 'TESTED'").select(*sorted(plain.columns)).collect())) == want
    monkeypatch.setattr(benchmark, "MOST_BACKGROUNDS", 2)
    assert sorted(map(str, benchmark.compare_to_all(values).filter("status = 'TESTED'").select(*sorted(plain.columns)).collect())) == want


def test_medians(spark):
    import statistics

    rng = random.Random(6)
    own = [(k % 4, None if rng.random() < 0.1 else rng.choice([0.0, -2.25, 7.5, round(rng.gauss(0, 9), 2)])) for k in range(801)]
    want = {g: statistics.median(v for h, v in own if h == g and v is not None) for g in range(4)}
    found = stats.medians(spark.createDataFrame([*own, (9, None), (8, 3.0), (8, 4.0)], "g int, v double").repartition(3), ["g"], "v")
    assert {r["g"]: r["median"] for r in found.collect()} == want | {8: 3.5}
    assert "percentile" not in found._jdf.queryExecution().toString()


def test_medians_of_contrasts_hold_no_side(spark):
    kind = "target_profile_id string, reference_profile_id string, metric string, group_id string, value double, is_target boolean"
    sides = spark.createDataFrame([("a", "b", "m", "1", 1.0, True), ("a", "b", "m", "2", 4.0, True), ("a", "b", "m", "3", 2.0, False), ("a", "c", "m", "1", 1.0, True)], kind)
    found = benchmark.contrast_medians(sides)
    assert rows(found, "reference_profile_id", "target_group_count", "reference_group_count", "target_median", "reference_median") == [("b", 2, 1, 2.5, 2.0), ("c", 1, 0, 1.0, None)]
    assert "percentile" not in found._jdf.queryExecution().toString()  # which holds a side's values in one task


def test_profiles_take_one_row_a_line(spark):
    kind = "group_id string, marker_id string, marker_class string, marker_category string, member_id string, species_label string"
    matches = spark.createDataFrame([("g", "m1", "F", "a;b", "p", "s"), ("g", "m1", "F", "a", "q", "s"), ("g", "m2", "F", None, "q", "t")], kind)
    found = benchmark.profiles(matches, ("group_id",))
    assert rows(found, "profile_id", "marker_count", "marker_ids", "matched_member_count", "matched_species_labels") == [
        ("F_ALL", 2, "m1;m2", 2, "s;t"), ("F_CATEGORY::UNCLASSIFIED", 1, "m2", 1, "t"), ("F_CATEGORY::a", 1, "m1", 2, "s"), ("F_CATEGORY::b", 1, "m1", 1, "s")
    ]
    assert "Expand" not in found._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def closed(spark):
    edges = [("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("A", "root"), ("B", "root"), ("c1", "C"), ("C", "root")]
    return spark.createDataFrame([(r["ancestor"], r["descendant"], r["depth"]) for r in taxonomy.closure(spark.createDataFrame(edges, "child string, parent string")).collect()], "ancestor string, descendant string, depth int")


def taxa(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "taxon_id string")


@pytest.mark.parametrize("chosen, said", [
    ([("REQUIRED_EXACT", "a1"), ("EXCLUDE_EXACT", "a1")], "required and excluded"),
    ([("REQUIRED_EXACT", "a1"), ("EXCLUDE_CLADE", "A")], "covered by an exclusion"),
    ([("REQUIRED_EXACT", "b1"), ("ONLY_IN_CLADE", "A")], "outside the only-in scope"),
    ([("INCLUDE_CLADE", "B"), ("EXCLUDE_CLADE", "B")], "covered by exclusions"),
    ([("INCLUDE_CLADE", "C")], "no represented terminal"),
    ([("INCLUDE_CLADE", "A"), ("EXCLUDE_EXACT", "a1"), ("EXCLUDE_EXACT", "a2")], "covered by exclusions"),
    ([("INCLUDE_CLADE", "A"), ("ONLY_IN_CLADE", "B")], "nothing inside the only-in scope"),
    ([("ONLY_IN_CLADE", "A"), ("ONLY_IN_CLADE", "B")], "no represented terminal"),
    ([("ONLY_IN_CLADE", "A"), ("EXCLUDE_CLADE", "A")], "cover the only-in scope"),
])
def test_contradictions(spark, closed, chosen, said):
    with pytest.raises(InputError, match=said):
        selection.check_contradictions([Selector(*c) for c in chosen], closed, taxa(spark, "a1", "a2", "b1"))


def test_selections_that_can_be_met(spark, closed):
    chosen = [Selector("REQUIRED_EXACT", "a1"), Selector("INCLUDE_CLADE", "A"), Selector("EXCLUDE_EXACT", "a2")]
    selection.check_contradictions(chosen, closed, taxa(spark, "a1", "a2", "b1"))
    selection.check_contradictions([], closed, taxa(spark))
    assert selection.summary(chosen) == "A group that has a1, has a member of A, lacks a2." and selection.summary([]) == "Any group."
    present = spark.createDataFrame([("g", "a1"), ("g", "b1"), ("g", None), ("h", "a1")], "group_id string, taxon_id string")
    assert rows(selection.outside_scope(present, closed, chosen, ("group_id",)), "group_id", "taxon_id") == [("g", "b1")]
    assert selection.outside_scope(present, closed, [], ("group_id",)).count() == 0
    states = selection.selection_states(taxa(spark, "a1", "a2", "A", "B", "b1"), closed, [Selector("ONLY_IN_CLADE", "A"), Selector("EXCLUDE_CLADE", "B"), Selector("REQUIRED_EXACT", "A")])
    assert rows(states, "taxon_id", "selection_state", "is_selected", "is_excluded") == [("A", "ONLY_IN_SCOPE|REQUIRED_EXACT", True, False), ("B", "EXCLUDED_CLADE", False, True), ("a1", "WITHIN_ONLY_IN_SCOPE", False, False), ("a2", "WITHIN_ONLY_IN_SCOPE", False, False), ("b1", "EXCLUDED_BY_CLADE", False, True)]
    with pytest.raises(IntegrityError):
        selection.check_species_rows(spark.createDataFrame([("g", "s"), ("g", "s")], "group_id string, species_label string"), ("group_id",))
    hoped = spark.createDataFrame([("a1", True), ("c1", False)], "taxon_id string, included boolean")
    assert rows(selection.expected_taxa(hoped, closed), "taxon_id") == [("a1",)]
    for bad in (hoped.unionByName(hoped), spark.createDataFrame([("A", True)], "taxon_id string, included boolean")):
        with pytest.raises(InputError):
            selection.expected_taxa(bad, closed)


def test_coverage_tree(spark, closed):
    here, none = taxa(spark, "a1", "a2", "b1"), taxa(spark)
    tree = selection.coverage_tree(closed, [Selector("EXCLUDE_EXACT", "a2")], here, taxa(spark, "c1", "a1"), taxa(spark, "b1"))
    selection.reconcile(tree)
    assert rows(tree, "taxon_id", "coverage_state", "represented_terminal_count", "expected_no_data_terminal_count", "excluded_terminal_count") == [
        ("A", "ANCESTOR_OF_REPRESENTED", 2, 0, 1), ("B", "ANCESTOR_OF_REPRESENTED", 1, 0, 0), ("C", "NOT_IN_EXPECTED_UNIVERSE", 0, 1, 0), ("a1", "REPRESENTED_IN_INPUT", 1, 0, 0),
        ("a2", "REPRESENTED_IN_INPUT", 1, 0, 1), ("b1", "OUTSIDE_SELECTED_SCOPE_WITH_HITS", 1, 0, 0), ("c1", "EXPECTED_NO_DATA", 0, 1, 0), ("root", "ANCESTOR_OF_REPRESENTED", 3, 1, 1),
    ]
    small = selection.coverage_tree(closed, [], here, none, none, compact=True)
    assert rows(small.filter("parent_taxon_id is not null"), "taxon_id", "parent_taxon_id") == [("A", "root"), ("a1", "A"), ("a2", "A"), ("b1", "root")]
    for broken in (tree.filter("taxon_id != 'A'"), tree.filter("taxon_id != 'root'"), tree.unionByName(tree), tree.withColumn("terminal_count", F.when(F.col("taxon_id") == "A", 9).otherwise(F.col("terminal_count")))):
        with pytest.raises(IntegrityError):
            selection.reconcile(broken)
    with pytest.raises(InputError):
        selection.coverage_tree(closed, [], here, none, taxa(spark, "c1"))
    with pytest.raises(InputError):
        selection.coverage_tree(closed, [], here, none, none, most=3)


def test_plan(spark):
    kind = ", ".join(f"{k} string" for k in KEY) + ", legacy_orthogroup_id string, member_count long, species_count long, mean_copies_per_species double, single_copy_species_count long"
    stat = lambda g, n, og="OG": (*G, g, og, n, n, 1.0, n)
    table = spark.createDataFrame([stat("t1", 4), stat("t2", 5), *[stat(f"c{i}", i) for i in range(1, 9)], stat("no", 4, "")], kind)
    made = plan.build_plan(table, [table.filter("group_id = 't1'"), table.filter("group_id in ('t1', 't2')")], 2)
    assert rows(made["targets"], "group_id") == [("t1",), ("t2",)]
    assert rows(made["links"], "anchor_group_id", "control_rank", "control_group_id", "control_member_count") == [("t1", 1, "c4", 4), ("t1", 2, "c5", 5), ("t2", 1, "c6", 6), ("t2", 2, "c7", 7)]
    assert rows(made["selected"].groupBy("membership_role").count(), "membership_role", "count") == [("CONTROL", 4), ("TARGET", 2)]
    with pytest.raises(InputError):
        plan.build_plan(table, [table], 2)
    with pytest.raises(InputError):
        plan.build_plan(table, [table], 0)
    with pytest.raises(IntegrityError, match="t1;t2"):
        plan.cluster_results(made["targets"].select(*KEY), table, table, table.filter("group_id = 'c1'"))
    names = spark.createDataFrame([(*G, "g", "OG", "A", "sp|P1|X_Y"), (*G, "g", "OG", "B", "P1")], ", ".join(f"{k} string" for k in KEY) + ", legacy_orthogroup_id string, species_label string, member_id string")
    seeds = spark.createDataFrame([("P1", "A")], "seed_id string, species_label string")
    assert rows(plan.select_by_alias(names, seeds), "matched_member_id", "match_authority") == [("sp|P1|X_Y", "UNIPROT_ACCESSION")]
    assert rows(plan.select_by_alias(names, seeds.select("seed_id")), "matched_member_id", "match_authority") == [("P1", "PROTEIN_ID"), ("sp|P1|X_Y", "UNIPROT_ACCESSION")]
