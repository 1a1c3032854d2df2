"""Kernels and operators on small inputs with values worked out by hand."""

import hashlib
import random
import statistics
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.errors import InputError, IntegrityError
from kinfold.functions import newick, stats, text
from kinfold.operators import benchmark, catalogue, distances, expression, geometry, memberships, motif, search, taxonomy, trees
from kinfold.plans import queries
from kinfold.schemas import KEY, conform, empty, struct

G = ("run", "HOG", "N0")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def members(spark):
    wide = spark.createDataFrame([("HOG1", "OG1", "c", "alpha_1, alpha_2", "beta_1", "", None), ("HOG2", "OG2", "c", "literal%member", "", "gamma_1", ""), ("HOG3", "OG3", "c", "a3", "b3", "c3", "")], "HOG string, OG string, `Gene Tree Parent Clade` string, A string, B string, C string, D string")
    return memberships.melt(wide, "run", "HOG", "N0", "N0.tsv")


@pytest.fixture(scope="module")
def resource(spark, members):
    d = spark.createDataFrame([(*G, "HOG1", "patristic", "EXACT", 3, 3, 3, 0.1, 0.02), (*G, "HOG3", "patristic", "EXACT", 3, 3, 3, 0.8, 0.4), (*G, "HOG1", "p", "EXACT", 3, 2, 0, None, None)], ", ".join(f"{k} string" for k in KEY) + ", distance_method string, computation_status string, total_member_count long, sampled_member_count long, distance_pair_count long, mean_distance double, population_stddev_distance double")
    return memberships.group_statistics(members), memberships.group_species_statistics(members), members, conform(d, "distance_statistics")


def test_melt_and_statistics(members, resource):
    assert rows(members.filter("group_id = 'HOG1'"), "species_label", "member_id") == [("A", "alpha_1"), ("A", "alpha_2"), ("B", "beta_1")]
    assert rows(resource[0], "group_id", "member_count", "species_count", "single_copy_species_count", "max_copies_per_species", "mean_copies_per_species", "is_singleton", "species_labels") == [("HOG1", 3, 2, 1, 2, 1.5, False, "A;B"), ("HOG2", 2, 2, 2, 1, 1.0, False, "A;C"), ("HOG3", 3, 3, 3, 1, 1.0, False, "A;B;C")]


def test_melt_rejects(spark):
    with pytest.raises(InputError):
        memberships.melt(spark.createDataFrame([("x",)], "A string"), "run", "HOG", "N0", "f")
    with pytest.raises(InputError):
        memberships.melt(spark.createDataFrame([("x", "y", "z")], "HOG string, hog2 string, `HOG ` string"), "run", "HOG", "N0", "f")


def test_contradicting_metadata(members):
    memberships.check_consistent(members)
    with pytest.raises(IntegrityError):
        memberships.check_consistent(members.unionByName(members.limit(1).withColumn("legacy_orthogroup_id", F.lit("other"))))


@pytest.mark.parametrize(("filters", "want"), [
    ({"member_id_contains": "alpha_2"}, ["HOG1"]), ({"member_id_contains": "%"}, ["HOG2"]), ({"group_id_contains": "HOG_"}, []),
    ({"members": (3, 3), "species": (2, 2)}, ["HOG1"]), ({"included_species": ("A", "B"), "include_mode": "ANY"}, ["HOG1", "HOG2", "HOG3"]),
    ({"included_species": ("A", "B")}, ["HOG1", "HOG3"]), ({"included_species": ("A", "B"), "include_mode": "EXACT_SET"}, ["HOG1"]), ({"included_species": ("A",), "include_mode": "ANY", "excluded_species": ("B",)}, ["HOG2"]),
    ({"distance_availability": "CALCULATED"}, ["HOG1", "HOG3"]), ({"distance_availability": "NOT_CALCULATED"}, ["HOG2"]), ({"maximum_mean_distance": 0.2}, ["HOG1"]), ({"maximum_distance_sd": 0.1}, ["HOG1"]),
])
def test_search(resource, filters, want):
    assert [r["group_id"] for r in search.search_groups(*resource, search.GroupFilters(**filters)).orderBy("group_id").collect()] == want


def test_orders_and_pages(resource):
    found = search.search_groups(*resource, search.GroupFilters())
    order = lambda o, *a: [r["group_id"] for r in search.page(found, o, *a).collect()]
    assert order("MEAN_DISTANCE_ASC") == ["HOG1", "HOG3", "HOG2"]
    assert order("MEAN_DISTANCE_DESC") == ["HOG3", "HOG1", "HOG2"]
    assert order("DISTANCE_SD_ASC") == ["HOG1", "HOG3", "HOG2"]
    assert order("SPECIES_COUNT_DESC") == ["HOG3", "HOG1", "HOG2"]
    assert order("GROUP_ID_ASC", 3, 2) == []
    with pytest.raises(InputError):
        search.GroupFilters(sort="?")


def test_protein_search(spark, resource):
    m = resource[2].withColumn("member_id", F.when(F.col("member_id") == "b3", "sp|P1|E_1").otherwise(F.col("member_id")))
    seq = m.select("run_id", "member_id", "species_label", F.concat(F.lit("i_"), "member_id").alias("internal_id"))
    one = lambda q, exact=True: rows(search.search_proteins(m, seq, resource[0], resource[3], q, exact), "group_id", "match_source", "matched_identifier")
    assert one("P1") == [("HOG3", "UNIPROT_ACCESSION", "P1")]
    assert one("E_1") == [("HOG3", "UNIPROT_ENTRY", "E_1")]
    assert one("i_a3") == [("HOG3", "INTERNAL_ID", "i_a3")]
    assert one("LITERAL%", False)[0][0] == "HOG2"


def test_site_difference(spark):
    df = spark.createDataFrame([("AA-X", "ATGX"), ("--", "XX"), ("", "")], "a string, b string").select(distances.site_difference(F.col("a"), F.col("b")).alias("x")).select("x.*")
    assert [tuple(r) for r in df.collect()] == [(2, 1, 0.5), (0, 0, None), (0, 0, None)]


def test_sampling_is_stable(spark):
    m = spark.createDataFrame([(*G, "g", x, x == "d") for x in "abcdef"], ", ".join(f"{k} string" for k in KEY) + ", member_id string, need boolean")
    two = lambda df: rows(distances.member_sample(df, 2, required="need"), "member_id", "computation_status")
    assert two(m) == two(m.orderBy(F.col("member_id").desc()))
    assert "d" in [x for x, _ in two(m)] and {s for _, s in two(m)} == {"DETERMINISTIC_MEMBER_SAMPLE"}


def test_alignment_distances(spark):
    m = spark.createDataFrame([(*G, "g", "protA", "AAAA"), (*G, "g", "protA2", "AATA"), (*G, "g", "protB", "TTTT")], ", ".join(f"{k} string" for k in KEY) + ", member_id string, sequence string")
    assert rows(distances.alignment_distances(m), "member_a", "member_b", "distance") == [("protA", "protA2", 0.25), ("protA", "protB", 1.0), ("protA2", "protB", 0.75)]
    assert distances.alignment_distances(m, 2).count() == 1


def test_newick():
    t = newick.parse("((a:0.1,'b c':0.2)0.9:0.3,c:0.4)root;")
    assert [r["node_name"] for r in newick.node_rows(t, "t")] == ["root", "", "a", "b c", "c"]
    assert t.support[1] == 0.9 and t.leaf_counts()[0] == 3
    p = newick.Paths(t)
    assert p.distance("a", "c") == pytest.approx(0.8) and p.distance("b c", "c") == pytest.approx(0.9) and p.distance("a", "b c") == pytest.approx(0.3)
    deep = newick.parse("(" * 3000 + "a:1" + ",b:1)" + ")" * 2999 + ";")
    assert newick.Paths(deep).distance("a", "b") == 2
    for bad in ("", "(a,b", "(a,b));", "(a,b);c", "(a:x,b);"):
        with pytest.raises(InputError):
            newick.parse(bad)
    with pytest.raises(InputError):
        newick.Paths(newick.parse("(a:-1,b:1);"))
    with pytest.raises(InputError):
        newick.resolve_leaves(p, ["a", "zz"])
    payload = newick.encode("(a,b);")
    assert newick.decode(*payload) == "(a,b);"
    with pytest.raises(InputError):
        newick.decode(payload[0], payload[1] + 1, payload[2])
    assert newick.write({"r": ["a", "b c"]}, "r") == "(a,'b c')r;"
    assert newick.partitions(newick.parse("((a,b)x,c)y;"), {"a": "1", "b": "1", "c": "2"}) == [(1, "1"), (4, "2")]
    plot = {r["name"]: r for r in newick.phylogram(t, {"a", "c"})}
    assert plot["a"]["x"] == pytest.approx(0.4) and plot["root"]["y"] == 0.5 and len(plot) == 3


def test_pairs_of_leaves_come_in_blocks():
    rng, parts = random.Random(3), [f"m{k}" for k in range(60)]
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [f"({','.join(f'{x}:{rng.random():.3f}' for x in parts[k : k + 2])})"]
    paths, names = newick.Paths(newick.parse(parts[0] + ";")), [f"m{k}" for k in rng.sample(range(60), 41)]
    blocks = list(paths.pairs(names, 100))
    found = {(int(a), int(b)): d for block in blocks for a, b, d in zip(*block, strict=True)}
    assert max(len(b[0]) for b in blocks) <= 100 and found == {(a, b): paths.distance(names[a], names[b]) for a in range(41) for b in range(a + 1, 41)}
    members = [{"member_id": f"m{k}", "aliases": None} for k in range(250)]
    tree = "(" + ",".join(f"m{k}:1" for k in range(250)) + ");"
    groups = pa.Table.from_pylist([{**dict(zip(KEY, G, strict=False)), "group_id": f"g{k}", "members": members, "newick": tree} for k in range(20)])
    sizes = [x.num_rows for x in trees.group_pairs(iter(groups.to_batches()))]
    assert sum(sizes) == 20 * 250 * 249 // 2 and max(sizes) <= trees.ROWS + newick.MOST_CELLS


def test_phylogram_of_a_long_chain():
    import time

    n, began = 30_000, time.monotonic()
    tree = newick.parse("(" * n + "a:1" + "".join(f",b{k}:1):1" for k in range(n)) + ";")
    plot = newick.phylogram(tree, {"a", "b0", "b5", f"b{n - 1}"})
    assert time.monotonic() - began < 20  # steps grew with the square of the nodes
    assert [(x["name"], x["y"]) for x in plot if x["is_leaf"]] == [("a", 0.0), ("b0", 1.0), ("b5", 2.0), (f"b{n - 1}", 3.0)]
    assert [x["parent"] for x in plot if not x["is_leaf"]] == [-1, 0, n - 6] and plot[-1]["x"] == 1 and len(plot) == 7


def test_phylograms_of_trees_that_share_leaf_names(spark):
    t = spark.createDataFrame([(f"t{k}", "((a:1,b:2):1,(c:1,d:1):2);" if k % 2 else "(a:1,(d:1,e:3):1);") for k in range(200)], "tree_id string, newick string")
    keep = spark.createDataFrame([("a",), ("d",)], "leaf string")
    found = trees.phylograms(t, keep)
    assert rows(found.filter("is_leaf").groupBy("name", "x", "y").count(), "name", "x", "y", "count") == [("a", 1.0, 0.0, 100), ("a", 2.0, 0.0, 100), ("d", 2.0, 1.0, 100), ("d", 3.0, 1.0, 100)]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()  # four names: not dealt out by name


def test_nodes_of_many_trees_are_one_batch(spark):
    texts = ["((a:0.1,'b c':0.2)0.9:0.3,c:0.4)root;", "(x,y:1);"]
    held = [({"run_id": "r", "tree_type": "T", "tree_id": f"t{k}"}, newick.parse(x)) for k, x in enumerate(texts)]
    assert trees._node_batch(held).column("parent_node_name").to_pylist() == [None, "root", "", "", "root", None, "", ""]
    t = spark.createDataFrame([("r", "T", f"t{k}", x) for k, x in enumerate(texts)], "run_id string, tree_type string, tree_id string, newick string").coalesce(1)
    found = trees.tree_nodes(t)
    want = [x for k, text in enumerate(texts) for x in newick.node_rows(newick.parse(text), f"t{k}")]
    assert [{c: r[c] for c in want[0]} for r in found.collect()] == want


def test_edges_name_both_ends(spark):
    t = spark.createDataFrame([("r", "T", "t", "((a:0.1,a:0.2)n:0.3,c:0.4)root;")], "run_id string, tree_type string, tree_id string, newick string")
    edges = trees.tree_edges(trees.tree_nodes(t))
    assert rows(edges, "parent_node_name", "child_node_name", "branch_length") == [("n", "a", 0.1), ("n", "a", 0.2), ("root", "c", 0.4), ("root", "n", 0.3)]
    assert "Join" not in edges._jdf.queryExecution().toString()


def test_patristic_tables(spark):
    g = spark.createDataFrame([(*G, "N0.HOG1", "OG1", [("protA", {}), ("protB", {"x_B": "SPECIES_PREFIXED"})]), (*G, "N0.HOG2", "", [("zz", {})])], ", ".join(f"{k} string" for k in KEY) + ", legacy_orthogroup_id string, members array<struct<member_id: string, aliases: map<string, string>>>")
    t = spark.createDataFrame([("OG1", "((protA:0.1,q:0.2):0.1,x_B:0.3);")], "tree_id string, newick string")
    pairs, failed = trees.patristic_distances(g, t)
    assert rows(pairs, "group_id", "distance") == [("N0.HOG1", pytest.approx(0.5))]
    assert rows(failed, "group_id", "failure_reason") == [("N0.HOG2", "no tree")]
    nodes = trees.tree_nodes(t.select(F.lit("run").alias("run_id"), F.lit("GENE_TREE").alias("tree_type"), "tree_id", "newick"))
    assert nodes.count() == 5 and trees.tree_edges(nodes).count() == 4


def test_statistics_kernels(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "i int, p double")
    assert [r["q"] for r in stats.benjamini_hochberg(df, "p", ["i"], out="q").orderBy("i").collect()] == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None]
    sample = [("a", v, True) for v in (4.0, 5.0, 6.0)] + [("a", v, False) for v in (1.0, 2.0, 3.0)] + [("b", v, True) for v in (1.0, 1.0, 2.0)] + [("b", v, False) for v in (1.0, 2.0, 2.0)] + [("c", 1.0, x) for x in (True, False, True)]
    got = {r["g"]: r for r in stats.mann_whitney(spark.createDataFrame(sample, "g string, v double, t boolean"), "v", "t", ["g"]).collect()}
    assert (got["a"]["mann_whitney_u"], got["a"]["cliffs_delta"], got["a"]["p_value_two_sided"]) == (9, 1, pytest.approx(0.0808555983700523))
    assert (got["b"]["mann_whitney_u"], got["b"]["cliffs_delta"], got["b"]["p_value_two_sided"]) == (3, pytest.approx(-1 / 3), pytest.approx(0.6192567541768621))
    assert (got["c"]["cliffs_delta"], got["c"]["p_value_two_sided"]) == (0, 1)
    f = stats.fisher_greater(spark.createDataFrame([(2, 0), (1, 1), (0, 2)], "h int, m int"), "h", "m", 2, 2).collect()
    assert [r["fisher_p_value"] for r in f] == [pytest.approx(1 / 6), pytest.approx(5 / 6), pytest.approx(1)]
    assert f[0]["odds_ratio"] == float("inf") and f[2]["odds_ratio"] == 0
    a, b = [stats.bootstrap_median_difference([1.0, 2.0, 3.0], [1.0, 5.0], 50, ["x"]) for _ in range(2)]
    assert a == b and a[0] <= a[1]


def test_taxonomy(spark, resource):
    cats = spark.createDataFrame([("A", "TARGET"), ("B", "TARGET"), ("C", "OUTSIDE")], "species_label string, category string")
    c = taxonomy.composition(resource[0], resource[1], cats, 2)
    assert rows(taxonomy.search_composition(c, "SAMPLED_EXCLUSIVE"), "group_id") == [("HOG1",)]
    assert taxonomy.search_composition(c, "NEAR_EXCLUSIVE", most_outside=1).count() == 3
    edges = spark.createDataFrame([("A", "10"), ("B", "10"), ("C", "20"), ("10", "1"), ("20", "1"), ("1", None)], "child string, parent string")
    closed = taxonomy.closure(edges)
    assert rows(closed.filter("ancestor = '1'"), "descendant", "depth") == [("1", 0), ("10", 1), ("20", 1), ("A", 2), ("B", 2), ("C", 2)]
    present = spark.createDataFrame([(*G, "g1", "A"), (*G, "g1", "B"), (*G, "g2", "A"), (*G, "g2", None), (*G, "g3", "C")], ", ".join(f"{k} string" for k in KEY) + ", taxon_id string")
    passing = lambda *s: [r["group_id"] for r in taxonomy.select_groups(present, closed, [taxonomy.Selector(*x) for x in s]).filter("passes").orderBy("group_id").collect()]
    assert passing(("REQUIRED_EXACT", "A")) == ["g1", "g2"]
    assert passing(("ONLY_IN_CLADE", "10")) == ["g1"]  # an unmapped member proves nothing
    assert passing(("EXCLUDE_CLADE", "10")) == ["g3"]
    assert passing(("INCLUDE_CLADE", "10"), ("EXCLUDE_EXACT", "B")) == ["g2"]
    with pytest.raises(InputError):
        taxonomy.check_selection([taxonomy.Selector("REQUIRED_EXACT", "A"), taxonomy.Selector("EXCLUDE_CLADE", "10")], closed)
    with pytest.raises(IntegrityError):
        taxonomy.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), 16)


def test_motif(spark, resource):
    seq = spark.createDataFrame([("A", "alpha_1", "MAAN*"), ("A", "alpha_2", "MQQN"), ("B", "beta_1", "MTTN")], "species_label string, member_id string, sequence string")
    found = motif.group_summary(motif.group_members(resource[2], seq, "N"), least_species=2, threshold=0.8)
    assert rows(found, "group_id", "matching_fraction", "represented_species") == [("HOG1", 1.0, "A; B")]
    assert motif.checked("N.{2}", "C_TERMINAL_REGEX") == "(?:N.{2})$" and motif.checked("N$", "C_TERMINAL_REGEX") == "N$"
    for bad in ("", "NX1", "N-", "A" * 101):
        with pytest.raises(InputError):
            motif.checked(bad, "SUFFIX")
    with pytest.raises(InputError):
        motif.checked("(?=N)", "REGEX")


def test_expression(spark):
    atlas = spark.createDataFrame([("A", "AT1", "GENEA", "e", u, c, v) for u, c, v in (("TPM", "leaf", 3.0), ("TPM", "root", 0.1), ("FPKM", "leaf", 30.0))] + [("A", f"AT{i}", "SHARED", "e", "TPM", "seedling", 1.0) for i in (2, 3)], "species_column string, gene_id string, gene_name string, experiment_accession string, expression_unit string, sample_or_condition string, expression_value double")
    seq = spark.createDataFrame([("run", "A", "sp|P1|X", "sp|P1|X d GN=GENEA"), ("run", "A", "two", "two GN=SHARED"), ("run", "B", "three", "three")], "run_id string, species_label string, member_id string, raw_header string")
    mapping = expression.map_members(seq, expression.aliases(seq), atlas)
    assert rows(mapping, "member_id", "mapping_status") == [("sp|P1|X", "MAPPED_UNIQUE"), ("two", "AMBIGUOUS")]
    meta = spark.createDataFrame([("A", "e", "leaf", "leaf", "", "")], "species_column string, experiment_accession string, sample_or_condition string, organism_part string, condition string, atlas_group_label string")
    context = expression.contexts(mapping, atlas, meta)
    assert rows(context, "expression_context", "metadata_status") == [("leaf", "MAPPED_WITH_TISSUE"), ("root", "METADATA_NOT_MAPPED")]
    got = {r["member_id"]: r for r in expression.member_summary(mapping, context).collect()}
    assert got["sp|P1|X"]["positive_context_count"] == 1 and got["sp|P1|X"]["broad_expression_supported"] and got["two"]["context_count"] is None
    with pytest.raises(InputError):
        expression.check_atlas(atlas.withColumn("expression_value", F.lit(-1.0)))


def test_catalogue(spark):
    smap = spark.createDataFrame([("P1", "A"), ("multi", "A"), ("multi", "B"), ("small", "Z")], "sequence_id string, cluster_id string")
    index = catalogue.clusters(spark.createDataFrame([("A", "3", "0", "0,1"), ("B", "2", "x", "1")], "CLUSTER string, NMEMBER string, RowStart string, RowGroup string"))
    ids = spark.createDataFrame([("sp|P1|X",), ("multi",), ("missing",), ("small",)], "input_id string")
    got = rows(catalogue.resolve(ids, smap, index).select("input_id", "mapping_status").distinct(), "input_id", "mapping_status")
    assert got == [("missing", "UNMATCHED"), ("multi", "MULTIPLE_GLOBAL_CLUSTERS"), ("small", "MAPPED_WITHOUT_ROW_GROUP_INDEX"), ("sp|P1|X", "EXPLICIT_ALIAS")]
    mem = spark.createDataFrame([("a", x) for x in "abcde"], "representative_id string, sequence_id string")
    kind = "qseqid string, sseqid string, pident double, length double, nident double, qstart double, qend double, qlen double, sstart double, send double, slen double, evalue double, bitscore double"
    al = spark.createDataFrame([("a", "b", 0.0, 100.0, 90.0, 1.0, 90.0, 100.0, 1.0, 90.0, 100.0, 1e-20, 90.0), ("a", "c", 0.0, 100.0, 90.0, 1.0, 90.0, 100.0, 1.0, 45.0, 100.0, 1e-20, 90.0), ("a", "d", 0.0, 100.0, 90.0, 0.0, 90.0, 100.0, 1.0, 90.0, 100.0, 1e-20, 90.0)], kind)
    audit = catalogue.audit_subclusters(mem, al)
    assert rows(audit, "sequence_id", "alignment_status") == [("a", "CENTROID_SELF"), ("b", "EXACT_THRESHOLDS_PASS"), ("c", "EXACT_THRESHOLDS_FAIL"), ("d", "INVALID_REALIGNMENT"), ("e", "NO_REALIGNMENT")]
    assert sorted(r["member_count"] for r in catalogue.subclusters(audit).collect()) == [1, 1, 1, 2]
    with pytest.raises(IntegrityError):
        catalogue.audit_subclusters(mem.filter("sequence_id != 'a'"), al)
    aligned = spark.createDataFrame([("ref", "AC-X"), ("member", "ADDX")], "sequence_id string, sequence string")
    columns = catalogue.alignment_columns(aligned, "ref").orderBy("alignment_column").collect()
    assert columns[2]["gap_fraction"] == 0.5 and columns[2]["reference_position"] is None and columns[3]["consensus_residue"] is None and columns[1]["shannon_entropy_bits"] == 1
    m = {r["sequence_id"]: r for r in catalogue.alignment_members(aligned, "ref", {("A", "A"): 4.0, ("C", "D"): -3.0}).collect()}["member"]
    assert (m["comparable_residue_count"], m["identity_to_reference_fraction"], m["reference_overlap_fraction"], m["score_sum"]) == (2, 0.5, 1.0, 1.0)


def test_benchmark(spark):
    stat = lambda g, n: (*G, g, n, n, 1.0, n)
    kind = ", ".join(f"{k} string" for k in KEY) + ", member_count long, species_count long, mean_copies_per_species double, single_copy_species_count long"
    anchors, pool = spark.createDataFrame([stat("t1", 4), stat("t2", 5)], kind), spark.createDataFrame([stat(f"c{i}", i) for i in range(2, 9)], kind)
    links = benchmark.match_controls(anchors, pool, 2)
    assert rows(links, "anchor_group_id", "control_rank", "control_group_id") == [("t1", 1, "c4"), ("t1", 2, "c5"), ("t2", 1, "c6"), ("t2", 2, "c7")]
    with pytest.raises(Exception, match="too few controls"):
        benchmark.match_controls(anchors, pool.limit(2), 2).collect()
    values = spark.createDataFrame([("t", "m", 2.0), ("a", "m", 1.0), ("b", "m", 2.0), ("c", "m", 3.0)], "group_id string, metric string, value double")
    own = spark.createDataFrame([("t", x) for x in "abc"], "anchor_id string, control_id string")
    assert rows(benchmark.classify(values, own), "control_median", "percentile", "dispersion_class") == [(2.0, 0.5, "TYPICAL")]
    assert rows(benchmark.residuals(values, own), "group_id", "residual") == [("t", 0.0)]
    one = benchmark.compare(values.filter("group_id = 'b'"), values, ["metric"]).first()  # itself left out: 1, 2, 3
    assert (one["background_group_count"], one["empirical_percentile"], one["lower_tail_p_value"], one["upper_tail_p_value"], one["leave_one_out"]) == (3, 0.5, 0.75, 0.75, True)
    names = spark.createDataFrame([("E3_ALL",), ("HOUSEKEEPING_ALL",), ("E3_CATEGORY::x",)], "profile_id string")
    assert rows(benchmark.plan_contrasts(names), "target_profile_id", "reference_profile_id") == [("E3_ALL", "HOUSEKEEPING_ALL"), ("E3_CATEGORY::x", "E3_OTHER"), ("E3_CATEGORY::x", "HOUSEKEEPING_ALL")]
    of = spark.createDataFrame([(p, g, "m", float(v)) for p, g, v in (("E3_ALL", "a", 1), ("E3_ALL", "b", 2), ("E3_ALL", "c", 3), ("E3_CATEGORY::x", "a", 1))], "profile_id string, group_id string, metric string, value double")
    sides = benchmark.contrast_sides(of, spark.createDataFrame([("E3_CATEGORY::x", "E3_OTHER")], "target_profile_id string, reference_profile_id string"))
    assert rows(sides, "group_id", "is_target") == [("a", True), ("b", False), ("c", False)]


def brute_bootstrap(target, reference, resamples, label):
    own = random.Random(int.from_bytes(hashlib.sha256("\x1f".join(label).encode()).digest()[:8], "big"))
    found = sorted(statistics.median([target[own.randrange(len(target))] for _ in target]) - statistics.median([reference[own.randrange(len(reference))] for _ in reference]) for _ in range(resamples))
    return stats.quantile(found, 0.025), stats.quantile(found, 0.975)


@pytest.mark.parametrize("n, m", [(1, 1), (3, 8), (64, 65), (700, 1001)])
def test_bootstrap_draws(n, m):
    rng = random.Random(n)
    t, r = [rng.gauss(0, 1) for _ in range(n)], [rng.gauss(1, 2) for _ in range(m)]
    assert stats.bootstrap_median_difference(t, r, 120, ["a", "b"]) == brute_bootstrap(t, r, 120, ["a", "b"])


def test_contrasts_are_of_all_groups(spark, sf_dir):
    sides, groups = defaultdict(list), queries._values(queries.Bridge(spark, sf_dir)).collect()
    for x in sorted(groups, key=lambda x: x["group_id"]):
        sides[x["profile_id"], x["metric"]].append(x["value"])
    found = queries.QUERIES["profile_contrasts"](spark, sf_dir).collect()
    assert len(found) == 50
    for k, x in enumerate(found):
        t, r = sides[x["target_profile_id"], x["metric"]], sides[x["reference_profile_id"], x["metric"]]
        assert (x["target_group_count"], x["reference_group_count"], x["status"]) == (len(t), len(r), "TESTED")
        assert x["median_difference"] == pytest.approx(statistics.median(t) - statistics.median(r))
        assert x["mann_whitney_u"] == sum((a > b) + 0.5 * (a == b) for a in t for b in r)
        assert x["cliffs_delta"] == pytest.approx(2 * x["mann_whitney_u"] / (len(t) * len(r)) - 1)
        if k % 20 == 0:
            low, high = brute_bootstrap(t, r, 2000, [x["target_profile_id"], x["reference_profile_id"], x["metric"]])
            assert (x["median_difference_ci_low"], x["median_difference_ci_high"]) == (low, high)


def test_geometry(spark):
    d = np.array([[0, 3, 4], [3, 0, 5], [4, 5, 0]], float)
    points, shares, lost = geometry.ordinate(d)
    assert geometry.fit(d, points)[0] < 1e-9 and sum(shares) == pytest.approx(1) and lost < 1e-9
    with pytest.raises(InputError):
        geometry.matrix(pd.DataFrame({"member_a": ["a", "a"], "member_b": ["b", "c"], "distance": [1.0, 2.0]}))
    pairs = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "c", "d", 1.0), ("g", "a", "c", 9.0), ("g", "a", "d", 9.5), ("g", "b", "c", 9.6), ("g", "b", "d", 9.7)], "group_id string, member_a string, member_b string, distance double")
    assert rows(geometry.connected_network(pairs, 1, ("group_id",)), "member_a", "member_b", "edge_type") == [("a", "b", "NEAREST_NEIGHBOUR"), ("a", "c", "COMPONENT_CONNECTOR"), ("c", "d", "NEAREST_NEIGHBOUR")]
    assert geometry.pcoa(pairs, ("group_id",)).count() == 4


def test_dispersion(spark):
    pairs = spark.createDataFrame([("g", "alpha_1", "alpha_2", 0.1), ("g", "alpha_1", "beta_1", 0.2), ("g", "alpha_2", "beta_1", 0.3)], "group_id string, member_a string, member_b string, distance double")
    assert rows(distances.member_dispersion(pairs, ("group_id",)).filter("is_medoid"), "member", "nearest_member") == [("alpha_1", "alpha_2")]
    species = spark.createDataFrame([("alpha_1", "A"), ("alpha_2", "A"), ("beta_1", "B")], "member_id string, species_label string")
    by = {(r["species_1"], r["species_2"]): r for r in distances.species_dispersion(distances.class_pairs(pairs, species)).collect()}
    assert by["A", "B"]["pair_count"] == 2 and by["A", "B"]["mean_distance"] == pytest.approx(0.25)
    assert [r["other_member"] for r in distances.focused(pairs, "alpha_1").collect()] == ["alpha_2", "beta_1"]


def test_schema(spark):
    assert empty(spark, "tree_nodes").count() == 0 and struct("clusters").fieldNames() == ["cluster_id", "member_count", "row_start", "row_groups"]
    one = conform(spark.createDataFrame([("c", "", "7")], "cluster_id string, member_count string, row_start string"), "clusters").first()
    assert tuple(one) == ("c", None, 7, None)


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.species_label(F.lit("Species_B.FAA.gz"))) == "Species_B"
    assert one(text.tree_id_of(F.lit("N0.HOG0000012"))) == "OG0000012"
    assert one(text.categories(F.lit(" a; b,"))) == ["a", "b"] and one(text.categories(F.lit(None).cast("string"))) == ["UNCLASSIFIED"]
    assert one(text.strip(F.lit("\t x \n"))) == "x"
