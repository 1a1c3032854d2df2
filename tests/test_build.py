"""A result directory becomes a resource that answers questions."""

import pytest
from pyspark.sql import functions as F

from kinfold import build, publish
from kinfold.errors import InputError, IntegrityError
from kinfold.operators import imports, search, trees

from .test_sources import result_dir  # noqa: F401


def test_build(spark, result_dir, tmp_path):  # noqa: F811
    out = str(tmp_path / "resource")
    assert build.run(spark, str(result_dir), out, "run") == "PUBLISHED"
    r = publish.open_resource(spark, out)
    pairs = {(p["member_a"], p["member_b"]): p["distance"] for p in r["pairwise_distances"].collect()}
    assert pairs == {("protA", "protA2"): pytest.approx(0.3), ("protA", "protB"): pytest.approx(0.5), ("protA2", "protB"): pytest.approx(0.6)}
    members = r["hog_memberships"].unionByName(r["legacy_orthogroup_memberships"])
    found = search.search_groups(r["group_statistics"], r["group_species_statistics"], members, r["distance_statistics"], search.GroupFilters(group_type="HOG", included_species=("Species_A", "Species_B"))).first()
    assert found["group_id"] == "N0.HOG0000001" and found["distance_pair_count"] == 3 and found["median_distance"] == pytest.approx(0.5)
    text = r["tree_payloads"].select(trees.decode_payload("newick_payload", "source_size_bytes", "source_sha256").alias("t")).first()["t"]
    assert text.startswith("((protA") and r["tree_nodes"].count() == 5 and r["tree_edges"].count() == 4


def test_distances_of_alignments(spark, result_dir, tmp_path):  # noqa: F811
    """AUTO takes alignments before trees, as what is asked for must be there."""
    found = build.relations(spark, str(result_dir), "run", source="AUTO")
    pairs = {(p["member_a"], p["member_b"]): (p["distance"], p["distance_method"]) for p in found["pairwise_distances"].collect()}
    assert pairs == {("protA", "protA2"): (0.25, "p_distance"), ("protA", "protB"): (1.0, "p_distance"), ("protA2", "protB"): (0.75, "p_distance")}
    stats = found["distance_statistics"].first()
    assert (stats["distance_pair_count"], stats["median_distance"], stats["mean_comparable_sites"], stats["computation_status"]) == (3, 0.75, 4.0, "EXACT")
    assert build.distance_source("AUTO", False, True) == "RESOLVED_GENE_TREE" and build.distance_source("AUTO", False, False) == build.distance_source("NONE", True, True) == "NONE"
    for asked in ("ALIGNED_SEQUENCE", "RESOLVED_GENE_TREE", "GUESS"):
        with pytest.raises(InputError):
            build.distance_source(asked, False, False)


def test_bundles_caches_and_payloads(spark, tmp_path):
    rows = spark.createDataFrame([("b", None, True), ("a", 1, False)], "k string, n int, t boolean")
    sums = publish.publish_bundle({"rows": rows}, str(tmp_path / "x"), {"run_id": "r"}, dry_run=True)
    assert not (tmp_path / "x").exists()
    assert publish.publish_bundle({"rows": rows}, str(tmp_path / "x"), {"run_id": "r"}) == sums
    assert (tmp_path / "x/rows.tsv").read_text() == "k\tn\tt\na\t1\tfalse\nb\t\ttrue\n" and sums["rows.tsv"] in (tmp_path / "x/checksums.sha256").read_text()
    with pytest.raises(InputError):
        publish.publish_bundle({"rows": rows}, str(tmp_path / "x"), {})
    assert publish.cached(rows, str(tmp_path), "a").count() == publish.cached(rows.limit(0), str(tmp_path), "a").count() == 2 and publish.cached(rows.limit(0), str(tmp_path), "b").count() == 0
    (tmp_path / "r.html").write_text('<html><script id="report-data" type="application/json">{"run_id": "r", "x": [1]}</script></html>')
    assert publish.report_payload(spark, str(tmp_path / "r.html"), "r").count() == 1
    for wrong in ("other", ""):
        with pytest.raises(InputError):
            publish.report_payload(spark, str(tmp_path / "r.html"), wrong)
    assert publish.safe_stem(" a/b: c?.tsv ") == "a_b_c_.tsv" and publish.safe_stem("///") == "export"


def test_imports_refuse_what_is_wrong(spark):
    f = spark.createDataFrame([("c", "a", "a", "MK"), ("c", "a", "b", "MKL")], "cluster_id string, centroid string, member_id string, sequence string")
    assert imports.import_clusters(f).first()["residue_count"] == 5
    own = f.select(F.col("member_id").alias("sequence_id"), "sequence")
    domain = own.select("sequence_id", F.md5(F.col("sequence").cast("binary")).alias("md5"), F.length("sequence").alias("length"), F.lit(1).alias("start"), F.length("sequence").alias("end"))
    assert imports.domain_rows(domain, own).count() == 2
    jobs = spark.createDataFrame([("a", "b"), ("b", "a")], "job string, source string")
    traits = spark.createDataFrame([("b", "m", "t", "1"), ("b", "m", "t", "2")], "job string, member_id string, trait string, value string")
    for wrong in (
        lambda: imports.import_clusters(f.filter("member_id != 'a'")),
        lambda: imports.import_clusters(f.unionByName(f)),
        lambda: imports.import_clusters(f, spark.createDataFrame([("c", 3)], "cluster_id string, member_count long")),
        lambda: imports.unique_sequences(f.unionByName(f)),
        lambda: imports.parent_map(spark.createDataFrame([("n", "p"), ("n", "q")], "node string, parent string")),
        lambda: imports.selected_sequences(f, spark.createDataFrame([("z",)], "member_id string")),
        lambda: imports.domain_rows(domain.withColumn("end", F.lit(9)), own),
        lambda: imports.domain_rows(domain.withColumn("md5", F.lit("x")), own),
        lambda: imports.domain_rows(domain.withColumn("sequence_id", F.lit("x")), own),
        lambda: imports.reference_first(f, "a", 1),
        lambda: imports.reference_first(f, "z", 5),
        lambda: imports.inherited_traits(jobs, traits, "a"),
        lambda: imports.inherited_traits(jobs.filter("job = 'a'"), traits, "a"),
        lambda: imports.source_table(spark, "x.docx"),
        lambda: imports.centroid_list(["a b"]),
        lambda: imports.row_groups("1,x"),
    ):
        with pytest.raises((InputError, IntegrityError)):
            wrong()
    assert imports.row_groups("[3, 1 1]") == (1, 3) and imports.centroid_list(["b", "a", "b"]) == ("b", "a")
