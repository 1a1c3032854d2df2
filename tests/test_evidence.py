"""Row groups, dumps, structures, lineage graphs, quality gates and versions: what they refuse, and what they give."""

import json

import pytest
from pyspark.sql import functions as F

from kinfold import publish
from kinfold.errors import InputError, IntegrityError
from kinfold.operators import expression, lineage_graph, memberships
from kinfold.plans import queries
from kinfold.plans.bridge import Bridge
from kinfold.quality import quality
from kinfold.schemas import KEY
from kinfold.sources import fasta, results, rowgroups, structures, taxdump

from .test_sources import result_dir  # noqa: F401


def test_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids = list(range(100))
    table = pa.table({"cluster": [f"c{k % 4}" if k >= 40 else "a" for k in ids], "member": ids, "sequence": ["MK"] * 100})
    pq.write_table(table, tmp_path / "x.parquet", row_group_size=20)
    path = str(tmp_path / "x.parquet")
    assert [r["member"] for r in rowgroups.read_groups(spark, path, (1, 3)).orderBy("member").collect()] == [*range(20, 40), *range(60, 80)]
    pushed = rowgroups.read_groups(spark, path, (0, 2)).filter("cluster = 'a'")
    assert pushed.count() == 20 and {r[0] for r in pushed.select("_row_group").distinct().collect()} == {0}
    index = rowgroups.index_groups(spark, path, "cluster")
    assert {r["cluster_id"]: (r["member_count"], r["row_groups"]) for r in index.collect()}["a"] == (40, "0,1")
    found = rowgroups.extract_indexed(spark, path, index, ("a",), "cluster", "member")
    assert found.count() == 40 and {r[0] for r in found.select("_row_group").distinct().collect()} == {0, 1}
    wrong = index.withColumn("member_count", F.col("member_count") + 1)
    for asked, refused in ((("nope",), InputError), ((), InputError)):
        with pytest.raises(refused):
            rowgroups.extract_indexed(spark, path, index, asked, "cluster", "member")
    for bad in (wrong, index.withColumn("row_groups", F.lit("0"))):
        with pytest.raises(IntegrityError):
            rowgroups.extract_indexed(spark, path, bad, ("a",), "cluster", "member")
    with pytest.raises(Exception, match="row groups"):
        rowgroups.read_groups(spark, path, (9,)).count()


def test_dump(spark, tmp_path):
    (tmp_path / "names.dmp").write_text("".join(f"{i}\t|\t{n}\t|\t\t|\t{c}\t|\n" for i, n, c in ((1, "root", "scientific name"), (2, "Plants", "scientific name"), (3, "Arabis  alpina", "scientific name"), (4, "Rosa alba", "scientific name"), (4, "white rose", "common name"), (5, "Rosa rosa", "scientific name"), (5, "White Rose", "synonym"))))
    (tmp_path / "nodes.dmp").write_text("".join(f"{i}\t|\t{p}\t|\t{r}\t|\n" for i, p, r in ((1, 1, "no rank"), (2, 1, "kingdom"), (3, 2, "species"), (4, 2, "species"), (5, 4, "variety"))))
    names, nodes = taxdump.names(spark, str(tmp_path / "names.dmp")), taxdump.nodes(spark, str(tmp_path / "nodes.dmp"))
    labels = spark.createDataFrame([("arabis_Alpina",), ("white_rose",), ("nothing",), ("Rosa rosa",)], "species_label string")
    found = {r["species_label"]: r for r in taxdump.candidates(labels, names, nodes, "2024-01-01", "v").collect()}
    one = found["Rosa rosa"]
    assert (one["mapping_status"], one["taxon_id"], one["lineage_taxon_ids"], one["lineage_names"], one["lineage_ranks"]) == ("PENDING_REVIEW", 5, "1;2;4", "root;Plants;Rosa alba", "no rank;kingdom;species")
    assert found["arabis_Alpina"]["taxon_id"] == 3 and found["nothing"]["mapping_status"] == "UNMAPPED" and found["nothing"]["lineage_taxon_ids"] is None
    assert (found["white_rose"]["mapping_status"], found["white_rose"]["candidate_taxon_ids"], found["white_rose"]["taxon_id"]) == ("AMBIGUOUS", "4;5", None)
    loop = spark.createDataFrame([(3, 4), (4, 5), (5, 3)], "taxon_id long, parent_taxon_id long").withColumn("rank", F.lit("x"))
    for bad in (lambda: taxdump.lineages(spark.createDataFrame([(3,)], "taxon_id long"), loop), lambda: taxdump.candidates(labels, names.filter("taxon_id != 2"), nodes, "2024-01-01", "v"), lambda: taxdump.candidates(labels, names, nodes, "1 May", "v"), lambda: taxdump.candidates(labels.union(labels), names, nodes, "2024-01-01", "v")):
        with pytest.raises((InputError, IntegrityError)):
            bad()
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tx\t|\n1\t|\t1\t|\ty\t|\n")
    with pytest.raises(IntegrityError):
        taxdump.nodes(spark, str(tmp_path / "nodes.dmp"))


def atom(serial, name, alt, residue, chain, number, x, occupancy=1.0, b=50.0, record="ATOM"):
    return f"{record:<6}{serial:>5} {name:^4}{alt}{residue} {chain}{number:>4}    {x:8.3f}{1.0:8.3f}{2.0:8.3f}{occupancy:6.2f}{b:6.2f}"


def test_structures(spark, tmp_path):
    good = "\n".join(["HEADER", atom(1, "N", " ", "MET", "A", 1, 0), atom(2, "CA", " ", "MET", "A", 1, 1), atom(3, "CA", "A", "GLY", "A", 2, 5, 0.4), atom(4, "CA", "B", "GLY", "A", 2, 6, 0.6), atom(5, "CA", " ", "TRP", "B", 1, 7), "ENDMDL", atom(6, "CA", " ", "LYS", "A", 1, 9)])
    for name, text in (("m1", good), ("m2", good), ("m3", good.replace(" 50.00", "150.00")), ("m4", good.replace("   1.000   1.000   2.000", "     inf   1.000   2.000")), ("m5", good.replace("ATOM  ", "HETATM"))):
        (tmp_path / f"{name}.pdb").write_text(text)
    models = structures.read_models(spark, str(tmp_path))
    rows = structures.residues(models.filter("model_id = 'm1'")).orderBy("residue_index").collect()
    assert [(r["residue_index"], r["chain_id"], r["pdb_residue_number"], r["residue"], r["x"]) for r in rows] == [(1, "A", 1, "M", 1.0), (2, "A", 2, "G", 6.0), (3, "B", 1, "W", 7.0)]
    expected = spark.createDataFrame([(m, "MGK" if m == "m2" else "MGW") for m in ("m1", "m2", "m3", "m4", "m5", "m6")], "model_id string, sequence string")
    assert {r["model_id"]: r["status"] for r in structures.judge(models, expected).collect()} == {"m1": "VALID", "m2": "SEQUENCE_DIFFERS", "m3": "CONFIDENCE_OUT_OF_RANGE", "m4": "PLACE_NOT_FINITE", "m5": "NO_ATOMS", "m6": "NO_MODEL"}
    assert structures.evidence(models, expected.filter("model_id = 'm1'")).count() == 3
    with pytest.raises(IntegrityError, match="m2"):
        structures.evidence(models, expected.filter("model_id <= 'm2'"))


def test_residue_numbers_beyond_four_digits(spark):
    known = {0: "   0", 9999: "9999", 10_000: "A000", 10_001: "A001", 1_223_055: "ZZZZ", 1_223_056: "a000", 2_436_111: "zzzz"}
    both = spark.createDataFrame(list(known.items()), "n int, t string").select("n", "t", structures.hybrid36(F.col("n"), 4).alias("h"), structures.from_hybrid36(F.trim("t"), 4).alias("back"))
    assert all(r["h"] == r["t"] and r["back"] == r["n"] for r in both.collect())
    odd = spark.createDataFrame([("-12",), ("A0b1",), ("x",), ("",)], "t string").select(structures.from_hybrid36(F.col("t"), 4).alias("n"))
    assert [r["n"] for r in odd.collect()] == [-12, None, None, None]


@pytest.mark.parametrize("name", ["structure_residues", "structure_states"])
def test_models_of_more_than_9999_residues(spark, tmp_path, name):
    import duckdb

    brands = ["Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15"]
    kind = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    parts = spark.range(52_000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.get(F.array(*map(F.lit, brands)), (F.col("id") % 5).cast("int")).alias("p_brand"), F.lit("t").alias("p_type"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    spark.createDataFrame(parts.toPandas(), kind).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        want = c.execute("SELECT " + ", ".join(columns) + f" FROM ({queries.SQL[name]})").fetchall()
    assert len(want) >= 5 and sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(str, want))


LINEAGE = "species_label string, taxon_id string, taxon_name string, taxon_rank string, authority string, release string, lineage_taxon_ids array<string>, lineage_names array<string>, lineage_ranks array<string>"


def lineage(label, taxon, path, names=None, ranks=None, release="1", rank="species"):
    return (label, taxon, label, rank, "x", release, path, names or [f"n{t}" for t in path], ranks or ["r"] * len(path))


def test_lineage_graph(spark):
    rows = [
        lineage("a", "t1", ["r", "p"]), lineage("b", "t2", ["r", "p"]), lineage("c", "t3", ["r", "p"], ["nr", "other"]), lineage("d", "t4", ["r", "p"], None, ["r", "z"]), lineage("e", "t5", ["q", "p"]),
        lineage("f", "t6", ["r"], release="2"), lineage("g", "", ["r"]), lineage("h", "t7", ["r", "p"], ["nr"]), lineage("i", "r", ["r"]), lineage("j", "t8", ["s"]), lineage("k", "t9", ["r", "m", "p"]),
    ]
    nodes, rejected = lineage_graph.reconcile(spark.createDataFrame(rows, LINEAGE))
    assert {r["species_label"]: r["reason"] for r in rejected.collect()} == {"c": "NAME_DIFFERS", "d": "RANK_DIFFERS", "e": "PARENT_DIFFERS", "f": "RELEASES_MIXED", "g": "NO_TERMINAL", "h": "LENGTHS_DIFFER", "i": "TAXON_REPEATS", "j": "OTHER_ROOT", "k": "PARENT_DIFFERS"}
    assert {r["taxon_id"]: (r["parent_taxon_id"], r["depth"], r["is_terminal"]) for r in nodes.collect()} == {"r": (None, 0, False), "p": ("r", 1, False), "t1": ("p", 2, True), "t2": ("p", 2, True)}
    edges = [(f"x{k}", f"x{k + 1}") for k in range(9)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c0", "c1")]
    looped = lineage_graph._on_cycles(spark.createDataFrame(edges, "taxon_id string, parent_taxon_id string"))
    assert {r["taxon_id"] for r in looped.collect()} == {"c0", "c1", "c2", "c3"}
    with pytest.raises(InputError, match="c: NAME_DIFFERS"):
        lineage_graph.graph(spark.createDataFrame(rows[:3], LINEAGE))
    graph = lineage_graph.graph(spark.createDataFrame(rows[:2], LINEAGE))
    assert [(s.kind, s.taxon_id) for s in lineage_graph.make_selection(graph, include_clade=("p", " p "), exclude_exact=("t2",))] == [("INCLUDE_CLADE", "p"), ("EXCLUDE_EXACT", "t2")]
    for bad in ({"include_clade": ("zzz",)}, {"required_exact": ("p",)}, {"required_exact": ("t1",), "exclude_exact": ("t1",)}, {"any_of": ("p",)}):
        with pytest.raises(InputError):
            lineage_graph.make_selection(graph, **bad)


def test_publishing_makes_each_relation_once(spark, tmp_path):
    """The checks read what was written; what fails them is not left behind."""
    made = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    members = spark.createDataFrame([("run", "HOG", "N0", "g", "o", "", f"s{k % 2}", f"m{k}", "f") for k in range(10)], "run_id string, group_type string, hierarchy_node string, group_id string, legacy_orthogroup_id string, gene_tree_parent_clade string, species_label string, member_id string, source_file string")
    species = spark.createDataFrame([("run", str(k), f"s{k}") for k in range(2)], "run_id string, species_index string, species_label string")
    relations = {
        "species": counted(species), "sequences": counted(members.select("run_id", F.col("member_id").alias("internal_id"), "member_id", "species_label")), "memberships": counted(members),
        "hog_memberships": counted(members), "group_statistics": counted(memberships.group_statistics(members)), "group_species_statistics": counted(memberships.group_species_statistics(members))
    }
    out = str(tmp_path / "out")
    assert publish.publish(spark, relations, out, "run", []) == "PUBLISHED" and made.value == 2 + 10 + 10 + 10 + 1 + 2
    with pytest.raises(IntegrityError, match="species_known"):
        publish.publish(spark, relations | {"species": species.limit(1)}, out, "run", [], force=True)
    assert publish.current(spark, out)["version"] == 1 and len(list((tmp_path / "out").glob("data-*"))) == 1
    with pytest.raises(IntegrityError, match="species_known"):
        publish.publish(spark, relations | {"species": species.limit(1)}, str(tmp_path / "other"), "run", [])
    assert not (tmp_path / "other").exists()


def test_second_version_is_read_from_the_first(spark, sf_dir, monkeypatch):
    made, stats = [], Bridge.stats
    monkeypatch.setattr(Bridge, "stats", lambda self: made.append(1) or stats(self))
    assert queries.QUERIES["published_versions"](spark, sf_dir).count() == 2 and len(made) == 1


def test_quality_names_what_fails(spark):
    key, group = ("r", "HOG", "N0"), ", ".join(f"{k} string" for k in KEY)
    stats = spark.createDataFrame([(*key, "g1", 2, 2), (*key, "g2", 1, 2), (*key, "g2", 3, 1)], f"{group}, member_count long, species_count long").withColumns({"single_copy_species_count": F.lit(1).cast("long"), "mean_copies_per_species": F.col("member_count") / F.col("species_count"), "is_singleton": F.col("member_count") == 1})
    members = spark.createDataFrame([(*key, "g1", "s1", "m1"), (*key, "g1", "s2", ""), (*key, "g3", "s1", "m3")], f"{group}, species_label string, member_id string")
    found = {r["check"]: (r["status"], r["observed"]) for r in quality({"group_statistics": stats, "memberships": members, "species": spark.createDataFrame([("r", "s1")], "run_id string, species_label string")}).collect()}
    assert found == {
        "group_statistics_present": ("PASS", "3"), "group_memberships_present": ("PASS", "3"), "species_present": ("PASS", "1"), "group_sizes_possible": ("FAIL", "1"), "group_copies_consistent": ("PASS", "0"), "membership_keys_complete": ("FAIL", "1"),
        "groups_unique": ("FAIL", "1"), "species_unique": ("PASS", "0"), "species_known": ("FAIL", "1"), "groups_have_members": ("FAIL", "1"), "members_have_groups": ("FAIL", "1"), "members_add_up": ("FAIL", "6"),
    }


def test_versions(spark, result_dir, tmp_path):  # noqa: F811
    from kinfold import build

    found = build.relations(spark, str(result_dir), "run")
    out = "file://" + str(tmp_path / "out")
    assert publish.publish(spark, found, out, "run", [("a", 1, "x")]) == "PUBLISHED"
    assert publish.publish(spark, found, out, "run", [("b", 1, "x")], force=True) == "PUBLISHED"
    manifest = publish.current(spark, out)
    assert manifest["version"] == 2 and publish.verify(spark, out) == [] and publish.open_resource(spark, out, 1)["species"].count() == 2
    (tmp_path / "out/manifest.json").unlink()  # a switch that was cut short
    assert publish.current(spark, out) == manifest
    assert spark.read.parquet(f"{out}/{manifest['data']}/quality").filter("status != 'PASS'").isEmpty()
    one = next((tmp_path / "out" / manifest["data"] / "species").glob("*.parquet"))
    one.write_bytes(one.read_bytes() + b"x")
    (one.parent / f".{one.name}.crc").unlink(missing_ok=True)
    assert publish.verify(spark, out) == [f"species/{one.name}"]
    assert dict(publish.metadata_rows(spark, out).collect())["run_id"] == "run"
    with pytest.raises(InputError):
        publish.open_resource(spark, str(tmp_path / "nowhere"))


def test_inventory_has_species_trees(spark, result_dir):  # noqa: F811
    (result_dir / "Species_Tree").mkdir()
    (result_dir / "Species_Tree/SpeciesTree_rooted.txt").write_text("(A:1,B:1);")
    rows = results.tree_inventory(spark, results.discover(result_dir), "run").orderBy("tree_type").collect()
    assert [(r["tree_type"], r["tree_id"], r["group_id"]) for r in rows] == [("RESOLVED_GENE_TREE", "OG0000001", "OG0000001"), ("SPECIES_TREE", "SpeciesTree_rooted", "")]


def test_sidecar_and_headings(spark, tmp_path):
    known = spark.createDataFrame([(f"0_{k}",) for k in range(25)], "internal_id string")
    records = known.select(F.col("internal_id").alias("member_id"), F.lit("MK*").alias("sequence"))
    out = str(tmp_path / "s")
    with pytest.raises(InputError):
        fasta.read_sidecar(spark, out)
    assert fasta.write_sidecar(spark, known.coalesce(1), records.coalesce(1), out, 10) == 25 and fasta.read_sidecar(spark, out).count() == 25
    data = json.loads((tmp_path / "s/sequences.json").read_text())["data"]
    assert len(list((tmp_path / "s" / data).glob("*.parquet"))) >= 3
    with pytest.raises(InputError):
        fasta.write_sidecar(spark, known, records, out)
    for text, bad in (("seed_id\tenabled\n1\ttrue\n", ""), ("seed_id\tseed_id\n1\t2\n", "twice"), ("seed_id\tcolour\n1\t2\n", "colour")):
        (tmp_path / "t.tsv").write_text(text)
        if bad:
            with pytest.raises(InputError, match=bad):
                results.read_relation(spark, str(tmp_path / "t.tsv"), "e3_seed_catalogue_audit")
        else:
            assert results.read_relation(spark, str(tmp_path / "t.tsv"), "e3_seed_catalogue_audit").first()["enabled"] is True
    rows = spark.createDataFrame([("s", "e", "x"), ("S", "e", "x")], "species_column string, experiment_accession string, sample_or_condition string")
    with pytest.raises(InputError, match="2 times"):
        expression.check_metadata(rows)
    with pytest.raises(InputError):
        expression.check_metadata(rows.drop("sample_or_condition"))
    expression.check_metadata(rows.limit(1))
