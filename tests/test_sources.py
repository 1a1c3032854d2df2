"""Result directories, FASTA, authorities, publication, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from kinfold import publish
from kinfold.errors import InputError, IntegrityError
from kinfold.operators import memberships
from kinfold.sources import authorities, fasta, results
from kinfold.streaming.events import windowed_counts


@pytest.fixture
def result_dir(tmp_path):
    for d in ("WorkingDirectory", "Orthogroups", "Phylogenetic_Hierarchical_Orthogroups", "Resolved_Gene_Trees", "MultipleSequenceAlignments"):
        (tmp_path / d).mkdir()
    (tmp_path / "Log.txt").write_text("started\nOrthoX version 2.5.5 Copyright\n")
    (tmp_path / "WorkingDirectory/SpeciesIDs.txt").write_text("0: Species_A.fa\n1: Species_B.faa\n")
    (tmp_path / "WorkingDirectory/SequenceIDs.txt").write_text("0_0: protA first: protein\n0_1: protA2 second protein\n1_0: protB\n")
    (tmp_path / "Orthogroups/Orthogroups.tsv").write_text("Orthogroup\tSpecies_A\tSpecies_B\nOG0000001\tprotA, protA2\tprotB\n")
    (tmp_path / "Phylogenetic_Hierarchical_Orthogroups/N0.tsv").write_text("HOG\tOG\tGene Tree Parent Clade\tSpecies_A\tSpecies_B\nN0.HOG0000001\tOG0000001\tn0\tprotA, protA2\tprotB\n")
    (tmp_path / "Resolved_Gene_Trees/OG0000001_tree.txt").write_text("((protA:0.1,protA2:0.2):0.1,protB:0.3)N0:0.0;")
    (tmp_path / "MultipleSequenceAlignments/N0.HOG0000001.fa").write_text(">protA\nAAAA\n>protA2\nAATA\n>protB\nTTTT\n")
    return tmp_path


def test_directory(spark, result_dir):
    layout = results.discover(result_dir)
    assert layout.version == "2.5.5" and layout.primary == "HOG" and len(layout.hogs) == 1
    seq = results.sequences(spark, layout, "run")
    assert sorted(tuple(r) for r in seq.select("internal_id", "species_label", "member_id", "raw_header", "source_line").collect()) == [("0_0", "Species_A", "protA", "protA first: protein", 1), ("0_1", "Species_A", "protA2", "protA2 second protein", 2), ("1_0", "Species_B", "protB", "protB", 3)]
    hogs, legacy = results.memberships(spark, layout, "run")
    assert hogs.count() == legacy.count() == 3
    assert memberships.group_statistics(hogs).first()["mean_copies_per_species"] == 1.5
    tree = results.tree_files(spark, layout, "run").first()
    assert tree["tree_id"] == "OG0000001" and tree["newick"].startswith("((protA")
    assert results.alignments(spark, layout).count() == 3


def test_directory_errors(spark, result_dir):
    (result_dir / "WorkingDirectory/SequenceIDs.txt").write_text("9_0: x\n")
    with pytest.raises(IntegrityError):
        results.sequences(spark, results.discover(result_dir), "run")
    (result_dir / "WorkingDirectory/SpeciesIDs.txt").write_text("0: a.fa\n0: b.fa\n")
    with pytest.raises(IntegrityError):
        results.species(spark, results.discover(result_dir), "run")
    (result_dir / "Log.txt").write_text("version 1.0")
    with pytest.raises(InputError):
        results.discover(result_dir)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nac\nGT*\n>y\nMM\n")
    got = sorted(tuple(r) for r in fasta.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("a.fa", "x", "x one", "ACGT*"), ("a.fa", "y", "y", "MM")]
    for bad in ("AC\n>x\nA\n", ">x\n>y\nA\n", ">x\nA\n>x\nC\n"):
        with pytest.raises(InputError):
            list(fasta.records(iter(bad.splitlines()), "f"))
    with pytest.raises(InputError):
        list(fasta.records(iter([">x", "A1"]), "f", "protein"))
    seq = spark.createDataFrame([("x", "A"), ("z", "A")], "internal_id string, species_label string")
    with pytest.raises(IntegrityError):
        fasta.reconcile(seq, fasta.read_fasta(spark, str(tmp_path)))


def test_authorities(spark):
    ok = spark.createDataFrame([("A", "101", "REVIEWED", "1;10", "root;clade")], "species_label string, taxon_id string, mapping_status string, lineage_taxon_ids string, lineage_names string")
    assert authorities.taxonomy(ok).first()["lineage"] == ["1", "10"]
    for bad in (ok.withColumn("mapping_status", F.lit("?")), ok.withColumn("lineage_names", F.lit("root")), ok.unionByName(ok)):
        with pytest.raises(InputError):
            authorities.taxonomy(bad)
    with pytest.raises(InputError):
        authorities.focus_proteins(spark.createDataFrame([("P1",), ("p1",)], "protein_id string"))
    with pytest.raises(InputError):
        authorities.markers(spark.createDataFrame([("m", "p", "OTHER", "")], "marker_id string, protein_identifier string, benchmark_class string, benchmark_subclass string"))


def test_publish(spark, result_dir, tmp_path):
    layout = results.discover(result_dir)
    hogs, _ = results.memberships(spark, layout, "run")
    rel = {"species": results.species(spark, layout, "run"), "sequences": results.sequences(spark, layout, "run"), "memberships": hogs, "hog_memberships": hogs, "group_statistics": memberships.group_statistics(hogs), "group_species_statistics": memberships.group_species_statistics(hogs)}
    out = str(tmp_path / "published")
    assert publish.publish(spark, rel, out, "run", [("a", 1, "x")]) == "PUBLISHED"
    assert publish.publish(spark, rel, out, "run", [("a", 1, "x")], resume=True) == "REUSED"
    with pytest.raises(InputError):
        publish.publish(spark, rel, out, "run", [("b", 1, "x")])
    opened = publish.open_resource(spark, out)
    assert opened["group_statistics"].count() == 1 and opened["distance_statistics"].count() == 0
    assert publish.verify(spark, out) == []
    manifest = json.loads((tmp_path / "published/manifest.json").read_text())
    (tmp_path / "published/manifest.json").write_text(json.dumps(manifest | {"run_id": "other"}))
    with pytest.raises(IntegrityError):
        publish.open_resource(spark, out)
    with pytest.raises(IntegrityError):
        publish.publish(spark, rel | {"memberships": hogs.limit(1)}, str(tmp_path / "x"), "run", [])


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="100 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["window_start"]), r["event_type"], r["n_events"]) for r in spark.table("counts").collect())
    assert got == sorted((str(r["window_start"]), r["event_type"], r["n_events"]) for r in windowed_counts(events).collect())
