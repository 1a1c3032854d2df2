"""Queries that write driver tables in the formats of sources and sinks and read them back,
with the tables they came from as SQL; and trees made of nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import header_aliases
from ..operators import trees
from ..publish import open_resource, publish, to_tsv, write_relations
from ..schemas import KEY, conform
from ..sources import fasta, results
from .bridge import RUN, Bridge, scratch, sql
from .queries import query, r


# a result directory: identifier files and group tables
def _layout(b: Bridge, *parts: str) -> results.Layout:
    """A result directory with some of its files, each written by tasks as a folder of text files."""
    root = scratch(b.spark)
    if "ids" in parts:
        nations = b.table("nation").select(F.concat_ws(": ", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(".fa"))))
        nations.write.text(f"{root}/{results.SPECIES_IDS}")
        headers = F.concat("c_name", F.lit(" of "), F.col("c_mktsegment"))
        names = F.concat_ws("_", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
        b.table("customer").select(F.concat_ws(": ", names, headers)).write.text(f"{root}/{results.SEQUENCE_IDS}")
    wide = {"hogs": (b.members(), "HOG", f"{root}/{results.HOGS}/N0.tsv"), "legacy": (b.legacy(), "Orthogroup", f"{root}/{results.LEGACY}")}
    for part, (members, heading, path) in wide.items():
        if part in parts:
            species = sorted(x["n_name"] for x in b.table("nation").select("n_name").collect())  # a column each
            cells = members.groupBy(F.col("group_id").alias(heading), F.col("legacy_orthogroup_id").alias("OG")).pivot("species_label", species)
            table = cells.agg(F.array_join(F.sort_array(F.collect_list("member_id")), ", "))
            to_tsv(table if part == "hogs" else table.drop("OG"), path)
    return results.Layout(
        root, "3.0", f"{root}/{results.LEGACY}" if "legacy" in parts else None, (f"{root}/{results.HOGS}/N0.tsv",) if "hogs" in parts else (), {},
        None, None
    )


@query("SELECT n_nationkey::VARCHAR AS species_index, n_name AS species_label, n_name || '.fa' AS source_fasta FROM nation")
def species_file(b: Bridge) -> DataFrame:
    return results.species(b.spark, _layout(b, "ids"), RUN).select("species_index", "species_label", "source_fasta")


@query(
    "SELECT c_nationkey || '_' || c_custkey AS internal_id, n_name AS species_label, c_name AS member_id, c_name || ' of ' || c_mktsegment AS raw_header FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
def sequence_file(b: Bridge) -> DataFrame:
    return results.sequences(b.spark, _layout(b, "ids"), RUN).select("internal_id", "species_label", "member_id", "raw_header")


@query(sql("lines members", "SELECT group_type, hierarchy_node, group_id, legacy_orthogroup_id, species_label, member_id FROM members"))
def hierarchical_table(b: Bridge) -> DataFrame:
    found, _ = results.memberships(b.spark, _layout(b, "hogs"), RUN)
    return found.select("group_type", "hierarchy_node", "group_id", "legacy_orthogroup_id", "species_label", "member_id")


@query(sql("lines legacy", "SELECT group_type, hierarchy_node, group_id, legacy_orthogroup_id, species_label, member_id FROM legacy"))
def legacy_table(b: Bridge) -> DataFrame:
    _, found = results.memberships(b.spark, _layout(b, "legacy"), RUN)
    return found.select("group_type", "hierarchy_node", "group_id", "legacy_orthogroup_id", "species_label", "member_id")


# sequences
def _proteins(b: Bridge) -> DataFrame:
    d = b.table("documents")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return d.select(
        F.col("doc_id").cast("string").alias("member_id"), F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "lang").alias("raw_header"),
        letters.alias("sequence")
    ).filter("sequence != ''")


_PROTEINS = "proteins AS (SELECT doc_id::VARCHAR AS member_id, concat_ws(' ', doc_id, source, lang) AS raw_header, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)"


@query(f"WITH {_PROTEINS} SELECT member_id, raw_header, length(sequence)::INT AS sequence_length, md5(sequence) AS digest FROM proteins WHERE sequence != ''")
def fasta_round_trip(b: Bridge) -> DataFrame:
    folder = scratch(b.spark)
    fasta.write_fasta(_proteins(b), folder)
    found = fasta.read_fasta(b.spark, folder, check="protein")
    return found.select("member_id", "raw_header", F.length("sequence").alias("sequence_length"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query(f"WITH {_PROTEINS} SELECT member_id AS internal_id, length(sequence)::INT AS sequence_length FROM proteins WHERE sequence != ''")
def reconciled_sequences(b: Bridge) -> DataFrame:
    known = _proteins(b).select(F.col("member_id").alias("internal_id"))
    starred = _proteins(b).select("member_id", F.concat("sequence", F.lit("*")).alias("sequence"))
    return fasta.reconcile(known, starred).select("internal_id", F.length("sequence").alias("sequence_length"))


@query(
    f"""WITH {_PROTEINS}, s AS (SELECT member_id, unnest(['member_id', 'raw_primary_token']) AS alias_type FROM proteins WHERE sequence != '') SELECT member_id, alias_type, member_id AS alias_value, 1::BIGINT AS mapping_tier FROM s WHERE alias_type = 'member_id'"""
)
def header_member_aliases(b: Bridge) -> DataFrame:
    rows = _proteins(b).select("member_id", F.explode(header_aliases(F.col("member_id"), F.col("raw_header"))).alias("a"))
    return rows.select("member_id", "a.*").filter("alias_type = 'member_id'")


def unique_sequences(b: Bridge) -> DataFrame:
    """The sequences with each internal id once, since lines share some."""
    return b.sequences().groupBy("run_id", "internal_id").agg(F.min("member_id").alias("member_id"), F.min("species_label").alias("species_label"))


# sinks
@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def tsv_round_trip(b: Bridge) -> DataFrame:
    folder = scratch(b.spark)
    to_tsv(b.table("part").select("p_partkey", "p_name", "p_brand", "p_size"), folder, gzip=True)
    return results.read_tsv(b.spark, folder)


@query(sql("lines members species stats", "SELECT group_id, legacy_orthogroup_id, member_count, species_count, is_singleton FROM stats"))
def relation_round_trip(b: Bridge) -> DataFrame:
    folder = scratch(b.spark)
    write_relations({"group_statistics": b.stats()}, folder, {"group_statistics": "group_id"})
    return b.spark.read.parquet(f"{folder}/group_statistics").select("group_id", "legacy_orthogroup_id", "member_count", "species_count", "is_singleton")


@query(sql("lines members species stats", "SELECT group_id, member_count, species_labels FROM stats"))
def published_statistics(b: Bridge) -> DataFrame:
    folder = scratch(b.spark)
    species = b.table("nation").select(
        F.lit(RUN).alias("run_id"), F.col("n_nationkey").cast("string").alias("species_index"), F.col("n_name").alias("species_label")
    )
    relations = {
        "species": species, "sequences": unique_sequences(b), "group_statistics": b.stats(), "group_species_statistics": b.species(),
        "memberships": b.members(), "hog_memberships": b.members()
    }
    publish(b.spark, relations, folder, RUN, [])
    return open_resource(b.spark, folder)["group_statistics"].select("group_id", "member_count", "species_labels")


@query("SELECT n_name AS species_label, n_nationkey::BIGINT AS taxon, NULL::DOUBLE AS missing FROM nation")
def conformed_types(b: Bridge) -> DataFrame:
    """Numbers in text become typed, absent columns null."""
    raw = b.table("nation").select(
        F.col("n_name").alias("species_label"), F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("species_member_count")
    )
    found = conform(raw, "group_species_statistics")
    return found.select("species_label", F.col("species_member_count").alias("taxon"), F.col("member_fraction").alias("missing"))


# trees: a region is a tree whose leaves are its nations
_LENGTH = "(n_nationkey + 1) / 8"


def _trees(b: Bridge) -> DataFrame:
    """The first nation by name hangs on the root, the others on a node named by the region."""
    both = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.concat("n_name", F.lit(":"), ((F.col("n_nationkey") + 1) / 8).cast("string"))
    per = both.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_name", leaf.alias("leaf")))).alias("x"))
    inner = F.concat(F.lit("("), F.array_join(F.transform(F.slice("x", 2, 1000), lambda s: s["leaf"]), ","), F.lit(")'"), "r_name", F.lit("':0.5"))
    text = F.concat(F.lit("("), F.get("x", F.lit(0))["leaf"], F.lit(","), inner, F.lit(")root;"))
    return per.select(F.lit(RUN).alias("run_id"), F.lit("GENE_TREE").alias("tree_type"), F.col("r_name").alias("tree_id"), text.alias("newick"))


_LEAVES = f"leaves AS (SELECT r_name AS tree_id, n_name, {_LENGTH} AS length, n_name = min(n_name) OVER (PARTITION BY r_name) AS alone, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {_LEAVES} SELECT tree_id, n_name AS node_name, true AS is_leaf, length AS branch_length, 1::BIGINT AS descendant_leaf_count FROM leaves
    UNION ALL SELECT tree_id, tree_id, false, 0.5, count(*) - 1 FROM leaves GROUP BY tree_id UNION ALL SELECT tree_id, 'root', false, NULL, count(*) FROM leaves GROUP BY tree_id""")  # fmt: skip
def tree_nodes(b: Bridge) -> DataFrame:
    return trees.tree_nodes(_trees(b)).select("tree_id", "node_name", "is_leaf", "branch_length", "descendant_leaf_count")


@query(
    f"""WITH {_LEAVES} SELECT tree_id, CASE WHEN alone THEN 'root' ELSE tree_id END AS parent, n_name AS child, length AS branch_length FROM leaves UNION ALL SELECT DISTINCT tree_id, 'root', tree_id, 0.5 FROM leaves"""
)
def tree_edges(b: Bridge) -> DataFrame:
    nodes = trees.tree_nodes(_trees(b))
    names = [nodes.select("tree_id", F.col("node_id").alias(f"{end}_node_id"), F.col("node_name").alias(end)) for end in ("parent", "child")]
    edges = trees.tree_edges(nodes).join(names[0], ["tree_id", "parent_node_id"]).join(names[1], ["tree_id", "child_node_id"])
    return edges.select("tree_id", "parent", "child", "branch_length")


@query(f"""WITH {_LEAVES} SELECT a.tree_id AS group_id, a.n_name AS member_a, b.n_name AS member_b, round(a.length + b.length + CASE WHEN a.alone THEN 0.5 ELSE 0 END, 6) AS distance, 'EXACT_MEMBER_ID' AS member_identifier_resolution
    FROM leaves a JOIN leaves b ON a.tree_id = b.tree_id AND a.n_name < b.n_name""")  # fmt: skip
def patristic_pairs(b: Bridge) -> DataFrame:
    pairs, _ = trees.patristic_distances(_tree_groups(b), _trees(b))
    return pairs.select("group_id", "member_a", "member_b", r("distance"), "member_identifier_resolution")


def _tree_groups(b: Bridge) -> DataFrame:
    both = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    member = F.struct(F.col("n_name").alias("member_id"), F.create_map(F.lit("none"), F.lit("NONE")).alias("aliases"))
    return both.groupBy(F.col("r_name").alias("group_id")).agg(F.collect_list(member).alias("members")).select(
        *[F.lit(v).alias(k) for k, v in zip(KEY[:3], (RUN, "HOG", "N0"), strict=True)], "group_id", F.lit("").alias("legacy_orthogroup_id"), "members"
    )


@query("SELECT r_name AS group_id, 'no tree' AS failure_reason FROM region WHERE r_name > 'AMERICA'")
def patristic_failures(b: Bridge) -> DataFrame:
    _, failures = trees.patristic_distances(_tree_groups(b), _trees(b).filter("tree_id <= 'AMERICA'"))
    return failures.select("group_id", "failure_reason")


@query("SELECT r_name AS tree_id, CASE WHEN r_name = 'ASIA' THEN 'RESOLVED_GENE_TREE' ELSE 'GENE_TREE' END AS tree_type FROM region")
def preferred_trees(b: Bridge) -> DataFrame:
    own = _trees(b)
    both = own.unionByName(own.filter("tree_id = 'ASIA'").withColumn("tree_type", F.lit("RESOLVED_GENE_TREE")))
    return trees.preferred_trees(both).select("tree_id", "tree_type")


@query("SELECT r_name AS tree_id, true AS same FROM region")
def tree_payloads(b: Bridge) -> DataFrame:
    packed = _trees(b).withColumn("x", trees.encode_payload("newick")).select("tree_id", "newick", "x.*")
    return packed.select("tree_id", (trees.decode_payload("payload", "size", "sha256") == F.col("newick")).alias("same"))


@query(f"""WITH {_LEAVES}, t AS (SELECT tree_id, bool_and(n_nationkey < 15) AS one FROM leaves WHERE NOT alone GROUP BY tree_id),
    a AS (SELECT tree_id, n_nationkey < 15 AS first FROM leaves WHERE alone), w AS (SELECT tree_id, one AND first AS whole, one FROM t JOIN a USING (tree_id))
    SELECT tree_id, 'root' AS node_name, 'old' AS label FROM w WHERE whole UNION ALL SELECT tree_id, tree_id, 'old' FROM w WHERE one AND NOT whole
    UNION ALL SELECT tree_id, n_name, CASE WHEN n_nationkey < 15 THEN 'old' ELSE 'new' END FROM leaves JOIN w USING (tree_id) WHERE NOT whole AND (alone OR NOT one)""")  # fmt: skip
def clade_partitions(b: Bridge) -> DataFrame:
    labels = b.table("nation").select(F.col("n_name").alias("leaf"), F.when(F.col("n_nationkey") < 15, "old").otherwise("new").alias("label"))
    return trees.clade_partitions(_trees(b), labels).select("tree_id", "node_name", "label")


@query(
    f"WITH {_LEAVES} SELECT tree_id, n_name AS name, round(length + CASE WHEN alone THEN 0 ELSE 0.5 END, 6) AS x, (row_number() OVER (PARTITION BY tree_id ORDER BY n_name) - 1)::DOUBLE AS y FROM leaves"
)
def phylogram_leaves(b: Bridge) -> DataFrame:
    keep = b.table("nation").select(F.col("n_name").alias("leaf"))
    return trees.phylograms(_trees(b), keep).filter("is_leaf").select("tree_id", "name", r("x"), "y")
