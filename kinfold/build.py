"""From a completed result directory to a published resource.

``python -m kinfold.build RESULTS OUTPUT --run-id ID`` reads identifiers, group tables and
trees, makes statistics and distances, checks everything and publishes it at once.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InputError
from .operators import distances, memberships, trees
from .publish import publish
from .schemas import KEY, conform
from .session import session
from .sources import results


def patristic_groups(members: DataFrame, sequences: DataFrame, most: int) -> DataFrame:
    """Groups with at most ``most`` sampled members each and the other names of these."""
    sampled = distances.member_sample(members, most)
    names = sequences.select("species_label", "member_id", "internal_id")
    alias = F.map_from_arrays(
        F.array("internal_id", F.concat_ws("_", "species_label", "member_id")), F.array(F.lit("INTERNAL_ID"), F.lit("SPECIES_PREFIXED_MEMBER_ID"))
    )
    rows = sampled.join(names, ["species_label", "member_id"], "left").withColumn("aliases", F.when(F.col("internal_id").isNotNull(), alias))
    return rows.groupBy(*KEY, "legacy_orthogroup_id").agg(
        F.collect_list(F.struct("member_id", "aliases")).alias("members"), F.first("total_member_count").alias("total_member_count"),
        F.first("computation_status").alias("computation_status")
    )


def distance_relations(members: DataFrame, sequences: DataFrame, tree_rows: DataFrame, most: int = 250) -> tuple[DataFrame, DataFrame]:
    """pairwise_distances and distance_statistics of groups with two members or more; a
    group that has none says why."""
    groups = patristic_groups(members, sequences, most).filter("size(members) > 1")
    pairs, failed = trees.patristic_distances(groups, trees.preferred_trees(tree_rows))
    sizes = groups.select(*KEY, "total_member_count", F.size("members").cast("long").alias("sampled_member_count"), "computation_status")
    ways = pairs.groupBy(*KEY).agg(F.first("member_identifier_resolution").alias("member_identifier_resolution"))
    done = distances.summarise(pairs).join(ways, list(KEY)).join(sizes, list(KEY)).withColumn("failure_reason", F.lit(""))
    none = failed.join(sizes, list(KEY)).withColumn("computation_status", F.lit("UNAVAILABLE")).withColumn("distance_pair_count", F.lit(0))
    stats = conform(done.withColumn("distance_method", F.lit("patristic_branch_length")), "distance_statistics").unionByName(
        conform(none.withColumn("distance_method", F.lit("patristic_branch_length")), "distance_statistics")
    )
    status = sizes.select(*KEY, "computation_status")
    return conform(pairs.join(status, list(KEY)), "pairwise_distances"), stats


SOURCES = ("AUTO", "ALIGNED_SEQUENCE", "RESOLVED_GENE_TREE", "NONE")


def distance_source(requested: str, has_alignments: bool, has_resolved_trees: bool) -> str:
    """Where distances come from: what was asked for, or alignments before trees before nothing."""
    if requested not in SOURCES:
        raise InputError(f"unknown distance source {requested}")
    if requested == "AUTO":
        return "ALIGNED_SEQUENCE" if has_alignments else "RESOLVED_GENE_TREE" if has_resolved_trees else "NONE"
    if requested == "ALIGNED_SEQUENCE" and not has_alignments or requested == "RESOLVED_GENE_TREE" and not has_resolved_trees:
        raise InputError(f"{requested}: the results hold none")
    return requested


def alignment_relations(members: DataFrame, aligned: DataFrame, most: int = 250) -> tuple[DataFrame, DataFrame]:
    """pairwise_distances and distance_statistics of aligned members (group_id, member_id,
    sequence) of files that are named by the group itself or else by its original group."""
    names = F.posexplode(F.array_distinct(F.array("group_id", F.coalesce("legacy_orthogroup_id", F.lit("")))))
    named = members.select(*KEY, "member_id", names.alias("place", "file")).distinct()
    met = named.join(aligned.select(F.col("group_id").alias("file"), "member_id", "sequence"), ["file", "member_id"])
    rows = met.groupBy(*KEY, "member_id").agg(F.min_by("sequence", "place").alias("sequence"))
    pairs = distances.alignment_distances(rows, most)
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_member_count")).withColumn("sampled_member_count", F.least("total_member_count", F.lit(most)))
    status = F.when(F.col("total_member_count") > most, "DETERMINISTIC_MEMBER_SAMPLE").otherwise("EXACT")
    sites = pairs.groupBy(*KEY).agg(F.avg("comparable_sites").alias("mean_comparable_sites"))
    done = distances.summarise(pairs).join(sizes, list(KEY)).join(sites, list(KEY)).withColumns(
        {
            "computation_status": status, "distance_method": F.lit("p_distance"), "member_identifier_resolution": F.lit("EXACT_MEMBER_ID"),
            "failure_reason": F.lit("")
        }
    )
    return conform(pairs, "pairwise_distances"), conform(done, "distance_statistics")


def relations(spark: SparkSession, root: str, run_id: str, most: int = 250, source: str = "") -> dict[str, DataFrame]:
    """All relations of a result directory, lazily. Distances come from ``source``, or if
    none is named from trees where there are any."""
    layout = results.discover(root, spark)
    hogs, legacy = results.memberships(spark, layout, run_id)
    members = reduce(DataFrame.unionByName, [m for m in (hogs, legacy) if m is not None])
    sequences = results.sequences(spark, layout, run_id)
    out = {
        "species": results.species(spark, layout, run_id),
        "sequences": sequences,
        "memberships": members,
        "group_statistics": memberships.group_statistics(members),
        "group_species_statistics": memberships.group_species_statistics(members),
    }
    for name, rows in (("hog_memberships", hogs), ("legacy_orthogroup_memberships", legacy)):
        if rows is not None:
            out[name] = rows
    found = results.tree_files(spark, layout, run_id)
    if found is not None:
        payload = trees.encode_payload(F.col("newick"))
        nodes = trees.tree_nodes(found)
        out |= {
            "tree_payloads": trees.preferred_trees(found).withColumn("p", payload).select("run_id", "tree_type", "tree_id", F.col("tree_id").alias("group_id"), F.col("path").alias("source_path"), F.col("p.size").alias("source_size_bytes"), F.col("p.sha256").alias("source_sha256"), F.lit("zlib+base64").alias("payload_encoding"), F.col("p.payload").alias("newick_payload")),
            "tree_nodes": nodes,
            "tree_edges": trees.tree_edges(nodes),
        }
    listed = results.tree_inventory(spark, layout, run_id)
    if listed is not None:
        out["tree_inventory"] = listed
    own, resolved = hogs if hogs is not None else legacy, "RESOLVED_GENE_TREE" in layout.trees
    asked = distance_source(source, layout.alignments is not None, resolved) if source else "RESOLVED_GENE_TREE" if found is not None else "NONE"
    if asked == "ALIGNED_SEQUENCE":
        out["pairwise_distances"], out["distance_statistics"] = alignment_relations(own, results.alignments(spark, layout), most)
    elif asked == "RESOLVED_GENE_TREE":
        out["pairwise_distances"], out["distance_statistics"] = distance_relations(own, sequences, found, most)
    return out


def inventory(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """path, size and SHA-256 of every input, hashed on the executors; a row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return [tuple(r) for r in files.select("path", "length", F.sha2("content", 256)).collect()]


def run(spark: SparkSession, root: str, output: str, run_id: str, most: int = 250, resume: bool = False, force: bool = False, source: str = "") -> str:
    """Build and publish; REUSED where the same run over the same inputs is there."""
    found = relations(spark, root, run_id, most, source)
    memberships.check_consistent(found["memberships"])
    return publish(spark, found, output, run_id, inventory(spark, root), resume, force)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("results")
    args.add_argument("output")
    args.add_argument("--run-id", required=True)
    args.add_argument("--max-members", type=int, default=250)
    args.add_argument("--distance-source", default="AUTO", choices=SOURCES)
    args.add_argument("--resume", action="store_true")
    args.add_argument("--force", action="store_true")
    a = args.parse_args()
    print(run(session(), a.results, a.output, a.run_id, a.max_members, a.resume, a.force, a.distance_source))


if __name__ == "__main__":
    main()
