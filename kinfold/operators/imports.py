"""What comes in from outside, and whole selections that go out: checked, never guessed or cut.

Every check is a distributed one: an anti join or an aggregate that shows one bad row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..functions.text import tree_id_of
from ..schemas import KEY


def _refuse(bad: DataFrame, said: str, error: type[Exception] = InputError) -> None:
    """An error with the first row of ``bad``, if it has one."""
    if first := bad.limit(1).collect():
        raise error(said.format(**first[0].asDict()))


def source_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the suffix of its path: Parquet, or text with tabs or commas and a heading."""
    bare = re.sub(r"\.gz$", "", path.rstrip("/").lower())
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    for suffix, separator in ((".tsv", "\t"), (".txt", "\t"), (".csv", ",")):
        if bare.endswith(suffix):
            return spark.read.csv(path, sep=separator, header=True, mode="FAILFAST", enforceSchema=False)
    raise InputError(f"{path}: neither Parquet nor a text table")


def parent_map(rows: DataFrame) -> DataFrame:
    """node and parent; a node with two parents, or without a name, is an error."""
    out = rows.select("node", "parent").distinct()
    _refuse(out.filter("node is null or trim(node) = ''"), "a node without a name")
    _refuse(out.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "node {node} has {n} parents", IntegrityError)
    return out


def row_groups(value: str, most: int = 10_000) -> tuple[int, ...]:
    """Numbers of row groups from a list with commas or spaces, in order and once each."""
    parts = [p for p in re.split(r"[,\s]+", value.strip("[] \t\n")) if p]
    if any(not p.isdigit() for p in parts):
        raise InputError(f"not a list of row groups: {value[:80]}")
    found = tuple(sorted({int(p) for p in parts}))
    if len(found) > most:
        raise InputError(f"more than {most} row groups")
    return found


def centroid_list(identifiers: Sequence[str]) -> tuple[str, ...]:
    """Identifiers in their first order, once each; empty ones and those with white space are errors."""
    found = tuple(dict.fromkeys(i.strip() for i in identifiers))
    if not found or any(not i or re.search(r"\s", i) for i in found):
        raise InputError("centroids are identifiers without white space")
    return found


def unique_sequences(fasta: DataFrame) -> DataFrame:
    """member_id, length and SHA-256 of every sequence; an identifier that comes twice is an error."""
    _refuse(fasta.groupBy("member_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sequence {member_id} comes {n} times", IntegrityError)
    return fasta.select("member_id", F.length("sequence").alias("length"), F.sha2(F.col("sequence").cast("binary"), 256).alias("sha256"))


def import_clusters(fasta: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """A row a cluster of ``fasta`` (cluster_id, centroid, member_id, sequence): members and
    lengths. Each cluster holds its centroid and, if ``expected`` (cluster_id, member_count)
    names it, that many members; or it is an error."""
    out = fasta.groupBy("cluster_id", "centroid").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_distinct("member_id").alias("distinct_count"),
        F.bool_or(F.col("member_id") == F.col("centroid")).alias("has_centroid"),
        F.min(F.length("sequence")).alias("minimum_length"),
        F.max(F.length("sequence")).alias("maximum_length"),
        F.sum(F.length("sequence")).alias("residue_count"),
    )
    _refuse(out.filter("not has_centroid"), "cluster {cluster_id} lacks its centroid {centroid}", IntegrityError)
    _refuse(out.filter("distinct_count != member_count"), "cluster {cluster_id} has a member twice", IntegrityError)
    if expected is not None:
        wanted = expected.select("cluster_id", F.col("member_count").alias("wanted"))
        _refuse(out.join(wanted, "cluster_id").filter("wanted != member_count"), "cluster {cluster_id} has {member_count} of {wanted} members", IntegrityError)
    return out.drop("distinct_count", "has_centroid")


def import_family(fasta: DataFrame, context: DataFrame) -> DataFrame:
    """Sequences with the context of their member (member_id, ...); sequences without any stay."""
    _refuse(context.groupBy("member_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "member {member_id} has {n} contexts", IntegrityError)
    return fasta.join(context, "member_id", "left")


def domain_rows(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Predicted domains (sequence_id, md5, length, analysis, signature, start, end) of known
    sequences (sequence_id, sequence) whose checksum and length agree and that hold them."""
    own = sequences.select("sequence_id", F.md5(F.col("sequence").cast("binary")).alias("own_md5"), F.length("sequence").alias("own_length"))
    met = rows.join(own, "sequence_id", "left")
    _refuse(met.filter("own_md5 is null"), "domain of an unknown sequence {sequence_id}")
    _refuse(met.filter("lower(md5) != own_md5 or length != own_length"), "sequence {sequence_id} is not the one that was analysed")
    _refuse(met.filter("start is null or end is null or start < 1 or start > end or end > own_length"), "a domain lies outside {sequence_id}")
    return met.drop("own_md5", "own_length").withColumn("evidence_type", F.lit("SEQUENCE_SIGNATURE_PREDICTION"))


def selected_sequences(fasta: DataFrame, wanted: DataFrame, column: str = "member_id") -> DataFrame:
    """The sequences of exact identifiers; one that is not there is an error."""
    ids = wanted.select(F.col(column).alias("member_id")).distinct()
    _refuse(ids.join(fasta, "member_id", "left_anti"), "no sequence {member_id}")
    return fasta.join(ids, "member_id", "left_semi")


def reviewed_traits(members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """sequence_id, species and taxon_id of members with exactly one positive taxon."""
    own = taxonomy.filter("taxon_id > 0").join(members.select("sequence_id").distinct(), "sequence_id", "left_semi")
    sure = own.groupBy("sequence_id").agg(F.min("species").alias("species"), F.min("taxon_id").alias("taxon_id"), F.count_distinct("taxon_id").alias("n"))
    return sure.filter("n = 1").drop("n")


def group_inputs(groups: DataFrame, members: DataFrame, most_groups: int = 500, most_inputs: int = 10_000) -> DataFrame:
    """All members of whole groups, the largest groups first: input_id, species_label, the
    group, selection_rank and source_member_count. Too many groups or proteins, or a group
    whose members are not as many as its statistics say, are errors: nothing is cut."""
    if groups.limit(most_groups + 1).count() > most_groups:
        raise InputError(f"more than {most_groups} groups")
    rank = F.row_number().over(Window.orderBy(F.col("member_count").desc(), "group_id"))  # of most_groups rows
    ranked = groups.select(*KEY, "member_count").withColumn("selection_rank", rank)
    rows = ranked.join(members.select(*KEY, "species_label", "member_id"), list(KEY), "left")
    have = rows.groupBy(*KEY, "member_count").agg(F.count("member_id").alias("n"))
    _refuse(have.filter("n != member_count"), "group {group_id} has {n} of {member_count} members", IntegrityError)
    if rows.select("member_id").distinct().limit(most_inputs + 1).count() > most_inputs:
        raise InputError(f"more than {most_inputs} proteins; select fewer groups")
    return rows.select(
        F.col("member_id").alias("input_id"), "species_label", *[F.col(k).alias(f"source_{k}") for k in KEY], "selection_rank",
        F.col("member_count").alias("source_member_count")
    )


def requested_sequences(inputs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The sequence (species_label, member_id, sequence) of every input; one without is an error."""
    asked = inputs.select("species_label", F.col("input_id").alias("member_id")).distinct()
    met = asked.join(sequences.select("species_label", "member_id", "sequence"), ["species_label", "member_id"], "left")
    _refuse(met.filter("sequence is null"), "no sequence for {member_id} of {species_label}")
    return met


def with_context(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Results with every group that their input came from; results of other inputs stay."""
    return results.join(inputs, "input_id", "left")


def reference_first(rows: DataFrame, reference: str, most: int, sample: bool = False) -> DataFrame:
    """The reference, then members by a hash of their identifier, ``most`` in all. More
    members than that are an error unless a sample is asked for."""
    if rows.filter(F.col("member_id") == reference).limit(1).count() == 0:
        raise InputError(f"no reference {reference}")
    if not sample and rows.limit(most + 1).count() > most:
        raise InputError(f"more than {most} members; ask for a sample")
    first = F.when(F.col("member_id") == reference, 0).otherwise(1)
    return rows.orderBy(first, F.sha2(F.col("member_id").cast("binary"), 256), "member_id").limit(most)


def tree_ids(groups: DataFrame) -> DataFrame:
    """Names under which a group's tree may stand (KEY, tree_id, position): its original
    group, the one its own name tells, and its own name."""
    ids = F.array_distinct(
        F.filter(F.array(F.trim("legacy_orthogroup_id"), tree_id_of(F.col("group_id")), F.col("group_id")), lambda x: x.isNotNull() & (x != ""))
    )
    return groups.select(*KEY, F.posexplode(ids).alias("position", "tree_id"))


def portable_trees(groups: DataFrame, payloads: DataFrame) -> DataFrame:
    """The tree of each group: resolved before original, then by the order of its names;
    two that are as good are an error."""
    kind = F.when(F.col("tree_type") == "RESOLVED_GENE_TREE", 0).when(F.col("tree_type") == "GENE_TREE", 1).otherwise(2)
    met = tree_ids(groups).join(payloads, ["run_id", "tree_id"]).withColumn("kind", kind) if "group_id" not in payloads.columns else tree_ids(groups).join(
        payloads.drop("group_id"), ["run_id", "tree_id"]
    ).withColumn("kind", kind)
    best = met.groupBy(*KEY).agg(F.min(F.struct("kind", "position")).alias("best"))
    chosen = met.join(best, list(KEY)).filter((F.col("kind") == F.col("best.kind")) & (F.col("position") == F.col("best.position")))
    _refuse(chosen.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "group {group_id} has {n} trees that are as good")
    return chosen.drop("best", "kind", "position")


def inherited_traits(jobs: DataFrame, traits: DataFrame, start: str, most: int = 32) -> DataFrame:
    """member_id, trait and value as the nearest job above ``start`` states them.

    ``jobs`` (job, source) is followed source by source; ``traits`` has job, member_id,
    trait and value. A cycle, a chain longer than ``most``, or two values of one trait and
    member in one job are errors.
    """
    # the sources above each job that ``start`` leads to, one link a round: a row each time
    chain, at = [], start
    while True:
        above = jobs.filter((F.col("job") == at) & F.col("source").isNotNull() & (F.col("source") != "")).select("source").distinct().limit(2).collect()
        if not above:
            break
        if len(above) > 1:
            raise IntegrityError(f"job {at} has two sources")
        at = above[0]["source"]
        if at in chain or at == start or len(chain) >= most:
            raise IntegrityError("jobs that are their own source, or too many of them")
        chain.append(at)
    order = F.array_position(F.array(*map(F.lit, chain)), F.col("job")) if chain else F.lit(0)
    rows = traits.filter(F.col("job").isin(chain) & F.col("value").isNotNull() & (F.col("value") != "")) if chain else traits.limit(0)
    per = rows.groupBy("job", "member_id", "trait").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n"))
    _refuse(per.filter("n > 1"), "member {member_id} has {n} values of {trait}", IntegrityError)
    return per.groupBy("member_id", "trait").agg(F.min_by("value", order).alias("value"))
