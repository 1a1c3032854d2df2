"""Global clusters: identifier resolution, taxonomy, sub-cluster audit, alignment columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..functions.text import strip

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def resolve_column(columns: list[str], choices: tuple[str, ...], required: bool = True) -> str | None:
    """The first of several documented names that a table has."""
    found = next((c for c in choices if c in columns), None)
    if found is None and required:
        raise InputError(f"none of the columns {', '.join(choices)} is there")
    return found


def clusters(index: DataFrame) -> DataFrame:
    """cluster_id, member_count, row_start, row_groups of an index; loose numbers become null."""
    name = lambda *c: F.col(resolve_column(index.columns, c))
    start, groups = resolve_column(index.columns, ("row_start", "RowStart"), False), resolve_column(index.columns, ("row_groups", "RowGroup"), False)
    return index.select(
        name("cluster_id", "CLUSTER").cast("string").alias("cluster_id"),
        name("member_count", "NMEMBER").cast("string").try_cast("long").alias("member_count"),
        (F.col(start).cast("string").try_cast("long") if start else F.lit(None).cast("long")).alias("row_start"),
        (F.col(groups).cast("string") if groups else F.lit(None).cast("string")).alias("row_groups")
    )


def reviewed(taxonomy: DataFrame) -> DataFrame:
    """Only reviewed rows, where a review status exists."""
    return taxonomy.filter("mapping_status = 'REVIEWED'") if "mapping_status" in taxonomy.columns else taxonomy


def identifier_aliases(ids: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """input_id, query_alias: the id, its accession, and either behind each prefix."""
    value = strip(F.col("input_id"))
    accession = F.when(value.rlike(r"^(sp|tr)\|[^|]+\|"), F.split_part(value, F.lit("|"), F.lit(2)))
    own = F.filter(F.array(value, accession), lambda x: x.isNotNull())
    parts = [own]
    for p in prefixes:
        parts.append(F.transform(own, _prefixed(p)))
    return ids.select(value.alias("input_id"), F.explode(F.array_distinct(F.concat(*parts))).alias("query_alias")).filter("query_alias != ''").distinct()


def _prefixed(prefix: str):
    return lambda x: F.concat(F.lit(prefix), x)


def resolve(ids: DataFrame, sequence_map: DataFrame, cluster_index: DataFrame, bridge: DataFrame | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Every input id with its clusters and how it was found; unmatched ids stay."""
    own = identifier_aliases(ids, prefixes)
    if bridge is not None:
        more = own.join(
            bridge.select(F.col("input_id").alias("query_alias"), F.col("sequence_id").alias("__b")), "query_alias"
        ).select("input_id", F.col("__b").alias("query_alias"))
        own_all = own.unionByName(more).distinct()
    else:
        own_all = own
    hits = own_all.join(sequence_map.distinct(), F.col("query_alias") == F.col("sequence_id")).join(
        cluster_index.select("cluster_id", "member_count"), "cluster_id", "left"
    ).distinct()
    n = hits.groupBy("input_id").agg(F.count_distinct("cluster_id").alias("global_cluster_count"))
    out = own.select("input_id").distinct().join(hits, "input_id", "left").join(n, "input_id", "left")
    status = F.when(F.col("cluster_id").isNull(), "UNMATCHED").when(
        F.col("member_count").isNull(), "MAPPED_WITHOUT_ROW_GROUP_INDEX"
    ).when(F.col("global_cluster_count") > 1, "MULTIPLE_GLOBAL_CLUSTERS").when(F.col("query_alias") == F.col("input_id"), "EXACT_ID").otherwise("EXPLICIT_ALIAS")
    return out.select(
        "input_id", F.col("query_alias").alias("matched_alias"), "sequence_id", "cluster_id", "member_count",
        F.coalesce("global_cluster_count", F.lit(0)).alias("global_cluster_count"), status.alias("mapping_status")
    )


def cluster_taxonomy(sequence_map: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Annotated members of each cluster by taxon."""
    return sequence_map.distinct().join(reviewed(taxonomy), "sequence_id").groupBy("cluster_id", "taxon_id").agg(
        F.min("species").alias("species"), F.count_distinct("sequence_id").alias("annotated_member_count")
    )


def browse(
    cluster_index: DataFrame, by_taxon: DataFrame | None = None, least_members: int = 1, ids: tuple[str, ...] = (), taxa: tuple[int, ...] = (),
    all_taxa: bool = False, annotated: bool = False
) -> DataFrame:
    """Clusters by size, id and any or all of some taxa."""
    out = cluster_index.filter(F.col("member_count") >= least_members)
    if ids:
        out = out.filter(F.col("cluster_id").isin(*ids))
    if taxa:
        hit = by_taxon.filter(F.col("taxon_id").isin(*taxa)).groupBy("cluster_id").agg(F.count_distinct("taxon_id").alias("n"))
        out = out.join(hit.filter(F.col("n") == len(set(taxa))) if all_taxa else hit, "cluster_id", "left_semi")
    if annotated:
        out = out.join(by_taxon, "cluster_id", "left_semi")
    return out


def statistics(members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Lengths and annotation of each cluster's sequences; a sequence with two taxa counts as none."""
    sure = reviewed(taxonomy).groupBy("sequence_id").agg(F.min("taxon_id").alias("taxon_id"), F.count_distinct("taxon_id").alias("n")).filter("n = 1").drop("n")
    rows = members.join(sure, "sequence_id", "left").withColumn("length", F.length("sequence"))
    return rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.min("length").alias("minimum_length"), F.max("length").alias("maximum_length"),
        F.avg("length").alias("mean_length"), F.median("length").alias("median_length"), F.count("taxon_id").alias("annotated_member_count"),
        F.count_distinct("taxon_id").alias("taxon_count")
    )


def extract(members: DataFrame, cluster_ids: tuple[str, ...], expected: DataFrame | None = None) -> DataFrame:
    """Members of some clusters; the filter reaches the files' statistics. Counts that
    differ from the index are an error."""
    out = members.filter(F.col("cluster_id").isin(*cluster_ids))
    if expected is not None:
        have = out.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("have"))
        bad = expected.filter(
            F.col("cluster_id").isin(*cluster_ids)
        ).join(have, "cluster_id", "left").filter("have is null or have != member_count").limit(1).collect()
        if bad:
            raise IntegrityError(f"cluster {bad[0]['cluster_id']} has {bad[0]['have']} of {bad[0]['member_count']} members")
    return out


def best_alignments(rows: DataFrame) -> DataFrame:
    """The best row of each (qseqid, sseqid): bit score, then e-value, then identity."""
    order = Window.partitionBy("qseqid", "sseqid").orderBy(
        F.col("bitscore").desc_nulls_last(), F.col("evalue").asc_nulls_last(), F.col("pident").desc_nulls_last()
    )
    return rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def audit_subclusters(membership: DataFrame, alignments: DataFrame, identity: float = 70.0, coverage: float = 80.0, evalue: float = 1e-10) -> DataFrame:
    """Whether each member's alignment to its representative holds: members that fail
    become clusters of their own. ``membership`` has representative_id and sequence_id."""
    double = membership.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    lost = membership.select(F.col("representative_id").alias("r")).distinct().join(
        membership.filter("sequence_id = representative_id").select(F.col("sequence_id").alias("r")), "r", "left_anti"
    ).limit(1)
    if not double.isEmpty() or not lost.isEmpty():
        raise IntegrityError("a sequence is in two clusters, or a representative is not in its own")
    num = ("length", "nident", "qstart", "qend", "qlen", "sstart", "send", "slen", "evalue", "bitscore")
    best = best_alignments(alignments)
    a = best.select(
        F.col("qseqid").alias("representative_id"), F.col("sseqid").alias("sequence_id"), *[F.col(c).cast("double").alias(c) for c in num],
        F.lit(True).alias("__hit")
    )
    pct = lambda x, y: F.try_divide(100 * x, y)
    a = a.withColumn("pident", pct(F.col("nident"), F.col("length"))).withColumn(
        "representative_coverage", pct(F.abs(F.col("qend") - F.col("qstart")) + 1, F.col("qlen"))
    ).withColumn("member_coverage", pct(F.abs(F.col("send") - F.col("sstart")) + 1, F.col("slen")))
    rows = membership.join(a, ["representative_id", "sequence_id"], "left")
    c = F.col
    finite = F.lit(True)
    for x in (*num, "pident"):
        finite = finite & c(x).isNotNull() & ~F.isnan(x) & (F.abs(c(x)) != float("inf"))
    valid = finite & (c("qlen") > 0) & (c("slen") > 0) & (c("length") > 0) & c("nident").between(0, c("length")) & (
        F.floor("nident") == c("nident")
    ) & (c("evalue") >= 0) & c("pident").between(0, 100) & c("representative_coverage").between(0, 100) & c("member_coverage").between(0, 100)
    for x, n in (("qstart", "qlen"), ("qend", "qlen"), ("sstart", "slen"), ("send", "slen")):
        valid = valid & c(x).between(1, c(n))
    passes = (c("pident") >= identity) & (
        c("representative_coverage") >= coverage
    ) & (c("member_coverage") >= coverage) & (c("evalue") <= evalue) & (c("bitscore") > 20)
    status = F.when(
        c("sequence_id") == c("representative_id"), "CENTROID_SELF"
    ).when(c("__hit").isNull(), "NO_REALIGNMENT").when(~F.coalesce(valid, F.lit(False)), "INVALID_REALIGNMENT").when(passes, "EXACT_THRESHOLDS_PASS").otherwise("EXACT_THRESHOLDS_FAIL")
    rows = rows.withColumn("alignment_status", status)
    kept = F.when(c("alignment_status").isin("CENTROID_SELF", "EXACT_THRESHOLDS_PASS"), c("representative_id")).otherwise(c("sequence_id"))
    rows = rows.withColumn("audited_representative_id", kept).withColumn(
        "subcluster_id", F.concat(F.lit("sub_"), F.substring(F.sha2(c("audited_representative_id").cast("binary"), 256), 1, 24))
    )
    return rows.select(
        "subcluster_id", "audited_representative_id", "sequence_id", c("representative_id").alias("native_representative_id"), "alignment_status",
        "pident", "representative_coverage", "member_coverage", "evalue", "bitscore"
    )


def subclusters(audited: DataFrame) -> DataFrame:
    """Sizes of audited sub-clusters and the least passing identity and coverages."""
    ok = F.col("alignment_status") == "EXACT_THRESHOLDS_PASS"
    least = lambda x: F.min(F.when(ok, F.col(x)))
    return audited.groupBy("subcluster_id").agg(
        F.min("audited_representative_id").alias("representative_id"), F.count(F.lit(1)).alias("member_count"),
        F.count_if(~F.col("alignment_status").isin("CENTROID_SELF", "EXACT_THRESHOLDS_PASS")).alias("rescued_singleton_count"),
        least("pident").alias("minimum_passing_identity"), least("representative_coverage").alias("minimum_passing_representative_coverage"),
        least("member_coverage").alias("minimum_passing_member_coverage")
    )


def alignment_columns(aligned: DataFrame, reference: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gap share, consensus and Shannon entropy of each column of aligned rows
    (sequence_id, sequence); residues are exploded and counted, partial counts first."""
    known = F.col("residue").isin(*AMINO_ACIDS)
    cells = aligned.select(
        *keys, (F.col("sequence_id") == reference).alias("is_reference"), F.posexplode(F.split("sequence", "")).alias("p", "residue")
    ).filter("residue != ''").withColumn("alignment_column", F.col("p") + 1)
    per = cells.groupBy(*keys, "alignment_column", "residue").agg(F.count(F.lit(1)).alias("c"), F.bool_or("is_reference").alias("at_reference"))
    n = F.sum("c")
    total = per.groupBy(*keys, "alignment_column").agg(
        n.alias("n"), F.sum(F.when(F.col("residue") == "-", F.col("c")).otherwise(0)).alias("gaps"),
        F.sum(F.when(known, F.col("c")).otherwise(0)).alias("known"),
        F.sum(F.when(known, F.col("c") * F.log2(F.col("c").cast("double")))).alias("clogc"), F.max(F.when(known, F.col("c"))).alias("top"),
        F.min(F.when(known, F.struct((-F.col("c")).alias("neg"), F.col("residue"))))["residue"].alias("consensus_residue"),
        F.bool_or(F.col("at_reference") & (F.col("residue") != "-")).alias("in_reference")
    )
    k = F.col("known").cast("double")
    place = F.sum(F.col("in_reference").cast("long")).over(Window.partitionBy(*keys).orderBy("alignment_column"))
    return total.select(
        *keys, "alignment_column", F.when(F.col("in_reference"), place).alias("reference_position"),
        (F.col("gaps") / F.col("n")).alias("gap_fraction"), (k / F.col("n")).alias("canonical_residue_fraction"), "consensus_residue",
        F.try_divide(F.col("top").cast("double"), k).alias("consensus_fraction_of_known"),
        F.when(k > 0, F.log2(k) - F.col("clogc") / k).alias("shannon_entropy_bits")
    )


def alignment_members(aligned: DataFrame, reference: str, scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Identity and overlap of each aligned row with the reference row; with ``scores`` of
    residue pairs also their sum over comparable sites."""
    ref = aligned.filter(F.col("sequence_id") == reference).select(F.col("sequence").alias("r"))  # one row
    rows = aligned.crossJoin(F.broadcast(ref.limit(1)))
    known = F.array(*map(F.lit, AMINO_ACIDS))
    pairs = F.zip_with(F.split("r", ""), F.split("sequence", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(pairs, lambda x: F.array_contains(known, x["a"]) & F.array_contains(known, x["b"]))
    overlap = F.size(F.filter(pairs, lambda x: (x["a"] != "-") & (x["b"] != "-") & (x["a"] != "") & (x["b"] != "")))
    bare = lambda c: F.length(F.replace(F.col(c), F.lit("-"), F.lit("")))
    out = rows.select(
        "sequence_id", F.lit(reference).alias("reference_id"), bare("sequence").cast("long").alias("sequence_length"),
        F.size(both).cast("long").alias("comparable_residue_count"),
        F.try_divide(
            F.size(F.filter(both, lambda x: x["a"] == x["b"])).cast("double"), F.size(both).cast("double")
        ).alias("identity_to_reference_fraction"),
        F.try_divide(overlap.cast("double"), bare("r").cast("double")).alias("reference_overlap_fraction"),
        F.try_divide(overlap.cast("double"), bare("sequence").cast("double")).alias("member_overlap_fraction"), both.alias("__both")
    )
    if scores:
        table = F.create_map(*[x for (a, b), v in sorted(scores.items()) for x in (F.lit(a + b), F.lit(float(v)))])
        out = out.withColumn(
            "score_sum", F.aggregate("__both", F.lit(0.0), lambda s, x: s + F.coalesce(F.element_at(table, F.concat(x["a"], x["b"])), F.lit(0.0)))
        )
    return out.drop("__both")
