"""Expression evidence: identifier mapping, contexts, summaries by member and group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.text import header_aliases, sorted_list
from ..schemas import KEY

MEMBER = ["run_id", "species_label", "member_id"]


def preferred_units(atlas: DataFrame) -> DataFrame:
    """Rows of each species' and experiment's unit: TPM where there is any, else FPKM."""
    unit = F.upper("expression_unit")
    choice = atlas.groupBy(F.upper("species_column").alias("__s"), F.col("experiment_accession").alias("__e")).agg(
        F.when(F.bool_or(unit == "TPM"), "TPM").when(F.bool_or(unit == "FPKM"), "FPKM").alias("selected_expression_unit")
    )
    return atlas.join(
        choice, (F.upper("species_column") == F.col("__s")) & (F.col("experiment_accession") == F.col("__e"))
    ).filter(F.upper("expression_unit") == F.col("selected_expression_unit")).drop("__s", "__e")


def check_atlas(atlas: DataFrame) -> None:
    """Unknown units and negative, infinite or undefined values are errors."""
    v = F.col("expression_value").cast("double")
    bad = atlas.filter(
        ~F.coalesce(F.upper("expression_unit").isin("TPM", "FPKM"), F.lit(False)) | v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    ).limit(1).collect()
    if bad:
        raise InputError(f"expression row {bad[0].asDict()} has an unknown unit or value")


#: Columns that a table of metadata needs, and those that tell its rows apart.
METADATA = ("species_column", "experiment_accession", "sample_or_condition")


def check_metadata(metadata: DataFrame) -> None:
    """Columns that are missing, and two rows of one species, experiment and sample, are
    errors; species are the same without case."""
    if lost := [c for c in METADATA if c not in metadata.columns]:
        raise InputError(f"metadata without {', '.join(lost)}")
    key = [F.upper("species_column").alias("species_column"), *METADATA[1:]]
    twice = metadata.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise InputError(f"metadata of {', '.join(str(twice[0][c]) for c in METADATA)} comes {twice[0]['n']} times")


def aliases(sequences: DataFrame) -> DataFrame:
    """Aliases of each member, the lowest (tier, type) of each spelling without case."""
    rows = sequences.select(*MEMBER, F.explode(header_aliases(F.col("member_id"), F.col("raw_header"))).alias("a")).select(*MEMBER, "a.*")
    best = rows.groupBy(*MEMBER, F.upper("alias_value").alias("__v")).agg(F.min(F.struct("mapping_tier", "alias_type", "alias_value")).alias("b"))
    return best.select(*MEMBER, "b.alias_type", "b.alias_value", "b.mapping_tier")


def map_members(members: DataFrame, alias_rows: DataFrame, atlas: DataFrame) -> DataFrame:
    """MAPPED_UNIQUE, AMBIGUOUS or NOT_MAPPED of each member, by the genes at its lowest
    matching tier; gene ids and names match within the species only.

    The catalogue is reduced to distinct genes before any join, so contexts fan out later.
    """
    genes = atlas.filter("gene_id is not null and gene_id != ''").select(F.upper("species_column").alias("species_key"), "gene_id", "gene_name").distinct()
    keyed = genes.select(
        "species_key", "gene_id", "gene_name",
        F.explode(F.array_distinct(F.array(F.upper("gene_id"), F.upper(F.coalesce("gene_name", F.lit("")))))).alias("gene_key")
    ).filter("gene_key != ''")
    hits = alias_rows.join(keyed, (F.upper("species_label") == F.col("species_key")) & (F.upper("alias_value") == F.col("gene_key")))
    tiers = hits.groupBy(*MEMBER, "mapping_tier").agg(
        F.count_distinct("gene_id").alias("matched_gene_count"), sorted_list(F.col("gene_id")).alias("matched_gene_ids"),
        sorted_list(F.coalesce("gene_name", F.lit(""))).alias("matched_gene_names"), sorted_list(F.col("alias_value")).alias("matched_aliases")
    )
    rest = ("matched_gene_count", "matched_gene_ids", "matched_gene_names", "matched_aliases")
    best = tiers.groupBy(*MEMBER).agg(F.min(F.struct("mapping_tier", *rest)).alias("b")).select(*MEMBER, "b.*")
    scoped = members.select(*MEMBER).distinct().join(genes.select("species_key").distinct(), F.upper("species_label") == F.col("species_key"), "left_semi")
    n = F.col("matched_gene_count")
    out = scoped.join(best, MEMBER, "left")
    status = F.when(n.isNull(), "NOT_MAPPED").when(n == 1, "MAPPED_UNIQUE").otherwise("AMBIGUOUS")
    reason = F.when(
        n.isNull(), "no_exact_species_scoped_identifier_match"
    ).when(n == 1, "unique_best_tier_exact_match").otherwise("multiple_genes_at_best_mapping_tier")
    return out.select(
        *MEMBER, status.alias("mapping_status"), "mapping_tier", F.coalesce(n, F.lit(0)).alias("matched_gene_count"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in rest[1:]], reason.alias("reason")
    )


def contexts(mapping: DataFrame, atlas: DataFrame, metadata: DataFrame, positive: float = 0.5) -> DataFrame:
    """Expression records of uniquely mapped members with their metadata and context label."""
    own = mapping.filter("mapping_status = 'MAPPED_UNIQUE'").select(
        *MEMBER, F.col("matched_gene_ids").alias("gene_id"), F.upper("species_label").alias("__s"), F.upper("matched_gene_ids").alias("__g")
    )
    e = preferred_units(atlas).drop("gene_id_key").withColumn(
        "__s", F.upper("species_column")
    ).withColumn("__g", F.upper("gene_id")).drop("gene_id", "species_column")
    rows = own.join(e, ["__s", "__g"])
    keys = ["experiment_accession", "sample_or_condition"]
    m = metadata.select(F.upper("species_column").alias("__s"), *keys, "organism_part", "condition", "atlas_group_label").withColumn("__known", F.lit(True))
    out = rows.join(m, ["__s", *keys], "left")
    label = F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("organism_part", "condition", "atlas_group_label", "sample_or_condition")], F.lit("UNSPECIFIED")
    )
    status = F.when(F.col("__known").isNull(), "METADATA_NOT_MAPPED").when(
        F.coalesce("organism_part", F.lit("")) == "", "MAPPED_WITHOUT_TISSUE"
    ).otherwise("MAPPED_WITH_TISSUE")
    return out.withColumn("expression_context", label).withColumn("metadata_status", status).withColumn(
        "expression_value", F.col("expression_value").cast("double")
    ).withColumn("expression_positive", F.col("expression_value") >= positive).drop("__s", "__g", "__known")


def member_summary(mapping: DataFrame, context: DataFrame, broad: float = 0.5) -> DataFrame:
    """Evidence of each member; what is not uniquely mapped has nulls, never zeros."""
    v, yes = F.col("expression_value"), F.col("expression_positive")
    e = context.groupBy(*MEMBER).agg(
        F.max("gene_id").alias("gene_id"), F.max("gene_name").alias("gene_name"), F.count_distinct("experiment_accession").alias("experiment_count"),
        sorted_list(F.col("selected_expression_unit")).alias("selected_expression_units"), F.count(F.lit(1)).alias("context_count"),
        F.count_if(yes).alias("positive_context_count"), F.avg(F.when(yes, 1.0).otherwise(0.0)).alias("positive_context_fraction"),
        F.min(v).alias("minimum_context_expression_value"), F.max(v).alias("maximum_context_expression_value"),
        F.median(v).alias("median_context_expression_value")
    )
    out = mapping.select(*MEMBER, "mapping_status").join(e, MEMBER, "left")
    unique, seen, enough = F.col("mapping_status") == "MAPPED_UNIQUE", F.col("context_count").isNotNull(), F.col("positive_context_fraction") >= broad
    zero = {c: F.when(unique, F.coalesce(c, F.lit(0))) for c in ("experiment_count", "positive_context_count")}
    out = out.withColumn("broad_expression_supported", F.when(enough, True).when(seen, False))
    out = out.withColumn(
        "evidence_status",
        F.when(~unique, F.col("mapping_status")).when(~seen, "NO_EXPRESSION_RECORDS").when(
            enough, "BROAD_EXPRESSION_SUPPORTED"
        ).otherwise("LIMITED_OR_ZERO_EXPRESSION")
    )
    return out.withColumns(
        zero | {
            "context_count": F.when(unique, F.coalesce("context_count", F.lit(0))), "gene_id": F.coalesce("gene_id", F.lit("")),
            "gene_name": F.coalesce("gene_name", F.lit("")),
            "selected_expression_units": F.when(unique, F.coalesce("selected_expression_units", F.lit("")))
        }
    )


def group_summary(members: DataFrame, summary: DataFrame) -> DataFrame:
    """Mapped, observed and broadly expressed members and species of each group."""
    rows = members.select(*KEY, "species_label", "member_id").join(summary, MEMBER, "left")
    status, seen = F.col("mapping_status"), F.coalesce(F.col("context_count") > 0, F.lit(False))
    unique = F.coalesce(status == "MAPPED_UNIQUE", F.lit(False))
    out = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("member_count"), F.count_if(unique).alias("unique_mapped_member_count"),
        F.count_if(status == "AMBIGUOUS").alias("ambiguous_member_count"),
        F.count_if(status.isNull() | (status == "NOT_MAPPED")).alias("not_mapped_member_count"),
        F.count_if(seen).alias("expression_observed_member_count"), F.count_if("broad_expression_supported").alias("broad_expression_member_count"),
        F.count_distinct(F.when(unique, F.col("species_label"))).alias("mapped_species_count"),
        F.count_distinct(F.when(seen, F.col("species_label"))).alias("expression_observed_species_count"),
        sorted_list(F.nullif("selected_expression_units", F.lit(""))).alias("selected_expression_units")
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumn("mapping_fraction", ratio("unique_mapped_member_count", "member_count")).withColumn(
        "expression_observed_fraction", ratio("expression_observed_member_count", "unique_mapped_member_count")
    )


def heatmap(context_rows: DataFrame, column: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Median, range and counts of values by group, species and context label."""
    label = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("Unknown"))
    v = F.col("expression_value")
    return context_rows.groupBy(*keys, "species_label", label.alias("context")).agg(
        F.median(v).alias("median_value"), F.min(v).alias("minimum_value"), F.max(v).alias("maximum_value"), F.count(F.lit(1)).alias("record_count"),
        F.count_distinct("member_id").alias("member_count")
    )


def intersections(rows: DataFrame, item: str, of: str) -> DataFrame:
    """Exact combinations of ``of`` values that items have, and how many items each has."""
    return rows.groupBy(item).agg(sorted_list(F.col(of)).alias("combination")).groupBy("combination").agg(F.count(F.lit(1)).alias("item_count"))


def evidence(members: DataFrame, mapping: DataFrame, summary: DataFrame, group_ids: tuple[str, ...] = (), species: tuple[str, ...] = ()) -> DataFrame:
    """Members of groups with their mapping and expression summary; those without stay, with nulls."""
    rows = members.filter(F.col("group_id").isin(*group_ids)) if group_ids else members
    rows = rows.filter(F.col("species_label").isin(*species)) if species else rows
    more = [c for c in summary.columns if c not in MEMBER and c not in mapping.columns]
    return rows.join(
        mapping.select(*[c for c in mapping.columns if c in MEMBER or c not in rows.columns]), list(MEMBER), "left"
    ).join(summary.select(*MEMBER, *more), list(MEMBER), "left")


def context_records(members: DataFrame, context: DataFrame, group_ids: tuple[str, ...] = (), species: tuple[str, ...] = (), unit: str = "") -> DataFrame:
    """Expression records of groups' members, of one unit if named."""
    rows = members.filter(F.col("group_id").isin(*group_ids)) if group_ids else members
    rows = rows.filter(F.col("species_label").isin(*species)) if species else rows
    own = context.filter(F.col("selected_expression_unit") == unit) if unit else context
    return rows.join(own.select(*[c for c in own.columns if c in MEMBER or c not in rows.columns]), list(MEMBER))


def assessed_members(parts: list[DataFrame], assessed: DataFrame) -> DataFrame:
    """All membership relations united, of species that were assessed (species_label)."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.join(assessed.select("species_label").distinct(), "species_label", "left_semi")
