"""Typed relations: field names and types of everything that is read, joined or published.

Four types occur: string, long, double, boolean. A field is written ``name`` (string) or
``name:type``. These names and types are fixed values of the data model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}

KEY = ("run_id", "group_type", "hierarchy_node", "group_id")
_KEY = "run_id group_type hierarchy_node group_id"
_MEMBERSHIP = f"{_KEY} legacy_orthogroup_id gene_tree_parent_clade species_label member_id source_file source_row:long"
_SIZES = "member_count:long species_count:long single_copy_species_count:long max_copies_per_species:long mean_copies_per_species:double"
_SPREAD = "minimum_distance:double q05_distance:double q25_distance:double median_distance:double mean_distance:double q75_distance:double q95_distance:double maximum_distance:double population_stddev_distance:double"
_SEED = (
    "seed_protein_names seed_categories seed_review_statuses seed_ubiquitin_go_statuses seed_organisms seed_evidence_type seed_source seed_sequence_identifiers"
    " seed_sequence_species seed_protein_sequence_length:long annotation_scope focus_authority_name focus_authority_sha256"
)
_SOURCE = "evidence_type source_title source_doi source_table source_version benchmark_authority_name benchmark_authority_sha256"

#: The relations of a published resource.
FIELDS: dict[str, str] = {
    "species": "run_id species_index species_label source_fasta source_file source_line:long",
    "sequences": "run_id internal_id species_index species_label source_fasta raw_header member_id source_file source_line:long",
    "hog_memberships": _MEMBERSHIP,
    "legacy_orthogroup_memberships": _MEMBERSHIP,
    "group_statistics": f"{_KEY} legacy_orthogroup_id gene_tree_parent_clade {_SIZES} is_singleton:boolean species_labels source_file",
    "group_species_statistics": f"{_KEY} legacy_orthogroup_id gene_tree_parent_clade species_label species_member_count:long member_fraction:double source_file",
    "tree_inventory": "run_id tree_type tree_id group_id path size_bytes:long sha256",
    "tree_payloads": "run_id tree_type tree_id group_id source_path source_size_bytes:long source_sha256 payload_encoding newick_payload",
    "tree_nodes": "run_id tree_type tree_id node_id parent_node_id node_name is_leaf:boolean branch_length:double confidence:double descendant_leaf_count:long",
    "tree_edges": "run_id tree_type tree_id parent_node_id child_node_id branch_length:double",
    "pairwise_distances": f"{_KEY} member_a member_b distance_method distance:double comparable_sites:long mismatch_sites:long computation_status source_file",
    "distance_statistics": f"{_KEY} distance_method computation_status member_identifier_resolution total_member_count:long sampled_member_count:long distance_pair_count:long unresolved_pair_count:long {_SPREAD} mean_comparable_sites:double source_file failure_reason",
    "e3_seed_matches": f"{_KEY} legacy_orthogroup_id gene_tree_parent_clade seed_id matched_member_id matched_species_label matched_internal_ids match_authority {_SEED}",
    "e3_seed_catalogue_audit": (
        "seed_id enabled:boolean match_status matched_group_count:long matched_group_ids matched_member_count:long matched_member_ids"
        f" matched_species_count:long matched_species_labels match_authorities {_SEED}"
    ),
    "e3_cluster_results": (
        f"{_KEY} legacy_orthogroup_id gene_tree_parent_clade {_SIZES} is_singleton:boolean species_labels group_source_file matched_seed_count:long matched_seed_ids"
        " matched_e3_member_count:long matched_e3_member_ids matched_e3_species_count:long matched_e3_species_labels match_authorities"
        " seed_protein_names seed_categories seed_review_statuses seed_ubiquitin_go_statuses seed_organisms focus_authority_name focus_authority_sha256"
        " distance_method computation_status member_identifier_resolution total_member_count:long sampled_member_count:long distance_pair_count:long unresolved_pair_count:long"
        f" {_SPREAD} mean_comparable_sites:double failure_reason distance_source_file distance_sampling_fraction:double expected_sample_pair_count:long"
        " resolved_pair_fraction:double full_group_distance_matrix:boolean distance_interquartile_range:double distance_range:double distance_coefficient_of_variation:double"
    ),
    "benchmark_marker_matches": (
        f"{_KEY} legacy_orthogroup_id marker_id protein_identifier protein_entry marker_name benchmark_class benchmark_subclass domain_architecture"
        f" matched_member_id matched_species_label match_authority {_SOURCE}"
    ),
    "benchmark_marker_audit": (
        "marker_id protein_identifier protein_entry marker_name benchmark_class benchmark_subclass enabled:boolean match_status"
        f" matched_group_count:long matched_group_ids matched_member_count:long matched_member_ids {_SOURCE}"
    ),
    "benchmark_cluster_results": (
        f"{_KEY} legacy_orthogroup_id gene_tree_parent_clade {_SIZES} profile_ids profile_classes profile_subclasses membership_roles distance_method computation_status"
        f" member_identifier_resolution total_member_count:long sampled_member_count:long distance_pair_count:long unresolved_pair_count:long {_SPREAD}"
        " distance_interquartile_range:double distance_coefficient_of_variation:double sampling_fraction:double pairwise_rows_persisted:boolean failure_reason"
    ),
    "benchmark_matched_controls": "run_id anchor_group_type anchor_hierarchy_node anchor_group_id control_group_type control_hierarchy_node control_group_id control_rank:long matching_score:double anchor_member_count:long control_member_count:long anchor_species_count:long control_species_count:long anchor_mean_copies_per_species:double control_mean_copies_per_species:double anchor_single_copy_fraction:double control_single_copy_fraction:double control_reused:boolean matching_variables",
    "benchmark_group_profiles": f"{_KEY} profile_id profile_class profile_subclass membership_role marker_count:long marker_ids protein_identifiers matched_member_count:long matched_member_ids matched_species_labels authority_names authority_sha256s",
    "benchmark_background_statistics": "run_id profile_id profile_class profile_subclass comparison_scale metric eligible_group_count:long minimum_value:double q25_value:double median_value:double mean_value:double q75_value:double maximum_value:double population_stddev_value:double",
    "benchmark_contrasts": "run_id contrast_id target_profile_id reference_profile_id comparison_scale metric target_group_count:long reference_group_count:long target_median:double reference_median:double median_difference:double median_difference_ci_low:double median_difference_ci_high:double cliffs_delta:double mann_whitney_u:double p_value_two_sided:double fdr_family fdr_q_value:double status interpretation",
    "benchmark_individual_comparisons": f"{_KEY} background_profile_id comparison_scale metric observed_value:double background_group_count:long background_median:double difference_from_background_median:double empirical_percentile:double lower_tail_p_value:double upper_tail_p_value:double two_sided_p_value:double fdr_family fdr_q_value:double leave_one_out:boolean status",
    "benchmark_cluster_classifications": f"{_KEY} matched_control_count:long mean_distance:double mean_distance_control_median:double mean_distance_control_percentile:double central_divergence_class distance_sd:double distance_sd_control_median:double distance_sd_control_percentile:double heterogeneity_class classification_rule status",
    "expression_identifier_aliases": "run_id species_label internal_id member_id alias_type alias_value mapping_tier:long source",
    "expression_member_mapping": "run_id species_label member_id mapping_status mapping_tier:long matched_gene_count:long matched_gene_ids matched_gene_names matched_aliases reason",
    "expression_member_summary": "run_id species_label member_id mapping_status gene_id gene_name experiment_count:long selected_expression_units expression_unit_count:long context_count:long positive_context_count:long positive_context_fraction:double minimum_context_expression_value:double maximum_context_expression_value:double median_context_expression_value:double broad_expression_supported:boolean evidence_status",
    "expression_group_summary": f"{_KEY} member_count:long unique_mapped_member_count:long ambiguous_member_count:long not_mapped_member_count:long expression_observed_member_count:long broad_expression_member_count:long mapped_species_count:long expression_observed_species_count:long mapping_fraction:double expression_observed_fraction:double selected_expression_units",
    "expression_context": (
        "run_id species_label member_id gene_id gene_name source_database experiment_accession expression_unit sample_or_condition atlas_group_label assay_ids assay_count:long"
        " organism_part developmental_stage genotype cultivar treatment condition expression_context metadata_status expression_value_statistic expression_summary_type"
        " expression_value:double expression_minimum:double expression_lower_quartile:double expression_median:double expression_upper_quartile:double expression_maximum:double"
        " expression_positive:boolean expression_source_file expression_source_file_sha256 metadata_source_file metadata_source_file_sha256"
    ),
    "protein_sequences": "internal_id species_label source_fasta member_id raw_header sequence",
    "clusters": "cluster_id member_count:long row_start:long row_groups",
    "sequence_map": "sequence_id cluster_id",
    "cluster_taxonomy": "cluster_id taxon_id:long species annotated_member_count:long",
    "identifier_bridge": "input_id sequence_id",
}


def struct(relation: str) -> T.StructType:
    """The schema of a relation."""
    fields = [f.partition(":") for f in FIELDS[relation].split()]
    return T.StructType([T.StructField(name, _TYPES[kind or "string"]) for name, _, kind in fields])


def conform(df: DataFrame, relation: str) -> DataFrame:
    """``df`` in the relation's columns and types; missing columns are null, and empty text
    becomes null in typed columns but stays empty text in strings."""
    have = set(df.columns)
    out = []
    for f in struct(relation).fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(df.schema[f.name].dataType, T.StringType):
            out.append(F.nullif(F.trim(F.col(f.name)), F.lit("")).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def empty(spark: SparkSession, relation: str) -> DataFrame:
    """The relation without rows, which stands in for an optional one that is absent."""
    return spark.createDataFrame([], struct(relation))
