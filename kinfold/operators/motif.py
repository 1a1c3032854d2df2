"""Sequence motifs: exact ends and regular expressions over members, by group and species."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.text import sorted_list

#: Fixed value: residues that an exact motif may name.
RESIDUES = set("ACDEFGHIKLMNPQRSTVWY")


def checked(expression: str, mode: str) -> str:
    """A valid search: SUFFIX, REGEX or C_TERMINAL_REGEX (anchored at the end if it is not)."""
    if not expression or len(expression) > 500:
        raise InputError("a motif has 1 to 500 characters")
    if mode == "SUFFIX":
        motif = expression.strip().upper()
        if not motif or len(motif) > 100 or set(motif) - RESIDUES:
            raise InputError("an exact motif has 1 to 100 canonical residues")
        return motif
    if mode not in ("REGEX", "C_TERMINAL_REGEX"):
        raise InputError(f"unknown motif mode {mode}")
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", expression):
        raise InputError("look-around and back-references are not supported")
    expression = re.sub(r"\\Z$", "$", expression)
    try:
        re.compile(expression)
    except re.error as e:
        raise InputError(f"not a regular expression: {e}") from e
    return expression if mode == "REGEX" or expression.endswith("$") else f"(?:{expression})$"


def matches(sequence: Column, expression: str, mode: str) -> Column:
    return F.endswith(sequence, F.lit(expression)) if mode == "SUFFIX" else sequence.rlike(expression)


def matched_text(sequence: Column, expression: str, mode: str) -> Column:
    return F.right(sequence, F.lit(len(expression))) if mode == "SUFFIX" else F.regexp_extract(sequence, expression, 0)


def group_members(members: DataFrame, sequences: DataFrame, expression: str, mode: str = "SUFFIX") -> DataFrame:
    """Distinct members with sequence_available, motif_match and matched_text; a member
    without a sequence stays, unassessed."""
    expression = checked(expression, mode)
    m = members.select("group_id", "species_label", "member_id").distinct()
    s = sequences.select("species_label", "member_id", F.upper(F.regexp_replace("sequence", r"\*+$", "")).alias("clean"))
    out = m.join(s, ["species_label", "member_id"], "left").withColumn("sequence_available", F.coalesce(F.length("clean") > 0, F.lit(False)))
    hit = F.col("sequence_available") & F.coalesce(matches(F.col("clean"), expression, mode), F.lit(False))
    return out.withColumn("motif_match", hit).withColumn("matched_text", F.when(F.col("motif_match"), matched_text(F.col("clean"), expression, mode)))


def group_summary(
    assessed: DataFrame, species: tuple[str, ...] = (), least_species: int = 1, least_proteins: int = 1, threshold: float = 0.0,
    required: tuple[str, ...] = ()
) -> DataFrame:
    """Groups in which enough of the assessed members of the analysis species match.

    ``assessed`` comes from :func:`group_members`; no ``species`` means all.
    """
    own = F.col("species_label").isin(*species) if species else F.lit(True)
    have, hit = F.col("sequence_available"), F.col("motif_match")

    def distinct_if(c: Column) -> Column:
        return F.count_distinct(F.when(c, F.col("species_label")))

    def list_if(c: Column) -> Column:
        return F.nullif(sorted_list(F.when(c, F.col("species_label")), "; "), F.lit(""))

    out = assessed.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("total_member_count"), F.count_if(have).alias("sequence_count"), F.count_if(~have).alias("unavailable_sequence_count"),
        F.count_distinct("species_label").alias("species_count"), distinct_if(have).alias("assessed_species_count"),
        F.count_if(hit).alias("matching_sequence_count"), distinct_if(hit).alias("matching_species_count"),
        F.count_if(own).alias("analysis_member_count"), F.count_if(own & have).alias("analysis_sequence_count"),
        distinct_if(own & have).alias("analysis_assessed_species_count"), F.count_if(own & hit).alias("analysis_matching_sequence_count"), distinct_if(own & hit).alias("analysis_matching_species_count"),
        list_if(F.lit(True)).alias("represented_species"), list_if(hit).alias("matching_species"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = out.withColumns(
        {
            "sequence_coverage": ratio("sequence_count", "total_member_count"),
            "matching_fraction": ratio("matching_sequence_count", "sequence_count"),
            "analysis_matching_fraction": ratio("analysis_matching_sequence_count", "analysis_sequence_count")
        }
    )
    out = out.filter(
        (
            F.col("analysis_assessed_species_count") >= least_species
        ) & (F.col("analysis_sequence_count") >= least_proteins) & (F.col("analysis_matching_fraction") >= threshold)
    )
    for s in required:
        out = out.filter(F.array_contains(F.split("matching_species", "; "), s))
    return out


def species_distribution(assessed: DataFrame) -> DataFrame:
    """By species: assessed, matching, unavailable, and a verdict."""
    out = assessed.groupBy("group_id", "species_label").agg(
        F.count(F.lit(1)).alias("published"), F.count_if("sequence_available").alias("assessed"), F.count_if("motif_match").alias("matching")
    )
    verdict = F.when(F.col("assessed") == 0, "Sequence unavailable").when(F.col("matching") == 0, "Assessed; no match").when(
        F.col("matching") == F.col("assessed"), "All assessed proteins match"
    ).otherwise("Some assessed proteins match")
    return out.withColumn("unavailable", F.col("published") - F.col("assessed")).withColumn(
        "match_fraction", F.try_divide(F.col("matching").cast("double"), F.col("assessed").cast("double"))
    ).withColumn("species_result", verdict)


def lineage_filter(
    assessed: DataFrame, analysis: DataFrame, least_fraction: float, required: list[DataFrame] = (), excluded: list[DataFrame] = ()
) -> DataFrame:
    """Groups in which at least ``least_fraction`` of the assessed analysis species match,
    each required set of species has a match and no excluded set has one; sets are tables
    of species_label. Adds analysis_species_match_fraction."""
    per = assessed.groupBy("group_id", "species_label").agg(F.bool_or("sequence_available").alias("have"), F.bool_or("motif_match").alias("hit"))
    marks = [analysis, *required, *excluded]
    for k, rows in enumerate(marks):
        per = per.join(
            rows.select("species_label").distinct().withColumn(f"in_{k}", F.lit(True)), "species_label", "left"
        ).withColumn(f"in_{k}", F.coalesce(f"in_{k}", F.lit(False)))
    seen, found = F.count_if(F.col("in_0") & F.col("have")), F.count_if(F.col("in_0") & F.col("hit"))
    met = [F.bool_or(F.col(f"in_{k}") & F.col("hit")).alias(f"met_{k}") for k in range(1, len(marks))]
    out = per.groupBy("group_id").agg(F.try_divide(found.cast("double"), seen.cast("double")).alias("analysis_species_match_fraction"), *met)
    out = out.filter(F.col("analysis_species_match_fraction") >= least_fraction)
    for k in range(1, len(marks)):
        out = out.filter(F.col(f"met_{k}") if k <= len(required) else ~F.col(f"met_{k}"))
    return out.select("group_id", "analysis_species_match_fraction")
