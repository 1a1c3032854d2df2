"""Text columns: literal search, identifiers, aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: identifiers of the form database|accession|entry.
PIPE_ID = r"^(sp|tr)\|[^|\s]+\|[^|\s]+$"
#: Fixed value: suffixes of protein files.
FASTA_SUFFIX = r"(?i)(\.fa|\.faa|\.fasta|\.fas|\.pep)(\.gz)?$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_literal(c: Column, value: str) -> Column:
    """Case-insensitive substring search in which no character is a wildcard."""
    return F.contains(F.lower(c), F.lower(F.lit(value.strip())))


def species_label(file_name: Column) -> Column:
    """A protein file's name without its suffix."""
    return F.regexp_replace(file_name, FASTA_SUFFIX, "")


def pipe_part(member: Column, part: int) -> Column:
    """Part 2 (accession) or 3 (entry) of a database|accession|entry identifier, else null."""
    return F.when(member.rlike(PIPE_ID), F.split_part(member, F.lit("|"), F.lit(part)))


def sorted_list(c: Column, separator: str = ";") -> Column:
    """Aggregate: distinct values in order, joined; empty text for none."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def categories(c: Column) -> Column:
    """Parts of a list separated by ``;`` or ``,``, trimmed; UNCLASSIFIED for none."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("UNCLASSIFIED")))


def header_aliases(member: Column, header: Column) -> Column:
    """Array of (alias_type, alias_value, mapping_tier) that a sequence header gives its member.

    Member id, first word of the header and accession stand in tier 1, as do gene and
    locus tags; the entry in tier 2; a version suffix dropped from any of them adds one.
    """
    header = F.coalesce(header, F.lit(""))
    primary = F.regexp_extract(header, r"^\s*(\S+)", 1)
    piped = F.when(primary != "", primary).otherwise(member)

    def one(kind: Column, value: Column, tier: Column) -> Column:
        return F.struct(kind.alias("alias_type"), value.alias("alias_value"), tier.cast("long").alias("mapping_tier"))

    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract(piped, r"(?i)^(?:sp|tr)\|([^|]+)\|([^|\s]+)", k), F.lit(""))

    tags = F.transform(
        F.regexp_extract_all(header, F.lit(r"(?i)((?:^|\s)(?:GN|gene|gene_id|locus|locus_tag)=[^\s;]+)"), 1),
        lambda t: one(F.lower(F.trim(F.split_part(t, F.lit("="), F.lit(1)))), F.regexp_extract(t, "=(.*)$", 1), F.lit(1))
    )
    found = F.concat(
        F.array(
            one(F.lit("member_id"), member, F.lit(1)), one(F.lit("raw_primary_token"), F.when(primary != member, primary), F.lit(1)),
            one(F.lit("uniprot_accession"), part(1), F.lit(1)), one(F.lit("uniprot_entry"), part(2), F.lit(2))
        ),
        tags
    )
    bare = F.transform(
        found,
        lambda a: one(
            F.concat(a["alias_type"], F.lit("_versionless")),
            F.when(a["alias_value"].rlike(r"\.\d+$"), F.regexp_replace(a["alias_value"], r"\.\d+$", "")), a["mapping_tier"] + 1
        )
    )
    return F.filter(F.concat(found, bare), lambda a: a["alias_value"].isNotNull() & (a["alias_value"] != ""))


def tree_id_of(group_id: Column) -> Column:
    """``N1.HOG0000012`` to ``OG0000012``; others as they are."""
    return F.regexp_replace(group_id, r"^N\d+\.HOG(\d+)$", "OG$1")


def normal_protein(sequence: Column, aligned: bool = False) -> Column:
    """A sequence in upper case without white space or, unless it is aligned, stops at its
    end; of an aligned one dots become dashes. Null where it is empty or no protein."""
    bare = F.upper(F.regexp_replace(sequence, r"\s+", ""))
    value = F.translate(bare, ".", "-") if aligned else F.regexp_replace(bare, r"\*+$", "")
    letters = F.replace(value, F.lit("-"), F.lit("")) if aligned else value
    return F.when(letters.rlike("^[A-Z]+$"), value)


def description(header: Column) -> Column:
    """The text of a header after its first word."""
    return F.regexp_extract(F.coalesce(header, F.lit("")), r"^\S+\s+(.*)$", 1)


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of parts with NUL between them, as deterministic samples use it."""
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)
