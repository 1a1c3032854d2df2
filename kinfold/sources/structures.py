"""Structure evidence: atom records of predicted models against the exact sequences.

A model is text in fixed columns. Its first model's residues are the alpha carbons of its
ATOM records, in the order in which they stand; they have to spell the expected sequence,
residue by residue, with finite places and a confidence between 0 and 100. Numbers that
outgrow their columns are hybrid-36: letters lead where digits no longer suffice. Everything is
column functions over a row a model, so models are spread over tasks and none is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IntegrityError

#: Most bytes of a model.
MOST_BYTES = 20_000_000
#: Names of residues in three letters and in one.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K",
    "MET": "M", "MSE": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"
}


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """model_id (the file's name without its suffix) and text of each model below a path."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(name.alias("model_id"), F.col("value").alias("text"))


def _field(line: Column, first: int, last: int) -> Column:
    return F.trim(F.substring(line, first, last - first + 1))


def hybrid36(number: Column, width: int) -> Column:
    """A number from 0 as text of a width: digits, then numbers of base 36 that begin with a
    capital, then such that begin with a small letter; null beyond those."""
    first, letters = 10 * 36 ** (width - 1), 26 * 36 ** (width - 1)
    over = number.cast("long") - 10**width
    based = lambda n: F.conv((n + first).cast("string"), 10, 36)
    digits = F.lpad(number.cast("string"), width, " ")
    return F.when(over < 0, digits).when(over < letters, based(over)).when(over < 2 * letters, F.lower(based(over - letters)))


def from_hybrid36(text: Column, width: int) -> Column:
    """The number of such a text; null for another."""
    first, letters = 10 * 36 ** (width - 1), 26 * 36 ** (width - 1)
    based = F.conv(F.upper(text), 36, 10).cast("long") - first + 10**width
    large, small = (text.rlike(f"^[{a}-{z}][0-9{a}-{z}]{{{width - 1}}}$") for a, z in ("AZ", "az"))
    return F.when(large, based).when(small, based + letters).otherwise(text.try_cast("long")).cast("int")


def residues(models: DataFrame) -> DataFrame:
    """model_id, residue_index (from 1), chain_id, pdb_residue_number, residue, confidence,
    x, y, z of every alpha carbon of a model's first part; a number that is none is null."""
    lines = F.split(F.element_at(F.split("text", r"(?m)^ENDMDL", 2), 1), r"\r?\n")
    atoms = models.select("model_id", F.posexplode(lines).alias("line_number", "line")).filter(
        F.col("line").startswith("ATOM  ") & (_field(F.col("line"), 13, 16) == "CA")
    )
    line = F.col("line")
    number = lambda a, b, kind: _field(line, a, b).try_cast(kind)
    names = F.create_map(*[F.lit(x) for pair in sorted(RESIDUES.items()) for x in pair])
    cut = atoms.select(
        "model_id", "line_number", F.substring(line, 22, 1).alias("chain_id"), from_hybrid36(_field(line, 23, 26), 4).alias("pdb_residue_number"), F.substring(line, 27, 1).alias("insertion"),
        F.coalesce(F.try_element_at(names, F.upper(_field(line, 18, 20))), F.lit("X")).alias("residue"), number(61, 66, "double").alias("confidence"),
        *[number(31 + 8 * k, 38 + 8 * k, "double").alias(c) for k, c in enumerate("xyz")], F.coalesce(number(55, 60, "double"), F.lit(0.0)).alias("occupancy"),
    )
    # of places that a residue may have, the one that is filled most, then the first
    best = F.struct(-F.col("occupancy"), F.col("line_number"))
    per = cut.groupBy("model_id", "chain_id", "pdb_residue_number", "insertion").agg(
        F.min("line_number").alias("line_number"), F.min_by(F.struct("residue", "confidence", "x", "y", "z"), best).alias("a")
    )
    ordered = per.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "chain_id", "pdb_residue_number", "a"))).alias("all"))  # a model's residues
    found = ordered.select("model_id", F.posexplode("all").alias("at", "r"))
    return found.select("model_id", (F.col("at") + 1).alias("residue_index"), "r.chain_id", "r.pdb_residue_number", "r.a.*")


def judge(models: DataFrame, expected: DataFrame) -> DataFrame:
    """model_id, residue_count, mean_confidence and status of each model of ``expected``
    (model_id, sequence): VALID, or the first of NO_MODEL, TOO_LARGE, NO_ATOMS,
    SEQUENCE_DIFFERS, CONFIDENCE_OUT_OF_RANGE and PLACE_NOT_FINITE that holds."""
    fits = F.coalesce(F.col("confidence").between(0, 100), F.lit(False))
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("residue_index", "residue"))), lambda r: r["residue"]), "")
    per = residues(models).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("residue_count"), F.avg("confidence").alias("mean_confidence"), spelled.alias("spelled"),
        F.bool_and(fits).alias("fits"), F.bool_and(finite).alias("finite")
    )
    sizes = models.select("model_id", F.octet_length("text").alias("size"))
    met = expected.select("model_id", "sequence").join(sizes, "model_id", "left").join(per, "model_id", "left")
    status = (
        F.when(F.col("size").isNull(), "NO_MODEL").when(F.col("size") > MOST_BYTES, "TOO_LARGE").when(F.col("residue_count").isNull(), "NO_ATOMS")
        .when(F.col("spelled") != F.col("sequence"), "SEQUENCE_DIFFERS").when(~F.col("fits"), "CONFIDENCE_OUT_OF_RANGE").when(~F.col("finite"), "PLACE_NOT_FINITE").otherwise("VALID")
    )
    return met.select("model_id", F.coalesce("residue_count", F.lit(0)).alias("residue_count"), "mean_confidence", status.alias("status"))


def evidence(models: DataFrame, expected: DataFrame) -> DataFrame:
    """The residues of all models of ``expected``; one that is not valid is an error."""
    bad = judge(models, expected).filter("status != 'VALID'").orderBy("model_id").limit(1).collect()
    if bad:
        raise IntegrityError(f"model {bad[0]['model_id']}: {bad[0]['status']}")
    return residues(models).join(expected.select("model_id"), "model_id", "left_semi")
