"""Candidate taxa of species labels from a taxonomy dump's name and node files.

Both files are text with fields between tab, bar and tab. Labels meet names by their
normalised form in one equi join; a label with one taxon is PENDING_REVIEW, with several
AMBIGUOUS, with none UNMAPPED, and nothing is ever reviewed here. Lineages are made for the
taxa that labels met, by pointer doubling: a round joins the lineages found so far with
pointers twice as long, so a tree of depth d takes log2 d rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..functions.text import sorted_list
from ..tables import discard, written

#: Files of a dump, and the class of the name that a taxon goes by.
NAMES, NODES, SCIENTIFIC = "names.dmp", "nodes.dmp", "scientific name"


def _rows(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t", -1)
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    bad = rows.filter((F.size("p") < len(columns)) | F.get("p", F.lit(0)).try_cast("long").isNull()).limit(1).collect()
    if bad:
        raise InputError(f"{path}: not a row of {', '.join(columns)}: {bad[0]['p'][0][:80]}")
    return rows.select(*[F.trim(F.get("p", F.lit(i))).alias(c) for i, c in enumerate(columns)])


def names(spark: SparkSession, path: str) -> DataFrame:
    """taxon_id, name and name_class of every name."""
    rows = _rows(spark, path, ("taxon_id", "name", "unique_name", "name_class"))
    return rows.select(F.col("taxon_id").cast("long").alias("taxon_id"), "name", "name_class")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """taxon_id, parent_taxon_id (null for the root) and rank; a taxon twice is an error."""
    rows = _rows(spark, path, ("taxon_id", "parent_taxon_id", "rank"))
    out = rows.select(F.col("taxon_id").cast("long").alias("taxon_id"), F.col("parent_taxon_id").try_cast("long").alias("parent_taxon_id"), "rank")
    twice = out.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise IntegrityError(f"{path}: taxon {twice[0]['taxon_id']} comes twice")
    return out.withColumn("parent_taxon_id", F.nullif("parent_taxon_id", F.col("taxon_id")))


def normal(name: Column) -> Column:
    """A name without case and with single spaces; underscores are spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, "_", " "), r"\s+", " ")))


def lineages(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """taxon_id, ancestor, depth (0 for the taxon itself) for the taxa in ``asked``
    (taxon_id), from ``tree`` (taxon_id, parent_taxon_id)."""
    far = written(tree.filter("parent_taxon_id is not null").select(F.col("taxon_id").alias("at"), F.col("parent_taxon_id").alias("up")), "pointers")
    paths = written(asked.select("taxon_id", F.col("taxon_id").alias("ancestor"), F.lit(0).alias("depth")).distinct(), "paths")
    step = 1
    while True:
        more = paths.join(far, paths["ancestor"] == far["at"]).select("taxon_id", F.col("up").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        more = written(more, "more")
        if more.isEmpty():
            discard(far, more)
            return paths
        loop = more.filter("taxon_id = ancestor").limit(1).collect()
        if loop:
            raise IntegrityError(f"taxon {loop[0]['taxon_id']} is its own ancestor")
        longer = written(paths.unionByName(more), "paths")
        again = longer.groupBy("taxon_id", "ancestor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if again:
            raise IntegrityError(f"taxon {again[0]['ancestor']} is its own ancestor")
        next_ = far.select(F.col("at").alias("mid"), F.col("up").alias("end"))
        doubled = written(far.join(next_, far["up"] == next_["mid"]).select("at", F.col("end").alias("up")), "pointers")
        discard(paths, more, far)
        paths, far, step = longer, doubled, 2 * step


def candidates(species: DataFrame, all_names: DataFrame, tree: DataFrame, source_date: str, source_version: str) -> DataFrame:
    """A row a species_label: mapping_status, taxon, its name, rank and lineage (ids, names
    and ranks from the root, without the taxon), the classes of the names that matched, and
    all candidates of an ambiguous label."""
    import datetime

    try:
        datetime.date.fromisoformat(source_date)
    except ValueError as error:
        raise InputError("the dump's date is no ISO date") from error
    if not source_version.strip():
        raise InputError("the dump's version is empty")
    labels = species.select("species_label")
    bad = labels.groupBy("species_label").agg(F.count(F.lit(1)).alias("n")).filter(
        "n > 1 or species_label is null or trim(species_label) = ''"
    ).limit(1).collect()
    if bad:
        raise InputError("species labels are unique and not empty")
    met = labels.withColumn("k", normal(F.col("species_label"))).join(all_names.select(normal(F.col("name")).alias("k"), "taxon_id", "name_class"), "k")
    per = met.groupBy("species_label", "taxon_id").agg(sorted_list(F.col("name_class")).alias("classes"))
    per = written(per, "matches")
    counted = per.groupBy("species_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("taxon_id").alias("taxon_id"), F.first("classes").alias("classes"),
        F.array_join(F.transform(F.array_sort(F.collect_list("taxon_id")), lambda t: t.cast("string")), ";").alias("candidate_taxon_ids")
    )
    found = labels.join(counted, "species_label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    paths = lineages(per.select("taxon_id").distinct(), tree)
    plain = all_names.filter(F.col("name_class") == SCIENTIFIC).groupBy("taxon_id").agg(F.min("name").alias("name"))
    known = tree.select(F.col("taxon_id").alias("ancestor"), "rank").join(plain.withColumnRenamed("taxon_id", "ancestor"), "ancestor", "left")
    steps = written(paths.join(known, "ancestor", "left"), "steps")
    lost = steps.filter("name is null").limit(1).collect()
    if lost:
        raise InputError(f"taxon {lost[0]['ancestor']} has no scientific name, or no node")
    along = F.sort_array(F.collect_list(F.struct("depth", "ancestor", "name", "rank")), asc=False)
    lists = steps.groupBy("taxon_id").agg(along.alias("x"))
    joined = lambda f: F.array_join(F.transform(F.filter("x", lambda s: s["depth"] > 0), f), ";")
    own = F.element_at("x", -1)
    lists = lists.select(
        F.col("taxon_id").alias("of"), own["name"].alias("accepted_species_name"), own["rank"].alias("taxon_rank"),
        joined(lambda s: s["ancestor"].cast("string")).alias("lineage_taxon_ids"), joined(lambda s: s["name"]).alias("lineage_names"),
        joined(lambda s: s["rank"]).alias("lineage_ranks")
    )
    one = found.withColumn("of", F.when(F.col("n") == 1, F.col("taxon_id"))).drop("taxon_id").join(lists, "of", "left")
    status = F.when(F.col("n") == 0, "UNMAPPED").when(F.col("n") == 1, "PENDING_REVIEW").otherwise("AMBIGUOUS")
    return one.select(
        "species_label", status.alias("mapping_status"), F.col("of").alias("taxon_id"), "accepted_species_name", "taxon_rank", "lineage_taxon_ids",
        "lineage_names", "lineage_ranks", F.when(F.col("n") == 1, F.col("classes")).alias("matched_name_classes"),
        F.when(F.col("n") > 1, F.col("candidate_taxon_ids")).alias("candidate_taxon_ids"), F.lit(source_date).alias("source_date"),
        F.lit(source_version).alias("taxonomy_release")
    )
