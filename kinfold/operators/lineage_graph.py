"""Reviewed lineages reconciled into one rooted graph.

Each lineage states, for every taxon on it, a name, a rank, a parent, a depth and a
release. What the first label (in order) says of a taxon holds; a lineage that says
otherwise is rejected with the first reason that applies, as is one whose taxa do not end
at the root that the first label's does. Cycles cannot be told from one lineage: they are
found among all edges by pointer doubling, and the lineages through them are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..tables import discard, written
from .taxonomy import SELECTORS, Selector, check_selection, closure

_SAID = ("name", "rank", "parent_taxon_id", "depth", "release")
#: Reasons in the order in which they are looked for.
REASONS = (
    "NO_TERMINAL", "LENGTHS_DIFFER", "TAXON_REPEATS", "RELEASES_MIXED", "NAME_DIFFERS", "RANK_DIFFERS", "PARENT_DIFFERS", "DEPTH_DIFFERS",
    "OTHER_ROOT", "CYCLE"
)


def statements(lineages: DataFrame) -> DataFrame:
    """species_label, taxon_id, name, rank, parent_taxon_id, depth, release, is_terminal for
    every taxon of lineages (species_label, taxon_id, taxon_name, taxon_rank, authority,
    release, and arrays lineage_taxon_ids, lineage_names, lineage_ranks from the root)."""
    ids, names, ranks = (F.concat(f"lineage_{of}", F.array(own)) for of, own in (("taxon_ids", "taxon_id"), ("names", "taxon_name"), ("ranks", "taxon_rank")))
    steps = F.transform(
        ids,
        lambda t, i: F.struct(
            t.alias("taxon_id"), F.get(names, i).alias("name"), F.get(ranks, i).alias("rank"),
            F.when(i > 0, F.get(ids, i - 1)).alias("parent_taxon_id"), i.alias("depth"), (i == F.size(ids) - 1).alias("is_terminal")
        )
    )
    return lineages.select("species_label", "release", F.explode(steps).alias("x")).select("species_label", "release", "x.*")


def reconcile(lineages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (taxon_id, name, rank, parent_taxon_id, depth, release, is_terminal) of the
    lineages that agree, and rejected (species_label, reason) of the others, both written."""
    sizes = [F.size(c) for c in ("lineage_taxon_ids", "lineage_names", "lineage_ranks")]
    first_release = lineages.groupBy(F.col("authority").alias("__a")).agg(F.min_by("release", "species_label").alias("__release"))
    met = lineages.join(first_release, F.col("authority").eqNullSafe(F.col("__a")), "left")
    whole = F.concat("lineage_taxon_ids", F.array("taxon_id"))
    own = (
        F.when(F.coalesce(F.trim("taxon_id"), F.lit("")) == "", "NO_TERMINAL").when((sizes[0] != sizes[1]) | (sizes[0] != sizes[2]), "LENGTHS_DIFFER")
        .when(F.size(F.array_distinct(whole)) != F.size(whole), "TAXON_REPEATS").when(~F.col("release").eqNullSafe(F.col("__release")), "RELEASES_MIXED")
    )
    judged = written(met.withColumn("reason", own).drop("__a", "__release"), "judged")
    said = written(statements(judged.filter("reason is null")), "said")
    order = F.col("species_label")
    held = said.groupBy(F.col("taxon_id").alias("t")).agg(F.min_by(F.struct(*_SAID), order).alias("held"))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"held.{c}"))
    why = F.when(differs("name"), "NAME_DIFFERS").when(differs("rank"), "RANK_DIFFERS").when(
        differs("parent_taxon_id"), "PARENT_DIFFERS"
    ).when(differs("depth"), "DEPTH_DIFFERS").when(differs("release"), "RELEASES_MIXED")
    against = said.join(held, said["taxon_id"] == held["t"]).withColumn("reason", why).filter("reason is not null")
    at = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    against = written(against.groupBy("species_label").agg(F.min_by("reason", at).alias("reason")), "against")
    kept = said.join(against, "species_label", "left_anti")
    root = kept.filter("parent_taxon_id is null").agg(F.min_by("taxon_id", "species_label").alias("root"))  # one row
    others = kept.filter("parent_taxon_id is null").join(root, F.col("taxon_id") != F.col("root")).select(
        "species_label", F.lit("OTHER_ROOT").alias("reason")
    ).distinct()
    others = written(others, "others")
    kept = written(kept.join(others, "species_label", "left_anti"), "kept")
    looped = written(_on_cycles(kept.filter("parent_taxon_id is not null").select("taxon_id", "parent_taxon_id").distinct()), "looped")
    cyclic = written(kept.join(looped, "taxon_id", "left_semi").select("species_label", F.lit("CYCLE").alias("reason")).distinct(), "cyclic")
    good = kept.join(cyclic, "species_label", "left_anti")
    nodes = good.groupBy("taxon_id").agg(
        *[F.first(c).alias(c) for c in ("name", "rank", "parent_taxon_id", "depth")], F.min("release").alias("release"),
        F.bool_or("is_terminal").alias("is_terminal")
    )
    rejected = judged.filter("reason is not null").select("species_label", "reason").unionByName(against).unionByName(others).unionByName(cyclic)
    out = written(nodes, "nodes"), written(rejected, "rejected")
    discard(judged, said, against, others, kept, looped, cyclic)
    return out


def _on_cycles(edges: DataFrame) -> DataFrame:
    """taxon_id of those that never reach a taxon without a parent: pointers are doubled
    until they have gone as many steps as there are edges; who still looks at a taxon with
    a parent is on a cycle or behind one."""
    pointers = written(edges.select(F.col("taxon_id").alias("at"), F.col("parent_taxon_id").alias("up")), "pointers")
    n, far = pointers.count(), 1
    while far <= n:
        ahead = pointers.select(F.col("at").alias("mid"), F.col("up").alias("end"))
        moved = written(pointers.join(ahead, pointers["up"] == ahead["mid"]).select("at", F.col("end").alias("up")), "pointers")
        discard(pointers)
        pointers, far = moved, 2 * far
        if pointers.isEmpty():
            break
    return pointers.select(F.col("at").alias("taxon_id"))


def graph(lineages: DataFrame) -> DataFrame:
    """The nodes of lineages that all agree under one root; any that is rejected is an error."""
    if lineages.isEmpty():
        raise InputError("a graph needs reviewed lineages")
    nodes, rejected = reconcile(lineages)
    bad = rejected.orderBy("species_label").limit(1).collect()
    if bad:
        raise InputError(f"lineage of {bad[0]['species_label']}: {bad[0]['reason']}")
    return nodes


def make_selection(nodes: DataFrame, **asked: Sequence[str]) -> list[Selector]:
    """Selectors of a graph by kind (required_exact, include_clade, only_in_clade,
    exclude_exact, exclude_clade), in a fixed order and once each. Unknown taxa, exact
    selectors of taxa that are no terminal, and contradictions are errors."""
    kinds = {k.lower(): k for k in SELECTORS}
    if unknown := set(asked) - set(kinds):
        raise InputError(f"unknown selector {sorted(unknown)[0]}")
    out = [Selector(kinds[k], t) for k in kinds for t in sorted({str(v).strip() for v in asked.get(k, ())} - {""})]
    wanted = sorted({s.taxon_id for s in out})
    known = {r["taxon_id"]: r["is_terminal"] for r in nodes.filter(F.col("taxon_id").isin(wanted)).select("taxon_id", "is_terminal").collect()}  # the taxa asked for
    for s in out:
        if s.taxon_id not in known:
            raise InputError(f"unknown taxon {s.taxon_id}")
        if s.kind.endswith("_EXACT") and not known[s.taxon_id]:
            raise InputError(f"{s.kind} needs a terminal taxon, not {s.taxon_id}")
    edges = nodes.select(F.col("taxon_id").alias("child"), F.col("parent_taxon_id").alias("parent"))
    check_selection(out, closure(edges))
    return out
