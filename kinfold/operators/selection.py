"""Taxonomic selections: contradictions, scope, and the coverage tree that shows them.

A taxonomy is its closure (ancestor, descendant, depth; see ``taxonomy.closure``).
Terminals are nodes without children. Sets of taxa stay tables; what the driver sees are
one row of flags and the name of a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError
from ..schemas import KEY
from .taxonomy import SELECTORS, Selector, common_root

#: How a node that a selector names is shown, and in words.
DIRECT = {
    "REQUIRED_EXACT": "REQUIRED_EXACT", "INCLUDE_CLADE": "INCLUDE_CLADE", "ONLY_IN_CLADE": "ONLY_IN_SCOPE", "EXCLUDE_EXACT": "EXCLUDED_EXACT",
    "EXCLUDE_CLADE": "EXCLUDED_CLADE"
}
CLADES = ("INCLUDE_CLADE", "ONLY_IN_CLADE", "EXCLUDE_CLADE")
WORDS = {
    "REQUIRED_EXACT": "has {}", "INCLUDE_CLADE": "has a member of {}", "ONLY_IN_CLADE": "has members of {} alone", "EXCLUDE_EXACT": "lacks {}",
    "EXCLUDE_CLADE": "has no member of {}"
}
MOST_NODES = 5000


def _of(selectors: list[Selector], kind: str) -> list:
    return [s.taxon_id for s in selectors if s.kind == kind]


def terminals(closed: DataFrame) -> DataFrame:
    """taxon_id of nodes without children."""
    parents = closed.filter("depth > 0").select(F.col("ancestor").alias("descendant")).distinct()
    return closed.filter("depth = 0").join(parents, "descendant", "left_anti").select(F.col("descendant").alias("taxon_id"))


def _flagged(taxa: DataFrame, closed: DataFrame, selectors: list[Selector]) -> DataFrame:
    """``taxa`` with the array ``over`` of the selected taxa that they are or lie below."""
    named = closed.filter(F.col("ancestor").isin([s.taxon_id for s in selectors])).select("ancestor", F.col("descendant").alias("taxon_id"))
    over = named.groupBy("taxon_id").agg(F.collect_set("ancestor").alias("over"))
    return taxa.join(over, "taxon_id", "left").withColumn("over", F.coalesce("over", F.array().cast(over.schema["over"].dataType)))


def _below(taxon_id) -> Column:
    return F.array_contains("over", F.lit(taxon_id))


def _excluded(selectors: list[Selector]) -> Column:
    exact = F.col("taxon_id").isin(_of(selectors, "EXCLUDE_EXACT")) if _of(selectors, "EXCLUDE_EXACT") else F.lit(False)
    for t in _of(selectors, "EXCLUDE_CLADE"):
        exact = exact | _below(t)
    return exact


def _allowed(selectors: list[Selector]) -> Column:
    out = F.lit(True)
    for t in _of(selectors, "ONLY_IN_CLADE"):
        out = out & _below(t)
    return out


def check_contradictions(selectors: list[Selector], closed: DataFrame, represented: DataFrame) -> None:
    """Selectors that no group could meet fail before any group is read.

    One pass over the terminals counts, for each condition, the taxa that could meet it.
    """
    wanted, only = _of(selectors, "REQUIRED_EXACT"), _of(selectors, "ONLY_IN_CLADE")
    if both := sorted(set(map(str, wanted)) & set(map(str, _of(selectors, "EXCLUDE_EXACT")))):
        raise InputError(f"required and excluded: {'; '.join(both)}")
    rows = terminals(closed).join(represented.select("taxon_id").distinct().withColumn("here", F.lit(True)), "taxon_id", "left")
    rows = _flagged(rows, closed, selectors).withColumn("here", F.coalesce("here", F.lit(False)))
    free, allowed, here = ~_excluded(selectors), _allowed(selectors), F.col("here")
    conditions = []
    for t in wanted:
        conditions.append((f"required taxon {t} is covered by an exclusion", (F.col("taxon_id") != F.lit(t)) | free, "all"))
        if only:
            conditions.append((f"required taxon {t} lies outside the only-in scope", (F.col("taxon_id") == F.lit(t)) & allowed, "any"))
    for t in _of(selectors, "INCLUDE_CLADE"):
        conditions.append((f"included clade {t} has no represented terminal", _below(t) & here, "any"))
        conditions.append((f"included clade {t} is covered by exclusions", _below(t) & here & free, "any"))
        if only:
            conditions.append((f"included clade {t} has nothing inside the only-in scope", _below(t) & here & free & allowed, "any"))
    if only:
        conditions.append(("the only-in scope has no represented terminal", allowed & here, "any"))
        conditions.append(("exclusions cover the only-in scope", allowed & free, "any"))
    if not conditions:
        return
    found = rows.agg(*[(F.bool_and(c) if how == "all" else F.bool_or(c)).alias(f"c{i}") for i, (_, c, how) in enumerate(conditions)]).first()
    for i, (said, _, _) in enumerate(conditions):
        if not found[i]:
            raise InputError(said)


def summary(selectors: list[Selector]) -> str:
    """The selection in words, in the order of its kinds."""
    said = [WORDS[k].format(t) for k in SELECTORS for t in sorted(_of(selectors, k), key=str)]
    return "A group that " + ", ".join(said) + "." if said else "Any group."


def check_species_rows(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """``rows`` of groups and species, or an error if a species comes twice in a group."""
    twice = rows.groupBy(*keys, "species_label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise IntegrityError(f"species {twice[0]['species_label']} comes twice in {twice[0]['group_id']}")
    return rows


def outside_scope(present: DataFrame, closed: DataFrame, selectors: list[Selector], keys: tuple[str, ...] = KEY) -> DataFrame:
    """Taxa of each group outside the scope of the selection: outside all included clades, or
    where none is included outside the only-in scope; nothing if there is neither."""
    include, only = _of(selectors, "INCLUDE_CLADE"), _of(selectors, "ONLY_IN_CLADE")
    rows = present.filter("taxon_id is not null").select(*keys, "taxon_id").distinct()
    if not include and not only:
        return rows.limit(0)
    taxa = _flagged(rows.select("taxon_id").distinct(), closed, selectors)
    inside = F.lit(False)
    for t in include:
        inside = inside | _below(t)
    return rows.join(taxa.filter(~(inside if include else _allowed(selectors))).select("taxon_id"), "taxon_id", "left_semi").select(*keys, "taxon_id")


def expected_taxa(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Expected taxa (taxon_id, included, reason, source) that are included; unknown or inner
    nodes and repeats are errors."""
    for bad, what in (
        (rows.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "comes twice"),
        (rows.join(terminals(closed), "taxon_id", "left_anti"), "is no terminal of the taxonomy")
    ):
        if first := bad.limit(1).collect():
            raise InputError(f"expected taxon {first[0]['taxon_id']} {what}")
    return rows.filter("included")


def selection_states(nodes: DataFrame, closed: DataFrame, selectors: list[Selector]) -> DataFrame:
    """``nodes`` (taxon_id) with selection_state, is_selected and is_excluded: what selectors
    say of the node itself, else what it inherits from clades above."""
    rows = _flagged(nodes, closed, selectors)
    named = F.lit(None).cast("string")
    for t in dict.fromkeys(s.taxon_id for s in selectors):
        states = [DIRECT[s.kind] for s in selectors if s.taxon_id == t]
        named = F.when(F.col("taxon_id") == F.lit(t), "|".join(states)).otherwise(named)
    inherited = F.lit(False)
    for t in _of(selectors, "EXCLUDE_CLADE"):
        inherited = inherited | _below(t)
    scope = F.lit("WITHIN_ONLY_IN_SCOPE") if _of(selectors, "ONLY_IN_CLADE") else F.lit("NEUTRAL")
    state = F.coalesce(named, F.when(inherited, "EXCLUDED_BY_CLADE").when(_allowed(selectors), scope).otherwise("NEUTRAL"))
    direct = F.split(named, r"\|")
    selected = F.coalesce(F.exists(direct, lambda s: ~s.startswith("EXCLUDED")), F.lit(False))
    excluded = F.when(named.isNotNull(), F.exists(direct, lambda s: s.startswith("EXCLUDED"))).otherwise(inherited)
    return rows.select(*nodes.columns, state.alias("selection_state"), selected.alias("is_selected"), excluded.alias("is_excluded"))


def coverage_tree(
    closed: DataFrame, selectors: list[Selector], represented: DataFrame, expected: DataFrame, outside: DataFrame, compact: bool = False,
    most: int = MOST_NODES
) -> DataFrame:
    """A row a node of the smallest tree over all represented, expected and selected
    terminals: its parent, states, and how many terminals below it are represented,
    expected without data, and excluded. With ``compact`` inner nodes that have one child
    and no selector are left out, and their child takes their place."""
    ends = terminals(closed)
    if lost := outside.join(represented, "taxon_id", "left_anti").limit(1).collect():
        raise InputError(f"taxon {lost[0]['taxon_id']} has hits but is not represented")
    here, hoped = represented.select("taxon_id").distinct(), expected.select("taxon_id").distinct()
    shown = here.unionByName(hoped)
    clades = [s.taxon_id for s in selectors if s.kind in CLADES]
    exact = [s.taxon_id for s in selectors if s.kind not in CLADES]
    if clades:
        under = closed.filter(F.col("ancestor").isin(clades)).select(F.col("descendant").alias("taxon_id"))
        shown = shown.unionByName(under.join(ends, "taxon_id", "left_semi"))
    if exact:
        shown = shown.unionByName(closed.filter((F.col("depth") == 0) & F.col("ancestor").isin(exact)).select(F.col("ancestor").alias("taxon_id")))
    shown = shown.distinct()
    top = common_root(closed, shown).collect()  # one row
    if not top:
        raise InputError("the displayed taxa have no common root")
    root = top[0]["root_id"]
    below = closed.filter(F.col("ancestor") == F.lit(root)).select(F.col("descendant").alias("ancestor"))
    over = shown.join(closed, shown["taxon_id"] == closed["descendant"]).join(below, "ancestor", "left_semi").select("ancestor", "taxon_id")
    nodes = over.select(F.col("ancestor").alias("taxon_id")).distinct()
    if nodes.limit(most + 1).count() > most:
        raise InputError(f"the tree has more than {most} nodes; narrow the expected taxa")
    parents = closed.filter("depth = 1").select(F.col("descendant").alias("taxon_id"), F.col("ancestor").alias("parent"))
    if compact:
        kids = nodes.join(parents, "taxon_id").groupBy(F.col("parent").alias("taxon_id")).agg(F.count(F.lit(1)).alias("kids"))
        kept = (F.col("taxon_id") == F.lit(root)) | (F.coalesce("kids", F.lit(0)) != 1)
        kept = kept | F.col("taxon_id").isin([s.taxon_id for s in selectors]) if selectors else kept
        nodes = nodes.join(kids, "taxon_id", "left").filter(kept).select("taxon_id")
        above = closed.filter("depth > 0").join(nodes.withColumnRenamed("taxon_id", "ancestor"), "ancestor", "left_semi")
        parents = above.groupBy(F.col("descendant").alias("taxon_id")).agg(F.min_by("ancestor", "depth").alias("parent"))
    flags = _flagged(shown, closed, selectors).withColumn("is_out", _excluded(selectors)).drop("over")
    marks = [(here, "is_represented"), (hoped, "is_expected"), (outside.select("taxon_id").distinct(), "is_outside_selected_scope")]
    for rows, name in marks:
        flags = flags.join(rows.withColumn(name, F.lit(True)), "taxon_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    counts = over.join(flags, "taxon_id").groupBy(F.col("ancestor").alias("node")).agg(
        F.count_if("is_represented").alias("represented_terminal_count"),
        F.count_if(F.col("is_expected") & ~F.col("is_represented")).alias("expected_no_data_terminal_count"),
        F.count_if("is_out").alias("excluded_terminal_count"),
        F.count(F.lit(1)).alias("terminal_count"),
    )
    own = flags.select(F.col("taxon_id").alias("t"), *[n for _, n in marks])
    rows = selection_states(nodes, closed, selectors).join(counts, F.col("taxon_id") == F.col("node")).join(
        own, F.col("taxon_id") == F.col("t"), "left"
    ).drop("node", "t")
    rows = rows.withColumns({n: F.coalesce(n, F.lit(False)) for _, n in marks})
    state = (
        F.when(F.col("is_outside_selected_scope"), "OUTSIDE_SELECTED_SCOPE_WITH_HITS")
        .when(F.col("is_represented"), "REPRESENTED_IN_INPUT")
        .when(F.col("is_expected"), "EXPECTED_NO_DATA")
        .when(F.col("represented_terminal_count") > 0, "ANCESTOR_OF_REPRESENTED")
        .otherwise("NOT_IN_EXPECTED_UNIVERSE")
    )
    placed = rows.join(parents, "taxon_id", "left").withColumn("parent_taxon_id", F.when(F.col("taxon_id") != F.lit(root), F.col("parent")))
    return placed.withColumn("coverage_state", state).drop("parent")


def reconcile(tree: DataFrame) -> None:
    """A coverage tree has one root, a parent for every other node, no cycle, and counts
    that add up; or it is an error."""
    sums = tree.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_distinct("taxon_id").alias("names"), F.count_if(F.col("parent_taxon_id").isNull()).alias("roots"),
        F.max("terminal_count").alias("most")
    ).first()
    if sums["roots"] != 1 or sums["nodes"] != sums["names"]:
        raise IntegrityError(f"a coverage tree with {sums['roots']} roots and {sums['nodes'] - sums['names']} repeated nodes")
    up = tree.select(F.col("taxon_id").alias("parent_taxon_id"), F.col("terminal_count").alias("above"))
    joined = tree.filter("parent_taxon_id is not null").join(up, "parent_taxon_id", "left")
    if joined.filter("above is null").limit(1).count():
        raise IntegrityError("a coverage tree with a parent that is not displayed")
    own = F.when(F.col("is_represented") | F.col("is_expected"), 1).otherwise(0)
    parts = joined.groupBy(F.col("parent_taxon_id").alias("taxon_id")).agg(F.sum("terminal_count").alias("parts"))
    wrong = tree.join(parts, "taxon_id").filter(
        (F.col("terminal_count") < F.col("parts")) | (F.col("terminal_count") > F.col("parts") + own)
    ).limit(1).collect()
    if wrong:
        raise IntegrityError(f"terminals below {wrong[0]['taxon_id']} do not add up")
