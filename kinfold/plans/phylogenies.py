"""Trees of parts: deep, with nodes of one, two or three children, one for each part that
was sold. The lines of a part are leaves in the order of their keys; each node holds the
one below it and one or two further leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import trees
from ..schemas import KEY
from ..tables import written
from .bridge import RUN, Bridge
from .queries import query, r

#: The level of the node that the k-th leaf hangs on; the first two share the lowest.
_LEVEL = "greatest(2, 1 + floor(2 * k / 3))"
_LEAVES = f"""leaves AS (SELECT *, {_LEVEL}::BIGINT AS level FROM (SELECT 'P' || l_partkey AS tree_id, 'M' || k AS leaf, l_quantity / 8 AS length, k FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_suppkey, l_extendedprice) AS k FROM lineitem))),
    tops AS (SELECT tree_id, max(level) AS top FROM leaves GROUP BY tree_id), inner_nodes AS (SELECT tree_id, unnest(range(2, top + 1)) AS level, top FROM tops)"""


def _leaves(b: Bridge) -> DataFrame:
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice")  # a part's lines
    rows = b.table("lineitem").withColumn("k", F.row_number().over(order))
    return rows.select(
        "l_partkey", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("tree_id"), F.concat(F.lit("M"), F.col("k").cast("string")).alias("leaf"),
        (F.col("l_quantity") / 8).alias("length"), "k", F.expr(_LEVEL).cast("long").alias("level")
    )


def _part_trees(b: Bridge) -> DataFrame:
    """run_id, tree_type, tree_id, newick, written."""
    leaf = F.concat("leaf", F.lit(":"), F.col("length").cast("string"))
    # by the key that the lines were numbered by: no second shuffle
    per = _leaves(b).groupBy("l_partkey", "tree_id").agg(F.array_sort(F.collect_list(F.struct("k", "level", leaf.alias("text")))).alias("x"))
    node = lambda s: F.concat(F.lit("("), s["text"], F.lit(")N"), s["level"].cast("string"))
    grown = F.aggregate(
        "x",
        F.struct(F.lit("").alias("text"), F.lit(2).cast("long").alias("level")),
        lambda s, v: F.struct(F.when(s["text"] == "", v["text"]).when(s["level"] == v["level"], F.concat(s["text"], F.lit(","), v["text"])).otherwise(F.concat(node(s), F.lit(":0.25,"), v["text"])).alias("text"), v["level"].alias("level")),
    )
    rows = per.select("tree_id", grown.alias("s")).select("tree_id", F.concat(node(F.col("s")), F.lit(";")).alias("newick"))
    return written(rows.select(F.lit(RUN).alias("run_id"), F.lit("GENE_TREE").alias("tree_type"), "tree_id", "newick"), "trees")


@query(f"""WITH {_LEAVES} SELECT tree_id, leaf AS node_name, true AS is_leaf, length AS branch_length, 1::BIGINT AS descendant_leaf_count FROM leaves
    UNION ALL SELECT i.tree_id, 'N' || i.level, false, CASE WHEN i.level < any_value(top) THEN 0.25 END, count(*) FILTER (l.level <= i.level) FROM inner_nodes i JOIN leaves l USING (tree_id) GROUP BY i.tree_id, i.level""")  # fmt: skip
def part_tree_nodes(b: Bridge) -> DataFrame:
    return trees.tree_nodes(_part_trees(b)).select("tree_id", "node_name", "is_leaf", "branch_length", "descendant_leaf_count")


@query(
    f"WITH {_LEAVES} SELECT tree_id, 'N' || level AS parent, leaf AS child, length AS branch_length FROM leaves UNION ALL SELECT tree_id, 'N' || (level + 1), 'N' || level, 0.25 FROM inner_nodes WHERE level < top"
)
def part_tree_edges(b: Bridge) -> DataFrame:
    edges = trees.tree_edges(trees.tree_nodes(_part_trees(b)))
    return edges.select("tree_id", F.col("parent_node_name").alias("parent"), F.col("child_node_name").alias("child"), "branch_length")


@query(
    f"""WITH {_LEAVES} SELECT a.tree_id AS group_id, least(a.leaf, b.leaf) AS member_a, greatest(a.leaf, b.leaf) AS member_b, round(a.length + b.length + 0.25 * (b.level - a.level), 6) AS distance FROM leaves a JOIN leaves b ON a.tree_id = b.tree_id AND a.k < b.k"""
)
def part_patristic_pairs(b: Bridge) -> DataFrame:
    member = F.struct(F.col("leaf").alias("member_id"), F.create_map(F.lit("none"), F.lit("NONE")).alias("aliases"))
    groups = _leaves(b).groupBy("l_partkey", F.col("tree_id").alias("group_id")).agg(F.collect_list(member).alias("members"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select(
        *[F.lit(v).alias(k) for k, v in zip(KEY[:3], (RUN, "HOG", "N0"), strict=True)], "group_id", F.lit("").alias("legacy_orthogroup_id"), "members"
    )
    pairs, _ = trees.patristic_distances(groups, _part_trees(b))
    return pairs.select("group_id", F.least("member_a", "member_b").alias("member_a"), F.greatest("member_a", "member_b").alias("member_b"), r("distance"))


@query(f"WITH {_LEAVES} SELECT tree_id, tree_id AS same FROM tops")
def part_tree_payloads(b: Bridge) -> DataFrame:
    """Trees whose text is what their packed payload unpacks to."""
    packed = _part_trees(b).withColumn("x", trees.encode_payload("newick")).select("tree_id", "newick", "x.*")
    return packed.select("tree_id", F.when(trees.decode_payload("payload", "size", "sha256") == F.col("newick"), F.col("tree_id")).alias("same"))


@query(
    f"""WITH {_LEAVES}, path AS (SELECT tree_id, leaf, k, length + 0.25 * (top - level) AS x FROM leaves JOIN tops USING (tree_id)) SELECT tree_id, leaf AS name, round(x, 6) AS x, (k - 1)::DOUBLE AS y FROM path"""
)
def part_phylogram_leaves(b: Bridge) -> DataFrame:
    keep = _leaves(b).select("leaf").distinct()
    return trees.phylograms(_part_trees(b), keep).filter("is_leaf").select("tree_id", "name", r("x"), "y")
