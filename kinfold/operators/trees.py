"""Trees as tables: nodes and edges, payloads, patristic distances of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..functions import newick
from ..functions.text import tree_id_of
from ..schemas import KEY
from ..tables import written


#: Rows that are Python objects at once, and rows that a task gives back at once.
FEW, ROWS = 64, 50_000
_NONE = np.zeros(1, np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, a few of them unpacked at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, FEW):
            yield from batch.slice(k, FEW).to_pylist()


def _spread(values: list[str | None], of: np.ndarray) -> pa.Array:
    """A column of texts, each of them named by its place in ``values``."""
    return pa.array(values, pa.string()).take(pa.array(of))


def _pair_batch(blocks: list[tuple]) -> pa.RecordBatch:
    """One batch of blocks of pairs."""
    of = np.repeat(np.arange(len(blocks)), [len(x[2]) for x in blocks])
    names = [m for x in blocks for m in x[1]]
    starts = np.cumsum([0] + [len(x[1]) for x in blocks[:-1]])
    a, b = (_spread(names, np.concatenate([x[k] + start for x, start in zip(blocks, starts, strict=True)])) for k in (2, 3))
    distance = pa.array(np.concatenate([x[4] for x in blocks]), from_pandas=True)
    keys = [_spread([x[0][k] for x in blocks], of) for k in range(len(KEY))]
    ways, reasons = (_spread([x[k] for x in blocks], of) for k in (5, 6))
    return pa.record_batch(
        [*keys, a, b, distance, ways, reasons], names=[*KEY, "member_a", "member_b", "distance", "member_identifier_resolution", "failure_reason"]
    )


def _group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Key, members, places of either end, distances, way and reason of blocks of pairs."""
    for r in _rows(batches):
        key = [r[k] for k in KEY]
        try:
            if r["newick"] is None:
                raise InputError("no tree")
            paths = newick.Paths(newick.parse(r["newick"]))
            members = sorted(m["member_id"] for m in r["members"])
            aliases = {m["member_id"]: dict(m["aliases"] or {}) for m in r["members"]}
            leaf, way = newick.resolve_leaves(paths, members, aliases)
            if len(members) < 2:
                raise InputError("fewer than two members")
            for a, b, distance in paths.pairs([leaf[m] for m in members]):
                yield key, members, a, b, distance, way, None
        except InputError as e:
            yield key, [None], _NONE, _NONE, np.array([np.nan]), None, str(e)


def group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups (KEY, members, newick) in batches of about ``ROWS``; no more are held."""
    held, n = [], 0
    for block in _group_blocks(batches):
        held.append(block)
        n += len(block[2])
        if n >= ROWS:
            yield _pair_batch(held)
            held, n = [], 0
    if held:
        yield _pair_batch(held)


def tree_nodes(trees: DataFrame) -> DataFrame:
    """Node rows of trees (run_id, tree_type, tree_id, newick), a tree at a time in a task;
    ``parent_node_name`` lets edges name both ends without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for r in _rows(batches):
            tree = newick.parse(r["newick"])
            held.append((r, tree))
            n += len(tree.parent)
            if n >= ROWS:
                yield _node_batch(held)
                held, n = [], 0
        if held:
            yield _node_batch(held)

    found = trees.select("run_id", "tree_type", "tree_id", "newick").mapInArrow(
        run,
        "run_id string, tree_type string, tree_id string, node long, parent long, node_name string, is_leaf boolean, branch_length double, confidence double, descendant_leaf_count long, parent_node_name string"
    )
    node = lambda c: F.concat("tree_id", F.lit(":n"), F.col(c).cast("string"))
    return found.select(
        "run_id", "tree_type", "tree_id", node("node").alias("node_id"), F.when(F.col("parent") < 0, "").otherwise(node("parent")).alias("parent_node_id"),
        "node_name", "is_leaf", "branch_length", "confidence", "descendant_leaf_count", "parent_node_name"
    )


def _node_batch(held: list[tuple[dict, newick.Tree]]) -> pa.RecordBatch:
    """The nodes of some trees, in preorder."""
    sizes = [len(tree.parent) for _, tree in held]
    of = np.repeat(np.arange(len(held)), sizes)
    parent = np.array([p for _, tree in held for p in tree.parent], np.int64)
    starts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    names = pa.array([x for _, tree in held for x in tree.name], pa.string())
    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    columns = {c: _spread([r[c] for r, _ in held], of) for c in ("run_id", "tree_type", "tree_id")} | {
        "node": pa.array(np.arange(len(of)) - starts), "parent": pa.array(parent), "node_name": names,
        "is_leaf": pa.array([x for _, tree in held for x in tree.leaves()]), "branch_length": number([x for _, tree in held for x in tree.length]),
        "confidence": number([x for _, tree in held for x in tree.support]),
        "descendant_leaf_count": pa.array([x for _, tree in held for x in tree.leaf_counts()]),
        "parent_node_name": names.take(pa.array(np.where(parent < 0, 0, parent + starts), mask=parent < 0))
    }
    return pa.RecordBatch.from_pydict(columns)


def tree_edges(nodes: DataFrame) -> DataFrame:
    """An edge for each node below another, with the names of its ends if the nodes have them."""
    names = [F.col("parent_node_name"), F.col("node_name").alias("child_node_name")] if "parent_node_name" in nodes.columns else []
    return nodes.filter("parent_node_id != ''").select(
        "run_id", "tree_type", "tree_id", "parent_node_id", F.col("node_id").alias("child_node_id"), "branch_length", *names
    )


def preferred_trees(inventory: DataFrame) -> DataFrame:
    """One tree of each id: a resolved one before an original; two of a kind are an error."""
    twice = inventory.groupBy("run_id", "tree_type", "tree_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise InputError(f"two {twice[0]['tree_type']} trees for {twice[0]['tree_id']}")
    rank = F.when(F.lower("tree_type").contains("resolved"), 0).otherwise(1)
    return inventory.withColumn("__r", F.row_number().over(Window.partitionBy("run_id", "tree_id").orderBy(rank, "tree_type"))).filter("__r = 1").drop("__r")


@F.pandas_udf(T.StructType([T.StructField("payload", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType())]))
def encode_payload(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([newick.encode(t) for t in text], columns=["payload", "size", "sha256"])


@F.pandas_udf(T.StringType())
def decode_payload(payload: pd.Series, size: pd.Series, sha256: pd.Series) -> pd.Series:
    return pd.Series([newick.decode(p, int(n), h) for p, n, h in zip(payload, size, sha256, strict=True)])


def patristic_distances(groups: DataFrame, trees: DataFrame, most: int = 250) -> tuple[DataFrame, DataFrame]:
    """Pairs and failures of groups (KEY, legacy_orthogroup_id, members: array of structs
    member_id, aliases: map; a bounded sample) over trees (tree_id, newick).

    A group takes the tree of its legacy id, else the one its own id names. Groups without
    a tree, or whose members cannot be placed, get a reason and no pairs.
    """
    ids = F.array_distinct(F.filter(F.array(F.nullif("legacy_orthogroup_id", F.lit("")), tree_id_of(F.col("group_id"))), lambda x: x.isNotNull()))
    wanted = groups.select(*KEY, "members", F.posexplode(ids).alias("__rank", "tree_id")).join(trees.select("tree_id", "newick"), "tree_id", "left")
    first = wanted.groupBy(*KEY).agg(
        F.first("members").alias("members"), F.min(F.when(F.col("newick").isNotNull(), F.struct("__rank", "tree_id", "newick"))).alias("t")
    )

    kind = ", ".join(f"{k} string" for k in KEY) + ", member_a string, member_b string, distance double, member_identifier_resolution string, failure_reason string"
    found = first.select(*KEY, "members", "t.newick").mapInArrow(group_pairs, kind)
    pairs = found.filter("failure_reason is null").drop("failure_reason").withColumn("distance_method", F.lit("patristic_branch_length"))
    return pairs, found.filter("failure_reason is not null").select(*KEY, "failure_reason")


def tree_leaves(trees: DataFrame) -> DataFrame:
    """tree_id and leaf: the names of each tree's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for r in _rows(batches):
            tree = newick.parse(r["newick"])
            held.append((r["tree_id"], [x for x, leaf in zip(tree.name, tree.leaves(), strict=True) if leaf]))
            n += len(held[-1][1])
            if n >= ROWS:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    def batch(held: list[tuple[str, list[str]]]) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
        return pa.record_batch([_spread([t for t, _ in held], of), pa.array([v for _, x in held for v in x], pa.string())], names=["tree_id", "leaf"])

    return trees.select("tree_id", "newick").mapInArrow(run, "tree_id string, leaf string")


def _with_leaves(trees: DataFrame, leaves: DataFrame, *columns: str) -> DataFrame:
    """Trees with those rows of ``leaves`` that name leaves of theirs, as an array ``of``.

    Trees may share the names of their leaves, so a name may be hot: the asked leaves are
    written, and their size tells the planner whether all tasks can have them.
    """
    asked = written(leaves.select("leaf", *columns), "leaves")
    of = tree_leaves(trees).join(asked, "leaf").groupBy("tree_id").agg(F.collect_list(F.struct("leaf", *columns)).alias("of"))
    return trees.select("tree_id", "newick").join(of, "tree_id")


def clade_partitions(trees: DataFrame, labels: DataFrame) -> DataFrame:
    """The largest clades of each tree whose leaves all have one label (leaf, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                tree = newick.parse(r.newick)
                rows += [(r.tree_id, tree.name[i], label) for i, label in newick.partitions(tree, {x["leaf"]: x["label"] for x in r.of})]
            yield pd.DataFrame(rows, columns=["tree_id", "node_name", "label"])

    return _with_leaves(trees, labels, "label").mapInPandas(run, "tree_id string, node_name string, label string")


def phylograms(trees: DataFrame, keep: DataFrame) -> DataFrame:
    """Coordinates of each tree cut down to some leaves (leaf)."""

    names = ("node", "parent", "name", "x", "y", "is_leaf")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rows = [], []
        for r in _rows(batches):
            own = newick.phylogram(newick.parse(r["newick"]), {x["leaf"] for x in r["of"]})
            of += [r["tree_id"]] * len(own)
            rows += own
            if len(rows) >= ROWS:
                yield batch(of, rows)
                of, rows = [], []
        if rows:
            yield batch(of, rows)

    def batch(of: list[str], rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([x[k] for x in rows], kind, from_pandas=True) for k, kind in zip(names, kinds, strict=True)]
        return pa.record_batch([pa.array(of, pa.string()), *columns], names=["tree_id", *names])

    return _with_leaves(trees, keep).mapInArrow(run, "tree_id string, node long, parent long, name string, x double, y double, is_leaf boolean")


def nested_trees(trees: DataFrame, traits: DataFrame) -> DataFrame:
    """Each tree as nested JSON with traits of its leaves (leaf, and a map ``traits``)."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (
                    r.tree_id, json.dumps(newick.nested(newick.parse(r.newick), {x["leaf"]: dict(x["traits"] or {}) for x in r.of}), sort_keys=True)
                ) for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=["tree_id", "json"])

    return _with_leaves(trees, traits, "traits").mapInPandas(run, "tree_id string, json string")
