"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document's set is its shingles of ``width`` words. Documents with the same words in the
same order are one class from the start, so copies are never compared with each other.

Forest: each of ``TREES`` trees labels a class by ``DEPTH`` minima of its shingles'
hashes; the sorted labels of a tree are its prefix trie. The level of two classes is the
length of the longest prefix that they share in any tree. For a pair of similarity s it is
d or more with probability p_d(s) = 1 - (1 - s^d)^trees; the shortest prefix looked at, the
stop depth, is the longest one with p_d(threshold) at the target recall. Below each shared
prefix of the stop depth lies a small trie; these are dealt out by that prefix, so no trie
is in one place, and within one the sorted labels show the depth at which two classes part.
The minima beyond the stop depth also tell how alike two classes are: a pair that agrees in
so few of them that one in a million at the threshold would is no candidate (``STRAY``).

Descent: pairs that share whole labels are verified first, then prefixes are shortened,
``shorten`` minima a round. After each round the recall is measured: each pair found so
far, of similarity s, stands for 1 / p_d(s) pairs, and one pair at the threshold is
presumed unseen besides. The descent ends where the measured recall reaches the target,
at the stop depth at the latest.

Candidates are compared where they meet. A prefix that more than ``block`` classes share
is split into blocks by a hash of the class, and each pair of blocks is a unit of its
own, so no task gathers an unbounded group, and no pair is left out. A pair is verified
in the first tree in which it shares a prefix of the stop depth, and nowhere else: a first
pass over labels alone finds which classes have such a pair there at which level, and only
these are sent there with their shingles.
Within a unit all overlaps are counted together by posting lists, and
what leaves it is one row a class (its links, and the unit's component that it is in),
never pairs.

Result: for each row its class of linked documents (the smallest id in the connected
component) and its number of links: rows whose shingle set has a Jaccard similarity of at
least ``threshold`` to its own, copies included, itself not. Shingles are compared by
64-bit hashes of their words. Components are found by contraction on tables, not on the
driver: however long a chain of near copies is, rounds grow with its logarithm.

Defined results: words are lower-case runs of letters, marks and digits; a text of fewer
words than ``width`` has one shingle of all its words; texts without words (null, empty)
have no links and are classes of their own; equal rows are copies; no rows give no rows;
further columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, keep_marked, materialise, release

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 18, 8, 0.9999
#: Minima by which a round shortens prefixes, and classes of a block: a unit holds two at most.
SHORTEN, BLOCK = 2, 400
#: Probability with which a pair at the threshold agrees in too few minima to be a candidate.
STRAY = 1e-6
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def stop_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, from the whole label down, that meets the recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def _numbers(n: int, name: str) -> np.ndarray:
    """n fixed 64-bit numbers, from a rule."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{name}{i}".encode(), digest_size=8).digest(), "little") for i in range(n)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashes words (remembering up to ``remembered``) and makes shingles of them."""

    def __init__(self, width: int = WIDTH, remembered: int = 200_000) -> None:
        self.width, self.remembered, self.known = width, remembered, {}

    def words(self, text: str) -> np.ndarray:
        found, known, out = WORD.findall(text.lower()), self.known, []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        if len(known) > self.remembered:
            known.clear()
        return np.array(out, np.uint64)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Hashes of all shingles in their order, with repeats."""
        n = min(self.width, len(words))
        if not n:
            return words
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out = (out ^ words[k : k + len(out)]) * _ODD
            out ^= out >> np.uint64(31)
        return _mix(out)


def found_share(similarity: np.ndarray, d: int, trees: int = TREES) -> np.ndarray:
    """Probability that a pair shares a prefix of d minima in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** d) ** trees


def _tail_bits(depth: int, stop: int) -> int:
    """Bits that each minimum below the stop depth has in a tail of 32 bits."""
    return 32 // max(1, depth - stop)


def least_agreement(threshold: float, minima: int, stray: float = STRAY) -> int:
    """The most minima in which all but ``stray`` of the pairs at the threshold agree."""
    below = 0.0
    for k in range(minima + 1):
        below += math.comb(minima, k) * threshold**k * (1 - threshold) ** (minima - k)
        if below > stray:
            return k
    return minima


def _labels(shingles: list[np.ndarray], trees: int, depth: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set (none empty) and tree the hash of the prefix of ``stop`` minima, and the
    further minima packed into one number whose order is that of the labels."""
    flat = np.concatenate(shingles)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in shingles])[:-1]])
    a, b = _numbers(trees * depth, "a") | np.uint64(1), _numbers(trees * depth, "b")
    heads, tails = np.zeros((len(shingles), trees), np.uint64), np.zeros((len(shingles), trees), np.uint32)
    buffer, bits = np.empty_like(flat), _tail_bits(depth, stop)
    for t in range(trees):
        for k in range(depth):
            np.multiply(flat, a[t * depth + k], out=buffer)
            np.add(buffer, b[t * depth + k], out=buffer)
            least = np.minimum.reduceat(buffer, starts)
            if k < stop:
                heads[:, t] = _mix(heads[:, t] ^ least) + np.uint64(t)
            else:
                tails[:, t] |= (_mix(least) >> np.uint64(64 - bits)).astype(np.uint32) << np.uint32(32 - bits * (k - stop + 1))
    return heads, tails ^ np.uint32(1 << 31)  # as signed numbers they sort alike


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64 if x.itemsize == 8 else np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int, depth: int, stop: int) -> DataFrame:
    """id, row, text_key, words_key, heads and tails (null for no words) of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = Shingler(width), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                words = [own.words(t or "") for t in batch.column(1).to_pylist()]
                keys = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for w in words]
                some = [i for i, w in enumerate(words) if len(w)]
                heads: list = [None] * len(words)
                tails: list = [None] * len(words)
                if some:
                    for labels, found in zip((heads, tails), _labels([own.shingles(words[i]) for i in some], trees, depth, stop), strict=True):
                        for i, x in zip(some, _signed(found).tolist(), strict=True):
                            labels[i] = x
                rows = pa.array(range(row, row + len(words)), pa.int64())
                row += len(words)
                yield pa.record_batch(
                    [
                        batch.column(0), rows, batch.column(2), pa.array(keys, pa.binary()), pa.array(heads, pa.list_(pa.int64())),
                        pa.array(tails, pa.list_(pa.int32()))
                    ],
                    names=["id", "row", "text_key", "words_key", "heads", "tails"]
                )
        del own
        release()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return narrow.mapInArrow(sign, "id long, row long, text_key long, words_key binary, heads array<long>, tails array<int>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first ``keys`` columns, as tables of many whole groups."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(i)[batch.num_rows - 1] for i in range(keys)]
        cut = batch.num_rows
        while cut and all(batch.column(i)[cut - 1] == last[i] for i in range(keys)):
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*left, batch.slice(0, cut)])
            left = [batch.slice(cut)]
        else:
            if left and any(left[-1].column(i)[left[-1].num_rows - 1] != last[i] for i in range(keys)):
                yield pa.Table.from_batches(left)
                left = []
            left.append(batch)
    if left:
        yield pa.Table.from_batches(left)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where the groups of a sorted table begin, and its length."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for i in range(keys):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _shared(one: np.ndarray, two: np.ndarray, below: int) -> np.ndarray:
    """How many minima tails share from the first on, of ``below``."""
    apart, bits = one ^ two, 32 // max(1, below)
    out = np.zeros(apart.shape, np.int8)
    for k in range(1, below + 1):
        out += apart >> np.uint32(32 - bits * k) == 0
    return out


def _agreeing(tails: np.ndarray, x: np.ndarray, y: np.ndarray, below: int, least: int) -> np.ndarray:
    """Whether the tails of each pair agree in ``least`` minima, of all trees together."""
    bits = 32 // max(1, below)
    minima = np.concatenate([(tails >> np.uint32(32 - bits * (k + 1)) & np.uint32((1 << bits) - 1)).astype(np.uint16) for k in range(below)], axis=1)
    out = np.empty(len(x), bool)
    for a in range(0, len(x), 100_000):
        out[a : a + 100_000] = (minima[x[a : a + 100_000]] == minima[y[a : a + 100_000]]).sum(axis=1) >= least
    return out


def _levels(
    heads: np.ndarray, tails: np.ndarray, tree: int, part: np.ndarray, i: int, j: int, stop: int, below: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y (x < y) and level of the pairs of a unit whose first shared prefix is here.

    The rows of a unit share a prefix of the stop depth in ``tree`` and are sorted by their
    tails there, so the depth at which two part is the least between neighbours from one
    to the other. Of a unit of two blocks only pairs across them count, and of all only
    those that agree in ``least`` further minima.
    """
    n = len(heads)
    steps = _shared(tails[:-1, tree], tails[1:, tree], below)
    x, y = np.triu_indices(n, 1)
    level = np.concatenate([np.minimum.accumulate(steps[k:]) for k in range(n - 1)]) if n > 1 else np.zeros(0, np.int8)
    if i != j:
        left = part[x] != part[y]
        x, y, level = x[left], y[left], level[left]
    for t in range(tree):  # met there
        new = heads[x, t] != heads[y, t]
        x, y, level = x[new], y[new], level[new]
    if below and len(x):
        near = _agreeing(tails, x, y, below, least)
        x, y, level = x[near], y[near], level[near]
    for t in range(tree + 1, heads.shape[1]):
        at = np.flatnonzero(heads[x, t] == heads[y, t])
        if len(at):
            level[at] = np.maximum(level[at], _shared(tails[x[at], t], tails[y[at], t], below))
    return x, y, level + stop


_KEY = ["tree", "label", "i", "j"]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, as unsigned numbers."""
    found = np.concatenate([np.asarray(c.flatten()).reshape(len(c), -1) for c in column.chunks])
    return found.view(np.uint64 if found.itemsize == 8 else np.uint32)


def _wanted(stop: int, below: int, shorten: int, least: int):
    """Of each unit the classes that have a pair to verify there, a row for each round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 4):
            bounds = _bounds(table, 4)
            tree, i, j, part = (table.column(c).to_numpy() for c in ("tree", "i", "j", "part"))
            heads, tails = _matrix(table.column("heads")), _matrix(table.column("tails"))
            rows, levels = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    x, y, depth = _levels(heads[a:b], tails[a:b], tree[a], part[a:b], i[a], j[a], stop, below, least)
                    turn = (stop + below - depth) // shorten
                    for d in np.unique(turn).tolist():
                        own = np.unique(np.concatenate([x[turn == d], y[turn == d]])) + a
                        rows.append(own)
                        levels.append(np.full(len(own), d, np.int32))
            if rows:
                found = table.select([*_KEY, "part", "vertex"]).take(pa.array(np.concatenate(rows)))
                yield from found.append_column("round", pa.array(np.concatenate(levels))).to_batches()
        release()

    return run


def _verify(threshold: float, levels: range, stop: int, depth: int, trees: int, least: int):
    """Of each unit the linked classes: root in the unit, rows linked to, and by shared
    prefix the pairs that those found stand for beyond themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 4):
            bounds = _bounds(table, 4)
            out: list[tuple[int, int, int, int, list[float]]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    out += _verified(table.slice(a, b - a), threshold, levels, stop, depth, trees, least)
            if out:
                kinds = [*[pa.int64()] * 4, pa.list_(pa.float64())]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["vertex", "root", "links", "pairs", "unseen"]
                )
        release()

    return run


def _overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share; x is sorted."""
    if len(x) <= 8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    posting, begin = owner[np.argsort(at, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(at))])
    place, out = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(x), np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    for a, b in zip(first, [*first[1:], len(x)], strict=True):
        own = at[place[x[a]] : place[x[a] + 1]]
        both = np.zeros(n, np.int64)
        for lo in range(0, len(own), 4096):  # bounded memory for long texts
            lengths = begin[own[lo : lo + 4096] + 1] - begin[own[lo : lo + 4096]]
            steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            both += np.bincount(posting[np.repeat(begin[own[lo : lo + 4096]], lengths) + steps], minlength=n)
        out[a:b] = both[y[a:b]]
    return out


def _verified(unit: pa.Table, threshold: float, levels: range, stop: int, depth: int, trees: int, least: int) -> list[tuple[int, int, int, int, list[float]]]:
    """(class, its root in the unit, rows it is linked to, pairs, unseen) for the linked
    classes of a unit; a pair counts with the class that comes first."""
    tree, i, j = (unit.column(c)[0].as_py() for c in ("tree", "i", "j"))
    vertex = unit.column("vertex").to_numpy()
    once = np.append(True, vertex[1:] != vertex[:-1])
    if not once.all():  # rows that repeat an id and its text
        unit = unit.filter(pa.array(once))
    vertex, weight, part = (unit.column(c).to_numpy() for c in ("vertex", "size", "part"))
    x, y, level_of = _levels(_matrix(unit.column("heads")), _matrix(unit.column("tails")), tree, part, i, j, stop, depth - stop, least)
    now = (level_of >= levels.start) & (level_of < levels.stop)
    x, y = x[now], y[now]
    sizes = np.asarray(pc.divide(pc.binary_length(unit.column("shingles")), 8))
    near = np.minimum(sizes[x], sizes[y]) >= threshold * np.maximum(sizes[x], sizes[y]) - 1e-9
    x, y = x[near], y[near]
    if not len(x):
        return []
    sets = [np.frombuffer(s, np.uint64) for s in unit.column("shingles").to_pylist()]
    both = _overlaps(sets, x, y)
    union = sizes[x] + sizes[y] - both
    linked = both >= threshold * union - 1e-9
    x, y, similarity = x[linked], y[linked], (both[linked] / union[linked])
    n = unit.num_rows
    links = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
    pairs = np.bincount(x, minlength=n)
    unseen = np.stack([np.bincount(x, 1 / found_share(similarity, d, trees) - 1, n) for d in range(stop, depth + 1)], axis=1)
    root = np.arange(n)
    for p, q in zip(x.tolist(), y.tolist(), strict=True):  # union by the smallest number, with path halving
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        root[max(p, q)] = min(p, q)
    out = []
    for k in np.flatnonzero(links).tolist():
        r = k
        while root[r] != r:
            r = root[r]
        out.append((int(vertex[k]), int(vertex[r]), int(links[k]), int(pairs[k]), unseen[k].tolist()))
    return out


def components(edges: DataFrame) -> DataFrame:
    """vertex and root (the smallest vertex connected to it) for edges (a, b) of numbers.

    Contraction on tables: every vertex with a smaller neighbour hooks to the smallest, the
    trees that arise are flattened by pointer doubling, and edges are relabelled with their
    roots, until none is left. A vertex without a smaller neighbour gets one in the next
    round, or was hooked to; so two rounds halve the vertices at least, whatever the graph.
    """
    known = edges.select(F.col("a").alias("vertex")).unionByName(edges.select(F.col("b").alias("vertex"))).distinct()
    roots = materialise(known.withColumn("root", F.col("vertex")), "roots")
    live = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "live")
    while not live.isEmpty():
        up = materialise(live.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("up")).withColumn("moved", F.lit(True)), "up")
        while not up.filter("moved").isEmpty():
            next_up = up.select(F.col("v").alias("w"), F.col("up").alias("far"))
            last, up = up, materialise(
                up.join(next_up, up["up"] == next_up["w"], "left").select(
                    "v", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")
                ),
                "up"
            )
            discard(last)
        tops = [up.select(F.col("v").alias(f"v{k}"), F.col("up").alias(f"up{k}")) for k in range(3)]
        x, y = F.coalesce("up0", "x"), F.coalesce("up1", "y")
        merged = live.join(tops[0], live["x"] == tops[0]["v0"], "left").join(tops[1], live["y"] == tops[1]["v1"], "left").filter(x != y)
        olds = [live, roots, up]
        live = materialise(merged.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).distinct(), "live")
        roots = materialise(roots.join(tops[2], roots["root"] == tops[2]["v2"], "left").select("vertex", F.coalesce("up2", "root").alias("root")), "roots")
        discard(*olds)
    discard(live)
    return roots


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES,
    depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, shorten: int = SHORTEN
) -> DataFrame:
    """A row per row of ``docs``: id, row, text_key, class_id, n_links and first (it is
    the row of its class with the smallest id, then row)."""
    spark, stop = docs.sparkSession, stop_depth(threshold, recall, trees, depth)
    signs = materialise(signatures(docs, id_col, text_col, width, trees, depth, stop), "signatures")
    classes = signs.filter("heads is not null").groupBy("words_key").agg(
        F.min("row").alias("vertex"), F.count(F.lit(1)).alias("size"), F.first("heads").alias("heads"), F.first("tails").alias("tails")
    )
    classes = materialise(classes, "classes")
    entries = classes.select("vertex", F.posexplode("heads").alias("tree", "label"))
    shared = materialise(entries.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")  # apart, so that a hot label can be split in the join
    # labels of one block are a unit each; the few larger ones are dealt out by block before they multiply
    one = entries.join(shared.filter(F.col("n") <= block), ["tree", "label"]).select(
        F.lit(0).alias("i"), F.lit(0).alias("j"), "vertex", "tree", "label", F.lit(0).alias("part")
    )
    blocks = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("vertex", F.lit("part")), blocks).cast("int")
    hot = entries.join(shared.filter(F.col("n") > block), ["tree", "label"]).select(
        "vertex", "tree", "label", blocks.alias("blocks"), part.alias("part")
    ).repartition("tree", "label", "part")
    many = hot.select("vertex", "tree", "label", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    units = materialise(
        one.unionByName(many.select(F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "vertex", "tree", "label", "part")),
        "units"
    )
    discard(shared)
    described = classes.select(F.col("vertex").alias("v"), "heads", "tails", "size")
    full = units.join(described, units["vertex"] == described["v"]).select(*_KEY, "part", "vertex", "heads", "tails")
    tail = F.get("tails", F.col("tree"))
    dealt = full.repartition(*_KEY).sortWithinPartitions(*_KEY, tail, "vertex")
    least = least_agreement(threshold, trees * (depth - stop))
    wanted = materialise(
        dealt.mapInArrow(_wanted(stop, depth - stop, shorten, least), "tree int, label long, i int, j int, part int, vertex long, round int"),
        "wanted"
    )
    discard(units)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(width)
        for batch in batches:
            sets = [np.unique(own.shingles(own.words(t or ""))).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["v", "shingles"])
        del own
        release()

    # the texts of the wanted classes' first rows, whose key is the id and a hash of the text
    asked = wanted.groupBy("vertex").agg(
        F.collect_list(F.struct(*_KEY, "part", "round")).alias("units")
    ).join(described, F.col("vertex") == F.col("v")).drop("v")
    asked = materialise(asked, "asked")
    keyed = materialise(
        signs.join(asked.select("vertex"), F.col("row") == F.col("vertex")).select(F.col("id").alias("k"), F.col("text_key").alias("t"), "vertex"),
        "wants"
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    side = F.broadcast(keyed) if bounded(keyed) else keyed
    found = narrow.join(side, F.col("id").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("t"))).select("vertex", "text")
    sets = found.mapInArrow(shingle, "v long, shingles binary")
    carried = materialise(sets.join(asked, F.col("v") == F.col("vertex")).drop("v"), "carried")
    discard(keyed, asked)
    rounds = {r["round"] for r in wanted.select("round").distinct().collect()}  # a few numbers
    found, pairs, unseen = [], 0, np.zeros(depth - stop + 1)
    for turn in range(-(-(depth - stop + 1) // shorten)):
        level = max(stop, depth - (turn + 1) * shorten + 1)
        if turn in rounds:
            own = F.explode(F.filter("units", lambda u: u["round"] == turn)).alias("u")  # noqa: B023
            ready = carried.select(own, "vertex", "size", "heads", "tails", "shingles").select(
                *[f"u.{c}" for c in (*_KEY, "part")], "vertex", "size", "heads", "tails", "shingles"
            )
            ready = ready.repartition(*_KEY).sortWithinPartitions(*_KEY, tail, "vertex")
            levels = range(level, depth - turn * shorten + 1)
            verified = ready.mapInArrow(
                _verify(threshold, levels, stop, depth, trees, least), "vertex long, root long, links long, pairs long, unseen array<double>"
            )
            found.append(materialise(verified, "links"))
            sums = found[-1].agg(F.sum("pairs"), *[F.sum(F.col("unseen")[k]) for k in range(depth - stop + 1)]).first()
            pairs += sums[0] or 0
            unseen += np.array([x or 0.0 for x in sums[1:]])
        presumed = 1 / float(found_share(threshold, level, trees)) - 1
        if pairs / (pairs + unseen[level - stop] + presumed) >= recall:
            break
    links = found[0] if found else spark.createDataFrame([], "vertex long, root long, links long")
    for more in found[1:]:
        links = links.unionByName(more)
    roots = components(links.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    degrees = links.groupBy(F.col("vertex").alias("v")).agg(F.sum("links").alias("links"))
    graph = roots.join(degrees, roots["vertex"] == degrees["v"]).select("vertex", "root", "links")
    known = classes.select("words_key", F.col("vertex").alias("v"), "size").join(graph, F.col("v") == graph["vertex"], "left")
    known = known.select(
        F.col("words_key").alias("key"), F.coalesce("root", "v").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    rows = materialise(
        signs.join(known, signs["words_key"] == known["key"], "left").select(
            "id", "row", "text_key", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        ),
        "rows"
    )
    discard(signs, classes, wanted, carried, *found)
    heads = materialise(rows.groupBy(F.col("root").alias("of")).agg(F.min(F.struct("id", "row")).alias("head")), "heads")  # apart, so that a hot class can be split in the join
    return rows.join(heads, rows["root"] == heads["of"]).select(
        "id", "row", "text_key", F.col("head.id").alias("class_id"), "n_links", (F.col("row") == F.col("head.row")).alias("first")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the first row of each class alone, in their own columns."""
    marks = join(docs, id_col, text_col, **options).select("id", "text_key", F.col("first").alias("kept"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return keep_marked(docs, materialise(marks, "marks"), F.col(id_col).cast("long"), F.xxhash64(text))
