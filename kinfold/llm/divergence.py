"""Source divergence audit: how far apart the word use of a language's sources is.

Terms are runs of letters (A-Z lower-cased, all beyond ASCII as it is). A language keeps
the terms that stand in at least ``least_docs`` of its documents. Each group (language and
source) and each language gives a kept term the whole number p = 1 + floor(10^9 * (count +
5) / (N + 5 V)). Two sources differ by the sum of |p - p'| over all kept terms, and a
source's marked terms are those it uses more than its language does.

Heavy-light split: a term present in more than ``dense_share`` of a language's groups is
heavy, the others are light. Both kinds are dealt out in tiles of terms, groups in blocks;
a unit is a tile and two blocks. Heavy tiles are dense matrices, compared row by row. In a
light tile most groups lack most terms and have the same p for each, their base: a pair
starts from the difference of the bases times the tile's terms; each group's few terms
correct it against the other's base (sorted once, summed by prefix), and terms that both
have correct it once more, posting by posting. All are whole numbers, so the units' sums
add up exactly, and a pair costs a row a tile.

Counts are combined in tasks before the shuffle, so a hot source moves a row a term and
task. No task holds a language, a group's terms or all pairs: a unit has at most two
blocks of groups and one tile of terms.

Defined results: null text, language and source are ''; a group without kept terms is
there with its pairs; a language of one source has no pairs; without kept terms values are
0; repeated rows count each; no rows give no rows; further columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

LEAST_DOCS, MOST_TERMS = 30, 50
UNIT, SMOOTH = 1_000_000_000, 5
#: Share of a language's groups beyond which a term is heavy; terms of a tile, groups of a block.
DENSE_SHARE = 0.25
DENSE_TILE, SPARSE_TILE, BLOCK = 2048, 16_384, 64
#: Terms that a counting task holds before it gives them out.
HELD = 200_000
#: Every byte that is no part of a term becomes a space, A-Z lower case.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, occurrences and documents; the term '' stands for the group itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, texts) in held.items():
                n = len(times) + 1
                terms = pa.array([b"", *times], pa.binary())
                yield pa.record_batch(
                    [
                        pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array([0, *times.values()], pa.int64()),
                        pa.array([0, *[texts[t] for t in times]], pa.int64())
                    ],
                    names=["lang", "source", "term", "occurrences", "documents"]
                )
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for lang, source, text in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    times, texts = held.setdefault((lang, source), (Counter(), Counter()))
                    found = text.translate(_BYTES).split()
                    times.update(found)
                    texts.update(set(found))
                if sum(len(t) for t, _ in held.values()) + len(held) > HELD:
                    yield from given()
        yield from given()
        release()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    narrow = docs.select(plain[0].alias("lang"), plain[1].alias("source"), plain[2].cast("binary").alias("text"))
    counted = narrow.mapInArrow(count, "lang string, source string, term binary, occurrences long, documents long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")
    )


def weight(occurrences: Column, n: Column, v: Column) -> Column:
    """p of a term with that many occurrences among ``n`` of ``v`` terms, at any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    share = F.call_function("div", F.lit(UNIT).cast("decimal(12,0)") * whole(occurrences + SMOOTH), whole(n + SMOOTH * v))
    return F.when(v > 0, 1 + share)


def _pairs(one: np.ndarray, two: np.ndarray, apart: bool) -> np.ndarray:
    """Row numbers (x, y) of a unit's pairs: across its blocks, or within its one block."""
    return np.array(np.meshgrid(one, two, indexing="ij")).reshape(2, -1) if apart else one[np.array(np.triu_indices(len(one), 1))]


def dense_sums(base: np.ndarray, at: list[np.ndarray], p: list[np.ndarray], terms: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of |p - p'| of the pairs (x, y) over a tile of ``terms`` terms, by a matrix."""
    tile = np.repeat(base[:, None], terms, axis=1)
    for row, (i, v) in enumerate(zip(at, p, strict=True)):
        tile[row, i] = v
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 256):
        out[a : a + 256] = np.abs(tile[x[a : a + 256]] - tile[y[a : a + 256]]).sum(axis=1)
    return out


def sparse_sums(base: np.ndarray, at: list[np.ndarray], p: list[np.ndarray], terms: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same sums from the few terms that each group has."""
    n = len(base)
    apart = np.abs(base[:, None] - base[None, :])
    total = terms * apart
    for g in range(n):  # g's terms against the base of every other
        v = np.sort(p[g])
        upto = np.concatenate([[0], np.cumsum(v)])
        k = np.searchsorted(v, base)
        own = (base * k - upto[k]) + (upto[-1] - upto[k] - base * (len(v) - k)) - len(v) * apart[g]
        total[g, :] += own
        total[:, g] += own
    group = np.repeat(np.arange(n), [len(i) for i in at])
    flat, value = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *p])
    order = np.argsort(flat, kind="stable")
    flat, group, value = flat[order], group[order], value[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(flat)))
    for c in np.unique(size[size > 1]).tolist():  # terms that c groups of the unit have
        i, j = np.triu_indices(c, 1)
        for start in np.array_split(first[size == c], 1 + (size == c).sum() * len(i) // 1_000_000):
            a, b = start[:, None] + i, start[:, None] + j
            g, h = group[a], group[b]
            more = np.abs(value[a] - value[b]) - np.abs(value[a] - base[h]) - np.abs(base[g] - value[b]) + apart[g, h]
            np.add.at(total, (g.ravel(), h.ravel()), more.ravel())
            np.add.at(total, (h.ravel(), g.ravel()), more.ravel())
    return total[x, y]


def _unit(key: tuple, rows: pa.Table) -> pa.Table:
    lang, dense, _, i, j = (k.as_py() for k in key)
    rows = rows.sort_by("source")
    block, sources = rows.column("block").to_numpy(), rows.column("source").to_pylist()
    at, p = ([np.asarray(v if v is not None else [], np.int64) for v in rows.column(c).to_pylist()] for c in ("at", "p"))
    x, y = _pairs(np.flatnonzero(block == i), np.flatnonzero(block == j), i != j)
    sums = (dense_sums if dense else sparse_sums)(rows.column("base").to_numpy(), at, p, rows.column("terms")[0].as_py(), x, y)
    return pa.table(
        {
            "lang": pa.array([lang] * len(x), pa.string()), "one": pa.array([sources[k] for k in x], pa.string()),
            "two": pa.array([sources[k] for k in y], pa.string()), "value": pa.array(sums, pa.int64())
        }
    )


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS,
    most_terms: int = MOST_TERMS, dense_share: float = DENSE_SHARE, dense_tile: int = DENSE_TILE, sparse_tile: int = SPARSE_TILE, block: int = BLOCK
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: for each group all other
    sources of its language, and its ``most_terms`` most marked terms."""
    counts = materialise(term_counts(docs, lang_col, source_col, text_col), "counts")
    groups = counts.filter("term = ''").select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    kept = counts.filter("term != ''").groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("occurrences").alias("all_occurrences"), F.count(F.lit(1)).alias("present")
    ).filter(F.col("documents") >= least_docs)
    kept = materialise(kept.join(sizes, "lang").withColumn("dense", F.col("present") > dense_share * F.col("groups")), "kept")
    # tiles: terms dealt by hash, numbered within
    width = F.when(F.col("dense"), dense_tile).otherwise(sparse_tile)
    kinds = kept.groupBy("lang", "dense").agg(F.count(F.lit(1)).alias("of_kind")).withColumn("tiles", F.ceil(F.col("of_kind") / width).cast("int"))
    tiled = kept.join(materialise(kinds, "kinds"), ["lang", "dense"]).withColumn("tile", F.pmod(F.xxhash64("term", F.lit("tile")), F.col("tiles")).cast("int"))
    tiled = tiled.repartition("lang", "dense", "tile")  # else the window would stay with the join's few keys
    placed = materialise(
        tiled.withColumn(
            "at", F.row_number().over(Window.partitionBy("lang", "dense", "tile").orderBy("term")) - 1
        ).select("lang", "term", "all_occurrences", "dense", "tile", "at"),
        "placed"
    )
    known = materialise(
        counts.join(placed, ["lang", "term"]).select("lang", "source", "term", "occurrences", "all_occurrences", "dense", "tile", "at"), "known"
    )
    own = known.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    langs = sizes.join(
        placed.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_occurrences").alias("all_n")), "lang", "left"
    ).na.fill(0, ["v", "all_n"])
    groups = groups.join(own, ["lang", "source"], "left").na.fill(0, ["n"]).join(langs, "lang")
    blocks = F.ceil(F.col("groups") / block).cast("int")
    base = F.coalesce(weight(F.lit(0), F.col("n"), F.col("v")), F.lit(0))
    groups = materialise(
        groups.select(
            "lang", "source", "n", "v", "all_n", base.alias("base"), blocks.alias("blocks"),
            F.pmod(F.xxhash64("source", F.lit("block")), blocks).cast("int").alias("block")
        ),
        "groups"
    )

    valued = known.join(groups.select("lang", "source", "n", "v", "all_n"), ["lang", "source"])
    valued = valued.withColumns({"p": weight(F.col("occurrences"), F.col("n"), F.col("v")), "q": weight(F.col("all_occurrences"), F.col("all_n"), F.col("v"))})
    cells = valued.groupBy("lang", "source", "dense", "tile").agg(F.collect_list(F.struct("at", "p")).alias("cells"))  # a tile's terms at most
    cells = cells.select("lang", "source", "dense", "tile", F.col("cells.at").alias("at"), F.col("cells.p").alias("p"))
    none = sizes.select("lang", F.lit(False).alias("dense"), F.lit(0).alias("tile"), F.lit(0).cast("long").alias("terms"))  # a language without terms has pairs too
    tiles = placed.groupBy("lang", "dense", "tile").agg(
        F.count(F.lit(1)).alias("terms")
    ).unionByName(none).groupBy("lang", "dense", "tile").agg(F.sum("terms").alias("terms"))
    rows = groups.select("lang", "source", "base", "block", "blocks").join(tiles, "lang").join(cells, ["lang", "source", "dense", "tile"], "left")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    dealt = rows.select("lang", "source", "base", "block", "dense", "tile", "terms", "at", "p", partner)
    dealt = dealt.select(
        "lang", "dense", "tile", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "source", "base", "block", "terms",
        "at", "p"
    )
    sums = dealt.groupBy("lang", "dense", "tile", "i", "j").applyInArrow(_unit, "lang string, one string, two string, value long")
    sums = sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = F.explode(
        F.array(
            F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))
        )
    ).alias("x")
    pairs = sums.select("lang", "value", both).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    marked = valued.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, marked)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= most_terms)).select("lang", "source", "part", "item", "value", "rank")
