"""Mixing sources to target weights along a time-varying curriculum, in native operations.

A source's weight is a piecewise linear function of training time 0..1. Its integral,
normalised, says which share of the source's target the run has asked for by then. The
documents of a source are laid end to end in a keyed order and repeated; a copy belongs
to the mix if its middle lies before the target, and its training position is the time at
which the source's cumulative demand reaches that middle (the inverse of the integral).
Sorting by position gives the training order.

Targets: the sources share ``epochs`` times all words by weight; no target exceeds
``most`` times its source's words, and what is cut off is shared again by weight among
the others until none is above (water filling).

Running sums are made in buckets of about ``bucket_rows`` documents, bounded for each
source by the leading digits of the sort key, so a source with a third of all rows is
spread over as many tasks as it has buckets; the buckets' sums are summed in ``SPAN``
buckets at a time, and only the spans' sums by source. Texts take no part in this: they
meet their positions at the end, in one join.

Defined results: null text has size 0, as has a text of white space; size 0 is never
taken. Null sources are one source, ordered last. Equal ids are ordered by size, and rows
alike in all of id, text and source are interchangeable. No rows give no rows. Columns of
the input other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise

#: Weights of the sources by their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Knots (time, factor) of the weight schedules of the sources by their order, repeating: level, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
EPOCHS, MOST, BUCKET_ROWS, SEED = 1.5, 2.0, 2000, "curriculum"
#: Buckets whose sums are summed in one group.
SPAN = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 0x09 to 0x0D; null: 0."""
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return (F.size(F.split(bare, " +")) - (bare == "").cast("int")).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the place of each source in the order of their names, nulls last."""
    order = F.col("source").asc_nulls_last()
    if bounded(sizes):
        return sizes.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    parts = materialise(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = parts.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("inside", inside).join(
        F.broadcast(bases), F.col("part") == F.col("p")
    ).withColumn("rank", F.col("base") + F.col("inside")).drop("part", "p", "base", "inside")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, n_rows; a row per source) with rank and target.

    Sources whose cap lies below what their weight would give them stand at it, and the
    others share what is left by weight, until none is above: a few sums over the sources.
    """
    named = _ranked(sizes)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    named = materialise(named.withColumn("ratio", F.col("cap") / F.col("weight")), "named")
    whole = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, free = None, whole["weight"]
    while free:
        above = level is not None and F.col("ratio") < level
        capped = F.sum(F.when(above, F.col("cap"))) if level is not None else F.lit(None)
        own = F.sum(F.when(~above, F.col("weight"))) if level is not None else F.sum("weight")
        found = named.agg(capped.cast("double").alias("capped"), own.alias("free")).first()
        if level is not None and found["free"] == free:
            break
        free = found["free"]
        level = (epochs * whole["size"] - (found["capped"] or 0.0)) / free if free else None
    shared = F.col("cap") if level is None else F.least("cap", F.col("weight") * level)
    return named.select("source", "source_size", "n_rows", "rank", shared.alias("target"))


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start time, start share, length, weight at start, slope) of each segment; shares of the whole area."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:], strict=False)) or min(w for _, w in knots) < 0:
        raise ValueError("a schedule has rising times from 0 to 1 and weights of 0 or more")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    out, share = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, share, t1 - t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        share += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def _time_at(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a schedule reaches ``share``, 0..1."""
    out = None
    for t0, s0, length, w, slope in reversed(_segments(knots)):
        need = F.greatest(share - s0, F.lit(0.0))
        # smaller root of slope/2 x^2 + w x = need, in the form that also holds for slope 0
        root = 2 * need / F.greatest(w + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * need, F.lit(0.0))), F.lit(1e-300))
        here = F.lit(t0) + F.least(root, F.lit(length))
        out = here if out is None else F.when(share < nxt, here).otherwise(out)
        nxt = s0
    return out


def assign(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    epochs: float = EPOCHS,
    most: float = MOST,
    bucket_rows: int = BUCKET_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: id, source, text_key (a hash of the text), size, source_size,
    target and positions, an array with a training position for each copy taken."""
    doc_id, text, source = F.col(id_col), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select(doc_id.alias("id"), word_count(text).alias("size"), source.alias("source"), key.alias("key"), F.xxhash64(text).alias("text_key"))
    rows = materialise(rows, "sizes")  # narrow rows; texts are read and measured once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    known = materialise(
        targets(sizes, weights, epochs, most).withColumn("buckets", F.ceil(F.col("n_rows") / bucket_rows)), "targets"
    ).withColumnRenamed("source", "known_source")
    leading = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("known_source"))).withColumn("bucket", F.floor(leading * F.col("buckets") / (1 << 32)))
    span = F.floor(F.col("bucket") / SPAN)
    sums = materialise(placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).withColumn("span", span), "sums")
    spans = sums.groupBy(F.col("rank").alias("r"), F.col("span").alias("s")).agg(F.sum("words").alias("words"))
    over_spans = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("r", "s", F.coalesce(F.sum("words").over(over_spans), F.lit(0)).alias("before"))
    running = Window.partitionBy("rank", "span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "span", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("within"))
    starts = starts.join(spans, (F.col("rank") == F.col("r")) & (F.col("span") == F.col("s")))
    starts = materialise(starts.select(F.col("rank").alias("of"), F.col("bucket").alias("in"), (F.col("before") + F.col("within")).alias("start")), "starts")
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("upto", F.sum("size").over(inside))
    laid = summed.join(starts, (F.col("rank") == F.col("of")) & (F.col("bucket") == F.col("in")))
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    at = F.transform(F.sequence(F.lit(0), F.lit(int(-(-most // 1)))), lambda k: (middle + k * F.col("source_size")) / F.col("target"))
    shares = F.when((F.col("size") > 0) & (F.col("target") > 0), F.filter(at, lambda s: s < 1)).otherwise(F.array().cast("array<double>"))
    kind = F.col("rank") % len(schedules)

    def time_of(share: Column) -> Column:
        out = _time_at(share, schedules[0])
        for i, knots in enumerate(schedules[1:], 1):
            out = F.when(kind == i, _time_at(share, knots)).otherwise(out)
        return out

    return laid.select("id", "source", "text_key", "size", "source_size", "target", F.transform(shares, time_of).alias("positions"))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` in training order: a row for each copy taken, in the columns of ``docs``,
    range-sorted by position (copies of a document stand at their own positions)."""
    placed = assign(docs, id_col, text_col, source_col, **options).filter(F.size("positions") > 0)
    alike = placed.groupBy(F.col("id").alias("__id"), F.col("text_key").alias("__text"), F.col("source").alias("__source"))
    taken = materialise(alike.agg(F.flatten(F.collect_list("positions")).alias("__positions"), F.count(F.lit(1)).alias("__rows")), "taken")  # rows of one id, text and source
    side = F.broadcast(taken) if bounded(taken) else taken
    on = F.col(id_col).eqNullSafe(F.col("__id")) & F.xxhash64(
        F.col(text_col).cast("string")
    ).eqNullSafe(F.col("__text")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    met = docs.join(side, on)
    if not taken.filter("__rows > 1").isEmpty():  # of rows alike one carries the copies of all
        met = met.filter("__rows = 1").unionByName(met.filter("__rows > 1").dropDuplicates(["__id", "__text", "__source"]))
    copies = met.select(*[docs[c] for c in docs.columns], F.explode("__positions").alias("__position"), "__id")
    return copies.repartitionByRange("__position", "__id").sortWithinPartitions("__position", "__id").select(*docs.columns)
