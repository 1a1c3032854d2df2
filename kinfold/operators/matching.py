"""Controls for anchors: nearest by structure, without replacement, in the anchors' order.

Each anchor in turn takes the nearest controls that are left; ties go to the smaller key.
Done one after the other that is a loop over all groups. Here it is deferred acceptance: as
every control prefers the anchor that is first by key, proposals in any order end in the
very same matching, provided that no seat is passed over that would still take the anchor.

Groups of the same structure (size, species, copies, single copies) are alike, so a kind of
controls is one place with as many seats as it has groups, and anchors of one kind share a
list of places, by score. In a round the anchors that still seek go to the place where
their rank among those of their kind falls, since the seats before it are taken by anchors
that come first; a place keeps the first it has seats for, and the others seek on behind
it. At the end the first in a place takes its first group, and so on.

Where kinds of controls are equally near to some kind of anchors, their groups are told
apart by key; such kinds are cut into runs of consecutive keys, each a place of its own.

A kind's list has the controls within a range of sizes. As the score is no less than the
difference of log sizes, it is known to be complete up to that range; where an anchor's
list does not go far enough, the range is widened and the matching starts again.

All of it is joins and ranks in buckets on written tables: no task holds a run, a kind or a
place, and the driver sees counts alone. Where many anchors want what few controls there are,
they displace each other in long chains, one link a round. So after some rounds a rest
whose size was counted to be small is settled by the same proposals in one task, each
anchor going on from where it stands; a larger rest takes further rounds.
"""

from __future__ import annotations

import bisect
import heapq
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..errors import InputError
from ..schemas import KEY
from ..tables import SPAN, discard, numbered, placed, written

SHAPE = ("member_count", "species_count", "mean_copies_per_species", "single_copy_species_count")
#: Buckets of log size for a doubling, and how many to either side a list spans at first.
STEPS, REACH = 4, 2
#: Rounds after which the rest may be settled at once, and how many rows of it.
ROUNDS, AT_ONCE = 3, 100_000
#: Seats that a seeker's place is looked up by at once.
SEATS = 64


@F.pandas_udf(DoubleType())
def _score(am: pd.Series, an: pd.Series, ac: pd.Series, a1: pd.Series, cm: pd.Series, cn: pd.Series, cc: pd.Series, c1: pd.Series) -> pd.Series:
    """The score of kinds; by the C library's logarithm, so that equal scores are equal."""
    out = []
    for m, n, c, s, om, on, oc, os_ in zip(am, an, ac, a1, cm, cn, cc, c1, strict=True):
        single = abs((s / n if n else 0.0) - (os_ / on if on else 0.0))
        out.append(abs(math.log2((m + 1) / (om + 1))) + 2 * (abs(n - on) / max(1, n)) + abs(math.log2((c + 0.25) / (oc + 0.25))) + single)
    return pd.Series(out, dtype="float64")


def _kinds(rows: DataFrame, name: str) -> DataFrame:
    """run_id, shape, number of groups and an id (``name``) of each kind, written."""
    shape = [F.coalesce(F.col(c), F.lit(0)).cast("double" if c.startswith("mean") else "long").alias(c) for c in SHAPE]
    counted = rows.select("run_id", *shape).groupBy("run_id", *SHAPE).agg(F.count(F.lit(1)).alias("groups"))
    return written(
        counted.withColumn(name, F.monotonically_increasing_id()).withColumn(
            "size_bucket", F.floor(F.log2(F.col("member_count") + 1.0) * STEPS + 1e-9)
        ),
        name
    )


def _of_kind(rows: DataFrame, kinds: DataFrame, name: str) -> DataFrame:
    same = F.lit(True)
    for c in ("run_id", *SHAPE):
        same = same & (F.coalesce(rows[c], F.lit(0)).cast("double" if c.startswith("mean") else "long") == kinds[c] if c != "run_id" else rows[c] == kinds[c])
    return rows.join(kinds.select("run_id", *SHAPE, name), same).select(*[rows[c] for c in KEY], rows["order"], name)


def _scored(asked: DataFrame, able: DataFrame) -> DataFrame:
    """kind, control_kind, score for pairs within each kind's reach, up to where that is complete."""
    near = asked.select("*", F.explode(F.sequence(F.col("size_bucket") - F.col("reach"), F.col("size_bucket") + F.col("reach"))).alias("bucket"))
    other = able.select("control_kind", F.col("run_id").alias("__run"), F.col("size_bucket").alias("__bucket"), *[F.col(c).alias(f"other_{c}") for c in SHAPE])
    met = near.join(other, (F.col("run_id") == F.col("__run")) & (F.col("bucket") == F.col("__bucket")))
    scored = met.withColumn("score", _score(*SHAPE, *[f"other_{c}" for c in SHAPE]))
    return scored.filter(F.col("whole") | (F.col("score") <= F.col("reach") / STEPS - 1e-6)).select("kind", "control_kind", "score")


def _runs(controls: DataFrame, tied: DataFrame) -> DataFrame:
    """``controls`` with the place that each is in: its kind, or a run of keys of a tied one."""
    marked = controls.join(tied.withColumn("tied", F.lit(True)), "control_kind", "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    # a run ends with its bucket too, which costs a place and changes nothing
    along = Window.partitionBy(F.floor(F.col("order") / SPAN)).orderBy("order")
    some = marked.filter("tied")
    begins = some.withColumn("begins", F.coalesce(F.lag("control_kind").over(along) != F.col("control_kind"), F.lit(True)))
    run = F.max(F.when(F.col("begins"), F.col("order"))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = begins.withColumn("run", run).drop("begins")
    return marked.filter("not tied").withColumn("run", F.lit(-1).cast("long")).unionByName(cut).drop("tied")


def _lists(scored: DataFrame, places: DataFrame) -> DataFrame:
    """kind, place, score, seats before it in the kind's list and with it."""
    met = scored.join(places, "control_kind")
    along = Window.partitionBy("kind").orderBy("score", "first")
    after = F.sum("seats").over(along)
    return met.withColumn("after", after).select("kind", "place", "score", (F.col("after") - F.col("seats")).alias("before"), "after")


def _rest(key: tuple, state: pa.Table, lists: pa.Table) -> pa.Table:
    """The held seats when all seekers have a place; a place of null where a list ends too soon."""
    rows = sorted(zip(*[lists.column(c).to_pylist() for c in ("kind", "before", "after", "place", "score", "seats")], strict=True))
    of: dict[int, list[tuple]] = {}
    for kind, _, after, place, score, seats in rows:
        of.setdefault(kind, []).append((after, place, score, seats))
    held: dict[int, list[tuple]] = {}
    seekers, out = [], []
    for turn, kind, place, score, behind in zip(*[state.column(c).to_pylist() for c in ("turn", "kind", "place", "score", "behind")], strict=True):
        if place is None:
            seekers.append((turn, kind, behind))
        else:
            heapq.heappush(held.setdefault(place, []), (-turn, kind, score, behind))
    while seekers:
        turn, kind, behind = seekers.pop()
        own = of.get(kind, [])
        at = bisect.bisect_right(own, behind, key=lambda x: x[0])
        while at < len(own):
            after, place, score, seats = own[at]
            taken = held.setdefault(place, [])
            if len(taken) < seats:
                heapq.heappush(taken, (-turn, kind, score, after))
                break
            if -taken[0][0] > turn:
                last, other, _, further = heapq.heapreplace(taken, (-turn, kind, score, after))
                seekers.append((-last, other, further))
                break
            at += 1
        else:
            out.append((kind, turn, None, None, behind))
    out += [(kind, -turn, place, score, behind) for place, own in held.items() for turn, kind, score, behind in own]
    return pa.table(
        {c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("kind", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("score", pa.float64()), ("behind", pa.int64())))}
    )


def match_controls(anchors: DataFrame, candidates: DataFrame, controls: int, at_once: int = AT_ONCE) -> DataFrame:
    """A row an anchor and control: KEY of both, control_rank and matching_score.

    ``anchors`` and ``candidates`` have KEY and SHAPE. An error if a run has fewer
    candidates than its anchors need.
    """
    asked_for = _kinds(anchors, "kind")
    able = _kinds(candidates, "control_kind")
    needs = asked_for.groupBy("run_id").agg(F.sum("groups").alias("wanted"))
    have = able.groupBy(F.col("run_id").alias("r")).agg(F.sum("groups").alias("there"), F.min("size_bucket").alias("low"), F.max("size_bucket").alias("high"))
    sizes = needs.join(have, needs["run_id"] == have["r"], "left").select("run_id", "wanted", F.coalesce("there", F.lit(0)).alias("there"), "low", "high")
    if short := sizes.filter(F.col("wanted") * controls > F.col("there")).limit(1).collect():
        raise InputError(f"too few controls remain: {short[0]['there']} groups for {short[0]['wanted']} anchors of run {short[0]['run_id']}")
    own = _of_kind(numbered(anchors.select(*KEY, *SHAPE), [*KEY], "order", "anchors"), asked_for, "kind")
    own = written(own, "anchors")
    other = written(_of_kind(numbered(candidates.select(*KEY, *SHAPE), [*KEY], "order", "controls"), able, "control_kind"), "controls")
    span = F.greatest(F.col("size_bucket") - F.col("low"), F.col("high") - F.col("size_bucket"))
    asked = asked_for.join(
        sizes.select("run_id", "low", "high"), "run_id"
    ).withColumn("span", span).drop("low", "high").withColumn("reach", F.lit(REACH).cast("long"))
    while True:
        asked = written(asked.withColumn("reach", F.least("reach", F.greatest("span", F.lit(0)))).withColumn("whole", F.col("reach") >= F.col("span")), "kinds")
        scored = written(_scored(asked, able), "scores")
        seats = scored.join(able.select("control_kind", F.col("groups").alias("seats")), "control_kind").groupBy("kind").agg(F.sum("seats").alias("seats"))
        short = asked.join(seats, "kind", "left").filter(~F.col("whole") & (F.coalesce("seats", F.lit(0)) < F.col("groups") * controls)).select("kind")
        lacking = written(short, "lacking")
        if lacking.isEmpty():
            found, lacking = _admitted(own, other, scored, controls, at_once)
            if lacking is None:
                return found
        asked = asked.join(
            lacking.distinct().withColumn("more", F.lit(4)), "kind", "left"
        ).withColumn("reach", F.col("reach") * F.coalesce("more", F.lit(1))).drop("more", "whole")


def _admitted(own: DataFrame, other: DataFrame, scored: DataFrame, controls: int, at_once: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The matching, or the kinds of anchors whose lists end too soon."""
    tied = scored.groupBy("kind", "score").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("control_kind").alias("all")
    ).filter("n > 1").select(F.explode("all").alias("control_kind")).distinct()
    runs = written(_runs(other, written(tied, "tied")), "runs")
    counted = runs.groupBy("control_kind", "run").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("seats"))
    places = written(counted.withColumn("place", F.monotonically_increasing_id()), "places")
    lists = written(_lists(scored, places.select("control_kind", "place", "first", "seats")), "lists")
    room = places.select("place", "seats")
    # an anchor seeks as often as it wants controls; turn is the order in which they come
    turn = F.explode(F.sequence(F.lit(0), F.lit(controls - 1)))
    seekers = written(
        own.select("kind", "order", turn.alias("k")).select(
            "kind", (F.col("order") * controls + F.col("k")).alias("turn"), F.lit(0).cast("long").alias("behind")
        ),
        "seekers"
    )
    held, turns = None, 0
    while left := seekers.count():
        if turns >= ROUNDS and left + held.count() + lists.count() <= at_once:
            zero = F.lit(0).alias("all")
            state = held.select(zero, "kind", "turn", "place", "score", "behind").unionByName(
                seekers.select(zero, "kind", "turn", F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("score"), "behind")
            )
            known = lists.join(room, "place").select(zero, "kind", "place", "score", "before", "after", "seats")
            held = written(
                state.groupBy("all").cogroup(known.groupBy("all")).applyInArrow(_rest, "kind long, turn long, place long, score double, behind long"),
                "held"
            )
            short = held.filter("place is null").select("kind").distinct()
            if not short.isEmpty():
                return None, written(short, "lacking")
            break
        turns += 1
        ranked = placed(seekers, ["kind", "behind"], "turn", "rank").withColumn("seat", F.col("behind") + F.col("rank"))
        ranked = written(ranked.select("kind", "turn", "seat"), "ranked")
        reach = ranked.groupBy(F.col("kind").alias("of")).agg(F.min("seat").alias("low"), F.max("seat").alias("high"))
        open_ = lists.join(reach, lists["kind"] == reach["of"]).filter((F.col("before") <= F.col("high")) & (F.col("after") > F.col("low")))
        bucket = lambda c: F.floor(c / SEATS)
        open_ = open_.select(
            F.col("kind").alias("of"), "place", "score", "before", "after",
            F.explode(F.sequence(bucket(F.greatest("before", "low")), bucket(F.least(F.col("after") - 1, F.col("high"))))).alias("bucket")
        )
        within = (F.col("kind") == F.col("of")) & (bucket(F.col("seat")) == F.col("bucket")) & F.col("seat").between(F.col("before"), F.col("after") - 1)
        asks = written(ranked.join(open_, within, "left").select("kind", "turn", "place", "score", F.col("after").alias("behind")), "asks")
        if not asks.filter("place is null").isEmpty():
            return None, written(asks.filter("place is null").select("kind").distinct(), "lacking")
        inside = asks if held is None else written(held.unionByName(asks), "inside")
        counts = inside.groupBy(F.col("place").alias("p")).agg(F.count(F.lit(1)).alias("n")).join(room.withColumnRenamed("place", "p"), "p")
        full = written(counts.filter("n > seats").select("p", "seats"), "full")
        fits = inside.join(full, inside["place"] == full["p"], "left_anti")
        crowded = written(inside.join(full, inside["place"] == full["p"]).drop("p"), "crowded")
        ranks = placed(crowded, ["place"], "turn", "rank")
        old = [seekers, ranked, asks]
        held = written(fits.unionByName(ranks.filter("rank < seats").drop("rank", "seats")), "held")
        seekers = written(ranks.filter("rank >= seats").select("kind", "turn", "behind"), "seekers")
        discard(*old, crowded, full)
    if held is None:
        held = own.sparkSession.createDataFrame([], "kind long, turn long, place long, score double, behind long")
    taken = placed(held, ["place"], "turn", "rank").select("turn", F.col("place").alias("in"), F.col("rank").alias("at"), "score")
    inside = placed(runs.join(places.select("control_kind", "run", "place"), ["control_kind", "run"]), ["place"], "order", "rank")
    met = taken.join(inside, (F.col("in") == F.col("place")) & (F.col("at") == F.col("rank")))
    pairs = met.select(
        F.floor(F.col("turn") / controls).alias("anchor"), "score", F.col("order").alias("control"),
        *[F.col(k).alias(f"control_{k}") for k in KEY[1:]]
    )
    pairs = pairs.withColumn("control_rank", F.row_number().over(Window.partitionBy("anchor").orderBy("score", "control")))  # an anchor's controls
    named = own.select(F.col("order").alias("anchor"), "run_id", *[F.col(k).alias(f"anchor_{k}") for k in KEY[1:]])
    out = pairs.join(named, "anchor")
    return out.select(
        "run_id", *[f"anchor_{k}" for k in KEY[1:]], *[f"control_{k}" for k in KEY[1:]], F.col("control_rank").cast("long").alias("control_rank"),
        F.col("score").alias("matching_score")
    ), None


def single_copy_fraction(of: dict[str, Column]) -> Column:
    return F.coalesce(F.try_divide(of["single_copy_species_count"].cast("double"), of["species_count"].cast("double")), F.lit(0.0))
