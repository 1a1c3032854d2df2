"""Matching without replacement against the loop it stands for; bootstrap blocks against one generator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.errors import InputError
from kinfold.functions import stats
from kinfold.operators import bootstrap, matching
from kinfold.schemas import KEY
from kinfold.tables import placed

KIND = ", ".join(f"{k} string" for k in KEY) + ", member_count long, species_count long, mean_copies_per_species double, single_copy_species_count long"


def group(run, name, members, species, single):
    return (run, "HOG", "N0", name, members, species, members / species, single)


def loop(anchors, pool, controls):
    """Anchors in the order of their keys; each takes the nearest that are left, by score and key."""
    def score(a, c):
        single = abs(a[7] / a[5] - c[7] / c[5])
        return abs(math.log2((a[4] + 1) / (c[4] + 1))) + 2 * (abs(a[5] - c[5]) / max(1, a[5])) + abs(math.log2((a[6] + 0.25) / (c[6] + 0.25))) + single

    free, out = set(pool), []
    for a in sorted(anchors):
        best = sorted((score(a, c), c) for c in free if c[0] == a[0])[:controls]
        assert len(best) == controls
        for rank, (s, c) in enumerate(best, 1):
            free.remove(c)
            out.append((a[0], a[3], c[3], rank, s))
    return sorted(out)


def random_groups(rng, n, prefix, most, runs=("r",)):
    out = set()
    for k in range(n):
        members = rng.choice([2, 3, 4, rng.randrange(2, most)])
        species = rng.randrange(1, members + 1)
        out.add(group(rng.choice(runs), f"{prefix}{rng.randrange(10**6)}-{k}", members, species, rng.randrange(species + 1)))
    return sorted(out)


def test_matching_is_the_loop(spark):
    """Runs at once: sparse and dense structures, anchors that want nearly all there is, all
    anchors alike so that they spill over, and kinds of controls that tie for some anchors."""
    rng, anchors, pool = random.Random(1), [], []
    for run, n_anchors, n_pool, most in (("p", 12, 150, 40), ("q", 40, 110, 9), ("r", 30, 61, 300)):
        anchors += random_groups(rng, n_anchors, "x", most, (run,))
        pool += random_groups(rng, n_pool, rng.choice("wy"), most, (run,))
    anchors += [group("s", f"a{k:02}", 4, 4, 4) for k in range(12)]
    pool += [group("s", f"c{k:02}", 3 + k % 7, 3 + k % 3, k % 3) for k in range(40)]
    anchors += [group("t", f"a{k:02}", 3, 3, 0) for k in range(6)] + [group("t", f"b{k:02}", 7, 7, 0) for k in range(4)]
    pool += [("t", "HOG", "N0", f"c{k:02}", (1, 7)[k % 2], 3, 1.0, 0) for k in range(24)] + [group("t", "d", 50, 5, 1)]
    found = matching.match_controls(spark.createDataFrame(anchors, KIND), spark.createDataFrame(pool, KIND), 2)
    got = sorted((r["run_id"], r["anchor_group_id"], r["control_group_id"], r["control_rank"], r["matching_score"]) for r in found.collect())
    assert got == loop(anchors, pool, 2)


def test_rounds_alone(spark):
    """Nothing is settled at once: anchors of one kind spill over to further kinds."""
    anchors = [group("s", f"a{k:02}", 4, 4, 4) for k in range(9)]
    pool = [group("s", f"c{k:02}", 3 + k % 5, 3 + k % 3, k % 3) for k in range(30)]
    found = matching.match_controls(spark.createDataFrame(anchors, KIND), spark.createDataFrame(pool, KIND), 2, at_once=0)
    got = sorted((r["run_id"], r["anchor_group_id"], r["control_group_id"], r["control_rank"], r["matching_score"]) for r in found.collect())
    assert got == loop(anchors, pool, 2)


def test_too_few_and_none(spark):
    anchors, pool = [group("r", "a", 4, 4, 4)], [group("r", "c", 4, 4, 4)]
    with pytest.raises(InputError, match="too few"):
        matching.match_controls(spark.createDataFrame(anchors, KIND), spark.createDataFrame(pool, KIND), 2)
    assert matching.match_controls(spark.createDataFrame([], KIND), spark.createDataFrame(pool, KIND), 2).count() == 0


def test_places_in_buckets(spark):
    rows = [(k % 3, k * 7 % 1000) for k in range(1000)]
    found = placed(spark.createDataFrame(rows, "g int, v long"), ["g"], "v", "place", 16).collect()
    for g in range(3):
        own = sorted((r["v"], r["place"]) for r in found if r["g"] == g)
        assert [p for _, p in own] == list(range(len(own)))


def test_bootstrap_blocks_draw_the_same_numbers(spark):
    rng, rows, want = random.Random(8), [], {}
    for name, n, m in (("a", 7, 4), ("b", 64, 33), ("c", 3, 90)):
        sides = {True: [round(rng.gauss(0, 1), 1) for _ in range(n)], False: [round(rng.gauss(1, 2), 1) for _ in range(m)]}
        rows += [(name, "m", f"g{k:03}", v, side) for side, own in sides.items() for k, v in enumerate(own)]
        want[name] = stats.bootstrap_median_difference(sides[True], sides[False], 90, [name, "m"])
    table = spark.createDataFrame(rows, "p string, metric string, group_id string, value double, is_target boolean")
    for block in (7, 1000):
        found = bootstrap.intervals(table.repartition(5), ["p", "metric"], 90, block)
        assert {r["p"]: (r["median_difference_ci_low"], r["median_difference_ci_high"]) for r in found.collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_marks_resume_the_generator():
    one, two = stats.Draws(5), random.Random(5)
    for n in (3, 1000, 70_001, 2):
        again = stats.Draws.resume(one.mark())
        want = [two.randrange(n) for _ in range(n)]
        assert one.below(n).tolist() == want and again.below(n).tolist() == want
    mark = one.mark()
    one.skip(100_000)
    again = stats.Draws.resume(mark)
    again.below(100_000)
    assert one.mark() == again.mark() and one.below(9).tolist() == again.below(9).tolist()


def test_middle_ranks_without_partition(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (5, 3000, 3001, 70_000):
        own = rng.permutation(n).astype(np.int32)
        one, two, three = stats.Draws(9), stats.Draws(9), stats.Draws(9)
        want = []
        for _ in range(6):
            drawn = np.sort(own[one.below(n)])
            want.append((drawn[(n - 1) // 2], drawn[n // 2]))
        quick, missed = stats.MiddleRanks(own), stats.MiddleRanks(own, -0.5)
        assert [quick.draw(two) for _ in range(6)] == want == [missed.draw(three) for _ in range(6)] and one.mark() == two.mark()
        if n > 3000:  # few of the ranks drawn are looked at
            sizes = []
            monkeypatch.setattr(stats.MiddleRanks, "_middle", staticmethod(lambda r, ends: sizes.append(len(r)) or (0, 0)))
            stats.MiddleRanks(own).draw(stats.Draws(1))
            monkeypatch.undo()
            assert sizes[0] < n / 4


def test_ranks_of_sides(spark):
    rows = [("a", True, f"g{k}", float(v)) for k, v in enumerate([5, 1, 3, 3])] + [("a", False, "g0", 2.0)]
    found = bootstrap.ranks(spark.createDataFrame(rows, "p string, is_target boolean, group_id string, value double"), ["p"]).filter(F.col("is_target")).orderBy("position").collect()
    assert [r["value"] for r in found] == [5, 1, 3, 3] and sorted(r["rank"] for r in found) == [0, 1, 2, 3] and (found[0]["rank"], found[1]["rank"]) == (3, 0)
