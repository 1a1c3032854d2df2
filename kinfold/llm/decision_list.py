"""Quality rules: word statistics of whole texts and learned decision lists, in native operations.

Base statistics are single-row expressions over arrays, so nothing is exploded or
shuffled. A decision list is learned by sequential covering: a conjunction of threshold
conditions is grown on two thirds of the labelled rows by FOIL gain, pruned on the other
third from its end, and added if it is precise enough on the pruning rows; the rows it
covers then leave. Each step sees only counts by (feature, threshold, label), which Spark
aggregates over all labelled rows: the driver holds features times thresholds numbers,
however many rows there are. The list is emitted as one ``CASE`` expression in its order.

Defined results: null text has no words; a text of fewer than ``least_words`` words fails
the base; ratios of empty texts are 0. Rows without a label, or with a null one, teach
nothing; of several labels of an id the lowest counts. Without labelled rows of both
classes the list is empty and keeps all. Equal rows get equal results. Further columns of
the input are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialise

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Ratios that conditions may test, in the order in which ties are broken.
FEATURES = ("symbol_ratio", "mark_ratio", "repeat_ratio", "dup_line_ratio", "mean_word_chars")
THRESHOLDS, MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 24, 12, 3, 0.8, 5


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more.

    Windows are hashed with their position, sorted, and compared with their neighbours;
    the union of the found windows follows from the gaps between their sorted starts.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(
            ordered,
            lambda o: F.filter(
                o, lambda s, j: F.coalesce(F.get(o, j - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(o, j + 1)["h"] == s["h"], F.lit(False))
            )
        )
        at = F.sort_array(F.transform(found, lambda s: s["i"]))
        return let(
            at,
            lambda a: F.aggregate(
                F.transform(a, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(a, j + 1) - x, F.lit(3)))), F.lit(0), lambda n, x: n + x
            )
        )

    return F.when(F.size(words) >= 4, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")

    def less(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")

    stats = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")))
    by_line = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    )
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        stats.alias("w"),
        by_line.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        less("!?").alias("n_marks"),
    )
    return found.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_marks")


def base_failed() -> Column:
    """The fixed rule over the columns of :func:`statistics`."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The features that conditions test, over the columns of :func:`statistics`."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / n,
        "mark_ratio": F.col("n_marks") / n,
        "repeat_ratio": F.col("n_repeat_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "mean_word_chars": F.col("word_chars") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    cover: int

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        return "IF " + " AND ".join(map(str, self.conditions)) + f" THEN reject ({self.precision:.3f} of {self.cover})"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def rejected_by(self, of: dict[str, Column] | None = None) -> Column:
        """Number of the first rule that holds, from 1; null where none does."""
        of = of or ratios()
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(of), F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), "ELSE keep"])


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, bool, float, str], tuple[int, int]]:
    """(rejects, keeps) that each condition covers, by part; one aggregation over ``rows``."""
    def bin_of(feature: str, at: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, at)), lambda t: F.col(feature) > t))

    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), bin_of(k, v).alias("b")) for i, (k, v) in enumerate(cuts.items())]))
    got = rows.select("part", "bad", bins.alias("x")).groupBy("part", "x.f", "x.b").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    names, out = list(cuts), {}
    for name in names:
        for j, t in enumerate(cuts[name]):
            for part in ("grow", "prune"):
                own = [r for r in got if names[r["f"]] == name and r["part"] == part]
                for above in (True, False):
                    hit = [r for r in own if (r["b"] > j) == above]
                    p = sum(r["p"] for r in hit)
                    out[name, above, t, part] = (p, sum(r["n"] for r in hit) - p)
    return out


def _totals(rows: DataFrame) -> dict[str, tuple[int, int]]:
    got = {r["part"]: (r["p"], r["n"] - r["p"]) for r in rows.groupBy("part").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    return {part: got.get(part, (0, 0)) for part in ("grow", "prune")}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """A decision list for rows whose label is 0, from all labelled rows that pass the base."""
    known = labels.select(
        F.col(id_col).alias("of"), F.col(label_col).alias("label")
    ).filter("label is not null").groupBy("of").agg(F.min("label").alias("label"))
    part = F.when(F.pmod(F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")), F.lit(3)) == 0, "prune").otherwise("grow")
    rows = stats.filter(~base_failed()).join(known, F.col("doc_id") == F.col("of")).select(
        part.alias("part"), (F.col("label") == 0).cast("int").alias("bad"), *[c.alias(k) for k, c in ratios().items()]
    )
    rows = materialise(rows, "labelled")
    # thresholds come from the rejected rows and the kept ones alike, so that a rare class has its own
    q = [i / (THRESHOLDS - 1) for i in range(THRESHOLDS)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(k, q, 1000).alias(k) for k in FEATURES]).collect()
    cuts = {k: sorted({float(x) for r in found for x in r[k]}) for k in FEATURES}
    if len(found) < 2:
        return DecisionList()
    rules: list[Rule] = []
    left = rows
    while len(rules) < MOST_RULES:
        total = _totals(left)
        if total["grow"][0] < LEAST_COVER:
            break
        grown: list[Condition] = []
        pruned: list[tuple[int, int]] = []
        inside, (p0, n0) = left, total["grow"]
        while n0 and len(grown) < MOST_CONDITIONS:
            counts = _counts(inside, cuts)
            best, gain = None, 1e-9
            for name in FEATURES:
                for t in cuts[name]:
                    for above in (True, False):
                        p, n = counts[name, above, t, "grow"]
                        if p >= LEAST_COVER and (g := _gain(p, n, p0, n0)) > gain:
                            best, gain = Condition(name, above, t), g
            if best is None:
                break
            grown.append(best)
            pruned.append(counts[best.feature, best.above, best.threshold, "prune"])
            p0, n0 = counts[best.feature, best.above, best.threshold, "grow"]
            inside = inside.filter(best.column({k: F.col(k) for k in FEATURES}))
        if not grown:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pruned]
        keep = max(range(len(grown)), key=lambda i: (worth[i], -i))
        p, n = pruned[keep]
        if p + n == 0 or p / (p + n) < LEAST_PRECISION:
            break
        rules.append(Rule(tuple(grown[: keep + 1]), p / (p + n), p + n))
        left = left.filter(~rules[-1].column({k: F.col(k) for k in FEATURES}))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of each row with base_failed, kept and rule (number of the rule that rejects it)."""
    stats = materialise(statistics(docs, id_col, text_col), "statistics")
    rules = learn(stats, labels.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else labels, id_col)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rejected_by())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
