"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's probability is a logistic function of the distinct words in it, each by
itself and by its beginnings; a document's is their noisy-or, 1 - prod(1 - p). Only
documents have labels, and the likelihood of these trains the weights of the words, so
the sentences that offend are found without having been labelled. The same weights then score each sentence of each whole text.

The model is fitted on the driver on at most ``sample_rows`` labelled rows, chosen by a
hash of the id, whole texts, as far as they fit into ``sample_chars`` characters: lengths
are summed first, and only texts that fit are moved. Its features are the at most
``most_features`` words and beginnings whose presence in a document goes with the label
most clearly (G statistic); these are what scoring tasks receive. All rows are scored,
over whole texts.

Defined results: null and empty texts have no sentence, and a score of 0. Text is
lower-cased; words are runs of letters; sentences end at ``.``, ``!``, ``?`` or a line
break. Null labels teach nothing; of several labels of an id the highest counts. Equal
texts get equal scores. If no labelled row is toxic, or all are, the score is the share
of toxic ones (0 where there are none). Further columns are never read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

SENTENCE = regex.compile(r"[^.!?\n]+")
WORD = regex.compile(r"\p{L}+")
THRESHOLD = 0.7
SAMPLE_ROWS, SAMPLE_CHARS, MOST_FEATURES, LEAST_G = 5000, 40_000_000, 600, 18.0
ROUNDS, RATE, RIDGE, BIAS = 300, 0.2, 5e-6, -5.0
#: Lengths of the beginnings of words that are features; most words whose weight a task remembers.
BEGINNINGS, REMEMBERED = (3, 4, 5, 6), 150_000


def held_out(id_col: Column) -> Column:
    """True for the third of the ids that no label is learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text that have a letter."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(m[0])]


def features(word: str) -> list[str]:
    """A word's features: the word with its end marked, and its beginnings."""
    return [f"{word}$", *[word[:k] for k in BEGINNINGS if len(word) >= k]]


@dataclass(frozen=True)
class NoisyOr:
    """Weights of features; ``share`` is the score where nothing could be learned."""

    weights: dict[str, float]
    bias: float
    share: float | None = None

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentence(self, text: str) -> float:
        z = self.bias + sum(self.word(w) for w in set(WORD.findall(text.lower())))
        return float(1 / (1 + np.exp(-z)))

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Spans of the sentences whose own probability is at least ``least``."""
        if self.share is not None:
            return []
        return [(a, b, p) for a, b in sentences(text) if (p := self.sentence(text[a:b])) >= least]


def _chosen(texts: list[str], y: np.ndarray, most: int) -> list[str]:
    """The features whose presence in a document goes with its label most clearly.

    Only features of at least three toxic documents are counted in the others, so what is
    held grows with the toxic part of the sample and not with its vocabulary.
    """
    def of(text: str) -> set[str]:
        return {f for w in set(WORD.findall(text.lower())) for f in features(w)}

    toxic = Counter(f for t, bad in zip(texts, y, strict=True) if bad for f in of(t))
    toxic = {f: k for f, k in toxic.items() if k >= 3}
    clean = Counter(f for t, bad in zip(texts, y, strict=True) if not bad for f in of(t) if f in toxic)
    n1 = int(y.sum())
    n0 = len(y) - n1
    scored = []
    for f, k1 in toxic.items():
        k0 = clean[f]
        seen, g = (k0 + k1) / (n0 + n1), 0.0
        for k, n in ((k1, n1), (k0, n0)):
            g += k * np.log(max(k, 1e-9) / (n * seen)) + (n - k) * np.log(max(n - k, 1e-9) / (n * (1 - seen) + 1e-9))
        if k1 / n1 > k0 / n0 and 2 * g >= LEAST_G:
            scored.append((-2 * g, f))
    return [f for _, f in sorted(scored)[:most]]


def fit(texts: list[str], toxic: np.ndarray, most_features: int = MOST_FEATURES, rounds: int = ROUNDS) -> NoisyOr:
    """Maximise the likelihood of the documents' labels under noisy-or, with a ridge, by Adam."""
    y = np.asarray(toxic).astype(bool)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return NoisyOr({}, 0.0, share)
    vocabulary = _chosen(texts, y, most_features)
    number = {w: i for i, w in enumerate(vocabulary)}
    row, col, doc, n = array("i"), array("i"), array("i"), 0
    for d, t in enumerate(texts):
        for a, b in sentences(t):
            known = {number[f] for w in set(WORD.findall(t[a:b].lower())) for f in features(w) if f in number}
            row.extend([n] * len(known))
            col.extend(sorted(known))
            doc.append(d)
            n += 1
    row, col, doc = (np.array(x, np.int64) for x in (row, col, doc))
    w, b = np.zeros(len(vocabulary)), BIAS
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, np.logaddexp(0, z), minlength=len(y))  # -log of the chance that no sentence offends
        pull = np.where(y, -1 / np.maximum(np.expm1(np.minimum(clean, 50)), 1e-9), 1.0) / len(y)
        g = p * pull[doc]
        grad = np.append(np.bincount(col, g[row], minlength=len(w)) + RIDGE * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * min(1.0, 2 * (1 - k / rounds) + 0.02) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return NoisyOr({word: float(x) for word, x in zip(vocabulary, w, strict=True)}, float(b))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS
) -> NoisyOr:
    """Fit on labelled rows that are not held out; labels are the only other input."""
    known = labels.select(
        F.col("doc_id").cast("long").alias("__of"), F.col("toxic").alias("__toxic")
    ).filter("__toxic is not null").filter(~held_out(F.col("__of")))
    known = known.groupBy("__of").agg(F.max("__toxic").alias("__toxic")).orderBy(F.xxhash64("__of"), "__of").limit(sample_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__hash"))
    met = rows.join(F.broadcast(known), F.col("__id") == F.col("__of"))
    # of rows of one id the shortest text; numbers alone, a row an id of the sample
    sized = met.groupBy("__id", "__toxic").agg(
        F.min(F.struct(F.length("__text").alias("n"), F.col("__hash").alias("h"))).alias("x")
    ).select("__id", "__toxic", "x.n", "x.h")
    # giants last; a window over sample_rows rows at most
    order = Window.orderBy(F.col("n") > sample_chars // 100, F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sized.withColumn("__chars", F.sum("n").over(order)).filter(F.col("__chars") <= sample_chars)
    fits = F.broadcast(materialise(fits.select(F.col("__id").alias("__of"), F.col("h").alias("__own"), "__toxic"), "sample"))
    got = rows.join(fits, (F.col("__id") == F.col("__of")) & (F.col("__hash") == F.col("__own")))
    found = got.groupBy("__id").agg(F.min(F.struct(F.col("__text").alias("t"), "__toxic")).alias("x")).select("__id", "x.*").orderBy("__id").toPandas()
    return fit(found["t"].tolist(), found["__toxic"].to_numpy(dtype=np.int64))


def score_column(model: NoisyOr, text: Column) -> Column:
    """The document score of a text column, by batches in Arrow."""
    spark_free = model  # goes to the tasks with the function; its size is bounded by MOST_FEATURES

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(spark_free)
        for texts in batches:
            yield pa.array(
                np.concatenate([np.zeros(0), *[scorer.scores([t or "" for t in texts.slice(a, 500).to_pylist()]) for a in range(0, len(texts), 500)]])
            )
        del scorer
        release()

    return score(text.cast("string"))


class Scorer:
    """Scores many texts; remembers the weights of up to REMEMBERED words and then forgets them all."""

    def __init__(self, model: NoisyOr) -> None:
        self.model, self.known = model, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.share is not None:
            return np.array([self.model.share if sentences(t) else 0.0 for t in texts])
        bias, out, known, words = self.model.bias, np.zeros(len(texts)), self.known, WORD.findall
        for i, text in enumerate(texts):
            z = []
            for s in SENTENCE.findall(text.lower()):
                if found := set(words(s)):
                    total = bias
                    for w in found:
                        x = known.get(w)
                        if x is None:
                            x = known[w] = self.model.word(w)
                        total += x
                    z.append(total)
            if len(known) > REMEMBERED:
                known.clear()
            if z:
                out[i] = -np.expm1(-np.logaddexp(0, z).sum())
        return np.clip(out, 0.0, 1.0)


def detect(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("score", score_column(model, F.col("text"))).select("id", "score")


def judge(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id and score of each row, how many of its sentences offend (probability ``least`` or
    more), and where the worst of them stands (null without any)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(1).to_pylist()
                scores = scorer.scores(texts)
                # a sentence offends only where the whole does, since noisy-or is no less than any of its parts
                found = [model.offending(t, least) if s >= least else [] for t, s in zip(texts, scores.tolist(), strict=True)]
                worst = [max(f, key=lambda x: (x[2], -x[0])) if f else (None, None, None) for f in found]
                columns = [
                    pa.array(scores), pa.array([len(f) for f in found], pa.int64()),
                    *[pa.array([w[k] for w in worst], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                ]
                yield pa.record_batch([batch.column(0), *columns], names=["id", "score", "n_offending", "worst_start", "worst_end", "worst_probability"])
        del scorer
        release()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(
        look, "id long, score double, n_offending long, worst_start long, worst_end long, worst_probability double"
    )


def locate(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each offending sentence: id, start, end (characters) and its probability."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows of found sentences alone are held
            rows = [
                (i, a, b, p) for i, t in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
                ) for a, b, p in model.offending(t or "", least)
            ]
            if rows:
                yield pa.record_batch(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                    names=["id", "start", "end", "probability"]
                )

    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(find, "id long, start long, end long, probability double")


def without_toxic(docs: DataFrame, model: NoisyOr, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows whose score reaches ``threshold``, in their own columns."""
    return docs.filter(score_column(model, F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < threshold)
