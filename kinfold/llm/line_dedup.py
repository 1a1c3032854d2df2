"""Substring deduplication by hashing lines or paragraphs.

A unit is a line, or a paragraph (lines up to a blank one), or with ``by="both"`` each
line and each paragraph of more than one line with words. Its digest is of its normalised
form: Unicode-folded words, so case, spacing, punctuation and, in a paragraph, the places
where its lines are wrapped do not count.
Digests are grouped globally, which keeps one small row a digest (minimum of rank and a
count, combined before the shuffle). Groups of one are dropped and the others written;
the occurrences then meet them in a join of two tables, which Spark broadcasts or splits
by skew, so a line that a third of all documents share needs no task of its own. Texts
never move.

Defined results:

* rank is (id, hash of the text, unit number); the lowest occurrence stays, nulls first;
* units of fewer than ``least_words`` words are no passages and are left alone;
* rows that repeat an id and its text are one document: nothing is removed for them;
* a unit repeated inside one document is removed there as well, after its first place;
* with ``both``, units are numbered by their first line, a paragraph meets a line of the
  same words, and the words of all that is removed stand at a lower rank;
* offsets are characters of the original text, the end excluding the line break;
* null and empty texts have no units; further columns are never read.

Passages that repeat across documents, whatever lines they stand in, come from
:func:`passages`: the words of a text are one long line, cut at no break but hashed as
lines of ``stretch`` words from each word on. Of the lines within any ``passage`` words
in a row the one of least digest is kept, so that equal passages keep equal lines, and
kept lines are grouped as above, in the document that stays as well as in the others:

* a passage of ``passage`` words or more that stands in two documents is always found,
  with at most ``passage - stretch`` words lost at either end; what is found repeats for
  ``stretch`` words at least (by digests of 64 bits);
* found lines that overlap or touch are one passage; its ``keep_id`` is the smallest id
  that has any of them, null before others;
* a passage repeated inside one document alone is none.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

#: Words that a unit needs to be a passage.
LEAST_WORDS = 20
#: Words of a passage that is found in whatever lines it stands, and of the lines that it is found by.
PASSAGE, STRETCH = 50, 40
#: Words whose hashes a task remembers at most between batches, and characters it takes at once beside a text.
REMEMBERED, AT_ONCE = 100_000, 1_000_000
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_SPLIT = {"line": regex.compile(r"[^\n]+"), "paragraph": regex.compile(r"(?:[^\n]+\n?)+"), "both": regex.compile(r"[^\n]+")}
_UNITS = "id long, body long, unit int, start long, end long, n_words int, digest binary"
_NAMES = [x.split()[0] for x in _UNITS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def normal(unit: str) -> list[str]:
    """Words of a unit: compatibility-composed, case-folded, without punctuation."""
    return WORD.findall(unit.lower() if unit.isascii() else unicodedata.normalize("NFKC", unit).casefold())


def units_of(text: str, by: str = "line", least_words: int = LEAST_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(number, start, end, words, digest) of each unit that is long enough."""
    if by == "both":
        return _lines_and_paragraphs(text, least_words)
    out = []
    for k, m in enumerate(_SPLIT[by].finditer(text)):
        a, b = m.span()
        unit = m[0]
        if unit.endswith("\n"):
            b, unit = b - 1, unit[:-1]
        if b - a >= 2 * least_words - 1 and len(words := normal(unit)) >= least_words:
            out.append((k, a, b, len(words), _digest(words)))
    return out


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def _lines_and_paragraphs(text: str, least_words: int) -> list[tuple[int, int, int, int, bytes]]:
    out, block, last = [], [], -1  # block: number, start, end and words of a paragraph's lines with words

    def close() -> None:
        if len(block) > 1:  # a paragraph of one line is that line
            words = [w for x in block for w in x[3]]
            if len(words) >= least_words:
                out.append((block[0][0], block[0][1], block[-1][2], len(words), _digest(words)))
        block.clear()

    for k, m in enumerate(_SPLIT["both"].finditer(text)):
        a, b = m.span()
        if a != last + 1:
            close()
        last = b
        if words := normal(m[0]):
            block.append((k, a, b, words))
            if len(words) >= least_words:
                out.append((k, a, b, len(words), _digest(words)))
    close()
    return out


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """Every unit of every text, with its digest; ``body`` is a hash of the whole text."""
    if by not in _SPLIT:
        raise ValueError(f"units are lines, paragraphs or both, not {by}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    body = None
                    for x in units_of(text, by, least_words):
                        body = xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63) if body is None else body
                        rows.append((i, body, *x))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, _UNITS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each occurrence to remove: id, body, unit, start, end, n_words, digest,
    the occurrence that stays (first_id, first_unit, first_start, first_end) and
    group_size (documents' occurrences)."""
    found = materialise(units(docs, id_col, text_col, by, least_words), "units")
    rank = F.struct("id", "body", "unit", "start", "end")
    groups = found.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups.filter("first != last").drop("last"), "groups")
    again = found.join(groups, "digest").filter(~rank.eqNullSafe(F.col("first")))
    kept = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "unit", "start", "end")]
    return again.select("id", "body", "unit", "start", "end", "n_words", F.hex("digest").alias("digest"), *kept, "group_size")


class _Hashes(dict):
    """Hash of each word in normal form, remembered."""

    def __missing__(self, word: str) -> int:
        normal_form = word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).casefold()
        found = self[word] = xxhash.xxh3_64_intdigest(normal_form.encode())
        return found


@functools.cache
def _word_characters() -> np.ndarray:
    """For each code point, whether words have it."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, bool)
    for m in WORD.finditer(every):
        out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = True
    out[0xD800:0xE000] = False
    return out


def _digests(words: np.ndarray, length: int) -> np.ndarray:
    """Digest of the ``length`` words from each word on."""
    factor, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(words) - length + 1, np.uint64)
    for k in range(length):
        out *= factor
        out += words[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def stretches_of(texts: list[str], passage: int, stretch: int, hashes: _Hashes) -> tuple[np.ndarray, ...]:
    """(text's number, first word, start, length, digest) of the lines kept."""
    joined = "\n".join(texts)
    inside = np.zeros(len(joined) + 2, np.int8)
    inside[1:-1] = _word_characters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if len(starts) < passage:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    words = np.fromiter((hashes[joined[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    text = np.searchsorted(begins, starts, "right") - 1
    digests = _digests(words, stretch)
    windows = len(words) - passage + 1
    least, at = digests[:windows].copy(), np.arange(windows)
    for k in range(1, passage - stretch + 1):
        less = np.flatnonzero(digests[k : k + windows] < least)
        least[less], at[less] = digests[less + k], less + k
    at = np.unique(at[text[:windows] == text[passage - 1 :]])  # windows within one text
    own = text[at]
    return own, at - np.searchsorted(text, own), starts[at] - begins[own], ends[at + stretch - 1] - starts[at], digests[at]


def _portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first number, texts) of portions of ``AT_ONCE`` characters, the last text of each beyond them."""
    first = size = 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= AT_ONCE or i == len(texts):
            yield first, texts[first:i]
            first, size = i, 0


def stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, stretch: int = STRETCH) -> DataFrame:
    """The lines of ``stretch`` words that stand for every text's passages; see the module."""
    if not 1 <= stretch <= passage:
        raise ValueError(f"lines of {stretch} words do not fit passages of {passage}")
    names = ["id", "body", "first_word", "start", "length", "digest"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in (whole.slice(a, 200) for whole in batches for a in range(0, whole.num_rows, 200)):
            every = [t or "" for t in batch.column(1).to_pylist()]
            for a, texts in _portions(every):
                own, *places, digests = stretches_of(texts, passage, stretch, hashes)
                bodies = np.zeros(len(texts), np.int64)
                for i in np.unique(own):
                    bodies[i] = xxhash.xxh3_64_intdigest(texts[i].encode()) - (1 << 63)
                columns = [batch.column(0).take(pa.array(own + a)), pa.array(bodies[own]), *(pa.array(x.astype(np.int64)) for x in places)]
                yield pa.record_batch([*columns, pa.array(digests.view(np.int64))], names=names)
                if len(hashes) > REMEMBERED:
                    hashes.clear()
        release()

    kinds = ", ".join(f"{name} long" for name in names)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, kinds)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, stretch: int = STRETCH) -> DataFrame:
    """A row for each passage that repeats across documents, in each document that has it:
    id, body, start, end, n_words and keep_id (its own id where it stays)."""
    found = materialise(stretches(docs, id_col, text_col, passage, stretch), "stretches")
    document = F.xxhash64("id", "body")
    groups = found.groupBy("digest").agg(
        F.min(document).alias("one"), F.max(document).alias("other"), F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("nameless")
    )
    groups = groups.filter("one != other").select("digest", "nameless", F.when(~F.col("nameless"), F.col("least")).alias("first"))
    shared = found.join(materialise(groups, "shared"), "digest")
    before = Window.partitionBy("id", "body").orderBy("first_word")
    reach = F.lag("first_word").over(before) + stretch
    apart = shared.withColumn("apart", F.when(F.col("first_word") <= reach, 0).otherwise(1))
    placed = apart.withColumn("number", F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranges = placed.groupBy("id", "body", "number").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
        (F.max("first_word") - F.min("first_word") + stretch).alias("n_words"),
        F.min("first").alias("first"), F.max("nameless").alias("nameless")
    )
    return ranges.select("id", "body", "start", "end", "n_words", F.when(~F.col("nameless"), F.col("first")).alias("keep_id"))


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``found`` cut from their texts; a line goes with its break."""

    @F.pandas_udf("long")
    def body_of(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63)).astype("int64")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is not None and own is not None:
                kept, at = [], 0
                for x in sorted((s["start"], s["end"]) for s in own):
                    kept.append(text[at : x[0]])
                    at = max(at, x[1] + 1 if text[x[1] : x[1] + 1] == "\n" else x[1])  # a line may lie in a paragraph
                text = "".join([*kept, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    spans = found.groupBy(F.col("id").alias("__id"), F.col("body").alias("__body")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (body_of(F.col(text_col)) == F.col("__body")), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("__spans"))).select(*[c for c in docs.columns])
