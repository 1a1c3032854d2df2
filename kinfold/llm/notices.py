"""License scan: fuzzy search for short notices by pigeonholed seeds and bounded errors.

A text is put in canonical form: A-Z lower-cased, words (runs of digits, a-z and characters
beyond ASCII) joined by single spaces. A notice may stand in it with ``edits`` changed,
lost or added characters at most. Its text is split into ``edits + 1`` pieces, one of
which such a place must hold unchanged (pigeonhole), so one automaton over the pieces of
all notices finds every candidate; the window around a candidate goes to the regex
library, whose bounded-error matching verifies the notice, counts its edits and gives its
span. A place begins and ends with whole words. Phrases of the base must stand exactly:
they are seeds of one piece and need no verification.

A notice's ``exact`` words must stand unchanged, since an edit would turn so short a word
into another one; only the rest has pieces and edits.

Memory: a text at a time, with an array of word offsets only where something was found; the
automaton has a few dozen pieces. No shuffle: documents stay where they are read.

Defined results: null is empty; a text without words has no finds, empty labels and score
0; repeated rows give repeated rows, null ids stay; further columns are never read. Of
finds of one notice that overlap the first by place stays. ``score`` is the greatest share
of a notice's characters that stand unchanged, 1 for a phrase of the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Characters of a notice for an edit, and edits at most.
CHARACTERS_AN_EDIT, MOST_EDITS = 8, 3

#: Phrases of the base, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    exact: str = ""
    edits: int = field(default=-1)

    @property
    def whole(self) -> str:
        return f"{self.exact} {self.text}" if self.exact else self.text

    @property
    def bound(self) -> int:
        return self.edits if self.edits >= 0 else min(MOST_EDITS, len(self.whole) // CHARACTERS_AN_EDIT)


#: Notices searched for with errors; those of the base come first.
NOTICES = (
    Notice("gnu general public license", "gpl"),
    Notice("apache license", "apache"),
    Notice("license", "mit", exact="mit"),
    Notice("creative commons attribution", "cc-by"),
    Notice("nc", "cc-by-nc", exact="cc by", edits=0),
    Notice("nd", "cc-by-nd", exact="cc by", edits=0),
    Notice("sa", "cc-by-sa", exact="cc by", edits=0),
    Notice("gnu lesser general public license", "lgpl"),
    Notice("gnu affero general public license", "agpl"),
    Notice("mozilla public license", "mpl"),
    Notice("license", "bsd", exact="bsd"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    Notice("permission is hereby granted free of charge", "mit"),
)
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAPS = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
FIND = "struct<label: string, notice: string, first_word: bigint, n_words: bigint, start: bigint, end: bigint, edits: int, similarity: double, base: boolean>"


def canonical(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and all between words turned into a space."""
    return pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.string())), pattern=_GAPS, replacement=" ")


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """``text`` cut into ``edits + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Finds places of phrases and notices in canonical texts."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base: dict[str, str] | None = None, remembered: int = 50_000) -> None:
        self.notices, self.base = notices, list((BASE if base is None else base).items())
        seeds: dict[str, list[tuple[int, int]]] = {f" {phrase} ": [(-1 - k, 0)] for k, (phrase, _) in enumerate(self.base)}
        self.patterns = []
        for k, n in enumerate(notices):
            # exact words have no seeds: what follows them is rarer
            skipped = len(n.exact) + 1 if n.exact else 0
            whole, bound = n.whole, n.bound
            cut = pieces(n.text, bound) if bound else [(-skipped, f" {whole} ")]
            for offset, piece in cut:
                seeds.setdefault(piece, []).append((k, offset + skipped if bound else -1))
            before = f"{regex.escape(n.exact, literal_spaces=True)} " if n.exact else ""
            self.patterns.append(regex.compile(f"(?b)(?<= ){before}(?:{regex.escape(n.text, literal_spaces=True)}){{e<={bound}}}(?= )"))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()
        self.remembered, self.known = remembered, {}

    def _verified(self, k: int, window: str) -> tuple[int, int, int] | None:
        """Start, end and edits of notice ``k`` in a window, if it is there."""
        if self.notices[k].exact and f" {self.notices[k].exact} " not in window:
            return None
        if (k, window) not in self.known:
            if len(self.known) > self.remembered:
                self.known.clear()
            m = self.patterns[k].search(window)
            self.known[k, window] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
        return self.known[k, window]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice or -1 - phrase, edits) of places in ``text``, which begins
        and ends with a space, sorted."""
        out, last = [], [(0, 0)] * len(self.notices)
        for end, (length, of) in self.automaton.iter(text):
            at = end - length + 1
            for k, offset in of:
                if k < 0:
                    out.append((at + 1, end, k, 0))
                    continue
                if at >= last[k][0] and end < last[k][1]:  # within the place found last
                    continue
                bound, size = self.notices[k].bound, len(self.notices[k].whole)
                low = max(0, at - offset - bound - 1)
                found = self._verified(k, text[low : at - offset + size + bound + 1])
                if found and low + found[0] >= last[k][1]:
                    last[k] = (low + found[0], low + found[1])
                    out.append((*last[k], k, found[2]))
        return sorted(out)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES, base: dict[str, str] | None = None
) -> DataFrame:
    """A row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and the places in ``finds``, whose start and end are characters of the
    text as it is."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices, base)
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                rows = [finder_row(finder, t, batch.column(1)[i]) for i, t in enumerate(canonical(batch.column(1)).to_pylist())]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _FINDS]
                yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *_COLUMNS])
        del finder
        release()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(
        search,
        f"id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, finds array<{FIND}>"
    )


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "finds"]
_FINDS = pa.list_(
    pa.struct(
        [
            ("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()),
            ("end", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("base", pa.bool_())
        ]
    )
)


def finder_row(finder: Finder, text: str, original: pa.Scalar) -> tuple:
    """The result of one text in canonical form; ``original`` is read where something was found."""
    bare = text.strip(" ")
    if not bare:
        return 0, 0, None, None, "", "", 0.0, []
    text = f" {bare} "
    n_words, places = text.count(" ") - 1, finder.find(text)
    if not places:
        return n_words, 0, None, None, "", "", 0.0, []
    spans = [m.span() for m in WORD.finditer(original.as_py())]
    finds, seen, word = [], 0, -1
    for start, end, k, edits in places:
        word, seen = word + text.count(" ", seen, start), start
        n = text.count(" ", start, end) + 1
        if k < 0:
            (phrase, label), similarity = finder.base[-1 - k], 1.0
        else:
            phrase, label = finder.notices[k].whole, finder.notices[k].label
            similarity = 1 - edits / len(phrase)
        finds.append(
            {
                "label": label, "notice": phrase, "first_word": word, "n_words": n, "start": spans[word][0], "end": spans[word + n - 1][1],
                "edits": edits, "similarity": similarity, "base": k < 0
            }
        )
    own = [f for f in finds if f["base"]]
    firsts = [f["first_word"] for f in own]
    labels = [",".join(sorted({f["label"] for f in part})) for part in (own, finds)]
    return n_words, len(own), min(firsts, default=None), max(firsts, default=None), *labels, max(f["similarity"] for f in finds), finds


def spans(scanned: DataFrame) -> DataFrame:
    """A row per place that :func:`scan` found."""
    return scanned.select("id", F.explode("finds").alias("find")).select("id", "find.*")
