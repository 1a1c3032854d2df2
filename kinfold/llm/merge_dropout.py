"""Encoding and decoding with a SentencePiece merge vocabulary, with seeded merge-dropout.

A text is cut where no piece can cross: before each run of spaces, and around line
breaks. Each part has an agenda of candidate merges, best score first and then leftmost.
The n-th candidate that comes up in a part is skipped for good if a keyed hash of the
seed, the document's id, the part's number in the text and n falls below ``dropout``; so
every occurrence of a word is segmented on its own, and one seed gives one segmentation,
on any machine and after any retry.

The agendas of a block of parts advance together, one candidate of each part a step, on
arrays: part x symbol, with the merge of each symbol and its right neighbour.
Parts of more than ``STEPPED`` symbols have a heap of their own. Nothing is remembered
from block to block, so a task's memory is a block's, however long a text is.

With ``dropout`` 0 the ids are those of the SentencePiece library. Decoding does not
depend on the segmentation: pieces are joined, and characters outside the vocabulary
travel as bytes. The space mark U+2581, which the library would turn into a space, also
travels as its bytes, so every text comes back whole.

Defined results: null text counts as empty; an empty text has no ids; null ids count as
-1 in the hash; repeated rows get equal ids; parts of any length are encoded whole.
Further columns are never read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

MARK = "▁"
DROPOUT, SEED = 0.1, 17
#: Parts of more symbols than this have a heap of their own.
STEPPED = 64
#: Characters of texts encoded together, and cells of a block of agendas.
CHARACTERS, CELLS = 1_000_000, 1_500_000
_CUT = re.compile(r"[^ ](?= )|\n")
_MASK, _ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15
_NONE, _GONE, _UNKNOWN = np.int32(2**31 - 1), -2, -1


def mix(x: int) -> int:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & _MASK
    x = (x ^ (x >> 29)) * 0xD6E8FEB86659FD93 & _MASK
    return x ^ (x >> 32)


def mix_all(x: np.ndarray) -> np.ndarray:
    """:func:`mix` of each of an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class MergeCodec:
    """A merge vocabulary: encodes texts and decodes ids."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        ids = {library.id_to_piece(i): i for i in plain}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece of this vocabulary crosses a space or a line break")
        merged = sorted((p for p in ids if len(p) > 1), key=lambda p: -library.get_score(ids[p]))
        # symbols: merged pieces, then single characters
        single = sorted({c for p in ids for c in p})
        self.symbol = {p: k for k, p in enumerate([*merged, *single])}
        self.symbol_id = np.array([ids.get(p, _UNKNOWN) for p in self.symbol], np.int64)
        self.of_character = np.full(0x110000, _UNKNOWN, np.int32)
        for c in single:
            self.of_character[ord(c)] = self.symbol[c]
        self.of_character[ord(" ")] = self.symbol.get(MARK, _UNKNOWN)
        self.of_character[ord(MARK)] = _UNKNOWN  # a real mark must not merge
        self.byte_ids = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        raw = [library.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        scores = {s: k for k, s in enumerate(sorted({library.get_score(ids[p]) for p in merged}, reverse=True))}
        self._pairs(merged, [scores[library.get_score(ids[p])] for p in merged])
        self.base = seed << 32
        self.limit = np.uint64(min(int(dropout * 2.0**64), _MASK))

    def _pairs(self, merged: list[str], ranks: list[int]) -> None:
        """The table of pairs of symbols that merge: open addressing, a row of slots a probe."""
        known, found = self.symbol, {}
        for made, p in enumerate(merged):
            for k in range(1, len(p)):
                a, b = known.get(p[:k]), known.get(p[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = made
        keys, made = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        # of each symbol the rank of the merge that makes it; the last stands for no merge
        self.rank_of = np.append(np.array(ranks, np.int32), np.full(len(known) - len(merged) + 1, _NONE, np.int32))
        self.bits = max(4, int(len(found)).bit_length() + 1)
        self.slot_key, self.slot_made = [], []
        while len(keys):
            at = self._slot(keys, len(self.slot_key))
            _, first = np.unique(at, return_index=True)
            self.slot_key.append(np.full(1 << self.bits, -1, np.int64))
            self.slot_made.append(np.full(1 << self.bits, -1, np.int32))
            self.slot_key[-1][at[first]], self.slot_made[-1][at[first]] = keys[first], made[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, made = keys[left], made[left]

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        odd = np.uint64(_ODD ^ (probe * 0x5851F42D4C957F2E))
        return ((keys.view(np.uint64) ^ (keys.view(np.uint64) >> np.uint64(17))) * odd >> np.uint64(64 - self.bits)).view(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, -1 for pairs that do not merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        for probe, (slot_key, slot_made) in enumerate(zip(self.slot_key, self.slot_made, strict=True)):
            own = keys[open_]
            at = self._slot(own, probe)
            there = slot_key[at]
            hit = there == own
            out[open_[hit]] = slot_made[at[hit]]
            open_ = open_[~hit & (there >= 0)]  # an empty slot ends the search
            if not len(open_):
                break
        return out

    def skipped(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Whether the n-th candidate that comes up in each occurrence is skipped."""
        return mix_all(keys + np.uint64((n + 1) * _ODD & _MASK)) < self.limit

    def _step(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of a block of parts, part by part, and the place of each in ``symbols``."""
        n, w = len(starts), int(lengths.max())
        sym = np.full((n, w + 1), _GONE, np.int32)  # the last column stands for no neighbour
        inside = np.arange(w + 1) < lengths[:, None]
        sym[inside] = symbols[_ranges(starts, lengths)]
        made = np.full((n, w + 1), -1, np.int32)  # what each symbol and its right neighbour merge to
        if w > 1:
            made[:, : w - 1] = self.merge(sym[:, : w - 1].ravel(), sym[:, 1:w].ravel()).reshape(n, w - 1)
        rank = self.rank_of[made]
        after = np.tile(np.arange(1, w + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, w, dtype=np.int16), (n, 1))
        before[:, 0] = w
        after[np.arange(n), lengths - 1] = w
        rows, turn = np.arange(n), 0
        while len(rows):
            own = rank if len(rows) == n else rank[rows]
            i = own.argmin(axis=1)
            live = own[np.arange(len(rows)), i] < _NONE
            rows, i = rows[live], i[live]
            skip = self.skipped(keys[rows], turn)
            rank[rows[skip], i[skip]] = _NONE
            r, i = rows[~skip], i[~skip]
            j, new = after[r, i], made[r, i]
            k, h = after[r, j], before[r, i]
            sym[r, i], sym[r, j], rank[r, j] = new, _GONE, _NONE
            after[r, i], before[r, k] = k, i
            for at, found in ((i, self.merge(new, sym[r, k])), (h, self.merge(sym[r, h], new))):
                made[r, at], rank[r, at] = found, self.rank_of[found]
            turn += 1
        sym[:, w] = _GONE
        left = sym != _GONE
        place = (starts[:, None] + np.arange(w + 1))[left]
        return sym[left], place

    def _heap(self, symbols: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of one long part, and the place of each in it."""
        parts, n, come = symbols.tolist(), len(symbols), 0
        before, after, end = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
        first = self.merge(symbols[:-1], symbols[1:])
        agenda = [(int(self.rank_of[first[i]]), i, i + 1, i + 2, int(first[i])) for i in np.flatnonzero(first >= 0).tolist()]
        heapq.heapify(agenda)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := int(self.merge(np.array([parts[i]]), np.array([parts[j]]))[0])) >= 0:
                heapq.heappush(agenda, (int(self.rank_of[s]), i, j, end[j], s))

        while agenda:
            _, i, j, e, s = heapq.heappop(agenda)
            if parts[i] == _GONE or parts[j] == _GONE or after[i] != j or end[j] != e:
                continue  # one of the two has been merged since
            come += 1
            if mix(key + come * _ODD & _MASK) < self.limit:
                continue
            parts[i], parts[j] = s, _GONE
            end[i], after[i] = e, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out = np.array(parts)
        return out[out != _GONE], np.flatnonzero(out != _GONE)

    def encode_points(self, points: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that begin at ``starts`` of an array of code points, and the number of ids of each."""
        lengths = np.diff(np.append(starts, len(points)))
        symbols = self.of_character[points]
        left = np.zeros(len(points), np.int32)  # at the place of its first character each final symbol, from 1
        order = np.argsort(lengths, kind="stable")
        at, short = 0, int(np.searchsorted(lengths[order], STEPPED, "right"))
        while at < short:
            most = np.searchsorted(lengths[order[at:short]], max(int(lengths[order[at]]) * 5 // 4, 4), "right")
            block = order[at : at + max(1, min(int(most), CELLS // (int(lengths[order[at]]) + 2)))]
            final, place = self._step(symbols, starts[block], lengths[block], keys[block])
            left[place] = final + 2
            at += len(block)
        for p in order[short:].tolist():
            a = int(starts[p])
            final, place = self._heap(symbols[a : a + int(lengths[p])], int(keys[p]))
            left[a + place] = final + 2
        place = np.flatnonzero(left)
        final = left[place].astype(np.int64) - 2
        ids = np.where(final >= 0, self.symbol_id[final], _UNKNOWN)
        counts = np.ones(len(ids), np.int64)
        if len(lost := np.flatnonzero(ids < 0)):  # characters outside the vocabulary travel as bytes
            point, which = np.unique(points[place[lost]], return_inverse=True)
            spelled = [chr(c).encode() for c in point.tolist()]
            length = np.array([len(s) for s in spelled])
            counts[lost] = length[which]
            ids = np.repeat(ids, counts)
            begin = np.cumsum(length) - length
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)][_ranges(begin[which], length[which])]
        return ids.astype(np.int32), np.add.reduceat(counts, np.searchsorted(place, starts)) if len(starts) else counts

    def encode_all(self, texts: Sequence[str], doc_ids: Sequence[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and the number of ids of each text."""
        out, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            nonlocal size
            if group:
                ids, own = self._group(group)
                out.append(ids)
                np.add.at(counts, [g[0] for g in group], own)
                group.clear()
                size = 0

        parts_before: dict[int, int] = {}
        for k, text in enumerate(texts):
            if not text:
                continue
            text, at = " " + text, 0
            while at < len(text):  # a long text in pieces cut between parts
                found = _CUT.search(text, at + CHARACTERS) if len(text) - at > CHARACTERS else None
                end = found.end() if found else len(text)
                piece = text if end - at == len(text) else text[at:end]
                whole = at == 0 and end == len(text)
                if whole and size + len(piece) > CHARACTERS or not whole:
                    flush()
                group.append((k, piece, doc_ids[k], parts_before.pop(k, 0)))
                size += len(piece)
                if not whole:
                    parts_before[k] = group[0][3] + self._starts(np.frombuffer(piece.encode("utf-32-le"), np.uint32), np.array([0])).size
                    flush()
                at = end
            parts_before.clear()
        flush()
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    @staticmethod
    def _starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where parts begin: at texts, at line breaks and after them, and at the first of a run of spaces."""
        space, line = points == 32, points == 10
        begins = line.copy()
        begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begins[texts] = True
        return np.flatnonzero(begins)

    def _group(self, group: list[tuple[int, str, int | None, int]]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(g[1] for g in group).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(g[1]) for g in group])
        begin = np.cumsum(lengths) - lengths
        starts = self._starts(points, begin)
        first = np.searchsorted(starts, begin)
        of = np.repeat(np.arange(len(group)), np.diff(np.append(first, len(starts))))
        bases = np.array([mix((self.base ^ (-1 if g[2] is None else g[2])) & _MASK) for g in group], np.uint64)
        number = np.arange(len(starts)) - first[of] + np.array([g[3] for g in group])[of]
        ids, counts = self.encode_points(points, starts, mix_all(bases[of] + number.astype(np.uint64)))
        return ids, np.add.reduceat(counts, first)

    def encode(self, text: str, doc_id: int | None = None) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text], [doc_id])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.raw_length):
            raise ValueError("an id is not in the vocabulary")
        return self.raw_bytes[_ranges(self.raw_start[ids], self.raw_length[ids])].tobytes()

    def decode(self, ids) -> str:
        """The text that the ids encode."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")[1:]


_CODECS: dict[tuple, MergeCodec] = {}


def codec(model: bytes, dropout: float, seed: int) -> MergeCodec:
    """The codec of a worker process, whose tables (a few MB) later tasks find again."""
    key = (hash(model), dropout, seed)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = MergeCodec(model, dropout, seed)
    return _CODECS[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """id, ids, n_ids and lossless (the ids decode to the text) of each row."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one file of a fixed vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value, dropout, seed)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                values, counts = own.encode_all(texts, batch.column(0).to_pylist())
                ends = np.cumsum(counts)
                lossless = [
                    not t if not n else own.decode_bytes(values[e - n : e])[1:] == t.encode() for t, n, e in zip(
                        texts, counts.tolist(), ends.tolist(), strict=True
                    )
                ]
                offsets = np.append(0, ends).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(counts),
                        pa.array(lossless, pa.bool_())
                    ],
                    names=["id", "ids", "n_ids", "lossless"]
                )
        release()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, ids array<int>, n_ids long, lossless boolean")


def decode(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id and text of rows of ids; null ids decode to null."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value, 0.0, 0)
        for batch in batches:
            yield pa.record_batch(
                [batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())],
                names=["id", "text"]
            )
        release()

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")
