"""Token-ID output: fixed-size id blocks, transposed into planes, compressed and indexed.

Documents are range-partitioned by id and sorted; each task encodes its range and writes
one shard file, so shards in their order hold all documents in ascending id order. Ids
are cut into blocks of ``block`` ids. A block is transposed into 4 byte planes or 32 bit
planes; each plane is compressed with zstandard by itself, and planes of zeros (the upper
bytes of ids below 65,536) take no room. The file ends with its index.

Layout, little-endian: ``KBP1``, the planes of all blocks, the footer (compressed JSON
head and arrays), its length as 8 bytes, ``KBP1``. The footer holds for each block its
offset, ids, compressed length of each plane and crc32, and for each document its id and
number of ids, so any document can be read by decoding only its own blocks.

A shard is written under a name of its own attempt and then renamed, so a task that runs
again (or twice) leaves one whole file. Paths may be of any file system that pyarrow
opens. A shard's memory is one batch, one block and the index.

Defined results: null text counts as empty; each document ends with ``end_id``, so an
empty one has that alone; null ids come first, equal ids are ordered by a hash of the
text; no rows give no shards. Further columns are never read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, release

MAGIC = b"KBP1"
BLOCK, LEVEL = 65_536, 3
#: Distinct pieces of words whose ids a task remembers; it then forgets all.
REMEMBERED = 400_000


def split_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of 32-bit ids, lowest first; a plane of zeros is empty."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T.copy(), axis=1, bitorder="little")
    else:
        planes = octets.T.copy()
    return [p.tobytes() if p.any() else b"" for p in planes]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids that :func:`split_planes` had."""
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in planes], axis=1)
    else:
        rows = [np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] if p else np.zeros(n, np.uint8) for p in planes]
        octets = np.packbits(np.stack(rows, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class ShardWriter:
    """Writes blocks as they fill; documents may span blocks."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = LEVEL) -> None:
        self.out, self.block, self.bits = out, block, bits
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.left = np.zeros(0, np.uint32)
        self.chunks: list[tuple] = []
        self.ids, self.nulls, self.counts = array("q"), array("B"), array("I")
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.ids.extend(i or 0 for i in doc_ids)
        self.nulls.extend(i is None for i in doc_ids)
        self.counts.extend(counts.tolist())
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            self._chunk(ids[a : a + self.block])
        self.left = ids[whole:].copy()

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.squeeze.compress(p) if p else b"" for p in split_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *map(len, packed)))
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Write what is left and the index; the number of ids."""
        if len(self.left):
            self._chunk(self.left)
        arrays = {
            "chunks": np.array(self.chunks, np.int64).reshape(len(self.chunks), -1), "doc_ids": np.array(self.ids, np.int64),
            "nulls": np.array(self.nulls, np.uint8), "counts": np.array(self.counts, np.uint32)
        }
        head = json.dumps(
            {"planes": 32 if self.bits else 4, "block": self.block, "arrays": [[k, v.dtype.str, list(v.shape)] for k, v in arrays.items()]}
        ).encode()
        footer = self.squeeze.compress(len(head).to_bytes(4, "little") + head + b"".join(v.tobytes() for v in arrays.values()))
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return int(arrays["counts"].sum(dtype=np.int64))


class Shard:
    """Reads a shard file: the index at once, blocks on demand."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        tail = self._read(size - 12, 12)
        if tail[8:] != MAGIC or self._read(0, 4) != MAGIC:
            raise ValueError("not a shard file, or cut short")
        n = int.from_bytes(tail[:8], "little")
        raw = zstandard.ZstdDecompressor().decompress(self._read(size - 12 - n, n), max_output_size=1 << 31)
        at = 4 + int.from_bytes(raw[:4], "little")
        head = json.loads(raw[4:at])
        found = {}
        for name, kind, shape in head["arrays"]:
            count = int(np.prod(shape))
            found[name] = np.frombuffer(raw, kind, count, at).reshape(shape)
            at += count * np.dtype(kind).itemsize
        self.block, self.chunks, self.counts = head["block"], found["chunks"], found["counts"]
        self.doc_ids = [None if z else int(i) for i, z in zip(found["doc_ids"], found["nulls"], strict=True)]
        self.ends = np.cumsum(self.counts, dtype=np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, *lengths = (int(x) for x in self.chunks[k])
        data, planes, unpack = self._read(at, sum(lengths)), [], zstandard.ZstdDecompressor()
        p = 0
        for length in lengths:
            planes.append(unpack.decompress(data[p : p + length], max_output_size=4 * n + 64) if length else b"")
            p += length
        ids = join_planes(planes, n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, place of its first id in the shard, ids) of each document, a block at a time."""
        have, base, k = np.zeros(0, np.uint32), 0, 0
        for doc_id, count, end in zip(self.doc_ids, self.counts.tolist(), self.ends.tolist(), strict=True):
            start = end - count
            parts = [have[start - base :]] if start - base < len(have) else []
            size = sum(map(len, parts))
            while size < count:
                base += len(have)
                have = self.chunk(k)
                k += 1
                parts.append(have[max(0, start - base) :])
                size += len(parts[-1])
            ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
            yield doc_id, start, ids[:count]


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies show for each byte: visible ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, spare = {b: chr(b) for b in own}, iter(range(256, 512))
    return [shown.get(b) or chr(next(spare)) for b in range(256)]


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` one after another, and where each begins, with the end of the last."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])], before


def _kinds() -> np.ndarray:
    """Kind of each byte of a plain word: 1 letter, 2 digit, 3 mark, 0 not plain. The apostrophe may start a contraction and ``<`` an added token."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = kinds[0x80:0xC0] = kinds[0xC3:0xC6] = 1
    kinds[list(b"0123456789")] = 2
    kinds[list(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")] = 3
    return kinds


def _lower_letters() -> np.ndarray:
    """Both bytes of the lower case of each character from U+00C0 to U+017F; zeros where that is no single letter from there."""
    lower = np.zeros((192, 2), np.uint8)
    for k in range(192):
        c = chr(0xC0 + k).lower()
        if len(c) == 1 and "\u00df" <= c <= "\u017e" and c != "\u00f7":
            lower[k] = list(c.encode())
    return lower


class WordEncoder:
    """Encodes whole texts with a tokenizers file.

    If the file's normaliser and splitter are those of ``BY_WORD``, no pattern matches
    across white space, so a text's ids are those of its words in order. The distinct words
    of a batch then are cut into pieces all at once, by the kinds of their bytes, and each
    distinct piece is encoded once: pieces of words of plain Latin letters, digits and marks
    go straight to the library's model, all other words whole through its pipeline.
    With any other file the library encodes the whole texts.
    """

    BY_WORD = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    )

    KINDS, LOWER = _kinds(), _lower_letters()

    def __init__(self, json_text: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(json_text)
        parts = json.loads(json_text)
        self.by_word = (parts.get("normalizer"), (parts.get("pre_tokenizer") or {}).get("pretokenizers")) == self.BY_WORD
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.values, self.ends = array("I"), array("q", [0])

    def cut(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """Pieces of all words one after another, plain ones in lower case; which distinct pieces are words to
        encode whole; where each word's pieces begin, with the end of the last."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = self.KINDS[text]
        lead = np.flatnonzero((text >= 0xC3) & (text <= 0xC5))
        letters = self.LOWER[(text[lead] - 0xC3) * np.int64(64) + (text[lead + 1] & 0x3F)]
        odd = kind == 0
        odd[lead[letters[:, 0] == 0]] = True
        seen = np.concatenate([[0], np.cumsum(odd)])
        whole = np.repeat(seen[offsets[1:]] > seen[offsets[:-1]], np.diff(offsets))
        low = text + 32 * ((text >= 65) & (text <= 90) & ~whole).astype(np.uint8)
        plain = ~whole[lead]
        low[lead[plain]], low[lead[plain] + 1] = letters[plain, 0], letters[plain, 1]
        begins = kind == 2
        begins[1:] |= kind[1:] != kind[:-1]
        begins &= ~whole
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(text))), pa.py_buffer(low)).dictionary_encode()
        apart = np.zeros(len(pieces.dictionary), bool)
        apart[np.asarray(pieces.indices)[whole[at]]] = True
        return pieces, apart, np.concatenate([[0], np.cumsum(begins)])[offsets]

    def ids(self, piece: str, apart: bool) -> list[int]:
        if apart:
            return self.whole.encode(piece, add_special_tokens=False).ids
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if not self.by_word:
            found = [e.ids for e in self.whole.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        pieces, apart, first = self.cut(coded.dictionary)
        number, at = self.number, np.empty(len(pieces.dictionary), np.int64)
        for j, (piece, alone) in enumerate(zip(pieces.dictionary.to_pylist(), apart.tolist(), strict=True)):
            k = number.get(piece)
            if k is None:
                k = number[piece] = len(number)
                self.values.extend(self.ids(piece, alone))
                self.ends.append(len(self.values))
            at[j] = k
        ends, used = np.array(self.ends, np.int64), at[np.asarray(pieces.indices)]
        ids, before = _gather(np.array(self.values, np.uint32), ends[used], ends[used + 1] - ends[used])
        ends, words = before[first], np.asarray(coded.indices)
        ids, before = _gather(ids, ends[words], ends[words + 1] - ends[words])
        if len(number) > self.remembered:
            self.forget()
        return ids, np.diff(before[offsets - offsets[0]])


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(json_text: str) -> WordEncoder:
    """The encoder of a worker process, whose vocabulary later tasks find again."""
    key = hash(json_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(json_text)
    return _ENCODERS[key]


def write(
    docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    block: int = BLOCK, bits: bool = False
) -> DataFrame:
    """Write shard files below ``path`` and return their manifest, a row a shard: shard,
    path, n_docs, n_ids and base (ids of all shards before it)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one file of a fixed tokenizer

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        shard, writer, words = context.partitionId(), None, encoder(vocabulary.value)
        final = f"{folder}/shard-{shard:06d}.kbp"
        tried = f"{folder}/_{shard:06d}-{context.taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(folder, recursive=True)
                writer = ShardWriter(store.open_output_stream(tried), block, bits)
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                ids, counts = words.encode(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                writer.add(part.column(0).to_pylist(), counts + 1, ids)
        words.forget()
        release()
        if writer is not None:
            n = writer.close()
            store.move(tried, final)
            yield pa.record_batch(
                [
                    pa.array([shard], pa.int32()), pa.array([final if isinstance(store, fs.LocalFileSystem) else f"{path}/shard-{shard:06d}.kbp"]),
                    pa.array([len(writer.ids)], pa.int64()), pa.array([n], pa.int64())
                ],
                names=["shard", "path", "n_docs", "n_ids"]
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = narrow.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    manifest = materialise(ordered.mapInArrow(write_shard, "shard int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per document of the shards: id, start (its place among all ids), n_ids,
    ids_crc32 (of its ids as little-endian 32-bit numbers), and with ``with_ids`` the ids."""

    def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * with_ids]
        names = ["id", "start", "n_ids", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with store.open_input_file(place) as file:
                    rows, held = [], 0
                    for doc_id, start, ids in Shard(file).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids.tolist()] * with_ids))
                        held += len(ids) if with_ids else 1
                        if held >= 200_000:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    shards = materialise(manifest.select("path", "base"), "shards")
    n = shards.count()
    return shards.repartition(max(1, min(n, 20_000))).mapInArrow(read_shard, "id long, start long, n_ids long, ids_crc32 long" + ", ids array<long>" * with_ids)
