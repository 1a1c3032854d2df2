"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling (gear) hash of its last 32 bytes has ``mask_bits`` zero
bits, so equal passages are cut alike wherever they stand. A text then is its recipe: the
ordered list of its chunks' identifiers. Only recipes are shuffled, never texts, so a
long document costs 8 bytes for each of its chunks.

Identifiers are the first 8 bytes of a chunk's SHA-256. They are verified: all chunks
with one identifier must agree in the other 24 bytes and in length. Texts with a chunk
that fails get the full digests into their key, so equal keys still mean equal texts.

Defined results:

* null text counts as empty; an empty text has an empty recipe, and all of them are copies;
* of equal texts the row with the largest id stays, null ids being smaller than all others;
* rows that repeat an id and its text are copies as well: one of them stays;
* no rows give no rows; further columns of the input are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_marked, materialise, release

WINDOW = 32
#: A chunk has about 2 ** MASK_BITS bytes, and at least and at most these.
MASK_BITS, LEAST, MOST = 11, 256, 16_384

_RECIPES = pa.schema(
    [
        ("id", pa.int64()), ("row", pa.int64()), ("text_sha256", pa.string()),
        ("chunks", pa.list_(pa.struct([("short", pa.int64()), ("rest", pa.binary()), ("length", pa.int32())])))
    ]
)


def _gear() -> np.ndarray:
    """256 fixed 32-bit numbers, from a rule: SHA-256 of the byte's value."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def cut(data: bytes, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data``, the last being its length; none for no data."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    rolled = GEAR[np.frombuffer(data, dtype=np.uint8)]
    step = 1
    while step < WINDOW:  # doubles the window: h2[i] = h[i] + (h[i - step] << step)
        shifted = np.left_shift(rolled[:-step], np.uint32(step))
        rolled = rolled.copy()
        rolled[step:] += shifted
        step *= 2
    marks = (np.flatnonzero(rolled >> np.uint32(32 - mask_bits) == 0) + 1).tolist()
    ends, last = [], 0
    for mark in [*marks, n]:
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least or mark == n and mark > last:
            last = mark
            ends.append(last)
    return ends


def recipe(data: bytes, **sizes: int) -> list[dict]:
    """The ordered chunks of ``data`` as identifier, rest of the digest and length."""
    out, last = [], 0
    for end in cut(data, **sizes):
        digest = hashlib.sha256(data[last:end]).digest()
        out.append({"short": int.from_bytes(digest[:8], "little", signed=True), "rest": digest[8:], "length": end - last})
        last = end
    return out


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            rows = pa.array(range(row, row + len(texts)), pa.int64())
            row += len(texts)
            yield pa.record_batch(
                [
                    batch.column(0), rows, pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array([recipe(t) for t in texts], _RECIPES.field("chunks").type)
                ],
                schema=_RECIPES
            )
    release()


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chunks."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    recipes = materialise(
        narrow.mapInArrow(_recipes, "id long, row long, text_sha256 string, chunks array<struct<short: long, rest: binary, length: int>>"), "recipes"
    )
    chunks = recipes.select("row", F.explode("chunks").alias("c")).select("row", "c.short", F.struct("c.rest", "c.length").alias("content"))
    clashes = chunks.groupBy("short").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a != b").select("short")
    lists = recipes.select("id", "row", "text_sha256", F.col("chunks.short").alias("recipe"), F.lit("").alias("clash"))
    clashes = materialise(clashes, "clashes")
    if not clashes.isEmpty():  # two contents under one short identifier: their texts are told apart by whole digests
        hit = chunks.join(clashes, "short").select("row").distinct()
        full = F.concat_ws("", F.transform("chunks", lambda c: F.concat(F.hex(c["rest"]), c["length"].cast("string"))))
        lists = recipes.join(hit.withColumn("hit", F.lit(True)), "row", "left").select(
            "id", "row", "text_sha256", F.col("chunks.short").alias("recipe"), F.when(F.col("hit"), F.sha2(full, 256)).otherwise("").alias("clash")
        )
    groups = lists.groupBy("recipe", "clash").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return lists.join(groups, ["recipe", "clash"]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`copies` drops, in their own columns."""
    marks = copies(docs, id_col, text_col).select("id", F.col("text_sha256").alias("text_key"), "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return keep_marked(docs, materialise(marks, "copies"), F.col(id_col).cast("long"), F.sha2(text.cast("binary"), 256))
