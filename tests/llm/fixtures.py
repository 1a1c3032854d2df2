"""Awkward documents that every operator must take."""

from __future__ import annotations

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, row string, kept string, size string, label string"


def docs(spark, rows):
    """(doc_id, text, source) rows with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z", "k", "s", "l") for i, t, s in rows], KIND)


def words(n: int, seed: int = 0) -> str:
    """n words of letters, no two alike, from a rule."""
    def letters(k: int) -> str:
        out = ""
        while k:
            out, k = out + "abcdefghijklmnopqrstuvwxyz"[k % 26], k // 26
        return out

    return " ".join(letters(seed * 100_003 + 7919 * k + 29) for k in range(n))


def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    same, long_text = words(60, 1), words(30_000, 2)
    return docs(spark, [
        (1, same, "a"), (2, same, "b"), (3, None, "a"), (4, "", None), (5, None, None), (6, same, None),
        (7, long_text, "a"), (8, long_text + " end", "a"), (9, words(60, 3), "b"), (9, words(60, 3), "b"), (None, words(60, 4), "b"), (None, None, None),
        (10, " \t\n\x0b ", "b"), (11, "one", "b"), (12, "ÄÖ ß é 日本 😀 ▁x\x00y", "a"), (13, same.upper() + "!", "a"),
    ])


def none(spark):
    return spark.createDataFrame([], KIND)
