"""License scan, embedding whitening and divergence audit against plain loops, and awkward inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import divergence, notices, toxicity, whitening

from .fixtures import docs, none, odd, words

# 11: license scan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_labels(text):
    """Labels of all notices, by the edit distance of every run of words."""
    own, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})), set()
    for n in notices.NOTICES:
        exact = n.exact.split()
        for i in range(len(own)):
            for j in range(i + len(exact) + 1, min(len(own), i + len(n.whole.split()) + n.bound + 1) + 1):
                rest = " ".join(own[i + len(exact) : j])
                if own[i : i + len(exact)] == exact and abs(len(rest) - len(n.text)) <= n.bound and distance(rest, n.text) <= n.bound:
                    out.add(n.label)
    return own, out | {label for phrase, label in notices.BASE.items() if f" {phrase} " in f" {' '.join(own)} "}


def edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("aeimnrst ") + text[i:], text[:i] + rng.choice("aeimnrst") + text[i + 1 :]])
    return text


def test_notices_against_edit_distances(spark):
    rng, rows = random.Random(11), []
    for k in range(260):
        n = notices.NOTICES[k % len(notices.NOTICES)]
        body = words(12, k).split()
        body.insert(rng.randrange(12), edited(rng, n.whole.title() if k % 3 else n.whole, rng.randrange(n.bound + 3)))
        rows.append((k, rng.choice(["\n", " ", ", "]).join(body), "s"))
    found = {r["id"]: r for r in notices.scan(docs(spark, rows)).collect()}
    some = 0
    for k, text, _ in rows:
        own, labels = brute_labels(text)
        r = found[k]
        assert (r["n_words"], set(filter(None, r["labels"].split(",")))) == (len(own), labels), text
        assert set(filter(None, r["base_labels"].split(","))) <= labels and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
        for f in r["finds"]:
            place = text[f["start"] : f["end"]]
            assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", place.lower()) == own[f["first_word"] : f["first_word"] + f["n_words"]]
            assert f["edits"] == distance(" ".join(own[f["first_word"] : f["first_word"] + f["n_words"]]), f["notice"])
            some += f["edits"] > 0
    assert some > 40


def test_pieces_cover_the_notice():
    for n in notices.NOTICES:
        cut = notices.pieces(n.text, n.bound)
        assert "".join(p for _, p in cut) == n.text and all(n.text[a : a + len(p)] == p for a, p in cut) and len(cut) == n.bound + 1


def test_phrases_count_every_place(spark):
    rows = [(1, "CC BY cc-by, cc by\nthe Mit License. mit license cc", "s"), (2, "a GNU General Public License; gnu general public licenses", "s"), (3, "emit licensing permit license", "s")]
    found = {r["id"]: r for r in notices.scan(docs(spark, rows)).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"], found[1]["score"]) == (5, 0, 9, "cc-by,mit", 1.0)
    assert (found[2]["n_base"], found[2]["first_word"], found[2]["labels"]) == (1, 1, "gpl")
    assert [f["edits"] for f in found[2]["finds"] if not f["base"]] == [0, 1]
    assert (found[3]["n_base"], found[3]["labels"], found[3]["score"], found[3]["finds"]) == (0, "", 0.0, [])
    assert notices.spans(notices.scan(docs(spark, rows))).count() == sum(len(r["finds"]) for r in found.values())


def test_scan_of_odd_rows(spark):
    found = notices.scan(odd(spark)).collect()
    assert len(found) == 16 and {(r["n_words"], r["labels"]) for r in found if r["id"] in (3, 4, 5, 10)} == {(0, "")}
    long_text = "apache license mit licence " * 8000
    r = notices.scan(docs(spark, [(1, long_text, "s")])).first()
    assert (r["n_words"], r["n_base"], len(r["finds"]), r["labels"]) == (32_000, 8000, 24_000, "apache,mit")
    assert notices.scan(none(spark)).count() == 0


# 2: offending sentences


def test_worst_sentence(spark):
    weights = {k: v for w, v in (("blatch", 6.0), ("zorg", 9.0)) for k in toxicity.features(w)[:1] for v in [v]}
    model = toxicity.NoisyOr(weights, -3.0)
    text = "A mola tiren. So blatch it is! Then zorg\nand more."
    rows = [(1, text, "s"), (2, "mola tiren", "s"), (3, None, "s"), (4, "", "s")]
    found = {r["id"]: r for r in toxicity.judge(docs(spark, rows), model).collect()}
    own = {r["id"]: r["score"] for r in toxicity.detect(docs(spark, rows), model).collect()}
    assert {k: r["score"] for k, r in found.items()} == own and found[1]["n_offending"] == 2
    assert "zorg" in text[found[1]["worst_start"] : found[1]["worst_end"]] and found[1]["worst_probability"] == pytest.approx(1 / (1 + math.exp(-6.0)))
    assert {(found[k]["n_offending"], found[k]["worst_start"]) for k in (2, 3, 4)} == {(0, None)}
    assert toxicity.judge(odd(spark), model).count() == 16 and toxicity.judge(none(spark), model).count() == 0


# 12: whitening


def vectors(spark, rows):
    """Vectors with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], "x", "y", 1.0) for i, v in rows], "vec_id long, embedding array<double>, x string, n string, whitened double")


def brute_whitening(rows, dims, k=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**63 for c in v)]
    fits = sorted({tuple(x) for _, x in kept})
    n, sums = len(fits), [sum(c) for c in zip(*fits, strict=True)]
    centred = np.array(fits, float) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return kept, n, sums, values, axes


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(150)]
    rows += [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [math.nan] * 6), (2003, [math.inf, 0, 0, 0, 0, 0]), (2004, [1.0]), (2005, [1e300] * 6), (2006, []), (7, base[7].tolist()), (None, base[3].tolist())]
    kept, n, sums, values, axes = brute_whitening(rows, 6)
    found = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    assert len(found) == 4 * len(kept) and {r["n"] for r in found} == {n == 300 and 300}
    by = defaultdict(list)
    for r in found:
        by[r["id"], r["component"]].append(r)
    white = np.zeros((4, n))
    order = {}
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for c in range(4):
            r = by[i, c + 1].pop()
            assert r["deviation"] == deviation
            want = (np.array(x) - np.array(sums) / n) @ axes[:, c] / math.sqrt(values[c])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9) and 0 <= r["identity_error"] < 1e-9
            white[c, order.setdefault(tuple(x), len(order))] = r["whitened"]
    assert np.allclose(white @ white.T / n - np.outer(white.mean(axis=1), white.mean(axis=1)), np.eye(4), atol=1e-9)


def test_sums_beyond_a_long_stay_exact(spark):
    big = 2.0**53
    rows = [(1, [big, 1.0]), (2, [big - 2, -1.0]), (3, [-big, 0.5]), (4, [2.0**54, 2.0])]
    model = whitening.fit(vectors(spark, rows).coalesce(1))
    assert model.sums == (256 * (2**53 + 2**53 - 2 - 2**53 + 2**54), 256 + -256 + 128 + 512)
    assert {r["deviation"] for r in whitening.transform(vectors(spark, rows), model).collect()} == {None}


def test_vectors_without_spread(spark):
    same = [(i, [0.5, 0.25]) for i in range(5)]
    assert whitening.whiten(vectors(spark, same)).count() == 0 and whitening.fit(vectors(spark, same)) is None
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    line = [(i, [i / 4, i / 2, -i]) for i in range(10)]  # one component can be told
    found = whitening.whiten(vectors(spark, line)).collect()
    assert {r["component"] for r in found} == {1} and all(r["explained"] == pytest.approx(1) for r in found)


def test_packing():
    x = np.array([[1, -128], [127, -129], [2**31, 0], [2**40, -(2**62)]], np.int64)
    import pyarrow as pa

    packed = whitening._packed(x)
    assert [p[0] for p in packed] == [1, 2, 8, 8] and (whitening._unpacked(pa.array(packed, pa.binary()), 2) == x).all()


# 13: divergence audit


def brute_audit(rows, least_docs, most_terms=50):
    plain = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for lang, source, t in rows]
    out = []
    for lang in {p[0] for p in plain}:
        own = [(s, t) for lang_, s, t in plain if lang_ == lang]
        seen = Counter(t for _, ts in own for t in set(ts))
        kept = {t for t, k in seen.items() if k >= least_docs}
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if t in kept)
        total, v = sum(counts.values(), Counter()), len(kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (total[t] + 5) // (total.total() + 5 * v) for t in kept}
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, most_terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def sourced(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, "x", "y", 0, "z") for k, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, base string, block int, at string")


def prose(seed):
    rng = random.Random(seed)
    vocabulary = words(60, 5).split() + ["Ärger", "ärger", "日本", "don't"]
    rows = []
    for k in range(160):
        s = None if k % 40 == 0 else f"s{min(rng.randrange(9), 5) if k % 3 else rng.randrange(14)}"
        own = vocabulary if s in ("s5", None) else vocabulary[: 20 + 3 * (len(s) + ord(s[1]) % 9)]
        rows.append((rng.choice(["en", "en", "de", None]), s, None if k % 50 == 3 else " ".join(rng.choice(own).title() if k % 7 == 0 else rng.choice(own) for _ in range(rng.randrange(1, 60)))))
    return [*rows, ("fr", "only", "un deux"), ("it", "a", "uno"), ("it", "b", None), ("it", "c", "")]


@pytest.mark.parametrize("options", [{}, {"dense_share": 0.0}, {"dense_share": 1.0}, {"block": 3, "dense_tile": 7, "sparse_tile": 11}])
def test_audit_against_plain_loops(spark, options):
    rows = prose(1)
    found = divergence.audit(sourced(spark, rows), least_docs=3, most_terms=20, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == brute_audit(rows, 3, 20)


def test_dense_and_sparse_sums_agree():
    rng = np.random.default_rng(3)
    for terms in (0, 1, 40):
        base = rng.integers(0, 50, 7)
        at = [np.flatnonzero(rng.random(terms) < share) for share in (0, 0.1, 0.2, 0.5, 0.9, 1, 0.3)]
        p = [rng.integers(1, 100, len(i)) for i in at]
        x, y = divergence._pairs(np.arange(4), np.arange(4, 7), True)
        assert divergence.dense_sums(base, at, p, terms, x, y).tolist() == divergence.sparse_sums(base, at, p, terms, x, y).tolist()


def test_weights_beyond_a_long(spark):
    row = spark.range(1).select(divergence.weight(F.lit(10**15), F.lit(3 * 10**15), F.lit(10**6)).alias("p"), divergence.weight(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**6) and row["none"] is None


def test_audit_of_odd_rows(spark):
    found = divergence.audit(odd(spark)).collect()
    assert {r["part"] for r in found} == {"pair"} and {r["value"] for r in found} == {0} and len(found) == 6  # en: sources '', a and b
    some = divergence.audit(odd(spark), least_docs=1).collect()
    assert all(r["rank"] <= 50 for r in some if r["part"] == "term") and any(r["part"] == "term" for r in some)
    assert divergence.audit(none(spark)).count() == 0
