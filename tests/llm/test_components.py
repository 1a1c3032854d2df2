"""Components of any graph, and joins of long chains and hot labels."""

import random

import pytest

from kinfold.llm import ngram_join

from .fixtures import docs, words


def graph(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def brute(edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return sorted((v, find(v)) for v in root)


def falling(n):
    """A path whose labels fall towards its middle."""
    labels = [2 * abs(k - n // 2) + (k < n // 2) for k in range(n)]
    return list(zip(labels, labels[1:], strict=False))


def test_components_settle_on_any_graph(spark):
    """A long path, stars, alternating labels, single vertices and random edges, at once."""
    rng, edges = random.Random(2), []
    for k, part in enumerate((falling(500), [(0, i) for i in range(1, 60)], [(i, 99 - i) for i in range(50)] + [(99 - i, i + 1) for i in range(49)], [(7, 7)], [(rng.randrange(300), rng.randrange(300)) for _ in range(260)])):
        edges += [(a + 10_000 * k, b + 10_000 * k) for a, b in part]
    found = ngram_join.components(graph(spark, edges).repartition(4))
    assert sorted((r["vertex"], r["root"]) for r in found.collect()) == brute(edges)
    assert ngram_join.components(graph(spark, [])).count() == 0


@pytest.mark.parametrize("n", [261])
def test_long_chain_is_one_class(spark, n):
    """Windows of 200 words, each moved on by 15: near copies of their neighbours only."""
    own = words(200 + 15 * n, 9).split()
    rows = [(k, " ".join(own[15 * k : 15 * k + 200]), "s") for k in range(n)]
    random.Random(1).shuffle(rows)
    found = ngram_join.join(docs(spark, rows)).collect()
    assert {r["class_id"] for r in found} == {0} and sum(r["first"] for r in found) == 1
    assert {r["n_links"] for r in found if 0 < r["id"] < n - 1} == {2} and {r["n_links"] for r in found if r["id"] in (0, n - 1)} == {1}


def test_hot_label_over_many_blocks(spark):
    """Near copies beyond one block of classes: every pair is looked at, each once."""
    own = words(120, 4).split()
    rows = []
    for k in range(40):
        body = list(own)
        body[60] = f"w{k}x"
        rows.append((k, " ".join(body), "s"))
    found = ngram_join.join(docs(spark, rows), block=7).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 39)}
