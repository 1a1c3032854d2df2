"""The pipeline against its stages one by one, and the SQL of the queries."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from kinfold.llm import merge_dropout, queries

from ..test_oracle import KINDS, duck, ordered  # noqa: F401
from .fixtures import none, odd
from .test_operators import brute_links


def test_stages(spark, sf_dir, tmp_path):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
        kept.append([tuple(r) for r in docs.select("doc_id", "text").collect()] if k < 4 else None)
    first, second, third, fourth, _ = kept
    assert 0 < len(first) <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    best = {}
    for i, t in first:
        best[t] = max(i, best.get(t, i))
    assert sorted(second) == sorted((i, t) for t, i in best.items())
    assert sorted(i for i, _ in third) == sorted({c for c, _ in brute_links(second).values()})
    assert set(fourth) <= set(third) and max(fourth.count(x) for x in set(fourth)) <= 2
    codec = merge_dropout.MergeCodec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    found = docs.collect()
    assert sorted((r["doc_id"], codec.decode(r["ids"])) for r in found) == sorted(fourth)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda rows: sorted((r["doc_id"], hashlib.md5(str(r["ids"]).encode()).hexdigest()) for r in rows)
    assert key(whole) == key(found)


@pytest.mark.parametrize("make", [odd, none])
def test_stages_take_odd_rows(spark, sf_dir, tmp_path, make):
    docs = make(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert (docs.count() > 0) == (make is odd)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, sf_dir, name):  # noqa: F811
    found, sql = queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name]
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + sql).fetchall()}
    assert {c: KINDS[t] for c, t in found.dtypes} == kinds
    columns = sorted(kinds)
    assert ordered(found.select(*columns).collect()) == ordered(duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_queries_cover_the_operators():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]


CONTRACT = {
    "op1_bit_planes": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_noisy_or": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_line_hashing": {"doc_id": "bigint", "start": "bigint", "end": "bigint", "keep_id": "bigint"},
    "op4_forest_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op5_url_automaton": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_merge_dropout": {"doc_id": "bigint", "ids": "array<int>", "n_ids": "bigint", "lossless": "boolean"},
    "op7_curriculum": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_decision_list": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_tool_calls": {"conv_id": "bigint", "turn": "bigint", "status": "string", "rank": "bigint", "json": "string"},
    "op11_fuzzy_notices": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op12_two_pass_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_heavy_light": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op10_chunk_recipes": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_the_contract(spark, sf_dir, name):
    """Each registered query has the columns and types of its contract, and a row a document where it says so."""
    found = queries.queries()[name](spark, sf_dir)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    ids = found.select(found.columns[0]).collect()
    if name in ("op3_line_hashing", "op9_tool_calls", "op12_two_pass_whitening", "op13_heavy_light"):
        assert ids
    else:
        table = "pages" if name.startswith("op5") else "documents"
        assert sorted(ids) == sorted(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(found.columns[0]).collect())
