"""The queries of the driver contract for this package's operators, with their SQL where
SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, chunk_dedup, curriculum, decision_list, divergence, line_dedup, merge_dropout, ngram_join, notices, tool_calls, toxicity, url_filter, whitening
from .common import table


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplanes.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bitplanes.read(spark, manifest).select(F.col("id").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op2_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    scored = toxicity.judge(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "worst_probability"
    )


def op3_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and paragraphs to remove, then a row for each passage that repeats across
    documents in each document that has it (``passage``; it removes no unit, so unit, start
    and end are null)."""
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.repeats(docs, by="both", least_words=3).select(
        F.col("id").alias("doc_id"), "unit", "start", "end", "n_words", "digest", F.col("first_id").alias("keep_id"),
        F.col("first_unit").alias("keep_unit"), F.col("first_start").alias("keep_start"), F.col("first_end").alias("keep_end"), "group_size",
        F.lit(False).alias("passage")
    )
    passages = line_dedup.passages(docs).select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("int").alias("n_words"), "keep_id", F.lit(True).alias("passage"),
        F.col("start").alias("passage_start"), F.col("end").alias("passage_end")
    )
    return found.unionByName(passages, allowMissingColumns=True)


def op4_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op5_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = curriculum.assign(table(spark, sf_dir, "documents"))
    first, second = (F.round(F.get("positions", F.lit(k)), 9) for k in (0, 1))
    taken = (F.col("size") * F.size("positions")).alias("taken")
    found = placed.select(
        F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), taken, first.alias("position"),
        second.alias("second_position")
    )
    return found.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_calls.link(table(spark, sf_dir, "conversations"))
    return linked.select(F.col("conv").alias("conv_id"), "turn", "kind", "call_id", "status", "problem", "rank", "hop", "json")


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.copies(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op11_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("finds").cast("long").alias("n_finds")
    )


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the fuzzy search that SQL can say."""
    return op11_fuzzy_notices(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op12_two_pass_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the whitening that SQL can say."""
    return op12_two_pass_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def op13_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_bit_planes, op2_noisy_or, op3_line_hashing, op4_forest_join, op5_url_automaton, op6_merge_dropout, op7_curriculum, op8_decision_list,
            op9_tool_calls, op10_chunk_recipes, op11_fuzzy_notices, license_phrases, op12_two_pass_whitening, embedding_deviations, op13_heavy_light
        )
    }


_ALLOW_BLOCK = """CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical LIKE '%.exe' OR canonical LIKE '%.zip' OR canonical LIKE '%.iso' OR canonical LIKE '%.mp4'
      OR regexp_matches(canonical, '(?s)^[^/]*/(.*/)?(login|cart)/') OR regexp_matches(canonical, '(?s)^[^/]*\\.xn--[^/]*/') THEN 'block'
    ELSE 'allow' END"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL of the queries that it can express."""
    return {
        "op5_url_automaton": f"""
            WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            shown AS (SELECT *, CASE WHEN host = '' THEN '' ELSE '.' || host || path END AS canonical FROM parts),
            judged AS (SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM shown)
            SELECT page_id, host, path, rule, {_ALLOW_BLOCK} AS verdict FROM judged""",
        "op7_curriculum": r"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('curriculum|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
            w AS (SELECT *, [3.0, 1.0, 2.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap FROM s),
            l AS (SELECT *, cap / weight AS ratio, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            t AS (SELECT *, least(cap, coalesce(weight * max(level) FILTER (ratio > level) OVER (), cap)) AS target FROM l),
            c AS (SELECT d.*, source_size, rank, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            x AS (SELECT *, CASE WHEN size > 0 AND target > 0 THEN (middle < target)::BIGINT + (middle + source_size < target)::BIGINT + (middle + 2 * source_size < target)::BIGINT ELSE 0 END AS copies, middle / target AS share FROM c)
            SELECT doc_id, size, source_size, round(target, 6) AS target, size * copies AS taken,
                round(CASE WHEN copies = 0 THEN NULL WHEN rank % 3 = 0 THEN share WHEN rank % 3 = 1 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share)) ELSE 2 * share / (1.5 + sqrt(2.25 - 2 * share)) END, 9) AS position,
                round(CASE WHEN copies < 2 THEN NULL WHEN rank % 3 = 0 THEN again WHEN rank % 3 = 1 THEN 2 * again / (0.5 + sqrt(0.25 + 2 * again)) ELSE 2 * again / (1.5 + sqrt(greatest(0, 2.25 - 2 * again))) END, 9) AS second_position
            FROM (SELECT *, (middle + source_size) / target AS again FROM x)""",
        "op9_tool_calls": """
            WITH e AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, CASE role WHEN 'user' THEN 'turn:' || turn WHEN 'assistant' THEN 'turn:' || (turn - 1) END AS call_id FROM conversations),
            m AS (SELECT e.*, CASE kind WHEN 'message' THEN 'message' WHEN 'call' THEN CASE WHEN EXISTS (SELECT 1 FROM e r WHERE r.kind = 'result' AND r.conv_id = e.conv_id AND r.call_id = e.call_id) THEN 'linked' ELSE 'unanswered' END ELSE CASE WHEN EXISTS (SELECT 1 FROM e r WHERE r.kind = 'call' AND r.conv_id = e.conv_id AND r.call_id = e.call_id) THEN 'linked' ELSE 'orphan' END END AS status FROM e)
            SELECT conv_id, turn, kind, call_id, status, NULL::VARCHAR AS problem, turn AS rank, 0 AS hop,
                '{' || CASE WHEN kind = 'call' THEN '"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},' ELSE '' END
                || CASE WHEN call_id IS NOT NULL THEN '"call_id":' || to_json(call_id) || ',' ELSE '' END
                || CASE WHEN kind != 'call' THEN '"content":' || to_json(text) || ',' ELSE '' END
                || '"kind":' || to_json(kind) || ',' || CASE WHEN kind = 'call' THEN '"name":"reply",' ELSE '' END || '"role":' || to_json(role) || ',"status":' || to_json(status) || '}' AS json
            FROM m""",
        "op10_chunk_recipes": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
            "license_phrases": r"""
            WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
            w AS (SELECT doc, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM d),
            n AS (SELECT doc, place, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third, lead(word, 3) OVER o AS fourth FROM w WINDOW o AS (PARTITION BY doc ORDER BY place)),
            f AS (SELECT doc, place, CASE WHEN word = 'gnu' AND second = 'general' AND third = 'public' AND fourth = 'license' THEN 'gpl' WHEN word = 'apache' AND second = 'license' THEN 'apache' WHEN word = 'cc' AND second = 'by' THEN 'cc-by' WHEN word = 'mit' AND second = 'license' THEN 'mit' END AS label FROM n),
            s AS (SELECT doc, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f WHERE label IS NOT NULL GROUP BY doc)
            SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN s USING (doc)""",
        "embedding_deviations": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
            fit AS (SELECT DISTINCT x FROM v), n AS (SELECT count(*) AS n FROM fit), s AS (SELECT i, sum(x[i])::BIGINT AS s FROM fit, range(1, 65) t(i) GROUP BY i), l AS (SELECT list(s ORDER BY i) AS sums FROM s)
            SELECT vec_id, k::INTEGER AS component, n, list_sum(list_transform(x, lambda c, i: (n * c - sums[i]) * (n * c - sums[i])))::BIGINT AS deviation FROM v, n, l, range(1, 5) t(k)""",
        "op13_heavy_light": r"""
            WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
            g AS (SELECT DISTINCT lang, source FROM d), numbered AS (SELECT row_number() OVER () AS doc, * FROM d), t AS (SELECT doc, lang, source, unnest(terms) AS term FROM numbered),
            kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
            c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL), l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS m FROM kept GROUP BY lang),
            s AS (SELECT lang, source, sum(n)::BIGINT AS m FROM c GROUP BY ALL),
            full_p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(s.m, 0) + 5 * v) AS p, 1 + (1000000000 * (total + 5)) // (l.m + 5 * v) AS q
                FROM g JOIN kept k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
            apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
            r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                UNION ALL SELECT lang, source, 'term', term, p - q FROM full_p WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
    }
