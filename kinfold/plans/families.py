"""Queries of imports, families and their trees, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distances, geometry, imports, motif, trees
from ..publish import cached, publish_bundle, publish_selection
from ..schemas import KEY
from ..sources import fasta
from .bridge import RUN, Bridge, scratch, sql
from .queries import _VECTORS, _motif_sql, _vectors, query, r
from .roundtrips import _LEAVES, _PROTEINS, _proteins, _trees
from .selections import G7, _orders


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_brand FROM part")
def table_by_suffix(b: Bridge) -> DataFrame:
    path = f"{scratch(b.spark)}.tsv.gz"
    b.table("part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_brand").write.csv(path, sep="\t", header=True, compression="gzip")
    return imports.source_table(b.spark, path)


@query(
    "SELECT n_name AS node, 'R:' || r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R:' || r_name, 'ROOT' FROM region"
)
def parent_authority(b: Bridge) -> DataFrame:
    return imports.parent_map(b.taxonomy().select(F.col("child").alias("node"), "parent"))


@query(f"WITH {_PROTEINS} SELECT member_id, length(sequence)::INT AS length, sha256(sequence) AS sha256 FROM proteins WHERE sequence != ''")
def sequence_index(b: Bridge) -> DataFrame:
    return imports.unique_sequences(_proteins(b))


# a part's brand is a cluster, the smallest key in it its centroid
@query("""WITH c AS (SELECT *, p_partkey::VARCHAR AS m, min(p_partkey) OVER (PARTITION BY p_brand)::VARCHAR AS centroid, length(p_name) AS n FROM part)
    SELECT p_brand AS cluster_id, centroid, count(*) AS member_count, min(n)::INT AS minimum_length, max(n)::INT AS maximum_length, sum(n)::BIGINT AS residue_count FROM c GROUP BY ALL""")  # fmt: skip
def imported_clusters(b: Bridge) -> DataFrame:
    part = b.table("part")
    first = part.groupBy("p_brand").agg(F.min("p_partkey").cast("string").alias("centroid"), F.count(F.lit(1)).alias("member_count"))
    rows = part.join(first, "p_brand").select(
        F.col("p_brand").alias("cluster_id"), "centroid", F.col("p_partkey").cast("string").alias("member_id"), F.col("p_name").alias("sequence")
    )
    return imports.import_clusters(rows, first.select(F.col("p_brand").alias("cluster_id"), "member_count"))


@query(
    f"WITH {_PROTEINS} SELECT member_id, length(sequence)::INT AS length, quality FROM proteins LEFT JOIN (SELECT doc_id::VARCHAR AS member_id, max(quality)::INT AS quality FROM labels GROUP BY ALL) USING (member_id) WHERE sequence != ''"
)
def imported_family(b: Bridge) -> DataFrame:
    context = b.table("labels").groupBy(F.col("doc_id").cast("string").alias("member_id")).agg(F.max("quality").cast("int").alias("quality"))
    return imports.import_family(_proteins(b), context).select("member_id", F.length("sequence").alias("length"), "quality")


@query(
    f"""WITH {_PROTEINS} SELECT member_id AS sequence_id, 'whole' AS analysis, 1 AS start, length(sequence)::INT AS "end", 'SEQUENCE_SIGNATURE_PREDICTION' AS evidence_type FROM proteins WHERE sequence != ''"""
)
def domain_predictions(b: Bridge) -> DataFrame:
    own = _proteins(b).select(F.col("member_id").alias("sequence_id"), "sequence")
    found = own.select(
        "sequence_id", F.upper(F.md5(F.col("sequence").cast("binary"))).alias("md5"), F.length("sequence").alias("length"),
        F.lit("whole").alias("analysis"), F.lit(1).alias("start"), F.length("sequence").alias("end")
    )
    return imports.domain_rows(found, own).select("sequence_id", "analysis", "start", "end", "evidence_type")


@query(
    f"WITH {_PROTEINS} SELECT member_id, length(sequence)::INT AS length FROM proteins JOIN documents ON member_id = doc_id::VARCHAR WHERE lang = 'de' AND sequence != ''"
)
def selected_sequences(b: Bridge) -> DataFrame:
    wanted = b.table("documents").filter("lang = 'de'").select(F.col("doc_id").cast("string").alias("member_id")).join(_proteins(b), "member_id", "left_semi")
    return imports.selected_sequences(_proteins(b), wanted).select("member_id", F.length("sequence").alias("length"))


@query(
    "SELECT c_custkey AS sequence_id, min(c_mktsegment) AS species, min(c_nationkey)::BIGINT AS taxon_id FROM customer WHERE c_nationkey > 0 GROUP BY ALL HAVING count(DISTINCT c_nationkey) = 1"
)
def reviewed_traits(b: Bridge) -> DataFrame:
    c = b.table("customer").select(
        F.col("c_custkey").alias("sequence_id"), F.col("c_mktsegment").alias("species"), F.col("c_nationkey").cast("long").alias("taxon_id")
    )
    return imports.reviewed_traits(c.select("sequence_id"), c)


_CHOSEN = "o_orderpriority = '5-LOW' AND o_totalprice > 480000"
_INPUTS = f"chosen AS (SELECT group_id, member_count, row_number() OVER (ORDER BY member_count DESC, group_id)::INT AS selection_rank FROM stats JOIN orders ON group_id = 'G' || o_orderkey WHERE {_CHOSEN}), inputs AS (SELECT member_id AS input_id, species_label, c.group_id AS source_group_id, selection_rank, member_count AS source_member_count FROM members m JOIN chosen c ON m.group_id = c.group_id)"


def _inputs(b: Bridge) -> DataFrame:
    stats = b.stats()
    return imports.group_inputs(stats.join(_orders(b, _CHOSEN), "group_id", "left_semi"), b.members(), 100_000, 1_000_000)


@query(sql("lines members species stats", f", {_INPUTS} SELECT * FROM inputs"))
def group_inputs(b: Bridge) -> DataFrame:
    return _inputs(b).select("input_id", "species_label", "source_group_id", "selection_rank", "source_member_count")


@query(
    sql(
        "lines members species stats",
        f", {_INPUTS} SELECT DISTINCT species_label, input_id AS member_id, species_label || ':' || input_id AS sequence FROM inputs"
    )
)
def requested_sequences(b: Bridge) -> DataFrame:
    known = b.members().select("species_label", "member_id", F.concat_ws(":", "species_label", "member_id").alias("sequence")).distinct()
    return imports.requested_sequences(_inputs(b), known)


@query(
    sql(
        "lines members species stats",
        f", {_INPUTS} SELECT p_partkey || '-1' AS input_id, p_size, source_group_id FROM part LEFT JOIN inputs ON input_id = p_partkey || '-1'"
    )
)
def results_with_context(b: Bridge) -> DataFrame:
    results = b.table("part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("-1")).alias("input_id"), "p_size")
    return imports.with_context(results, _inputs(b)).select("input_id", "p_size", "source_group_id")


@query("SELECT c_name AS member_id FROM customer ORDER BY c_name != (SELECT min(c_name) FROM customer), sha256(c_name), c_name LIMIT 40")
def reference_first(b: Bridge) -> DataFrame:
    rows = b.table("customer").select(F.col("c_name").alias("member_id"))
    reference = rows.agg(F.min("member_id")).first()[0]
    return imports.reference_first(rows, reference, 40, sample=True)


@query(
    sql(
        "lines members species stats",
        "SELECT group_id, legacy_orthogroup_id AS tree_id, CASE WHEN o_orderstatus = 'P' THEN 'RESOLVED_GENE_TREE' ELSE 'GENE_TREE' END AS tree_type FROM stats JOIN orders ON group_id = 'G' || o_orderkey"
    )
)
def portable_trees(b: Bridge) -> DataFrame:
    orders = b.table("orders").select(
        F.lit(RUN).alias("run_id"), F.concat(F.lit("OG"), F.col("o_orderkey").cast("string")).alias("tree_id"),
        F.when(
            F.col("o_orderstatus") == "P", F.array(F.lit("GENE_TREE"), F.lit("RESOLVED_GENE_TREE"))
        ).otherwise(F.array(F.lit("GENE_TREE"))).alias("kinds")
    )
    payloads = orders.select("run_id", "tree_id", F.explode("kinds").alias("tree_type"))
    return imports.portable_trees(b.stats(), payloads).select("group_id", "tree_id", "tree_type")


@query("SELECT c_name AS member_id, 'species' AS trait, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'old ' || c_mktsegment END AS value FROM customer")
def inherited_traits(b: Bridge) -> DataFrame:
    jobs = b.spark.createDataFrame([("j3", "j2"), ("j2", "j1"), ("j1", None)], "job string, source string")
    c = b.table("customer").select(F.col("c_name").alias("member_id"), F.lit("species").alias("trait"), "c_mktsegment", "c_acctbal")
    near = c.filter("c_acctbal > 0").select(F.lit("j2").alias("job"), "member_id", "trait", F.col("c_mktsegment").alias("value"))
    far = c.select(F.lit("j1").alias("job"), "member_id", "trait", F.concat(F.lit("old "), "c_mktsegment").alias("value"))
    return imports.inherited_traits(jobs, near.unionByName(far), "j3")


# trees and matrices
@query(
    f"""WITH {_LEAVES} SELECT tree_id, (2 + (SELECT count(*) FROM leaves o WHERE o.tree_id = l.tree_id))::BIGINT AS node_count, 'INTERNAL_1' AS root_name, max(n_name) FILTER (alone) AS first_leaf, max(length) FILTER (alone) AS first_div, tree_id AS first_species FROM leaves l GROUP BY tree_id"""
)
def nested_trees(b: Bridge) -> DataFrame:
    both = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    traits = both.select(F.col("n_name").alias("leaf"), F.create_map(F.lit("species"), F.col("r_name")).alias("traits"))
    found = trees.nested_trees(_trees(b), traits)
    child = "$.children[0]"
    return found.select(
        "tree_id",
        F.size(F.regexp_extract_all("json", F.lit('("name":)'), 1)).cast("long").alias("node_count"),
        F.get_json_object("json", "$.name").alias("root_name"),
        F.get_json_object("json", f"{child}.name").alias("first_leaf"),
        F.get_json_object("json", f"{child}.node_attrs.div").cast("double").alias("first_div"),
        F.get_json_object("json", f"{child}.node_attrs.species.value").alias("first_species"),
    )


_CLASSES = "cl AS (SELECT CASE WHEN member_a % 4 = member_b % 4 THEN 'WITHIN_SPECIES' ELSE 'BETWEEN_SPECIES' END AS pair_class, round(distance, 9) AS distance FROM vp)"


def _classes(b: Bridge) -> DataFrame:
    species = b.table("embeddings").select(F.col("vec_id").alias("member_id"), (F.col("vec_id") % 4).cast("string").alias("species_label"))
    return distances.class_pairs(_vectors(b), species).select("pair_class", F.round("distance", 9).alias("distance"))


@query(
    f"{_VECTORS}, {_CLASSES}, w AS (SELECT min(distance) AS lo, max(distance) AS hi FROM cl), k AS (SELECT pair_class, least(19, floor((distance - lo) / (hi - lo) * 20))::BIGINT AS bin FROM cl, w), n AS (SELECT pair_class, bin, count(*) AS pair_count FROM k GROUP BY ALL) SELECT *, round(pair_count / sum(pair_count) OVER (PARTITION BY pair_class), 6) AS probability FROM n"
)
def class_histogram(b: Bridge) -> DataFrame:
    return distances.class_histogram(_classes(b)).withColumn("probability", r("probability"))


@query(
    f"{_VECTORS}, {_CLASSES} SELECT DISTINCT pair_class, round(distance, 6) AS distance, round(cume_dist() OVER (PARTITION BY pair_class ORDER BY distance), 6) AS cumulative_fraction FROM cl"
)
def class_cumulative(b: Bridge) -> DataFrame:
    return distances.class_cumulative(_classes(b)).select("pair_class", r("distance"), r("cumulative_fraction")).distinct()


@query(f"{_VECTORS} SELECT group_id, member_a::VARCHAR AS member_a, member_b::VARCHAR AS member_b, round(distance, 5) AS distance, true AS shrinks FROM vp")
def shepard_points(b: Bridge) -> DataFrame:
    """A projection never lies further apart than its exact distances; its axes have no SQL."""
    found = geometry.shepard(_vectors(b), ("group_id",))
    shrinks = (F.col("distance_2d") <= F.col("distance_3d") + 1e-9) & (F.col("distance_3d") <= F.col("distance") + 1e-6)
    return found.select("group_id", "member_a", "member_b", F.round("distance", 5).alias("distance"), shrinks.alias("shrinks"))


@query(_motif_sql("ends_with(clean, 'N')", """, s AS (SELECT group_id, species_label, bool_or(have) AS have, bool_or(hit) AS hit FROM hits GROUP BY ALL)
    SELECT group_id, round(count(*) FILTER (hit AND species_label != 'de') / nullif(count(*) FILTER (have AND species_label != 'de'), 0), 6) AS analysis_species_match_fraction FROM s GROUP BY group_id
    HAVING count(*) FILTER (hit AND species_label != 'de') / nullif(count(*) FILTER (have AND species_label != 'de'), 0) >= 0.3 AND bool_or(hit AND species_label = 'en') AND NOT bool_or(hit AND species_label = 'de')"""))  # fmt: skip
def motif_lineage_filter(b: Bridge) -> DataFrame:
    rows = motif.group_members(b.motif_members(), b.motif_sequences(), "N", "SUFFIX")
    langs = rows.select("species_label").distinct()
    found = motif.lineage_filter(
        rows, langs.filter("species_label != 'de'"), 0.3, [langs.filter("species_label = 'en'")], [langs.filter("species_label = 'de'")]
    )
    return found.withColumn("analysis_species_match_fraction", r("analysis_species_match_fraction"))


@query(
    """SELECT r_name AS group_id, count(*) AS total_member_count, count(*) * (count(*) - 1) // 2 AS distance_pair_count, 'p_distance' AS distance_method, 'EXACT' AS computation_status FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def alignment_statistics(b: Bridge) -> DataFrame:
    from ..build import alignment_relations

    both = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = both.select(
        *[F.lit(G7[k]).alias(k) for k in KEY[:3]], F.col("r_name").alias("group_id"), F.lit("").alias("legacy_orthogroup_id"),
        F.col("n_name").alias("member_id")
    )
    aligned = both.select(
        F.col("r_name").alias("group_id"), F.col("n_name").alias("member_id"), F.rpad(F.upper("n_name"), F.lit(12), F.lit("Q")).alias("sequence")
    )
    _, stats = alignment_relations(members, aligned)
    return stats.select("group_id", "total_member_count", "distance_pair_count", "distance_method", "computation_status")


# sinks of selections
@query(
    "SELECT 'benchmark_group_profiles' AS relation, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'marker_audit', count(*) FROM part"
)
def published_selection(b: Bridge) -> DataFrame:
    profiles = _orders(b, "o_orderpriority = '1-URGENT'").select(*[F.lit(G7[k]).alias(k) for k in KEY[:3]], "group_id", F.lit("E3_ALL").alias("profile_id"))
    found = publish_selection(b.spark, {"benchmark_group_profiles": profiles, "marker_audit": b.table("part")}, scratch(b.spark))
    return b.spark.createDataFrame(sorted(found.items()), "relation string, n long")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def audit_bundle(b: Bridge) -> DataFrame:
    rows = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    folder = scratch(b.spark)
    publish_bundle({"nations": rows}, folder, {"run_id": RUN})
    return imports.source_table(b.spark, f"{folder}/nations.tsv")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY ALL")
def cached_result(b: Bridge) -> DataFrame:
    folder, rows = scratch(b.spark), b.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    cached(rows, folder, "part", "brands")
    return cached(rows.limit(0), folder, "part", "brands")  # found by its parts, not computed


@query(f"WITH {_PROTEINS} SELECT count(*) AS n, sum(length(sequence))::BIGINT AS residues FROM proteins WHERE sequence != ''")
def written_fasta(b: Bridge) -> DataFrame:
    folder = scratch(b.spark)
    fasta.write_fasta(_proteins(b).repartition(3), folder)
    return fasta.read_fasta(b.spark, folder).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("residues"))
