"""Relations over the driver's tables, so that every operator has something to run on.

A group is an order (hierarchical authority) or a part (legacy authority), a member a
line, a species a supplier's nation; the regions above nations are its taxonomy. Distances
are price differences of an order's lines. Each relation has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distances, memberships, taxonomy
from ..schemas import KEY
from ..tables import fresh, written

RUN = "run"


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return fresh(spark, "kinfold")


class Bridge:
    """Lazy relations of one scale factor's folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _lines(self) -> DataFrame:
        nations = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
        return self.table("lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey"))

    def members(self) -> DataFrame:
        return self._lines().select(
            F.lit(RUN).alias("run_id"), F.lit("HOG").alias("group_type"), F.lit("N0").alias("hierarchy_node"),
            F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("group_id"),
            F.concat(F.lit("OG"), F.col("l_orderkey").cast("string")).alias("legacy_orthogroup_id"), F.lit("").alias("gene_tree_parent_clade"),
            F.col("n_name").alias("species_label"),
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("member_id"),
            F.lit("N0.tsv").alias("source_file")
        )

    def legacy(self) -> DataFrame:
        return self._lines().select(
            F.lit(RUN).alias("run_id"), F.lit("LEGACY_ORTHOGROUP").alias("group_type"), F.lit("").alias("hierarchy_node"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("group_id"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("legacy_orthogroup_id"), F.lit("").alias("gene_tree_parent_clade"),
            F.col("n_name").alias("species_label"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("member_id"),
            F.lit("Orthogroups.tsv").alias("source_file")
        )

    def all_members(self) -> DataFrame:
        return self.members().unionByName(self.legacy())

    def sequences(self) -> DataFrame:
        """A line's internal id: order and line number."""
        return self._lines().select(
            F.lit(RUN).alias("run_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("member_id"),
            F.col("n_name").alias("species_label"),
            F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("internal_id")
        )

    def stats(self) -> DataFrame:
        return memberships.group_statistics(self.members())

    def species(self) -> DataFrame:
        return memberships.group_species_statistics(self.members())

    def _measured(self) -> DataFrame:
        """Members with what their distances are made of."""
        return self.table("lineitem").select(
            F.lit(RUN).alias("run_id"), F.lit("HOG").alias("group_type"), F.lit("N0").alias("hierarchy_node"),
            F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("group_id"),
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("member_id"), "l_extendedprice",
            "l_quantity"
        )

    def paired_groups(self) -> DataFrame:
        """Keys of the groups that have a pair, from counts alone."""
        return self._measured().groupBy(*KEY).agg(F.count_distinct("member_id").alias("n")).filter("n > 1").drop("n")

    def pair_distances(self, groups: DataFrame | None = None) -> DataFrame:
        """The pairs of all groups, or of some."""
        lines = self._measured()
        if groups is not None:
            lines = lines.join(groups.select(*KEY), list(KEY), "left_semi")
        rows = distances.pairs(lines, KEY, "member_id", "l_extendedprice", "l_quantity")
        return rows.select(
            *KEY, "member_a", "member_b", F.round(F.abs(F.col("l_extendedprice_a") - F.col("l_extendedprice_b")), 2).alias("distance"),
            (F.abs(F.col("l_quantity_a") - F.col("l_quantity_b")).cast("double")).alias("other")
        )

    def distance_statistics(self) -> DataFrame:
        sizes = self.members().groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_member_count"))
        # both methods from one self join
        price = F.struct(F.lit("price").alias("distance_method"), F.col("distance").alias("distance"))
        quantity = F.struct(F.lit("quantity").alias("distance_method"), F.col("other").alias("distance"))
        methods = F.explode(F.when(F.col("other") > 5, F.array(price, quantity)).otherwise(F.array(price)))
        rows = self.pair_distances().select(*KEY, methods.alias("x")).select(*KEY, "x.*")
        out = distances.summarise(rows, (*KEY, "distance_method"))
        out = out.join(sizes, list(KEY))
        exact = F.col("distance_method") == "price"
        return out.withColumn(
            "sampled_member_count", F.when(exact, F.col("total_member_count")).otherwise(F.col("total_member_count") - 1)
        ).withColumn("computation_status", F.when(exact, "EXACT").otherwise("DETERMINISTIC_MEMBER_SAMPLE")).withColumn("source_file", F.lit("lineitem")).withColumn("failure_reason", F.lit("")).withColumn("member_identifier_resolution", F.lit("EXACT_MEMBER_ID")).withColumn("mean_comparable_sites", F.lit(0.0))

    def categories(self, region: str = "EUROPE", reviewed: int = 20) -> DataFrame:
        """TARGET nations of a region, OUTSIDE the other reviewed ones; the rest is unmapped."""
        both = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return both.select(
            F.col("n_name").alias("species_label"),
            F.when(F.col("n_nationkey") >= reviewed, "UNRESOLVED").when(F.col("r_name") == region, "TARGET").otherwise("OUTSIDE").alias("category")
        )

    def taxonomy(self) -> DataFrame:
        """child, parent: nations under regions under one root."""
        n, r = self.table("nation"), self.table("region")
        return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.concat(F.lit("R:"), "r_name").alias("parent")).unionByName(
            r.select(F.concat(F.lit("R:"), "r_name").alias("child"), F.lit("ROOT").alias("parent"))
        )

    def closure(self) -> DataFrame:
        """The taxonomy's closure, written once, since plans over it read it many times."""
        return written(taxonomy.closure(self.taxonomy()), "closure")

    def taxa(self) -> DataFrame:
        """KEY and taxon_id of every member; nations from the 20th on are unmapped."""
        known = self.table("nation").filter("n_nationkey < 20").select(F.col("n_name").alias("species_label"), F.col("n_name").alias("taxon_id"))
        return self.species().select(*KEY, "species_label").join(known, "species_label", "left").select(*KEY, "taxon_id")

    def atlas(self) -> DataFrame:
        """Expression records: gene = user, experiment = day, context = event type; every
        third record is FPKM and the rest TPM."""
        e = self.table("events").filter("value is not null")
        return e.select(
            F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("species_column"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("gene_id"),
            F.concat(F.lit("N"), (F.col("user_id") % 50).cast("string")).alias("gene_name"),
            F.date_format("ts", "yyyy-MM-dd").alias("experiment_accession"),
            F.when(F.col("event_id") % 3 == 0, "FPKM").otherwise("TPM").alias("expression_unit"), F.col("event_type").alias("sample_or_condition"),
            F.abs("value").alias("expression_value")
        )

    def expression_metadata(self) -> DataFrame:
        return self.atlas().select("species_column", "experiment_accession", "sample_or_condition").distinct().select(
            "*", F.when(F.col("sample_or_condition") == "click", "leaf").otherwise("").alias("organism_part"), F.lit("").alias("condition"),
            F.when(F.col("sample_or_condition") == "view", "grp").otherwise("").alias("atlas_group_label")
        )

    def expression_members(self) -> DataFrame:
        """Members of the three species: a user id, or for every fifth a name that several genes share."""
        u = self.table("events").select("user_id").distinct()
        return u.select(
            F.lit(RUN).alias("run_id"), F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("species_label"),
            F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("member_id"),
            F.when(F.col("user_id") % 7 == 0, F.lit("none")).when(
                F.col("user_id") % 5 == 0, F.concat(F.lit("N"), (F.col("user_id") % 50).cast("string"))
            ).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("alias_value"),
            F.lit("g").alias("alias_type"), F.lit(1).cast("long").alias("mapping_tier"), (F.col("user_id") % 40).alias("g")
        )

    def expression_groups(self) -> DataFrame:
        return self.expression_members().select(
            "run_id", F.lit("HOG").alias("group_type"), F.lit("N0").alias("hierarchy_node"),
            F.concat(F.lit("E"), F.col("g").cast("string")).alias("group_id"), "species_label", "member_id"
        )

    def motif_members(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("source").alias("group_id"), F.col("lang").alias("species_label"), F.col("doc_id").cast("string").alias("member_id"))

    def motif_sequences(self) -> DataFrame:
        """Letters of the texts as residues; a text without letters has no sequence."""
        d = self.table("documents")
        return d.select(
            F.col("lang").alias("species_label"), F.col("doc_id").cast("string").alias("member_id"),
            F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence")
        )


_LINES = "lines AS (SELECT l.*, n_name FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
_MEMBERS = "members AS (SELECT 'run' AS run_id, 'HOG' AS group_type, 'N0' AS hierarchy_node, 'G' || l_orderkey AS group_id, 'OG' || l_orderkey AS legacy_orthogroup_id, n_name AS species_label, l_partkey || '-' || l_linenumber AS member_id FROM lines)"
_LEGACY = "legacy AS (SELECT 'run' AS run_id, 'LEGACY_ORTHOGROUP' AS group_type, '' AS hierarchy_node, 'P' || l_partkey AS group_id, 'P' || l_partkey AS legacy_orthogroup_id, n_name AS species_label, l_orderkey || '-' || l_linenumber AS member_id FROM lines)"
_SPECIES = "species AS (SELECT run_id, group_type, hierarchy_node, group_id, legacy_orthogroup_id, species_label, count(*) AS species_member_count FROM members GROUP BY ALL)"
_STATS = "stats AS (SELECT run_id, group_type, hierarchy_node, group_id, legacy_orthogroup_id, sum(species_member_count)::BIGINT AS member_count, count(*) AS species_count, count(*) FILTER (species_member_count = 1) AS single_copy_species_count, max(species_member_count) AS max_copies_per_species, sum(species_member_count) / count(*) AS mean_copies_per_species, sum(species_member_count) = 1 AS is_singleton, string_agg(species_label, ';' ORDER BY species_label) AS species_labels FROM species GROUP BY ALL)"
_PAIRS = "pairs AS (SELECT a.group_id, a.member_id AS member_a, b.member_id AS member_b, round(abs(a.l_extendedprice - b.l_extendedprice), 2) AS distance, abs(a.l_quantity - b.l_quantity)::DOUBLE AS other FROM (SELECT 'G' || l_orderkey AS group_id, l_partkey || '-' || l_linenumber AS member_id, l_extendedprice, l_quantity FROM lineitem) a JOIN (SELECT 'G' || l_orderkey AS group_id, l_partkey || '-' || l_linenumber AS member_id, l_extendedprice, l_quantity FROM lineitem) b ON a.group_id = b.group_id AND a.member_id < b.member_id)"
_QUANTILES = "count(*) AS distance_pair_count, min(d) AS minimum_distance, quantile_cont(d, 0.05) AS q05_distance, quantile_cont(d, 0.25) AS q25_distance, quantile_cont(d, 0.5) AS median_distance, avg(d) AS mean_distance, quantile_cont(d, 0.75) AS q75_distance, quantile_cont(d, 0.95) AS q95_distance, max(d) AS maximum_distance, stddev_pop(d) AS population_stddev_distance"
_DISTANCES = f"sizes AS (SELECT 'G' || l_orderkey AS group_id, count(*) AS total_member_count FROM lines GROUP BY ALL), summaries AS (SELECT group_id, 'price' AS distance_method, {_QUANTILES} FROM (SELECT group_id, distance AS d FROM pairs) GROUP BY group_id UNION ALL SELECT group_id, 'quantity', {_QUANTILES} FROM (SELECT group_id, other AS d FROM pairs WHERE other > 5) GROUP BY group_id), distances AS (SELECT s.*, total_member_count, CASE WHEN distance_method = 'price' THEN total_member_count ELSE total_member_count - 1 END AS sampled_member_count, CASE WHEN distance_method = 'price' THEN 'EXACT' ELSE 'DETERMINISTIC_MEMBER_SAMPLE' END AS computation_status FROM summaries s JOIN sizes USING (group_id))"
_CATEGORIES = "categories AS (SELECT n_name AS species_label, CASE WHEN n_nationkey >= 20 THEN 'UNRESOLVED' WHEN r_name = 'EUROPE' THEN 'TARGET' ELSE 'OUTSIDE' END AS category FROM nation JOIN region ON n_regionkey = r_regionkey)"
_TAXA = "taxa AS (SELECT group_id, CASE WHEN n_nationkey < 20 THEN n_name END AS taxon_id, 'R:' || r_name AS clade FROM species JOIN nation ON species_label = n_name JOIN region ON n_regionkey = r_regionkey)"
_ATLAS = "atlas AS (SELECT 'S' || (user_id % 3) AS species_column, 'U' || user_id AS gene_id, 'N' || (user_id % 50) AS gene_name, strftime(ts, '%Y-%m-%d') AS experiment_accession, CASE WHEN event_id % 3 = 0 THEN 'FPKM' ELSE 'TPM' END AS expression_unit, event_type AS sample_or_condition, abs(value) AS expression_value FROM events WHERE value IS NOT NULL)"
_PREFERRED = "preferred AS (SELECT * FROM (SELECT *, CASE WHEN bool_or(expression_unit = 'TPM') OVER (PARTITION BY species_column, experiment_accession) THEN 'TPM' ELSE 'FPKM' END AS selected_expression_unit FROM atlas) WHERE expression_unit = selected_expression_unit)"
_EMEMBERS = "emembers AS (SELECT DISTINCT 'S' || (user_id % 3) AS species_label, 'm' || user_id AS member_id, CASE WHEN user_id % 7 = 0 THEN 'none' WHEN user_id % 5 = 0 THEN 'N' || (user_id % 50) ELSE 'u' || user_id END AS alias_value, 'E' || (user_id % 40) AS group_id FROM events)"
_MAPPING = "genes AS (SELECT DISTINCT species_column, gene_id, gene_name FROM atlas), mapping AS (SELECT m.species_label, m.member_id, m.group_id, count(DISTINCT g.gene_id) AS matched_gene_count, coalesce(string_agg(DISTINCT g.gene_id, ';' ORDER BY g.gene_id), '') AS matched_gene_ids FROM emembers m LEFT JOIN genes g ON g.species_column = m.species_label AND upper(m.alias_value) IN (g.gene_id, g.gene_name) GROUP BY ALL), mapped AS (SELECT *, CASE matched_gene_count WHEN 0 THEN 'NOT_MAPPED' WHEN 1 THEN 'MAPPED_UNIQUE' ELSE 'AMBIGUOUS' END AS mapping_status FROM mapping)"
_CONTEXT = "context AS (SELECT m.species_label, m.member_id, m.group_id, e.gene_id, e.experiment_accession, e.sample_or_condition, e.expression_value, e.expression_value >= 0.5 AS positive, CASE sample_or_condition WHEN 'click' THEN 'leaf' WHEN 'view' THEN 'grp' ELSE sample_or_condition END AS expression_context, CASE sample_or_condition WHEN 'click' THEN 'leaf' ELSE '' END AS organism_part FROM mapped m JOIN preferred e ON e.species_column = m.species_label AND e.gene_id = m.matched_gene_ids WHERE mapping_status = 'MAPPED_UNIQUE')"
_MOTIF = "assessed AS (SELECT source AS group_id, lang AS species_label, doc_id::VARCHAR AS member_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS clean FROM documents)"
CTES = {
    "lines": _LINES, "members": _MEMBERS, "legacy": _LEGACY, "species": _SPECIES, "stats": _STATS, "pairs": _PAIRS, "distances": _DISTANCES,
    "categories": _CATEGORIES, "taxa": _TAXA, "atlas": _ATLAS, "preferred": _PREFERRED, "emembers": _EMEMBERS, "mapping": _MAPPING,
    "context": _CONTEXT, "motif": _MOTIF
}


def sql(names: str, select: str) -> str:
    """A statement over some of the relations, in their order; one that begins with a comma adds its own."""
    body = select.strip()
    return "WITH " + ", ".join(CTES[n] for n in names.split()) + (body if body.startswith(",") else " " + body)
