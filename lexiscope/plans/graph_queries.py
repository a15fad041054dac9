"""Registered queries of terminology, metadata and audit operators, each with the same result in SQL.

The SQL states the results from what is known of the tables (parts have two roots above them, suppliers a
nation and a region), not by walking a graph, so it checks the walks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.journals import class_percentages, classify
from lexiscope.operators import metadata as md
from lexiscope.operators import terminology as tm
from lexiscope.plans.queries import _ORDERS, ORDER_TARGETS, SCOPES
from lexiscope.plans.storage import terminology_home
from lexiscope.plans.targets import target_frame
from lexiscope.sources import tables as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def parts(spark: SparkSession, sf_dir: str) -> tm.Terminology:
    return tm.Terminology(tb.part_concepts(spark, sf_dir), "part", tuple(f"Brand#{i}" for i in range(1, 26)), terminology_home(spark))


def places(spark: SparkSession, sf_dir: str) -> tm.Terminology:
    return tm.Terminology(tb.place_concepts(spark, sf_dir), "supplier", ("Supplier",), terminology_home(spark))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.counted_leaves(tb.order_corpus(spark, sf_dir).annotations)


def ids(spark: SparkSession, sf_dir: str, terminology: tm.Terminology, counted: DataFrame | None = None) -> DataFrame:
    """``(target, scope, id, n)`` from ``counted`` leaves, or those of the orders."""
    return tm.linked_ids(leaves(spark, sf_dir) if counted is None else counted, target_frame(spark, ORDER_TARGETS), SCOPES, terminology)


def part_anchor_weights(spark: SparkSession, sf_dir: str, terminology: tm.Terminology | None = None) -> DataFrame:
    return (terminology or parts(spark, sf_dir)).anchor_weights(tb.term_topics(spark), tb.anchors(spark))


# --- SQL --------------------------------------------------------------------------------------------------

_CONCEPTS = """concepts(ui, name, top1, top2) AS (
    SELECT 'part:' || p_partkey, p_name, 'type:' || p_type, 'brand:' || p_brand FROM part
    UNION ALL SELECT DISTINCT 'type:' || p_type, p_type, 'type:' || p_type, NULL FROM part
    UNION ALL SELECT DISTINCT 'brand:' || p_brand, p_brand, 'brand:' || p_brand, NULL FROM part),
branch AS (SELECT ui, top1 AS key, CASE WHEN top2 IS NULL THEN 1.0 ELSE 0.5 END AS w FROM concepts UNION ALL SELECT ui, top2, 0.5 FROM concepts WHERE top2 IS NOT NULL)"""
_TOPICS = """topics(term, topic) AS (VALUES ('ECONOMY', 'price'), ('PROMO', 'price'), ('LARGE', 'size'), ('MEDIUM', 'size'), ('SMALL', 'size')),
roots(ui, key) AS (SELECT 'type:' || term, topic FROM topics WHERE term IN (SELECT p_type FROM part)
    UNION ALL SELECT 'brand:Brand#1', 'first brand' WHERE EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1')
    UNION ALL SELECT 'brand:Brand#2', 'Brand#2' WHERE EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#2')),
up AS (SELECT c.ui, r.key FROM concepts c JOIN roots r ON r.ui = c.top1 UNION ALL SELECT c.ui, r.key FROM concepts c JOIN roots r ON r.ui = c.top2),
anchored AS (SELECT ui, key, count(*) / max(n) AS w FROM up JOIN (SELECT ui, count(*) AS n FROM up GROUP BY ui) USING (ui) GROUP BY ui, key)"""
_IDS = """ids AS (SELECT target, scope, identifier AS id, count(*) AS n FROM leaves JOIN scopes USING (label) WHERE {0} GROUP BY ALL)"""
_PART_IDS = _IDS.format("identifier IS NOT NULL AND resource LIKE 'Brand#%'")
_SUPP_IDS = _IDS.format("resource = 'supplier'")


def _coverage(weights: str, keys: str = "") -> str:
    every = f"every AS (SELECT DISTINCT target, scope, key FROM ids, ({keys}))," if keys else "every AS (SELECT target, scope, key FROM mass),"
    return f"""{_ORDERS}, {_CONCEPTS}, {_TOPICS}, {_PART_IDS}, total AS (SELECT target, scope, sum(n) AS n_ids FROM ids GROUP BY ALL),
        mass AS (SELECT target, scope, key, sum(w) AS c, sum(w * n) AS a FROM ids JOIN {weights} x ON x.ui = 'part:' || ids.id GROUP BY ALL),
        whole AS (SELECT key, sum(w) AS t FROM {weights} GROUP BY key), {every}
        r AS (SELECT target, scope, key, coalesce(c, 0) AS c, coalesce(a, 0) AS a, coalesce(t, 0) AS t, n_ids FROM every LEFT JOIN mass USING (target, scope, key) LEFT JOIN whole USING (key) JOIN total USING (target, scope))
        SELECT target, scope, key, round(CAST(c AS DOUBLE), 8) AS count, round(CAST(a AS DOUBLE), 8) AS annotation_count, round(CAST(t AS DOUBLE), 8) AS terminology_total,
            round(CASE WHEN t > 0 THEN CAST(c AS DOUBLE) / CAST(t AS DOUBLE) ELSE 0 END, 8) AS terminology_proportion, round(CAST(a AS DOUBLE) / n_ids, 8) AS annotation_proportion FROM r"""


_ARTICLES = """targets(target, subset) AS (VALUES ('train', 'train'), ('dev', 'dev'), ('test', 'test'), ('orders', NULL)),
topics_of AS (SELECT l_orderkey, list_sort(list(DISTINCT term)) AS terms FROM (SELECT l_orderkey, unnest([p_type, p_brand]) AS term FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey),
articles AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS document_id, CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS subset, c_mktsegment AS journal,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS journal_id, CAST(year(o_orderdate) AS VARCHAR) AS pub_year, terms
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN topics_of ON l_orderkey = o_orderkey),
journals(journal_id, terms) AS (VALUES ('AUTOMOBILE', ['ECONOMY', 'LARGE']), ('BUILDING', ['Brand#1', 'No such term', 'SMALL']), ('FURNITURE', CAST([] AS VARCHAR[])), ('HOUSEHOLD', ['No such term'])),
names(journal_id, topics) AS (VALUES ('FURNITURE', ['home', 'wood']), ('HOUSEHOLD', ['home'])),
term_w AS (SELECT lower(c.name) AS term, a.key, sum(a.w / n) AS w FROM anchored a JOIN concepts c USING (ui) JOIN (SELECT lower(name) AS term, count(DISTINCT ui) AS n FROM concepts GROUP BY 1) m ON m.term = lower(c.name) GROUP BY ALL),
by_topic AS (SELECT journal_id, key, sum(w / n) AS w FROM (SELECT journal_id, lower(unnest(terms)) AS term, len(terms) AS n FROM journals) JOIN term_w USING (term) GROUP BY ALL),
strict AS (SELECT * FROM by_topic UNION ALL SELECT journal_id, unnest(topics), 1.0 / len(topics) FROM names JOIN journals USING (journal_id) WHERE len(terms) = 0),
loose0 AS (SELECT *, 'journal_mesh' AS source FROM by_topic UNION ALL SELECT journal_id, unnest(topics), 1.0 / len(topics), 'journal_name' FROM names WHERE journal_id NOT IN (SELECT journal_id FROM by_topic)),
loose AS (SELECT journal_id, key, w / sum(w) OVER (PARTITION BY journal_id) AS w, source FROM loose0)"""
_WITH_ARTICLES = f"WITH {_CONCEPTS}, {_TOPICS}, {_ARTICLES}"
_PARTS = """norm AS (SELECT term, key, w / sum(w) OVER (PARTITION BY term) AS w FROM term_w),
terms AS (SELECT o_orderkey, document_id, subset, journal_id, 1.0 / len(terms) AS part, unnest(terms) AS name FROM articles WHERE len(terms) > 0 UNION ALL SELECT o_orderkey, document_id, subset, journal_id, 1.0, NULL FROM articles WHERE coalesce(len(terms), 0) = 0),
parts AS (
    SELECT document_id, subset, TRUE AS own, key, sum(part * w) AS w FROM terms JOIN norm ON term = lower(name) GROUP BY ALL
    UNION ALL SELECT document_id, subset, FALSE, coalesce(key, 'Unknown'), sum(part * coalesce(w, 1)) FROM terms t LEFT JOIN loose USING (journal_id) WHERE name IS NULL OR lower(name) NOT IN (SELECT term FROM norm) GROUP BY ALL)"""


def _shared(rows: str, more: str = "") -> str:
    """``rows``: a query for (subset, key, w)."""
    return f"""{_WITH_ARTICLES}{more}, k AS (SELECT target, key, sum(w) AS c FROM ({rows}) r JOIN targets t ON t.subset IS NULL OR t.subset = r.subset GROUP BY ALL)
        SELECT target, 'all' AS scope, key, round(CAST(c AS DOUBLE), 8) AS count, round(c / sum(c) OVER (PARTITION BY target), 8) AS proportion FROM k"""


# --- terminology ------------------------------------------------------------------------------------------


@query("t01_concept_depth", f"""WITH {_CONCEPTS} SELECT ui, CASE WHEN top2 IS NULL THEN 1 ELSE 2 END AS depth FROM concepts
    UNION ALL SELECT 'region:' || r_regionkey, 1 FROM region UNION ALL SELECT 'nation:' || n_nationkey, 2 FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 3 FROM supplier""")
def concept_depth(spark, sf_dir):
    return parts(spark, sf_dir).depths().unionByName(places(spark, sf_dir).depths())


@query("t02_top_ancestors", f"""WITH {_CONCEPTS} SELECT ui, key AS top FROM branch
    UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def top_ancestors(spark, sf_dir):
    return parts(spark, sf_dir).top_ancestors().unionByName(places(spark, sf_dir).top_ancestors())


@query("t03_branch_weights", f"WITH {_CONCEPTS} SELECT ui, key, CAST(w AS DOUBLE) AS w FROM branch")
def branch_weights(spark, sf_dir):
    return parts(spark, sf_dir).branch_weights()


@query("t04_tree_concepts", """SELECT 'region:' || r_regionkey AS ui, 'region:' || r_regionkey AS concept FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier""")
def tree_concepts(spark, sf_dir):
    return places(spark, sf_dir).tree_concepts


@query("t06_anchor_weights", f"WITH {_CONCEPTS}, {_TOPICS} SELECT ui, key, round(CAST(w AS DOUBLE), 8) AS w FROM anchored")
def anchor_weights(spark, sf_dir):
    return part_anchor_weights(spark, sf_dir).withColumn("w", F.round("w", 8))


@query("t06_anchor_weights_by_tree", """SELECT 'region:0' AS ui, 'first' AS key, 1.0::DOUBLE AS w FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'nation:' || n_nationkey, 'first', CASE WHEN n_nationkey = 5 THEN 1.0 ELSE 1.0 END FROM nation WHERE n_regionkey = 0 AND n_name <> 'NATION_1'
    UNION ALL SELECT 'nation:' || n_nationkey, 'second', 1.0 FROM nation WHERE n_name = 'NATION_1'
    UNION ALL SELECT 'supplier:' || s_suppkey, CASE WHEN n_name = 'NATION_1' THEN 'second' ELSE 'first' END, 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0 OR n_name = 'NATION_1'""")
def anchor_weights_by_tree(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/region.parquet").filter("r_regionkey = 0").select(F.col("r_name").alias("term"), F.lit("first").alias("topic"))
    terms = region.unionByName(tb.constant(spark, [("NATION_1", "second")], "term string, topic string"))
    return places(spark, sf_dir).anchor_weights(terms)


@query("t07_topic_weights", f"{_WITH_ARTICLES} SELECT term, key, round(CAST(w AS DOUBLE), 8) AS w FROM term_w WHERE term IN ('economy', 'brand#1', 'small', 'blue bolt')")
def topic_weights(spark, sf_dir):
    parts_ = parts(spark, sf_dir)
    terms = tb.constant(spark, [("ECONOMY",), ("Brand#1",), ("SMALL",), (" Blue  bolt ",), ("No such term",)], "term string")
    found = parts_.topic_weights(terms, "term", part_anchor_weights(spark, sf_dir, parts_))
    return found.select(F.lower(F.trim(F.regexp_replace("term", r"\s+", " "))).alias("term"), "key", F.round("w", 8).alias("w"))


@query("t13_treetop_names", """SELECT 'region:' || r_regionkey AS ui, 'Region ' || r_regionkey AS top FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Region ' || n_regionkey FROM nation""")
def treetop_names(spark, sf_dir):
    names = tb.read(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"), F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("name"))
    return places(spark, sf_dir).treetops(names)


@query("j10_journal_name_matches", """SELECT c_mktsegment AS text, c_mktsegment AS journal_id FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING') GROUP BY c_mktsegment""")
def journal_name_matches(spark, sf_dir):
    journals = tb.journals(spark).select("journal_id", F.initcap("name").alias("name"), F.lit(None).cast("string").alias("abbreviation"), F.array(F.concat(F.lit("The "), F.lower("name"))).alias("name_variants"))
    twin = tb.constant(spark, [("X", "building.", None, [])], "journal_id string, name string, abbreviation string, name_variants array<string>")
    wanted = tb.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text")).distinct()
    return md.match_journals(wanted, journals.unionByName(twin))


@query("t08_global_branch_totals", f"WITH {_CONCEPTS} SELECT key, CAST(sum(w) AS DOUBLE) AS total FROM branch GROUP BY key")
def global_totals(spark, sf_dir):
    parts_ = parts(spark, sf_dir)
    return parts_.totals(parts_.branch_weights())


@query("t09_depth_totals", """SELECT 1 AS key, CAST((SELECT count(*) FROM region) AS DOUBLE) AS total UNION ALL SELECT 2, CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS DOUBLE)""")
def depth_totals(spark, sf_dir):
    places_ = places(spark, sf_dir)
    return places_.totals(places_.depth_weights())


@query("t10_branch_labels", """SELECT 'region:' || r_regionkey AS key, r_name AS label FROM region UNION ALL SELECT 'R' || r_regionkey, r_name FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'R' || n_regionkey || '.N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier""")
def branch_labels(spark, sf_dir):
    return places(spark, sf_dir).labels()


@query("j04_resolve_identifiers", "SELECT CAST(l_partkey AS VARCHAR) AS id, 'part:' || l_partkey AS ui, count(*) AS n FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'brand_' || p_brand, 'brand:' || p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'absent', NULL, 1")
def resolve_identifiers(spark, sf_dir):
    given = tb.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("id")).unionAll(tb.read(spark, sf_dir, "part").select(F.concat(F.lit("brand_"), "p_brand")))
    given = given.unionAll(tb.constant(spark, [("absent",)], "id string")).groupBy("id").agg(F.count("*").alias("n"))
    return parts(spark, sf_dir).resolved(given, "id").select("id", "ui", "n")


@query("m48_high_level_concept_counts", _coverage("branch"))
def high_level_concept_counts(spark, sf_dir, found=None):
    parts_ = parts(spark, sf_dir)
    return tm.branch_coverage(ids(spark, sf_dir, parts_) if found is None else found, parts_, parts_.branch_weights())


@query("m48_high_level_concept_counts_by_topic", _coverage("anchored", "SELECT key FROM anchored UNION SELECT topic FROM topics"))
def concept_counts_by_topic(spark, sf_dir):
    parts_ = parts(spark, sf_dir)
    topics = tb.term_topics(spark).select(F.col("topic").alias("key")).distinct()
    return tm.branch_coverage(ids(spark, sf_dir, parts_), parts_, part_anchor_weights(spark, sf_dir, parts_), topics)


@query("m49_concept_depth_counts", f"""{_ORDERS}, {_SUPP_IDS}, total AS (SELECT target, scope, CAST(sum(n) AS DOUBLE) AS c FROM ids GROUP BY ALL),
    whole(depth, t) AS (SELECT 1, (SELECT count(*) FROM region) UNION ALL SELECT 2, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier))
    SELECT target, scope, depth, CASE WHEN depth = 2 THEN c ELSE 0 END AS count, CAST(t AS DOUBLE) AS terminology_total, CASE WHEN depth = 2 THEN 1.0::DOUBLE ELSE 0 END AS share FROM total, whole""")
def concept_depth_counts(spark, sf_dir, found=None):
    places_ = places(spark, sf_dir)
    return tm.depth_coverage(ids(spark, sf_dir, places_) if found is None else found, places_)


@query("j05_missing_identifiers", f"{_ORDERS}, {_PART_IDS} SELECT DISTINCT target, scope, id FROM ids WHERE CAST(id AS BIGINT) % 7 = 0")
def missing_identifiers(spark, sf_dir):
    whole = tb.part_concepts(spark, sf_dir).filter("not (ui like 'part:%' and seq % 7 = 0)")
    some = tm.Terminology(whole, "part", tuple(f"Brand#{i}" for i in range(1, 26)))
    return tm.missing_ids(ids(spark, sf_dir, some), some)


@query("d07_coverage_summary", f"""{_ORDERS}, {_PART_IDS} SELECT target, scope, CAST(sum(n) AS BIGINT) AS n_input_ids, count(*) AS n_unique_ids, count(*) FILTER (CAST(id AS BIGINT) % 7 = 0) AS n_missing_ids FROM ids GROUP BY target, scope""")
def coverage_summary(spark, sf_dir, found=None):
    whole = tb.part_concepts(spark, sf_dir).filter("not (ui like 'part:%' and seq % 7 = 0)")
    some = tm.Terminology(whole, "part", tuple(f"Brand#{i}" for i in range(1, 26)))
    return tm.coverage_summary(ids(spark, sf_dir, some) if found is None else found, some)


# --- metadata ---------------------------------------------------------------------------------------------


def _frames(spark, sf_dir, of_articles: bool = True):
    """Articles, targets, journals, topics of their terms (of the journals' only, unless ``of_articles``), and name topics."""
    parts_ = parts(spark, sf_dir)
    articles = tb.order_articles(spark, sf_dir)
    terms = tb.journals(spark).select(F.explode("mesh_topics").alias("term"))
    if of_articles:
        terms = terms.unionByName(articles.select(F.explode("mesh_topics").alias("term")))
    weights = parts_.topic_weights(terms, "term", part_anchor_weights(spark, sf_dir, parts_))
    return articles, target_frame(spark, ORDER_TARGETS), tb.journals(spark), weights, tb.name_topics(spark)


@query("m39_journal_distribution", _shared("SELECT subset, coalesce(journal, 'Unknown') AS key, 1 AS w FROM articles"))
def journal_distribution(spark, sf_dir):
    return md.value_distribution(tb.order_articles(spark, sf_dir), target_frame(spark, ORDER_TARGETS), "journal")


@query("m43_publication_year_distribution", _shared("SELECT subset, pub_year AS key, 1 AS w FROM articles"))
def publication_year_distribution(spark, sf_dir):
    return md.value_distribution(tb.order_articles(spark, sf_dir), target_frame(spark, ORDER_TARGETS), "pub_year")


@query("m40_journal_topic_distribution", _shared("""SELECT a.subset, coalesce(x.key, 'Unknown') AS key, 1 AS w FROM articles a
    LEFT JOIN (SELECT DISTINCT journal_id, CASE WHEN term LIKE 'Brand%' THEN 'brand:' ELSE 'type:' END || term AS key FROM (SELECT journal_id, unnest(terms) AS term FROM journals)
        WHERE term IN (SELECT p_type FROM part) OR term IN (SELECT p_brand FROM part)) x USING (journal_id)"""))
def journal_topic_distribution(spark, sf_dir):
    parts_ = parts(spark, sf_dir)
    terms = tb.journals(spark).select(F.explode("mesh_topics").alias("term")).distinct()
    tops = parts_.named(terms, "term").join(parts_.top_ancestors(), "ui").select("term", "top").distinct()
    return md.treetop_distribution(tb.order_articles(spark, sf_dir), target_frame(spark, ORDER_TARGETS), tb.journals(spark), tops)


@query("m41_journal_mesh_topic_distribution", _shared("SELECT subset, coalesce(key, 'Unknown') AS key, coalesce(w, 1) AS w FROM articles LEFT JOIN strict USING (journal_id)"))
def journal_mesh_topic_distribution(spark, sf_dir):
    articles, targets, journals, weights, names = _frames(spark, sf_dir, False)
    return md.journal_topic_distribution(articles, targets, md.journal_profile(journals, weights, names, False))


@query("m42_article_mesh_topic_distribution", _shared("SELECT subset, key, w FROM parts", ", " + _PARTS))
def article_mesh_topic_distribution(spark, sf_dir):
    parts_, journals = parts(spark, sf_dir), tb.journals(spark)
    listed = md.article_terms(tb.order_articles(spark, sf_dir))
    terms = journals.select(F.explode("mesh_topics").alias("term")).unionByName(listed.select("term").filter("term is not null"))
    weights = parts_.topic_weights(terms, "term", part_anchor_weights(spark, sf_dir, parts_))
    return md.article_topic_distribution(listed, target_frame(spark, ORDER_TARGETS), weights, md.journal_profile(journals, weights, tb.name_topics(spark), True))


@query("a01_terminology_mapping_audit", f"""WITH {_CONCEPTS}, {_TOPICS} SELECT c.ui, c.name, coalesce(string_agg(a.key || '=' || round(CAST(a.w AS DOUBLE), 4), ';' ORDER BY a.key), '') AS weights, coalesce(round(sum(CAST(a.w AS DOUBLE)), 8), 0) AS weight_sum
    FROM concepts c LEFT JOIN anchored a USING (ui) GROUP BY c.ui, c.name""")
def terminology_mapping_audit(spark, sf_dir):
    parts_ = parts(spark, sf_dir)
    entry = F.concat(F.col("key"), F.lit("="), F.round("w", 4).cast("string"))
    weights = part_anchor_weights(spark, sf_dir, parts_).groupBy("ui").agg(F.array_join(F.sort_array(F.collect_list(entry)), ";").alias("weights"), F.round(F.sum("w"), 8).alias("weight_sum"))
    rows = parts_.concepts.select("ui", "name").join(weights, "ui", "left")
    return rows.select("ui", "name", F.coalesce("weights", F.lit("")).alias("weights"), F.coalesce("weight_sum", F.lit(0.0)).alias("weight_sum"))


@query("a02_journal_topic_audit", f"""{_WITH_ARTICLES}, x AS (SELECT journal_id, string_agg(key || '=' || round(CAST(w AS DOUBLE), 4), ';' ORDER BY key) AS weights FROM strict GROUP BY journal_id)
    SELECT j.journal_id, j.journal_id AS name, count(o_orderkey) AS usage, CAST(len(any_value(j.terms)) AS INT) AS n_topics, 'Other' AS journal_class, any_value(x.weights) AS weights FROM journals j LEFT JOIN articles USING (journal_id) LEFT JOIN x USING (journal_id) GROUP BY j.journal_id""")
def journal_topic_audit(spark, sf_dir):
    articles, _, journals, weights, names = _frames(spark, sf_dir, False)
    out = md.journal_audit(articles, journals, md.journal_profile(journals, weights, names, False))
    return out.withColumn("weights", F.array_join(F.transform(F.map_entries("weights"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"))


@query("a03_journal_totals", f"{_WITH_ARTICLES} SELECT key, round(CAST(sum(w) AS DOUBLE), 4) AS total FROM articles JOIN strict USING (journal_id) GROUP BY key")
def journal_totals(spark, sf_dir):
    articles, _, journals, weights, names = _frames(spark, sf_dir, False)
    return md.journal_totals(articles, journals, md.journal_profile(journals, weights, names, False))


@query("a04_journal_term_totals", f"{_WITH_ARTICLES} SELECT term, round(CAST(sum(1.0 / n) AS DOUBLE), 4) AS total FROM articles JOIN (SELECT journal_id, unnest(terms) AS term, len(terms) AS n FROM journals) USING (journal_id) GROUP BY term")
def journal_term_totals(spark, sf_dir):
    return md.journal_term_totals(tb.order_articles(spark, sf_dir), tb.journals(spark))


@query("a05_article_topic_audit", f"""{_WITH_ARTICLES}, {_PARTS}, c AS (SELECT document_id, count(name) AS n_terms, count(*) FILTER (name IS NOT NULL AND lower(name) NOT IN (SELECT term FROM norm)) AS n_unmapped FROM terms GROUP BY document_id),
    s AS (SELECT DISTINCT journal_id, source FROM loose)
    SELECT document_id, CASE WHEN n_terms = n_unmapped THEN coalesce(source, 'unknown') WHEN n_unmapped = 0 THEN 'article_mesh' ELSE 'article_mesh+' || coalesce(source, 'unknown') END AS source,
        CAST(n_terms AS INT) AS n_terms, CAST(n_unmapped AS INT) AS n_unmapped FROM c JOIN articles USING (document_id) LEFT JOIN s USING (journal_id)""")
def article_topic_audit(spark, sf_dir):
    articles, _, journals, weights, names = _frames(spark, sf_dir)
    return md.article_audit(articles, weights, md.journal_profile(journals, weights, names, True)).select("document_id", "source", "n_terms", "n_unmapped")


@query("a06_article_totals_without_fallback", f"{_WITH_ARTICLES}, {_PARTS} SELECT key, round(sum(round(CAST(w AS DOUBLE), 4)), 4) AS total FROM parts WHERE own GROUP BY key")
def article_totals(spark, sf_dir):
    articles, _, journals, weights, names = _frames(spark, sf_dir)
    return md.article_totals(articles, weights, md.journal_profile(journals, weights, names, True), False)


@query("a07_unmapped_terms", f"{_WITH_ARTICLES} SELECT name AS term, round(CAST(sum(1.0 / n) AS DOUBLE), 4) AS total FROM (SELECT unnest(terms) AS name, len(terms) AS n FROM articles) WHERE lower(name) NOT IN (SELECT term FROM term_w) GROUP BY name")
def unmapped_terms(spark, sf_dir):
    articles, _, _, weights, _ = _frames(spark, sf_dir)
    return md.unmapped_terms(articles, weights)


@query("s14_journal_classes", "SELECT source AS name, 'Other' AS journal_class, count(*) AS n FROM documents GROUP BY source UNION ALL VALUES ('Nature', 'Multidisciplinary', 1), ('J Neurosci', 'Neuroscience', 1), ('BMC Cancer', 'Oncology', 1), ('J Med Chem', 'Chemistry & Materials', 1), ('Unknown', 'Other', 1)")
def journal_classes(spark, sf_dir):
    fixed = tb.constant(spark, [("Nature",), ("J Neurosci",), ("BMC Cancer",), ("J Med Chem",), ("Unknown",)], "name string")
    rows = tb.read(spark, sf_dir, "documents").select(F.col("source").alias("name")).unionByName(fixed)
    return rows.groupBy("name").agg(F.count("*").alias("n")).select("name", classify(F.col("name")).alias("journal_class"), "n")


@query("s15_journal_class_percentages", """SELECT DISTINCT lang AS target, c AS journal_class, CASE c WHEN 'Other' THEN 100.0::DOUBLE ELSE 0 END AS percent FROM documents,
    (SELECT unnest(['Genetics & Genomics', 'Neuroscience', 'Oncology', 'Immunology', 'Cell & Dev Biology', 'Biochemistry & Mol Bio', 'Pharmacology & Toxicology', 'Cardiology & Vasc', 'Chemistry & Materials', 'Clinical Medicine', 'Multidisciplinary', 'Other']) AS c)""")
def journal_class_percentages(spark, sf_dir):
    counted = tb.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("target"), F.col("source").alias("key")).agg(F.count("*").cast("double").alias("proportion"))
    return class_percentages(counted, ["target"])
