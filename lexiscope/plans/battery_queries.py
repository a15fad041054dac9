"""Registered queries that run whole batteries, and source readers over files written from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.plans import graph_queries as gq
from lexiscope.plans import queries as mq
from lexiscope.plans.battery import Battery
from lexiscope.plans.queries import ORDER_TARGETS, SCOPES
from lexiscope.plans.resources import Resources
from lexiscope.sources import tables as tb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(function):
        QUERIES[name] = function
        ORACLES[name] = sql
        return function

    return register


def _battery(metrics: list[dict]) -> Battery:
    found = Battery({"orders": []}, ORDER_TARGETS, [{"bundles": list(ORDER_TARGETS), **m} for m in metrics], {k: v for k, v in SCOPES.items() if v})
    found.validate()
    return found


def _resources(spark, sf_dir: str) -> Resources:
    terminologies = {"parts": gq.parts(spark, sf_dir), "places": gq.places(spark, sf_dir)}
    return Resources(tb.order_articles(spark, sf_dir), tb.journals(spark), terminologies, tb.term_topics(spark), tb.anchors(spark), tb.name_topics(spark))


def _together(results: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.withColumn("result", F.lit(name)) for name, df in results.items()))


def _union(names: dict[str, str]) -> str:
    return " UNION ALL BY NAME ".join(f"SELECT *, '{result}' AS result FROM ({gq.ORACLES[name]})" for result, name in names.items())


@query("b01_metadata_battery", _union({"journals": "m39_journal_distribution", "years": "m43_publication_year_distribution", "tops": "m40_journal_topic_distribution", "journal topics": "m41_journal_mesh_topic_distribution", "article topics": "m42_article_mesh_topic_distribution"}))
def metadata_battery(spark, sf_dir):
    battery = _battery([
        {"result": "journals", "metric": "journal_distribution"}, {"result": "years", "metric": "publication_year_distribution"}, {"result": "tops", "metric": "journal_topic_distribution", "terminology": "parts"},
        {"result": "journal topics", "metric": "journal_MeSH_topic_distribution", "terminology": "parts"}, {"result": "article topics", "metric": "article_MeSH_topic_distribution", "terminology": "parts"},
    ])
    return _together(battery.run(spark, tb.order_corpus(spark, sf_dir), _resources(spark, sf_dir)))


@query("b02_terminology_battery", f"""SELECT target, scope, 'topics' AS result, key, count, annotation_count, terminology_total, annotation_proportion AS share FROM ({gq.ORACLES["m48_high_level_concept_counts_by_topic"]})
    UNION ALL SELECT target, scope, 'depths', CAST(depth AS VARCHAR), count, NULL, terminology_total, share FROM ({gq.ORACLES["m49_concept_depth_counts"]})""")
def terminology_battery(spark, sf_dir):
    battery = _battery([{"result": "topics", "metric": "high_level_concept_counts", "terminology": "parts"}, {"result": "depths", "metric": "concept_depth_counts", "terminology": "places"}])
    found = battery.run(spark, tb.order_corpus(spark, sf_dir), _resources(spark, sf_dir))
    topics, depths = found["topics"], found["depths"]
    shared = ("target", "scope", "result", "key", "count", "annotation_count", "terminology_total", "share")
    topics = topics.withColumn("result", F.lit("topics")).withColumn("share", F.col("annotation_proportion"))
    depths = depths.withColumn("result", F.lit("depths")).withColumn("key", F.col("depth").cast("string")).withColumn("annotation_count", F.lit(None).cast("double"))
    return topics.select(*shared).unionByName(depths.select(*shared))


_SHARED_SCALARS = {"mention_count": "m05_mention_count", "identifier_count": "m07_identifier_count", "unique_mentions": "m33_unique_mentions", "unique_identifiers": "m35_unique_identifiers"}
_SHARED_STATS = {
    "annotations_per_document_stats": "m11_annotations_per_document_stats", "unique_mentions_per_document_stats": "m13_unique_mentions_per_document_stats", "mention_length_stats": "m21_mention_length_stats",
    "mention_redundancy_stats": "m26_mention_redundancy_stats", "variation_degree_stats": "m29_variation_degree_stats", "ambiguity_degree_stats": "m30_ambiguity_degree_stats",
}
_SHARED_SHARES = {"label_distribution": "m36_label_distribution", "identifier_resource_distribution": "m37_identifier_resource_distribution", "match_type_distribution": "m38_match_type_distribution"}
_TEXT_SHARED = {"token_length_stats": "m20_token_length_stats", "sentence_length_stats": "m19_sentence_length_stats", "passage_length_stats": "m18_passage_length_stats", "token_redundancy_stats": "m25_token_redundancy_stats", "sentence_redundancy_stats": "m24_sentence_redundancy_stats"}


def _plain(names: dict[str, str]) -> str:
    return " UNION ALL BY NAME ".join(f"SELECT *, '{metric}' AS result FROM ({mq.ORACLES[name]})" for metric, name in names.items())


def _sharing(spark, corpus, targets: dict, scopes: dict, metrics) -> DataFrame:
    battery = Battery({c: [] for parts in targets.values() for c, _ in parts}, targets, [{"bundles": list(targets), "result": m, "metric": m} for m in metrics], scopes)
    battery.validate()
    return _together(battery.run(spark, corpus, summary=battery.summary(corpus)))


def _shared_orders(metrics: dict[str, str]):
    scopes = {k: v for k, v in SCOPES.items() if v}
    return lambda spark, sf_dir: _sharing(spark, tb.order_corpus(spark, sf_dir), ORDER_TARGETS, scopes, metrics)


for _name, _metrics in (("b03_shared_counts", _SHARED_SCALARS), ("b03_shared_statistics", _SHARED_STATS), ("b03_shared_distributions", _SHARED_SHARES)):
    query(_name, _plain(_metrics))(_shared_orders(_metrics))


@query("b04_shared_text_statistics", _plain(_TEXT_SHARED))
def shared_text_statistics(spark, sf_dir):
    return _sharing(spark, tb.text_corpus(spark, sf_dir), mq.TEXT_TARGETS, {}, _TEXT_SHARED)
