"""Registered queries of readers: tables written in a corpus or terminology format and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators.metrics import METRICS
from lexiscope.plans import queries as mq
from lexiscope.plans.frames import load, save
from lexiscope.plans.storage import shared_folder
from lexiscope.plans.targets import target_frame
from lexiscope.sources import corpora, terminologies
from lexiscope.sources import tables as tb
from lexiscope.sources.links import Grammar


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/round-trips/{name}-{uuid.uuid4().hex}"


def _mentions(corpus) -> DataFrame:
    texts = corpus.passages.select("document_id", "passage_no", F.col("text").alias("passage"), F.col("offset").cast("int").alias("passage_at"))
    span = F.get("spans", F.lit(0))
    rows = corpus.annotations.select("document_id", "passage_no", "text", "label", span["start"].alias("begins"), span["end"].alias("ends"), F.get("links", F.lit(0))["identifier"].alias("identifier"))
    return texts.join(rows, ["document_id", "passage_no"], "left")


def bioc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as BioC documents of two passages, their priority and their status, each a mention of the customer or clerk."""
    orders, path = tb.read(spark, sf_dir, "orders"), _folder(spark, "bioc")

    def passage(text: str, at, kind: str, identifier):
        infon = lambda key, value: F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_VALUE"))
        place = F.struct(at.alias("_offset"), F.length(text).alias("_length"))
        mention = F.struct(F.lit(f"T-{kind}").alias("_id"), F.array(infon("type", F.lit(kind)), infon("identifier", identifier)).alias("infon"), F.array(place).alias("location"), F.col(text).alias("text"))
        return F.struct(F.array(infon("section", F.lit(kind))).alias("infon"), at.alias("offset"), F.col(text).alias("text"), F.array(mention).alias("annotation"))

    second = F.length("o_orderpriority") + 1
    passages = F.array(passage("o_orderpriority", F.lit(0), "customer", F.col("o_custkey")), passage("o_orderstatus", second, "year", F.year("o_orderdate")))
    rows = orders.select(F.col("o_orderkey").cast("string").alias("id"), passages.alias("passage"))
    rows.write.format("xml").option("rowTag", "document").option("rootTag", "collection").save(path)
    return _mentions(corpora.read_bioc(spark, path, "orders", grammar=Grammar()))


def pubtator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as PubTator blocks: the priority as title, status and year as abstract, a mention in each."""
    orders, path = tb.read(spark, sf_dir, "orders"), _folder(spark, "pubtator")
    k, title, abstract = F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.concat_ws(" ", "o_orderstatus", F.year("o_orderdate").cast("string"))
    line = lambda start, text, kind, identifier: F.concat_ws("\t", k, start.cast("string"), (start + F.length(text)).cast("string"), text, F.lit(kind), identifier.cast("string"))
    blocks = F.concat(k, F.lit("|t|"), title, F.lit("\n"), k, F.lit("|a|"), abstract, F.lit("\n"), line(F.lit(0), title, "customer", F.col("o_custkey")), F.lit("\n"), line(F.length(title) + 1, F.col("o_orderstatus"), "year", F.year("o_orderdate")), F.lit("\n"))
    orders.select(blocks).write.text(path)
    return _mentions(corpora.read_pubtator(spark, path, "orders", grammar=Grammar()))


def _both(second: str) -> str:
    return f"""SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 0 AS passage_no, o_orderpriority AS passage, 0 AS passage_at, o_orderpriority AS text, 'customer' AS label, 0 AS begins, CAST(length(o_orderpriority) AS INTEGER) AS ends, CAST(o_custkey AS VARCHAR) AS identifier FROM orders
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, {second}, CAST(length(o_orderpriority) + 1 AS INTEGER), o_orderstatus, 'year', CAST(length(o_orderpriority) + 1 AS INTEGER), CAST(length(o_orderpriority) + 1 + length(o_orderstatus) AS INTEGER), CAST(year(o_orderdate) AS VARCHAR) FROM orders"""


def obo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as OBO terms under their type and brand; every seventh is obsolete."""
    part, path = tb.read(spark, sf_dir, "part"), _folder(spark, "obo")
    key = F.col("p_partkey").cast("string")
    term = F.concat(F.lit("[Term]\nid: part:"), key, F.lit("\nname: "), F.col("p_name"), F.lit("\nalt_id: "), key, F.lit("\nis_a: type:"), F.translate("p_type", " ", "_"), F.lit(" ! type\nis_a: "), F.col("p_brand"), F.when(F.col("p_partkey") % 7 == 0, "\nis_obsolete: true\n").otherwise("\n"))
    part.select(term).write.text(path)
    return terminologies.read_obo(spark, path).select("ui", "name", "parent_ids", "alt_ids")


def saved_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label distribution of orders that were saved and loaded."""
    path = _folder(spark, "corpus")
    save(tb.order_corpus(spark, sf_dir), path)
    return METRICS["label_distribution"].run(load(spark, path), target_frame(spark, mq.ORDER_TARGETS), mq.SCOPES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"l01_bioc_round_trip": bioc, "l02_pubtator_round_trip": pubtator, "l08_obo_round_trip": obo, "l09_saved_corpus": saved_corpus}
ORACLES: dict[str, str] = {
    "l01_bioc_round_trip": _both("o_orderstatus"), "l02_pubtator_round_trip": _both("o_orderstatus || ' ' || CAST(year(o_orderdate) AS VARCHAR)"),
    "l08_obo_round_trip": "SELECT 'part:' || p_partkey AS ui, p_name AS name, ['type:' || replace(p_type, ' ', '_'), p_brand] AS parent_ids, [CAST(p_partkey AS VARCHAR)] AS alt_ids FROM part WHERE p_partkey % 7 > 0",
    "l09_saved_corpus": mq.ORACLES["m36_label_distribution"],
}
