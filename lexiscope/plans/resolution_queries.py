"""Registered queries of metadata resolution: orders as articles and parts as journals, with tables as services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators import resolution as rs
from lexiscope.sources import tables as tb

DOCUMENT_FIELDS = {"journal": "strict", "year": "first_seen", "sources": "set_union"}


def _map(**columns: Column) -> Column:
    """The identifiers that aren't null."""
    pairs = [F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), F.array(c).alias("value"))) for k, c in columns.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def _order_keys(k: Column) -> dict[str, Column]:
    """Two thirds of the orders have a pmid, two thirds a doi."""
    return {"pmid": F.when(k % 3 != 1, k.cast("string")), "doi": F.when(k % 3 != 0, F.concat(F.lit("10.1/"), k.cast("string")))}


def completed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the metadata that it gets: every fifth is in the store; one pmid service knows the even numbers, one
    those that 7 doesn't divide, and a doi service those that 11 doesn't."""
    customer = tb.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    orders = tb.read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    known = orders.select(k.alias("k"), _map(**_order_keys(k)).alias("identifiers"), F.col("c_mktsegment").alias("journal"), F.year("o_orderdate").cast("string").alias("year"))

    def service(name: str, kind: str, where: str) -> rs.Service:
        rows = known.filter(where).withColumn("sources", F.array(F.lit(name)))
        return lambda wanted: rows.withColumn("value", F.element_at(F.try_element_at("identifiers", F.lit(kind)), 1)).join(wanted, "value", "left_semi").select("identifiers", *DOCUMENT_FIELDS)

    store = known.filter("k % 5 = 0").select(F.col("k").cast("long").alias("record_id"), "identifiers", "journal", "year", F.array(F.lit("store")).alias("sources"))
    documents = orders.select(k.alias("k"), F.map_filter(F.create_map(*(x for kind, c in _order_keys(k).items() for x in (F.lit(kind), c))), lambda _, v: v.isNotNull()).alias("identifiers"))
    services = {"pmid": [service("even", "pmid", "k % 2 = 0"), service("seven", "pmid", "k % 7 > 0")], "doi": [service("eleven", "doi", "k % 11 > 0")]}
    out, left = rs.complete_documents(documents, store, services, DOCUMENT_FIELDS)
    values = out.select(F.explode(F.flatten(F.map_values("identifiers"))).alias("value"), *DOCUMENT_FIELDS)
    each = documents.select("k", F.explode("identifiers").alias("kind", "value")).join(values, "value", "left").join(left.withColumn("open", F.lit(True)), ["kind", "value"], "left")
    return each.select(F.col("k").cast("long").alias("k"), "kind", "journal", "year", "sources", F.coalesce("open", F.lit(False)).alias("still_open"))


_DOCUMENTS = """
WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, c_mktsegment AS journal, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderkey % 3 <> 1 AS p, o_orderkey % 3 <> 0 AS d FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (
    SELECT *, k % 5 = 0 AS stored, k % 5 > 0 AND p AND k % 2 = 0 AS even, k % 5 > 0 AND p AND k % 2 > 0 AND k % 7 > 0 AS seven, k % 5 > 0 AND d AND k % 11 > 0 AS eleven FROM o),
g AS (SELECT *, list_filter([CASE WHEN stored THEN 'store' END, CASE WHEN even THEN 'even' END, CASE WHEN seven THEN 'seven' END, CASE WHEN eleven THEN 'eleven' END], lambda x: x IS NOT NULL) AS found FROM f),
kinds AS (SELECT *, 'pmid' AS kind FROM g WHERE p UNION ALL SELECT *, 'doi' FROM g WHERE d)
SELECT k, kind, CASE WHEN len(found) > 0 THEN journal END AS journal, CASE WHEN len(found) > 0 THEN year END AS year, CASE WHEN len(found) > 0 THEN found END AS sources,
    CASE WHEN stored THEN false WHEN kind = 'pmid' THEN NOT (even OR seven) ELSE NOT eleven AND NOT even AND NOT seven END AS still_open FROM kinds
"""


def completed_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as journals that articles know by one key each (NLM id, ISSN, abbreviation or name); every sixth is in the
    store, the catalogue lacks every ninth, and records of every tenth come without topics until they are refreshed."""
    k = F.col("p_partkey")
    part = tb.read(spark, sf_dir, "part").select(k.cast("long").alias("k"), F.concat(F.lit("N"), k.cast("string")).alias("nlm"), F.concat(F.lit("I"), k.cast("string")).alias("issn"), F.concat(F.lit("Journal of "), k.cast("string")).alias("name"), F.concat(F.lit("J. "), k.cast("string")).alias("abbreviation"), "p_brand")
    none = F.lit(None).cast("array<string>")
    whole = lambda df, topics: df.select(F.create_map(F.lit("nlm"), F.array("nlm"), F.lit("issn"), F.array("issn")).alias("identifiers"), "name", "abbreviation", none.alias("name_variants"), topics.alias("mesh_topics"))
    listed = part.filter("k % 9 > 0")
    some = F.when(F.col("k") % 10 > 0, F.array("p_brand"))
    service = lambda key: lambda wanted: whole(listed.join(wanted, F.col(key) == F.col("value"), "left_semi"), some)
    refresh = lambda wanted: whole(listed.join(wanted, F.col("nlm") == F.col("value"), "left_semi"), F.array("p_brand"))
    store = whole(part.filter("k % 6 = 0"), some).join(part.filter("k % 6 = 0").select(F.col("k").alias("record_id"), F.col("name")), "name").select("record_id", "identifiers", "name", "abbreviation", "name_variants", "mesh_topics")
    known = lambda n, c: F.when(F.col("k") % 4 == n, F.col(c))
    infos = part.select(_map(nlm=known(0, "nlm"), issn=known(1, "issn")).alias("identifiers"), F.upper(known(2, "abbreviation")).alias("abbreviation"), known(3, "name").alias("name"))

    def by_text(key: str):
        form = F.upper("value") if key == "abbreviation" else F.col("value")
        return lambda wanted: whole(listed.join(wanted, F.upper(key) == form if key == "abbreviation" else F.col(key) == form, "left_semi"), some)

    out = rs.complete_journals(infos, store, {"nlm": service("nlm"), "issn": service("issn"), "abbreviation": by_text("abbreviation"), "name": by_text("name")})
    out, _ = rs.refresh_journals(out, refresh)
    return out.select(F.element_at(F.col("identifiers")["nlm"], 1).alias("nlm"), "name", "abbreviation", "mesh_topics")


_JOURNALS = """SELECT 'N' || p_partkey AS nlm, 'Journal of ' || p_partkey AS name, 'J. ' || p_partkey AS abbreviation, CASE WHEN p_partkey % 10 > 0 OR p_partkey % 9 > 0 THEN [p_brand] END AS mesh_topics
    FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 9 > 0"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"r05_completed_documents": completed_documents, "r07_completed_journals": completed_journals}
ORACLES: dict[str, str] = {"r05_completed_documents": _DOCUMENTS, "r07_completed_journals": _JOURNALS}
