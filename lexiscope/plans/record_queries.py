"""Registered queries of record stores: ordered upserts of orders into customers, their conflicts, and store versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.operators import records
from lexiscope.plans.storage import shared_folder
from lexiscope.sources import stores
from lexiscope.sources import tables as tb

FIELDS = {"name": "strict_case_insensitive", "nation": "strict", "first": "first_seen", "last": "replace", "tags": "set_union", "years": "append"}


def _text(c: str):
    return F.col(c).cast("string")


def customer_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second customer as a record."""
    none = F.lit(None).cast("string")
    return tb.read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(
        (F.col("c_custkey") / 2).cast("long").alias("record_id"), F.create_map(F.lit("customer"), F.array(_text("c_custkey"))).alias("identifiers"),
        F.col("c_name").alias("name"), _text("c_nationkey").alias("nation"), none.alias("first"), none.alias("last"), F.array(F.lit("store")).alias("tags"), F.array(F.lit(0)).alias("years"),
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of their customers: each names itself and the order before it, only the first one the customer."""
    customer = tb.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = tb.read(spark, sf_dir, "orders").withColumn("before", before).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    own, linked = F.array(_text("o_orderkey")), F.array(_text("o_orderkey"), _text("before"))
    ids = F.when(F.col("before").isNull(), F.create_map(F.lit("customer"), F.array(_text("o_custkey")), F.lit("order"), own)).otherwise(F.create_map(F.lit("order"), linked))
    return rows.select(
        F.col("o_orderkey").cast("long").alias("n"), ids.alias("identifiers"), F.when(F.col("o_orderkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("o_orderkey") % 3 > 0, _text("c_nationkey")).alias("nation"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("first"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("last"), F.array("o_orderpriority").alias("tags"), F.array(F.year("o_orderdate")).alias("years"),
    )


def upserted_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.upsert(customer_store(spark, sf_dir), order_rows(spark, sf_dir), FIELDS, "n")
    listed = lambda kind: F.coalesce(F.try_element_at("identifiers", F.lit(kind)), F.array().cast("array<string>"))
    return out.select("record_id", listed("customer").alias("customers"), listed("order").alias("orders"), *FIELDS)


_CHAINS = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, o_orderstatus AS s, year(o_orderdate) AS y, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
tags AS (SELECT o_custkey, list(p ORDER BY seen) AS tags FROM (SELECT o_custkey, p, min(o_orderkey) AS seen FROM o GROUP BY ALL) GROUP BY o_custkey),
folded AS (
    SELECT o_custkey, min(o_orderkey) AS start, list_sort(list(CAST(o_orderkey AS VARCHAR))) AS orders, list(y ORDER BY o_orderkey) AS years,
        arg_min(CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END, o_orderkey) AS name, max(CAST(c_nationkey AS VARCHAR)) FILTER (o_orderkey % 3 > 0) AS nation,
        arg_min(p, o_orderkey) FILTER (o_orderkey % 5 > 0) AS first, arg_max(s, o_orderkey) FILTER (o_orderkey % 7 > 0) AS last
    FROM o GROUP BY o_custkey),
fresh AS (SELECT o_custkey, row_number() OVER (ORDER BY start) AS k FROM folded WHERE o_custkey % 2 = 1)
SELECT CAST(CASE WHEN c.c_custkey % 2 = 0 THEN c.c_custkey // 2 ELSE fresh.k + (SELECT max(c_custkey // 2) FROM customer WHERE c_custkey % 2 = 0) END AS BIGINT) AS record_id, [CAST(c.c_custkey AS VARCHAR)] AS customers,
    coalesce(f.orders, []) AS orders, CASE WHEN c.c_custkey % 2 = 0 THEN c.c_name ELSE f.name END AS name, CASE WHEN c.c_custkey % 2 = 0 THEN CAST(c.c_nationkey AS VARCHAR) ELSE f.nation END AS nation, f.first, f.last,
    CASE WHEN c.c_custkey % 2 = 0 THEN list_concat(['store'], coalesce(t.tags, [])) ELSE t.tags END AS tags, CASE WHEN c.c_custkey % 2 = 0 THEN list_concat([0], coalesce(f.years, [])) ELSE f.years END AS years
FROM customer c LEFT JOIN folded f ON f.o_custkey = c.c_custkey LEFT JOIN tags t ON t.o_custkey = c.c_custkey LEFT JOIN fresh ON fresh.o_custkey = c.c_custkey
WHERE c.c_custkey % 2 = 0 OR f.o_custkey IS NOT NULL
"""


def upsert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows for each order: one with key a, one with key b, one with both; by the order's number the row with both
    comes first (no conflict), last, or last behind a record that has a already."""
    orders = tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    a, b = (F.concat(F.lit(x), F.col("k").cast("string")) for x in "ab")
    ids = lambda *x: F.create_map(F.lit("key"), F.array(*x))
    store = orders.filter("k % 3 = 2").select(F.col("k").alias("record_id"), ids(a).alias("identifiers"))
    row = lambda n, i: F.struct((F.col("k") * 4 + n).alias("n"), i.alias("identifiers"))
    early = F.array(row(0, ids(a, b)), row(1, ids(a)), row(2, ids(b)))
    late = F.array(row(0, ids(a)), row(1, ids(b)), row(2, ids(a, b)))
    rows = orders.select(F.inline(F.when(F.col("k") % 3 == 0, early).otherwise(late)))
    return records.conflicts(store, rows, "n")


_CONFLICTS = """SELECT CAST(o_orderkey AS BIGINT) * 4 + 2 AS n, CASE WHEN o_orderkey % 3 = 2 THEN [CAST(o_orderkey AS BIGINT)] ELSE CAST([] AS BIGINT[]) END AS record_ids,
    CASE WHEN o_orderkey % 3 = 2 THEN [CAST(o_orderkey AS BIGINT) * 4 + 1] ELSE [CAST(o_orderkey AS BIGINT) * 4, CAST(o_orderkey AS BIGINT) * 4 + 1] END AS first_rows FROM orders WHERE o_orderkey % 3 > 0"""


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits to a store: the customers; without those whose number ends in 0, and an equal one, which is no new
    version; and with one new record for each nation, whose ids don't use deleted ones again."""
    path = f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}"
    kind = {"name": "strict"}
    first = stores.commit(customer_store(spark, sf_dir).select("record_id", "identifiers", "name"), path, stores.current(spark, path))
    gone = first.records.filter("record_id % 10 = 0 OR record_id > 60")
    second = stores.commit(records.delete(first.records, gone), path, first)
    second = stores.commit(second.records.orderBy(F.desc("record_id")), path, second)
    nation = tb.read(spark, sf_dir, "nation")
    rows = nation.select(F.col("n_nationkey").cast("long").alias("n"), F.create_map(F.lit("nation"), F.array(_text("n_nationkey"))).alias("identifiers"), F.col("n_name").alias("name"))
    stores.commit(records.upsert(second.records, rows, kind, "n", second.next_id), path, second)
    out = None
    for version in (1, 2, 3):
        read = stores.current(spark, path, version)
        one = read.records.select(F.lit(version).alias("version"), F.lit(read.next_id).cast("long").alias("next_id"), "record_id", "name")
        out = one if out is None else out.unionByName(one)
    return out


_VERSIONS = """
WITH s AS (SELECT CAST(c_custkey // 2 AS BIGINT) AS record_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0), m AS (SELECT max(record_id) + 1 AS top FROM s), n AS (SELECT count(*) AS n FROM nation),
left_over AS (SELECT * FROM s WHERE NOT (record_id % 10 = 0 OR record_id > 60))
SELECT 1 AS version, top AS next_id, record_id, name FROM s, m UNION ALL SELECT 2, top, record_id, name FROM left_over, m
UNION ALL SELECT 3, top + n, record_id, name FROM left_over, m, n UNION ALL SELECT 3, top + n, top + row_number() OVER (ORDER BY n_nationkey) - 1, n_name FROM nation, m, n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"r01_upsert_chains": upserted_chains, "r01_upsert_conflicts": upsert_conflicts, "l10_store_versions": store_versions}
ORACLES: dict[str, str] = {"r01_upsert_chains": _CHAINS, "r01_upsert_conflicts": _CONFLICTS, "l10_store_versions": _VERSIONS}
