"""Plain tables as annotated corpora.

``text_corpus`` reads documents (lines are passages; every fifth id is the test split), benchmark items and
conversations (turns are passages).  ``order_corpus`` reads orders as documents and their items as mentions:
text is the part's name and the line status, the label is the return flag, and links are, in this order,
absent for items without tax, NIL for quantities from 49, composites of part and supplier for discounts from
0.09, and else the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.plans.frames import LEAF, Corpus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    docs = read(spark, sf_dir, "documents").select(
        F.lit("documents").alias("corpus"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("subset"), F.col("doc_id").cast("string").alias("document_id"), "text"
    )
    items = read(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("corpus"), F.lit("heldout").alias("subset"), F.col("item_id").cast("string").alias("document_id"), "text"
    )
    both = docs.unionByName(items)
    passages = both.select("corpus", "subset", "document_id", F.posexplode(F.split("text", "\n")).alias("passage_no", "text"))
    turns = read(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("corpus"), F.lit("chat").alias("subset"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("passage_no"), "text"
    )
    documents = both.drop("text").unionByName(turns.select("corpus", "subset", "document_id").distinct())
    return Corpus(documents, passages.unionByName(turns))


def order_subset(key):
    return F.when(key % 10 == 0, "test").when(key % 10 == 1, "dev").otherwise("train")


def order_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    orders = read(spark, sf_dir, "orders")
    keys = lambda k: (F.lit("orders").alias("corpus"), order_subset(F.col(k)).alias("subset"), F.col(k).cast("string").alias("document_id"))
    documents = orders.select(*keys("o_orderkey"))
    passages = orders.select(*keys("o_orderkey"), F.lit(0).alias("passage_no"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    items = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat_ws(" ", "p_name", F.lower("l_linestatus"))
    match = F.when(F.col("l_linestatus") == "F", "exact").otherwise("related")
    leaf = lambda i, r, m: F.struct(i.cast("string").alias("identifier"), r.alias("resource"), m.alias("match_type")).cast(LEAF)
    whole = leaf(F.col("l_partkey"), F.col("p_brand"), match)
    composite = F.array(whole, leaf(F.col("l_suppkey"), F.lit("supplier"), match))
    nil = F.array(leaf(F.lit(None), F.lit("<NIL>"), F.lit("NIL")))
    none, empty = F.col("l_tax") == 0, F.array().cast(f"array<{LEAF}>")
    is_nil, several = F.col("l_quantity") >= 49, F.col("l_discount") >= 0.09
    key = F.concat_ws("|", F.col("l_partkey").cast("string"), "p_brand", match)
    pair = F.concat(F.lit("distributive("), key, F.lit(";"), F.concat_ws("|", F.col("l_suppkey").cast("string"), F.lit("supplier"), match), F.lit(")"))
    annotations = items.select(
        *keys("l_orderkey"), text.alias("text"),
        F.transform(F.sequence(F.lit(0), F.col("l_linenumber") % 2), lambda i: F.struct((i * 20).alias("start"), (i * 20 + F.length(text)).alias("end"))).alias("spans"),
        F.col("l_returnflag").alias("label"),
        F.when(none, empty).when(is_nil, nil).when(several, composite).otherwise(F.array(whole)).alias("links"),
        F.when(none, F.lit(None)).when(is_nil, F.lit("NIL")).when(several, pair).otherwise(key).alias("link_key"),
        F.when(~none & ~is_nil & several, F.array(F.lit("distributive"))).otherwise(F.array().cast("array<string>")).alias("link_relations"),
        F.when(none, F.array().cast("array<string>")).when(is_nil, F.array(F.lit("NIL"))).otherwise(F.array(match)).alias("match_types"),
    )
    return Corpus(documents, passages, annotations)


def _strings(*items) -> object:
    return F.array(*items).cast("array<string>") if items else F.array().cast("array<string>")


def part_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under two parents each, their type and their brand; the bare part key is an alternative id."""
    part = read(spark, sf_dir, "part")
    none = _strings()
    row = lambda seq, ui, name, parents, alt: (seq.cast("long").alias("seq"), ui.alias("ui"), name.alias("name"), none.alias("tree_numbers"), parents.alias("parent_ids"), none.alias("mapped_ui_ids"), alt.alias("alt_ids"))
    kind, brand = F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("brand:"), "p_brand")
    parts = part.select(*row(F.col("p_partkey"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.col("p_name"), F.array(kind, brand), none))
    types = part.select("p_type").distinct().select(*row(F.lit(-1), kind, F.col("p_type"), none, none))
    brands = part.select("p_brand").distinct().select(*row(F.lit(-2), brand, F.col("p_brand"), none, none))
    return parts.unionByName(types).unionByName(brands)


def place_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations by tree number; suppliers have no place in the tree but are mapped to their nation."""
    none = _strings()
    text = lambda c: F.col(c).cast("string")
    row = lambda seq, ui, name, trees, mapped: (seq.cast("long").alias("seq"), ui.alias("ui"), name.alias("name"), trees.alias("tree_numbers"), none.alias("parent_ids"), mapped.alias("mapped_ui_ids"), none.alias("alt_ids"))
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    top = F.concat(F.lit("R"), text("r_regionkey"))
    regions = region.select(*row(F.col("r_regionkey"), F.concat(F.lit("region:"), text("r_regionkey")), F.col("r_name"), F.array(top), none))
    tree = F.concat(F.lit("R"), text("n_regionkey"), F.lit(".N"), text("n_nationkey"))
    nations = nation.select(*row(F.col("n_nationkey"), F.concat(F.lit("nation:"), text("n_nationkey")), F.col("n_name"), F.array(tree), none))
    supplier = read(spark, sf_dir, "supplier")
    suppliers = supplier.select(*row(F.col("s_suppkey"), F.concat(F.lit("supplier:"), text("s_suppkey")), F.col("s_name"), none, F.array(F.concat(F.lit("nation:"), text("s_nationkey")))))
    return regions.unionByName(nations).unionByName(suppliers)


def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles: the customer's market segment is the journal, the order's year the year, and the
    distinct types and brands of the parts in it the topics."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    items = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    topics = items.groupBy("l_orderkey").agg(F.sort_array(F.array_union(F.collect_set("p_type"), F.collect_set("p_brand"))).alias("mesh_topics"))
    rows = orders.join(topics, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    return rows.select(
        F.lit("orders").alias("corpus"), order_subset(key).alias("subset"), key.cast("string").alias("document_id"), F.col("c_mktsegment").alias("journal"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("journal_id"), F.year("o_orderdate").cast("string").alias("pub_year"), "mesh_topics",
    )


#: Journals with the topics they list, and topics that stand in by name; FURNITURE lists none, HOUSEHOLD one that
#: maps to nothing, and MACHINERY has no record.
JOURNALS = {"AUTOMOBILE": ["ECONOMY", "LARGE"], "BUILDING": ["Brand#1", "No such term", "SMALL"], "FURNITURE": [], "HOUSEHOLD": ["No such term"]}
NAME_TOPICS = {"FURNITURE": ["home", "wood"], "HOUSEHOLD": ["home"]}
TERM_TOPICS = {"ECONOMY": "price", "PROMO": "price", "LARGE": "size", "MEDIUM": "size", "SMALL": "size"}
ANCHORS = {"brand:Brand#1": "first brand", "brand:Brand#2": None}


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small configured table as a local relation."""
    import json

    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kinds = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


def journals(spark: SparkSession) -> DataFrame:
    return constant(spark, [(k, k, v) for k, v in JOURNALS.items()], "journal_id string, name string, mesh_topics array<string>")


def name_topics(spark: SparkSession) -> DataFrame:
    return constant(spark, list(NAME_TOPICS.items()), "name string, topics array<string>")


def term_topics(spark: SparkSession) -> DataFrame:
    return constant(spark, list(TERM_TOPICS.items()), "term string, topic string")


def anchors(spark: SparkSession) -> DataFrame:
    return constant(spark, list(ANCHORS.items()), "id string, label string")
