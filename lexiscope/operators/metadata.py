"""Metrics over publication metadata, and the audits that explain them.

Frames: ``articles(corpus, subset, document_id, journal, journal_id, pub_year, mesh_topics)``, one per document;
``journals(journal_id, name, mesh_topics)``; topic tables ``(term, key, w)`` from ``Terminology.topic_weights``;
``name_topics(name, topics)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import journal_key
from lexiscope.operators.statistics import DIGITS, shares
from lexiscope.plans.storage import written
from lexiscope.plans.targets import ALL, at_targets

UNKNOWN = "Unknown"
AUDIT_DIGITS = 4


def _weighted(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows(corpus, subset, key, w)`` as shares per target; summed per subset before joining targets."""
    by_subset = rows.groupBy("corpus", "subset", "key").agg(F.sum("w").alias("w"))
    there = at_targets(by_subset, targets).groupBy("target", "key").agg(F.sum("w").alias("count")).withColumn("scope", F.lit(ALL))
    return shares(there, ["target", "scope"]).withColumn("count", F.round("count", DIGITS)).select("target", "scope", "key", "count", "proportion")


def value_distribution(articles: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """Share of documents per value; null and empty are Unknown."""
    key = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN))
    return _weighted(articles.select("corpus", "subset", key.alias("key"), F.lit(1.0).alias("w")), targets)


def normalised(weights: DataFrame, keys: list[str]) -> DataFrame:
    total = weights.groupBy(*keys).agg(F.sum("w").alias("_total")).filter("_total != 0")
    return weights.join(total, keys).withColumn("w", F.col("w") / F.col("_total")).drop("_total")


def journal_weights(journals: DataFrame, topic_weights: DataFrame) -> DataFrame:
    """``(journal_id, key, w)``: each of a journal's topics has an equal part; what doesn't map is lost."""
    size = F.size("mesh_topics")
    terms = journals.filter(size > 0).select("journal_id", (1.0 / size).alias("part"), F.explode("mesh_topics").alias("term"))
    return terms.join(topic_weights, "term").groupBy("journal_id", "key").agg(F.sum(F.col("part") * F.col("w")).alias("w"))


def name_weights(journals: DataFrame, name_topics: DataFrame) -> DataFrame:
    """``(journal_id, key, w)`` by exact journal name, in equal parts."""
    found = journals.join(name_topics.filter(F.size("topics") > 0), "name")
    return found.select("journal_id", F.explode("topics").alias("key"), (1.0 / F.size("topics")).alias("w"))


def journal_profile(journals: DataFrame, topic_weights: DataFrame, name_topics: DataFrame, unmapped_too: bool) -> DataFrame:
    """``(journal_id, key, w, source)``.  The name's topics stand in where a journal lists no topics, and with
    ``unmapped_too`` (then everything is also brought to sum 1) where none of those listed maps."""
    by_topic = journal_weights(journals, topic_weights)
    without = journals.join(by_topic.select("journal_id").distinct(), "journal_id", "left_anti")
    if not unmapped_too:
        without = without.filter(F.coalesce(F.size("mesh_topics"), F.lit(0)) <= 0)
    by_name = name_weights(without, name_topics)
    both = by_topic.withColumn("source", F.lit("journal_mesh")).unionByName(by_name.withColumn("source", F.lit("journal_name")))
    return normalised(both, ["journal_id"]) if unmapped_too else both


def journal_topic_distribution(articles: DataFrame, targets: DataFrame, profile: DataFrame) -> DataFrame:
    """Fractional topic mass of the documents' journals; documents whose journal has none count as Unknown."""
    rows = articles.select("corpus", "subset", "journal_id").groupBy("corpus", "subset", "journal_id").agg(F.count("*").alias("n")).join(profile, "journal_id", "left")
    key, w = F.coalesce("key", F.lit(UNKNOWN)), F.coalesce("w", F.lit(1.0)) * F.col("n")
    return _weighted(rows.select("corpus", "subset", key.alias("key"), w.alias("w")), targets)


def treetop_distribution(articles: DataFrame, targets: DataFrame, journals: DataFrame, topic_tops: DataFrame) -> DataFrame:
    """Each document counts once for each distinct top of its journal's topics; Unknown without any.
    ``topic_tops(term, top)``."""
    tops = journals.select("journal_id", F.explode("mesh_topics").alias("term")).join(topic_tops, "term").select("journal_id", F.col("top").alias("key")).distinct()
    rows = articles.groupBy("corpus", "subset", "journal_id").agg(F.count("*").alias("n")).join(tops, "journal_id", "left")
    return _weighted(rows.select("corpus", "subset", F.coalesce("key", F.lit(UNKNOWN)).alias("key"), F.col("n").cast("double").alias("w")), targets)


def _listed(articles: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, journal_id, size, term)``: an article's topics and their number; one row with a null term where there are none."""
    size = F.coalesce(F.size("mesh_topics"), F.lit(0))
    return articles.select(*keys, "journal_id", F.when(size > 0, size).otherwise(1).alias("size"), F.explode_outer(F.when(size > 0, F.col("mesh_topics"))).alias("term"))


def article_parts(articles: DataFrame, topic_weights: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, own, key, w)``: an article's topics in equal parts, each term brought to sum 1; a term that
    doesn't map, and an article without terms, takes the journal's profile or else Unknown.  ``own`` says that
    the weight came from the article's terms."""
    return _placed(_listed(articles, keys).withColumn("part", 1.0 / F.col("size")), topic_weights, profile, keys)


def _placed(terms: DataFrame, topic_weights: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, own, key, w)`` of ``terms(keys, journal_id, part, term)``."""
    weights = normalised(topic_weights, ["term"])
    mapped = terms.join(weights, "term").select(*keys, F.lit(True).alias("own"), "key", (F.col("part") * F.col("w")).alias("w"))
    rest = terms.join(weights.select("term").distinct(), "term", "left_anti").groupBy(*keys, "journal_id").agg(F.sum("part").alias("part"))
    rest = rest.join(profile.select("journal_id", "key", "w"), "journal_id", "left")
    filled = rest.select(*keys, F.lit(False).alias("own"), F.coalesce("key", F.lit(UNKNOWN)).alias("key"), (F.col("part") * F.coalesce("w", F.lit(1.0))).alias("w"))
    return mapped.unionByName(filled).groupBy(*keys, "own", "key").agg(F.sum("w").alias("w"))


def article_terms(articles: DataFrame) -> DataFrame:
    """``(corpus, subset, journal_id, size, term, n)``: how many articles with ``size`` topics list a topic, written.  The
    articles are read once for the topics that are to be looked up and for their distribution."""
    keys = ["corpus", "subset"]
    return written(_listed(articles, keys).groupBy(*keys, "journal_id", "size", "term").agg(F.count("*").alias("n")), "article-terms")


def article_topic_distribution(terms: DataFrame, targets: DataFrame, topic_weights: DataFrame, profile: DataFrame) -> DataFrame:
    """Topic mass of the articles' topics, ``terms`` from ``article_terms``; what doesn't map falls as in ``article_parts``."""
    parts = terms.withColumn("part", F.col("n") / F.col("size"))
    return _weighted(_placed(parts, topic_weights, profile, ["corpus", "subset"]).select("corpus", "subset", "key", "w"), targets)


# --- audits -----------------------------------------------------------------------------------------------


def article_audit(articles: DataFrame, topic_weights: DataFrame, profile: DataFrame) -> DataFrame:
    """Per article: where its topics come from, its terms, those that don't map, and its weights (four digits)
    with and without what the journal fills in."""
    keys = ["document_id"]
    weights = normalised(topic_weights, ["term"])
    size = F.coalesce(F.size("mesh_topics"), F.lit(0))
    terms = articles.select("document_id", F.explode("mesh_topics").alias("term"))
    unmapped = terms.join(weights.select("term").distinct(), "term", "left_anti").groupBy("document_id").agg(F.sort_array(F.collect_list("term")).alias("unmapped"))
    sources = profile.groupBy("journal_id").agg(F.first("source").alias("fallback_source"))
    parts = article_parts(articles, topic_weights, profile, keys)
    as_map = lambda c: F.map_from_entries(F.sort_array(F.collect_list(c)))
    rounded = F.round(F.sum("w"), AUDIT_DIGITS)
    full = parts.groupBy("document_id", "key").agg(rounded.alias("w")).groupBy("document_id").agg(as_map(F.struct("key", "w")).alias("weights"))
    own = parts.filter("own").withColumn("w", F.round("w", AUDIT_DIGITS)).groupBy("document_id").agg(as_map(F.struct("key", "w")).alias("own_weights"))
    rows = articles.select("document_id", "journal_id", F.when(size > 0, size).otherwise(0).alias("n_terms"))
    rows = rows.join(unmapped, "document_id", "left").join(sources, "journal_id", "left").join(full, "document_id", "left").join(own, "document_id", "left")
    fallback, n_unmapped = F.coalesce("fallback_source", F.lit("unknown")), F.coalesce(F.size("unmapped"), F.lit(0))
    n_unmapped = F.when(F.col("unmapped").isNull(), 0).otherwise(n_unmapped)
    source = F.when((F.col("n_terms") == 0) | (n_unmapped == F.col("n_terms")), fallback).when(n_unmapped == 0, "article_mesh").otherwise(F.concat(F.lit("article_mesh+"), fallback))
    return rows.select("document_id", source.alias("source"), "n_terms", n_unmapped.cast("int").alias("n_unmapped"), "unmapped", "weights", "own_weights")


def article_totals(articles: DataFrame, topic_weights: DataFrame, profile: DataFrame, with_fallback: bool = True) -> DataFrame:
    """``(key, total)``: sums of the articles' rounded weights, rounded."""
    parts = article_parts(articles, topic_weights, profile, ["document_id"])
    if not with_fallback:
        parts = parts.filter("own")
    each = parts.groupBy("document_id", "key").agg(F.round(F.sum("w"), AUDIT_DIGITS).alias("w"))
    return each.groupBy("key").agg(F.round(F.sum("w"), AUDIT_DIGITS).alias("total"))


def unmapped_terms(articles: DataFrame, topic_weights: DataFrame) -> DataFrame:
    """``(term, total)``: parts of articles that fall on terms without any weight."""
    terms = articles.filter(F.size("mesh_topics") > 0).select((1.0 / F.size("mesh_topics")).alias("part"), F.explode("mesh_topics").alias("term"))
    rest = terms.join(topic_weights.select("term").distinct(), "term", "left_anti")
    return rest.groupBy("term").agg(F.round(F.sum("part"), AUDIT_DIGITS).alias("total"))


def journal_usage(articles: DataFrame, journals: DataFrame) -> DataFrame:
    used = articles.groupBy("journal_id").agg(F.count("*").alias("usage"))
    return journals.join(used, "journal_id", "left").withColumn("usage", F.coalesce("usage", F.lit(0).cast("long")))


def journal_audit(articles: DataFrame, journals: DataFrame, profile: DataFrame) -> DataFrame:
    """Per journal: usage, listed topics, its class by name, and its topic weights (four digits)."""
    from lexiscope.functions.journals import classify

    entries = profile.withColumn("w", F.round("w", AUDIT_DIGITS)).groupBy("journal_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "w")))).alias("weights"))
    rows = journal_usage(articles, journals).join(entries, "journal_id", "left")
    return rows.select("journal_id", "name", "usage", F.size("mesh_topics").alias("n_topics"), classify(F.col("name")).alias("journal_class"), "weights")


def journal_totals(articles: DataFrame, journals: DataFrame, profile: DataFrame) -> DataFrame:
    """``(key, total)``: the journals' weights times their usage."""
    rows = journal_usage(articles, journals).join(profile, "journal_id")
    return rows.groupBy("key").agg(F.round(F.sum(F.col("usage") * F.col("w")), AUDIT_DIGITS).alias("total"))


def journal_term_totals(articles: DataFrame, journals: DataFrame) -> DataFrame:
    """``(term, total)``: usage of the journals that list a term, in equal parts over a journal's terms."""
    rows = journal_usage(articles, journals).filter("usage > 0 and size(mesh_topics) > 0").select((F.col("usage") / F.size("mesh_topics")).alias("part"), F.explode("mesh_topics").alias("term"))
    return rows.groupBy("term").agg(F.round(F.sum("part"), AUDIT_DIGITS).alias("total"))


def match_journals(wanted: DataFrame, journals: DataFrame) -> DataFrame:
    """``(text, journal_id)``: the one journal whose name, abbreviation or variant has the same match form as
    ``wanted.text``; none if there are several."""
    names = journals.select("journal_id", F.explode(F.array_compact(F.concat(F.array("name", "abbreviation"), F.coalesce("name_variants", F.array().cast("array<string>"))))).alias("n"))
    keyed = names.select("journal_id", journal_key(F.col("n")).alias("k")).filter("k != ''").distinct()
    hits = wanted.withColumn("k", journal_key(F.col("text"))).join(keyed, "k")
    return hits.groupBy("text").agg(F.count_distinct("journal_id").alias("n"), F.min("journal_id").alias("journal_id")).filter("n = 1").select("text", "journal_id")


def match_journal_identifiers(wanted: DataFrame, journals: DataFrame) -> DataFrame:
    """``(key, journal_id)``: for each ``wanted(key, identifiers)`` the one journal that shares an identifier; the
    NLM id decides before ISSNs do, and several journals for one kind are none."""
    flat = lambda df, k: df.select(k, F.explode("identifiers").alias("kind", "values")).select(k, "kind", F.explode("values").alias("value")).distinct()
    hits = flat(wanted, "key").join(flat(journals, "journal_id"), ["kind", "value"]).select("key", "kind", "journal_id").distinct()
    each = hits.groupBy("key", "kind").agg(F.count("*").alias("n"), F.min("journal_id").alias("journal_id")).filter("n = 1")
    return each.groupBy("key").agg(F.min_by("journal_id", F.when(F.col("kind") == "nlm", 0).otherwise(1)).alias("journal_id"))


def reconcile(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Year and journal of two tables of one key: where both have one, the old year wins, and the old journal does
    if the names are the same but for case and punctuation; a journal that really differs is an error."""
    both = old.alias("o").join(new.alias("n"), key, "full")
    same = journal_key(F.col("o.journal")) == journal_key(F.col("n.journal"))
    clash = F.col("o.journal").isNotNull() & F.col("n.journal").isNotNull() & ~same
    journal = F.when(clash, F.raise_error(F.concat(F.lit("journals differ: "), F.col("o.journal"), F.lit(" and "), F.col("n.journal")))).otherwise(F.coalesce("o.journal", "n.journal"))
    return both.select(key, F.coalesce("o.pub_year", "n.pub_year").alias("pub_year"), journal.cast("string").alias("journal"))


def resolve_metadata(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    """``documents(corpus, subset, document_id, identifiers)`` with the first record of ``metadata(record_id,
    identifiers, ...)`` that one of the document's identifiers hits, in their order."""
    asked = documents.select("corpus", "document_id", F.posexplode(F.map_entries("identifiers")).alias("place", "e")).select("corpus", "document_id", "place", "e.key", "e.value")
    held = metadata.select("record_id", F.explode(F.map_entries("identifiers")).alias("e")).select("record_id", F.col("e.key").alias("key"), F.explode("e.value").alias("value"))
    first = asked.join(held, ["key", "value"]).groupBy("corpus", "document_id").agg(F.min_by("record_id", "place").alias("record_id"))
    return documents.join(first, ["corpus", "document_id"], "left").join(metadata.drop("identifiers"), "record_id", "left")
