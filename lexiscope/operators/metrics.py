"""The metrics of a corpus, each one plan over all targets and scopes.

A metric is a function ``(corpus, targets, scopes, where) -> DataFrame`` in the registry; ``where`` is an
AnnotationFilter.  Results have the columns target and scope, and then value (counts), the statistics, or key,
count and proportion (distributions); overlaps take pairs of targets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import tokens
from lexiscope.operators import statistics as st
from lexiscope.operators.summaries import Summary
from lexiscope.plans.frames import KEYS, Corpus
from lexiscope.plans.targets import ALL, AnnotationFilter, at_targets, every_pair, with_scopes

BY = ["target", "scope"]


@dataclass(frozen=True)
class Metric:
    name: str
    run: Callable[..., DataFrame]
    scoped: bool = False
    filtered: bool = False
    kind: str = "subset"


METRICS: dict[str, Metric] = {}


def metric(name: str, **flags):
    """Register a metric; a name can be taken once."""

    def register(function):
        if name in METRICS:
            raise ValueError(f"metric {name} is registered already")
        METRICS[name] = Metric(name, function, **flags)
        return function

    return register


def _mentions(corpus: Corpus, where: AnnotationFilter | None) -> DataFrame:
    return corpus.annotations.filter(where.condition()) if where else corpus.annotations


def _scalar(rows: DataFrame, targets: DataFrame, value) -> DataFrame:
    """Sum of ``value`` per target; summed per subset first, as sums can be joined to targets afterwards."""
    by_subset = rows.groupBy("corpus", "subset").agg(st.weighted_sum(rows, value).alias("value"))
    got = at_targets(by_subset, targets).groupBy("target").agg(F.sum("value").alias("value"))
    names = targets.select("target").distinct()
    return names.join(got, "target", "left").select("target", F.lit(ALL).alias("scope"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def _stats(rows: DataFrame, targets: DataFrame, scopes=None, scoped: bool = False) -> DataFrame:
    """Statistics of the column value: counted per subset, then by target."""
    keys = ["scope"] if scoped else []
    counted = rows.groupBy("corpus", "subset", *keys, F.col("value").cast("double").alias("value")).agg(st.occurrences(rows).alias("n"))
    there = at_targets(counted, targets)
    if not scoped:
        there = there.withColumn("scope", F.lit(ALL))
    return st.complete(st.describe_counted(there, BY), every_pair(targets, scopes if scoped else None))


def _multiplicities(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Statistics of how often each distinct key occurs in a target."""
    by_subset = st.vocabulary(rows, ["corpus", "subset"])
    keyed = at_targets(by_subset, targets).groupBy("target", "key").agg(F.sum("n").alias("value")).withColumn("scope", F.lit(ALL))
    return st.complete(st.describe(keyed, BY), every_pair(targets, None))


def _distinct(rows: DataFrame, targets: DataFrame) -> DataFrame:
    by_subset = rows.select("corpus", "subset", "key").distinct()
    got = at_targets(by_subset, targets).distinct().groupBy("target").agg(F.count("*").alias("value"))
    names = targets.select("target").distinct()
    return names.join(got, "target", "left").select("target", F.lit(ALL).alias("scope"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def _per_document(corpus: Corpus, where, scopes, value, what: str) -> DataFrame:
    """``(corpus, subset, scope, value)`` per document, documents without mentions included as 0."""
    if isinstance(corpus, Summary):
        if where:
            raise ValueError("a summary has no filtered annotations of documents")
        return corpus.per_document(what, scopes)
    tagged = with_scopes(_mentions(corpus, where).select(*KEYS, "text", "label", "links"), scopes)
    counted = tagged.groupBy(*KEYS, "scope").agg(value.alias("value"))
    names = [ALL, *(n for n, labels in (scopes or {}).items() if labels)]
    every = corpus.documents.select(*KEYS).withColumn("scope", F.explode(F.array(*map(F.lit, names))))
    return every.join(counted, [*KEYS, "scope"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def _leaves(mentions: DataFrame, *columns: str) -> DataFrame:
    return mentions.select("corpus", "subset", *columns, *st.carried(mentions), F.explode("links").alias("leaf"))


def _mention_tokens(mentions: DataFrame, *columns: str) -> DataFrame:
    return mentions.select("corpus", "subset", *columns, *st.carried(mentions), F.explode(tokens(F.col("text"))).alias("key"))


# --- counts -----------------------------------------------------------------------------------------------


@metric("document_count")
def document_count(corpus, targets, scopes=None, where=None):
    return _scalar(corpus.documents, targets, F.lit(1))


@metric("passage_count")
def passage_count(corpus, targets, scopes=None, where=None):
    return _scalar(corpus.passages.select("corpus", "subset", *st.carried(corpus.passages)), targets, F.lit(1))


@metric("sentence_count")
def sentence_count(corpus, targets, scopes=None, where=None):
    return _scalar(corpus.passage_sizes(), targets, F.col("sentences"))


@metric("token_count")
def token_count(corpus, targets, scopes=None, where=None):
    return _scalar(corpus.passage_sizes(), targets, F.col("tokens"))


@metric("mention_count", filtered=True)
def mention_count(corpus, targets, scopes=None, where=None):
    return _scalar(_mentions(corpus, where), targets, F.lit(1))


@metric("mention_token_count", filtered=True)
def mention_token_count(corpus, targets, scopes=None, where=None):
    return _scalar(_mentions(corpus, where), targets, F.size(tokens(F.col("text"))))


@metric("identifier_count", filtered=True)
def identifier_count(corpus, targets, scopes=None, where=None):
    return _scalar(_mentions(corpus, where), targets, F.size("links"))


# --- statistics -------------------------------------------------------------------------------------------


def _document_stats(column: str):
    def run(corpus, targets, scopes=None, where=None):
        return _stats(corpus.document_sizes().withColumn("value", F.col(column)), targets)

    return run


for _name, _column in (("passages_per_document_stats", "passages"), ("sentences_per_document_stats", "sentences"), ("tokens_per_document_stats", "tokens"), ("document_length_stats", "chars")):
    metric(_name)(_document_stats(_column))


@metric("annotations_per_document_stats", scoped=True, filtered=True)
def annotations_per_document_stats(corpus, targets, scopes=None, where=None):
    return _stats(_per_document(corpus, where, scopes, F.count("*"), "annotations"), targets, scopes, True)


@metric("annotations_per_1000_tokens_stats", scoped=True, filtered=True)
def annotations_per_1000_tokens_stats(corpus, targets, scopes=None, where=None):
    counts = _per_document(corpus, where, scopes, F.count("*"), "annotations")
    if not isinstance(corpus, Summary):
        counts = counts.join(corpus.document_sizes().select(*KEYS, "tokens"), KEYS)
    rate = F.when(F.col("tokens") > 0, F.col("value") / F.col("tokens") * 1000).otherwise(0.0)
    return _stats(counts.withColumn("value", rate), targets, scopes, True)


@metric("unique_mentions_per_document_stats", scoped=True, filtered=True)
def unique_mentions_per_document_stats(corpus, targets, scopes=None, where=None):
    return _stats(_per_document(corpus, where, scopes, F.count_distinct("text"), "mentions"), targets, scopes, True)


@metric("unique_identifiers_per_document_stats", scoped=True, filtered=True)
def unique_identifiers_per_document_stats(corpus, targets, scopes=None, where=None):
    if isinstance(corpus, Summary):
        return _stats(_per_document(corpus, where, scopes, None, "identifiers"), targets, scopes, True)
    mentions = _mentions(corpus, where).select(*KEYS, "label", "text", F.explode("links").alias("leaf"))
    leaves = mentions.select(*KEYS, "label", "text", F.col("leaf.identifier").alias("links"))
    wanted = F.count_distinct("links") + F.max(F.col("links").isNull().cast("int"))  # NIL is one value
    return _stats(_per_document(Corpus(corpus.documents, corpus.passages, leaves), None, scopes, wanted, "identifiers"), targets, scopes, True)


@metric("spans_per_annotation_stats", filtered=True)
def spans_per_annotation_stats(corpus, targets, scopes=None, where=None):
    return _stats(_mentions(corpus, where).withColumn("value", F.size("spans")), targets)


@metric("identifiers_per_annotation_stats", filtered=True)
def identifiers_per_annotation_stats(corpus, targets, scopes=None, where=None):
    return _stats(_mentions(corpus, where).withColumn("value", F.size("links")), targets)


@metric("passage_length_stats")
def passage_length_stats(corpus, targets, scopes=None, where=None):
    return _stats(corpus.passages.select("corpus", "subset", *st.carried(corpus.passages), F.length("text").alias("value")), targets)


def _unit_length_stats(unit: str):
    def run(corpus, targets, scopes=None, where=None):
        return _stats(corpus.exploded(unit).withColumn("value", F.length("key")), targets)

    return run


for _unit in ("sentence", "token"):
    metric(f"{_unit}_length_stats")(_unit_length_stats(_unit))


@metric("mention_length_stats", filtered=True)
def mention_length_stats(corpus, targets, scopes=None, where=None):
    return _stats(_mentions(corpus, where).withColumn("value", F.length("text")), targets)


@metric("mention_token_length_stats", filtered=True)
def mention_token_length_stats(corpus, targets, scopes=None, where=None):
    return _stats(_mention_tokens(_mentions(corpus, where)).withColumn("value", F.length("key")), targets)


# --- redundancy -------------------------------------------------------------------------------------------


@metric("passage_redundancy_stats")
def passage_redundancy_stats(corpus, targets, scopes=None, where=None):
    return _multiplicities(corpus.passages.select("corpus", "subset", *st.carried(corpus.passages), F.col("text").alias("key")), targets)


def _unit_redundancy(unit: str):
    def run(corpus, targets, scopes=None, where=None):
        return _multiplicities(corpus.exploded(unit), targets)

    return run


for _unit in ("sentence", "token"):
    metric(f"{_unit}_redundancy_stats")(_unit_redundancy(_unit))


@metric("mention_redundancy_stats", filtered=True)
def mention_redundancy_stats(corpus, targets, scopes=None, where=None):
    return _multiplicities(_mentions(corpus, where).withColumn("key", F.col("text")), targets)


@metric("mention_token_redundancy_stats", filtered=True)
def mention_token_redundancy_stats(corpus, targets, scopes=None, where=None):
    return _multiplicities(_mention_tokens(_mentions(corpus, where)), targets)


@metric("identifier_redundancy_stats", filtered=True)
def identifier_redundancy_stats(corpus, targets, scopes=None, where=None):
    return _multiplicities(_leaves(_mentions(corpus, where)).withColumn("key", F.col("leaf.identifier")), targets)


def _degrees(corpus, targets, scopes, where, group, member):
    """Statistics of the number of distinct ``member`` per ``group``, one of which tells the label: so scopes, which follow
    from labels, are told after rows were made distinct."""
    rows = _mentions(corpus, where).select("corpus", "subset", "label", group.alias("g"), member.alias("m")).distinct()
    tagged = with_scopes(at_targets(rows, targets).distinct(), scopes)
    found = tagged.groupBy(*BY, "g").agg(F.count("*").alias("value"))
    return st.complete(st.describe(found, BY), every_pair(targets, scopes))


@metric("variation_degree_stats", scoped=True, filtered=True)
def variation_degree_stats(corpus, targets, scopes=None, where=None):
    concept = F.struct("label", F.coalesce("link_key", F.lit("None")).alias("link"))
    return _degrees(corpus, targets, scopes, where, concept, F.col("text"))


@metric("ambiguity_degree_stats", scoped=True, filtered=True)
def ambiguity_degree_stats(corpus, targets, scopes=None, where=None):
    concept = F.struct("label", F.coalesce("link_key", F.lit("None")).alias("link"))
    return _degrees(corpus, targets, scopes, where, F.col("text"), concept)


# --- distinct counts --------------------------------------------------------------------------------------


def _unit_distinct(unit: str):
    def run(corpus, targets, scopes=None, where=None):
        return _distinct(corpus.exploded(unit), targets)

    return run


metric("unique_tokens")(_unit_distinct("token"))
metric("unique_sentences")(_unit_distinct("sentence"))


@metric("unique_mentions", filtered=True)
def unique_mentions(corpus, targets, scopes=None, where=None):
    return _distinct(_mentions(corpus, where).withColumn("key", F.col("text")), targets)


@metric("unique_mention_tokens", filtered=True)
def unique_mention_tokens(corpus, targets, scopes=None, where=None):
    return _distinct(_mention_tokens(_mentions(corpus, where)), targets)


@metric("unique_identifiers", filtered=True)
def unique_identifiers(corpus, targets, scopes=None, where=None):
    return _distinct(_leaves(_mentions(corpus, where)).withColumn("key", F.col("leaf.identifier")), targets)


# --- distributions ----------------------------------------------------------------------------------------


def _shared(rows: DataFrame, targets: DataFrame, key) -> DataFrame:
    counted = rows.groupBy("corpus", "subset", "scope", F.coalesce(key.cast("string"), F.lit("null")).alias("key")).agg(st.occurrences(rows).alias("n"))
    there = at_targets(counted, targets).groupBy(*BY, "key").agg(F.sum("n").alias("count"))
    return st.shares(there, BY)


@metric("label_distribution", scoped=True, filtered=True)
def label_distribution(corpus, targets, scopes=None, where=None):
    return _shared(with_scopes(_mentions(corpus, where), scopes), targets, F.col("label"))


@metric("identifier_resource_distribution", scoped=True, filtered=True)
def identifier_resource_distribution(corpus, targets, scopes=None, where=None):
    return _shared(_leaves(with_scopes(_mentions(corpus, where), scopes), "scope"), targets, F.col("leaf.resource"))


@metric("match_type_distribution")
def match_type_distribution(corpus, targets, scopes=None, where=None):
    return _shared(_leaves(corpus.annotations.withColumn("scope", F.lit(ALL)), "scope"), targets, F.col("leaf.match_type"))


# --- overlaps ---------------------------------------------------------------------------------------------


def _overlapped(rows: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    return st.overlap(at_targets(rows.select("corpus", "subset", "scope", "key").distinct(), targets).distinct(), pairs)


@metric("token_overlap", kind="cross")
def token_overlap(corpus, targets, pairs, scopes=None, where=None):
    return _overlapped(corpus.exploded("token").withColumn("scope", F.lit(ALL)), targets, pairs)


@metric("mention_overlap", kind="cross", scoped=True, filtered=True)
def mention_overlap(corpus, targets, pairs, scopes=None, where=None):
    return _overlapped(with_scopes(_mentions(corpus, where), scopes).withColumn("key", F.col("text")), targets, pairs)


@metric("mention_token_overlap", kind="cross", scoped=True, filtered=True)
def mention_token_overlap(corpus, targets, pairs, scopes=None, where=None):
    return _overlapped(_mention_tokens(with_scopes(_mentions(corpus, where), scopes), "scope"), targets, pairs)


@metric("identifier_overlap", kind="cross", scoped=True, filtered=True)
def identifier_overlap(corpus, targets, pairs, scopes=None, where=None):
    leaves = _leaves(with_scopes(_mentions(corpus, where), scopes), "scope")
    return _overlapped(leaves.withColumn("key", F.col("leaf.identifier")), targets, pairs)
