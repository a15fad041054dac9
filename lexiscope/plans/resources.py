"""Metrics that need more than a corpus: articles with journals and topics, or a terminology.

They are registered by name like those over a corpus alone, and batteries plan both kinds alike.  What they need
comes in ``Resources``; everything derived from it (the weights of terms, the profiles of journals) is planned
once per call, whatever the number of targets and scopes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators import metadata as md
from lexiscope.operators import terminology as tm
from lexiscope.operators.metrics import METRICS
from lexiscope.plans.frames import Corpus
from lexiscope.plans.storage import terminology_home

TERMINOLOGY_READERS: dict[str, Callable[..., DataFrame]] = {}


def terminology_reader(name: str):
    """Register a reader of ``concepts`` frames; a name can be taken once."""

    def register(function):
        if name in TERMINOLOGY_READERS:
            raise ValueError(f"terminology reader {name} is registered already")
        TERMINOLOGY_READERS[name] = function
        return function

    return register


@terminology_reader("obo")
def _obo(spark, **options):
    from lexiscope.sources.terminologies import read_obo

    return read_obo(spark, **options)


@terminology_reader("mesh")
def _mesh(spark, **options):
    from lexiscope.sources.terminologies import read_mesh

    return read_mesh(spark, **options)


def read_terminology(spark: SparkSession, reader: str, prefix: str | None = None, aliases=(), **options) -> tm.Terminology:
    return tm.Terminology(TERMINOLOGY_READERS[reader](spark, **options), prefix, tuple(aliases), terminology_home(spark))


@dataclass(frozen=True)
class Resources:
    """``articles(corpus, subset, document_id, journal, journal_id, pub_year, mesh_topics)``, ``journals(journal_id,
    name, mesh_topics)``, terminologies by name, ``term_topics(term, topic)``, ``anchors(id, label)`` and
    ``name_topics(name, topics)``; a metric says which of them it lacks.  ``leaves`` are the corpus's, counted for all
    metrics that look identifiers up; where there are none, each counts them."""

    articles: DataFrame | None = None
    journals: DataFrame | None = None
    terminologies: Mapping[str, tm.Terminology] = field(default_factory=dict)
    term_topics: DataFrame | None = None
    anchors: DataFrame | None = None
    name_topics: DataFrame | None = None
    leaves: DataFrame | None = None

    def need(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise ValueError(f"this metric needs {name}")
        return found

    def terminology(self, name: str) -> tm.Terminology:
        if name not in self.terminologies:
            raise ValueError(f"unknown terminology {name}")
        return self.terminologies[name]

    def weights(self, name: str) -> DataFrame:
        """``(ui, key, w)`` by topics where they are configured, else by branches."""
        found = self.terminology(name)
        if self.term_topics is None:
            return found.branch_weights()
        return found.anchor_weights(self.term_topics, self.anchors) if self.anchors is not None else found.anchor_weights(self.term_topics)

    def term_weights(self, name: str, listed: DataFrame | None = None) -> DataFrame:
        """``(term, key, w)`` of the journals' terms, and of those ``listed`` by articles."""
        terms = self.need("journals").select(F.explode("mesh_topics").alias("term"))
        if listed is not None:
            terms = terms.unionByName(listed.select("term").filter("term is not null"))
        return self.terminology(name).topic_weights(terms.distinct(), "term", self.weights(name))

    def profile(self, weights: DataFrame, unmapped_too: bool) -> DataFrame:
        return md.journal_profile(self.need("journals"), weights, self.need("name_topics"), unmapped_too)


@dataclass(frozen=True)
class ResourceMetric:
    name: str
    run: Callable[..., DataFrame]
    scoped: bool = False
    terminology: bool = False


RESOURCE_METRICS: dict[str, ResourceMetric] = {}


def resource_metric(name: str, **flags):
    """Register a metric ``(corpus, targets, scopes, resources, terminology name)``; a name can be taken once."""

    def register(function):
        if name in RESOURCE_METRICS or name in METRICS:
            raise ValueError(f"metric {name} is registered already")
        RESOURCE_METRICS[name] = ResourceMetric(name, function, **flags)
        return function

    return register


@resource_metric("journal_distribution")
def journal_distribution(corpus, targets, scopes, resources, name):
    return md.value_distribution(resources.need("articles"), targets, "journal")


@resource_metric("publication_year_distribution")
def publication_year_distribution(corpus, targets, scopes, resources, name):
    return md.value_distribution(resources.need("articles"), targets, "pub_year")


@resource_metric("journal_topic_distribution", terminology=True)
def journal_topic_distribution(corpus, targets, scopes, resources, name):
    journals, found = resources.need("journals"), resources.terminology(name)
    terms = journals.select(F.explode("mesh_topics").alias("term")).distinct()
    tops = found.named(terms, "term").join(found.top_ancestors(), "ui").select("term", "top").distinct()
    return md.treetop_distribution(resources.need("articles"), targets, journals, tops)


@resource_metric("journal_MeSH_topic_distribution", terminology=True)
def journal_mesh_topic_distribution(corpus, targets, scopes, resources, name):
    weights = resources.term_weights(name)
    return md.journal_topic_distribution(resources.need("articles"), targets, resources.profile(weights, False))


@resource_metric("article_MeSH_topic_distribution", terminology=True)
def article_mesh_topic_distribution(corpus, targets, scopes, resources, name):
    listed = md.article_terms(resources.need("articles"))
    weights = resources.term_weights(name, listed)
    return md.article_topic_distribution(listed, targets, weights, resources.profile(weights, True))


def linked_ids(corpus: Corpus, targets: DataFrame, scopes, resources: Resources, found: tm.Terminology) -> DataFrame:
    """``(target, scope, id, n)``: identifiers of the terminology's resources."""
    counted = tm.counted_leaves(corpus.annotations) if resources.leaves is None else resources.leaves
    return tm.linked_ids(counted, targets, scopes, found)


@resource_metric("high_level_concept_counts", scoped=True, terminology=True)
def high_level_concept_counts(corpus, targets, scopes, resources, name):
    found = resources.terminology(name)
    topics = resources.term_topics
    listed = topics if topics is None else topics.select(F.col("topic").alias("key")).distinct()
    return tm.branch_coverage(linked_ids(corpus, targets, scopes, resources, found), found, resources.weights(name), listed)


@resource_metric("concept_depth_counts", scoped=True, terminology=True)
def concept_depth_counts(corpus, targets, scopes, resources, name):
    found = resources.terminology(name)
    return tm.depth_coverage(linked_ids(corpus, targets, scopes, resources, found), found)
