"""What the metrics of a corpus need of it, counted in one reading.

A summary stands for its corpus: every metric runs on it and gives the same rows.  Its tables are

    profiles   corpus, subset, passages, sentences, tokens, chars, figures, _n     documents with equal figures
    units      corpus, subset, unit, key, _n                                       distinct passages, sentences, tokens
    mentions   corpus, subset, label, text, links, link_key, ..., spans, _n        distinct annotations

with the number of occurrences in ``_n``.  ``figures`` holds a document's annotations by label, and its distinct
mentions and identifiers by scope.  So counts, medians, deviations, shares and overlaps of any target follow without
reading the corpus again, and those of any group of labels too, but for the distinct mentions and identifiers of
documents, whose scopes are chosen when the summary is made.  Summaries of disjoint sets of documents add up.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.operators.statistics import WEIGHT
from lexiscope.plans.frames import KEYS, Corpus
from lexiscope.plans.storage import removed, written
from lexiscope.plans.targets import ALL

BY_SUBSET = ["corpus", "subset"]
SIZES = ["passages", "sentences", "tokens", "chars"]
MENTION = ["label", "text", "links", "link_key", "link_relations", "match_types"]
UNITS = ("passage", "sentence", "token")
PARTS = ("profiles", "units", "mentions")


class Summary(Corpus):
    """A corpus as counted rows; parts that weren't asked for are None, and their metrics raise."""

    def __init__(self, profiles: DataFrame | None, units: DataFrame | None, mentions: DataFrame | None, scopes: Mapping[str, Sequence[str]]):
        documents = profiles.select(*BY_SUBSET, WEIGHT) if profiles is not None else None
        passages = units.filter("unit = 'passage'").select(*BY_SUBSET, F.col("key").alias("text"), WEIGHT) if units is not None else None
        annotations = mentions.withColumn("spans", F.array_repeat(F.lit(0), F.col("spans"))) if mentions is not None else None
        super().__init__(documents, passages, annotations)
        for name, value in (("profiles", profiles), ("units", units), ("mentions", mentions), ("scopes", dict(scopes))):
            object.__setattr__(self, name, value)

    def _part(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise ValueError(f"the summary has no {name}")
        return found

    def document_sizes(self) -> DataFrame:
        return self._part("profiles").select(*BY_SUBSET, *SIZES, WEIGHT)

    def passage_sizes(self) -> DataFrame:
        """Sums by document: enough for totals, which is all that metrics take of them."""
        return self.document_sizes()

    def exploded(self, what: str) -> DataFrame:
        return self._part("units").filter(F.col("unit") == what).select(*BY_SUBSET, "key", WEIGHT)

    def per_document(self, what: str, scopes: Mapping[str, Sequence[str]] | None) -> DataFrame:
        """``(corpus, subset, scope, value, tokens, _n)``: annotations, or distinct mentions or identifiers, of each
        document in each scope; annotations by any labels, the others by the summary's own scopes only."""
        named = {ALL: None, **{n: labels for n, labels in (scopes or {}).items() if labels}}
        values = []
        for scope, labels in named.items():
            if what != "annotations" and labels is not None and set(labels) != set(self.scopes.get(scope) or ()):
                raise ValueError(f"the summary has no {what} of the scope {scope}")
            total = F.aggregate(F.filter("figures", _figure(what, scope, labels)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
            values.append(F.struct(F.lit(scope).alias("scope"), total.alias("value")))
        return self._part("profiles").select(*BY_SUBSET, "tokens", WEIGHT, F.explode(F.array(*values)).alias("x")).select(*BY_SUBSET, "x.*", "tokens", WEIGHT)

    def union(self, other: Summary) -> Summary:
        """The summary of both corpora, which must not share documents and must have the same parts and scopes."""
        if self.scopes != other.scopes or any((getattr(self, p) is None) != (getattr(other, p) is None) for p in PARTS):
            raise ValueError("summaries of different parts or scopes")
        both = {p: getattr(self, p).unionByName(getattr(other, p)) if getattr(self, p) is not None else None for p in PARTS}
        return Summary(*(_added(both[p]) if both[p] is not None else None for p in PARTS), self.scopes)

    def discard(self) -> None:
        """Delete the tables, once nothing reads them any more."""
        removed(*(getattr(self, p) for p in PARTS if getattr(self, p) is not None))


def _figure(what: str, scope: str, labels: Sequence[str] | None):
    """Tells the figures of ``what`` in a scope: annotations by their labels, the others by the scope's name."""
    if what == "annotations" and labels is None:
        return lambda x: x["kind"] == what
    if what == "annotations":
        return lambda x: (x["kind"] == what) & F.coalesce(x["label"].isin(*labels), F.lit(False))
    return lambda x: (x["kind"] == what) & (x["scope"] == scope)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*(c for c in rows.columns if c != WEIGHT)).agg(F.sum(WEIGHT).alias(WEIGHT))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count("*").alias(WEIGHT))


def _figures(annotations: DataFrame, scopes: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(KEYS, figures)``: annotations are shuffled once, by document, and what is distinct in a document is found there by
    grouping, which spills, so that no set of its texts is held in memory; its row has one entry a label and scope."""
    wanted = {ALL: F.lit(True), **{name: F.coalesce(F.col("label").isin(*labels), F.lit(False)) for name, labels in scopes.items() if labels}}
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    identifiers = F.transform("links", lambda x: row("identifiers", x["identifier"]))
    dealt = annotations.select(*KEYS, "label", "text", "links").repartition(*KEYS)
    rows = dealt.select(*KEYS, "label", F.explode(F.concat(F.array(row("annotations", F.col("label")), row("mentions", F.col("text"))), identifiers)).alias("x"))
    # A value is one row of its document, with a mark for each scope that has it, however many labels and scopes those are.
    marks = [F.max(scope.cast("int")).alias(f"in{k}") for k, scope in enumerate(wanted.values())]
    told = rows.groupBy(*KEYS, F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"), *marks)
    of = lambda kind, n: F.when(F.col("kind") == kind, n)
    entry = lambda kind, scope, label, n: F.struct(F.lit(kind).alias("kind"), scope.cast("string").alias("scope"), label.cast("string").alias("label"), n.cast("long").alias("n"))
    sums, entries, none = [], [], F.lit(None)
    for k, name in enumerate(wanted):
        # A missing text is no mention; a missing identifier is one value, NIL.
        for kind, n in (("mentions", F.when(F.col("value").isNull(), 0).otherwise(F.col(f"in{k}"))), ("identifiers", F.col(f"in{k}"))):
            sums += [F.sum(of(kind, n)).alias(f"{kind}{k}"), F.max(of(kind, F.col(f"in{k}"))).alias(f"{kind}{k}_there")]
            entries.append(F.when(F.col(f"{kind}{k}_there") == 1, entry(kind, F.lit(name), none, F.col(f"{kind}{k}"))))
    by_label = F.collect_list(of("annotations", entry("annotations", none, F.col("value"), F.col("n")))).alias("by_label")
    found = told.groupBy(*KEYS).agg(by_label, *sums)
    return found.select(*KEYS, F.sort_array(F.concat("by_label", F.array_compact(F.array(*entries)))).alias("figures"))


def summarised(corpus: Corpus, scopes: Mapping[str, Sequence[str]] | None = None, parts: Iterable[str] = PARTS, units: Iterable[str] = UNITS) -> Summary:
    """The summary of ``corpus``, written to the shared folder.  Where two parts need the annotations, the columns that
    they need are written first, so that the corpus's reader and joins run once."""
    parts, scopes, units = set(parts), {k: list(v) for k, v in (scopes or {}).items() if v}, [u for u in UNITS if u in set(units)]
    annotated, found, drafts = corpus.annotations, {}, []
    if annotated is not None and {"profiles", "mentions"} <= parts:
        annotated = written(annotated.select(*KEYS, *MENTION, F.size("spans").alias("spans")), "annotations")
        drafts.append(annotated)
    elif annotated is not None:
        annotated = annotated.withColumn("spans", F.size("spans"))
    if "profiles" in parts:
        none = F.array().cast("array<struct<kind:string,scope:string,label:string,n:bigint>>")
        sizes = corpus.document_sizes()
        sizes = sizes.join(_figures(annotated, scopes), KEYS, "left") if annotated is not None else sizes.withColumn("figures", none)
        found["profiles"] = written(_counted(sizes.select(*BY_SUBSET, *SIZES, F.coalesce("figures", none).alias("figures"))), "profiles")
    if "units" in parts:
        found["units"] = written(_units(corpus, units), "units")
    if "mentions" in parts and annotated is not None:
        found["mentions"] = written(_counted(annotated.select(*BY_SUBSET, *MENTION, "spans")), "mentions")
    removed(*drafts)
    return Summary(*(found.get(p) for p in PARTS), scopes)


def _units(corpus: Corpus, units: Sequence[str]) -> DataFrame:
    """All units of a passage in one pass; with a sentence model, sentences in a pass of their own."""
    from lexiscope.functions.text import sentences, tokens

    one = lambda unit: lambda x: F.struct(F.lit(unit).alias("unit"), x.alias("key"))
    apart = "sentence" in units and corpus.sentence_model is not None
    of = {"passage": F.array(F.col("text")), "sentence": sentences(F.col("text")), "token": tokens(F.col("text"))}
    taken = [F.coalesce(F.transform(of[u], one(u)), F.array().cast("array<struct<unit:string,key:string>>")) for u in units if not (apart and u == "sentence")]
    parts = []
    if taken:
        parts.append(corpus.passages.select(*BY_SUBSET, F.explode(F.concat(*taken)).alias("x")).select(*BY_SUBSET, "x.*"))
    if apart:
        parts.append(corpus.exploded("sentence").select(*BY_SUBSET, F.lit("sentence").alias("unit"), "key"))
    return _counted(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


@dataclass(frozen=True)
class Need:
    """The part of a summary that a metric reads, and the units if it reads those."""

    part: str
    unit: str | None = None
    filtered: bool = True


_DOCUMENTS = ("document_count", "sentence_count", "token_count", "passages_per_document_stats", "sentences_per_document_stats", "tokens_per_document_stats", "document_length_stats")
_BY_DOCUMENT = ("annotations_per_document_stats", "annotations_per_1000_tokens_stats", "unique_mentions_per_document_stats", "unique_identifiers_per_document_stats")
_MENTIONS = (
    "mention_count", "mention_token_count", "identifier_count", "spans_per_annotation_stats", "identifiers_per_annotation_stats", "mention_length_stats", "mention_token_length_stats",
    "mention_redundancy_stats", "mention_token_redundancy_stats", "identifier_redundancy_stats", "variation_degree_stats", "ambiguity_degree_stats", "unique_mentions", "unique_mention_tokens",
    "unique_identifiers", "label_distribution", "identifier_resource_distribution", "match_type_distribution", "mention_overlap", "mention_token_overlap", "identifier_overlap",
)
NEEDS: dict[str, Need] = {
    **{m: Need("profiles") for m in _DOCUMENTS}, **{m: Need("profiles", filtered=False) for m in _BY_DOCUMENT}, **{m: Need("mentions") for m in _MENTIONS}, "passage_count": Need("units", "passage"),
    **{f"{u}_{kind}_stats": Need("units", u) for u in UNITS for kind in ("length", "redundancy")}, "unique_tokens": Need("units", "token"), "unique_sentences": Need("units", "sentence"), "token_overlap": Need("units", "token"),
}


def summary_for(corpus: Corpus, metrics: Iterable[str], scopes: Mapping[str, Sequence[str]] | None = None) -> Summary:
    """The smallest summary from which all of ``metrics`` follow."""
    needs = [NEEDS[m] for m in metrics]
    return summarised(corpus, scopes, {n.part for n in needs}, {n.unit for n in needs if n.unit})
