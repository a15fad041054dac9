"""Batteries: a YAML description of corpora, bundles, scopes, filters and metrics, planned and run.

    corpora:  {name: {reader: bioc, path: ..., subset: train, ...}}
    bundles:  {target: [[corpus, subset], ...]}
    entity_scopes: {scope: {labels: [...]}}
    annotation_filters: {name: {labels: [...], link_relations: [...], match_types: [...]}}
    terminologies: {name: {reader: obo, path: ..., prefix: ..., aliases: [...]}}
    metrics:  [{result: name, metric: name, bundles: [...] | pairs: [[a, b], ...], filter: name, terminology: name}]

Metrics over articles or terminologies take them from ``Resources`` given to ``run``; terminologies that are
described above are read where those given lack them.  Everything about names is checked before any data is read.  One plan a metric covers all its targets and
scopes; metrics that take counts of the same things can share one reading (``Battery.summary``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators.metrics import METRICS
from lexiscope.operators.summaries import NEEDS, Summary, summary_for
from lexiscope.operators.terminology import counted_leaves
from lexiscope.plans.frames import Corpus
from lexiscope.plans.resources import RESOURCE_METRICS, TERMINOLOGY_READERS, Resources, read_terminology
from lexiscope.plans.targets import ALL, AnnotationFilter, target_frame

READERS: dict[str, Callable[..., Corpus]] = {}
#: Result rows that may be collected for one JSON document.
MOST_RESULT_ROWS = 1_000_000


def reader(name: str):
    """Register a corpus reader; a name can be taken once."""

    def register(function):
        if name in READERS:
            raise ValueError(f"reader {name} is registered already")
        READERS[name] = function
        return function

    return register


@reader("bioc")
def _bioc(spark, **options):
    from lexiscope.sources.corpora import read_bioc

    return read_bioc(spark, **options)


@reader("pubtator")
def _pubtator(spark, **options):
    from lexiscope.sources.corpora import read_pubtator

    return read_pubtator(spark, **options)


@reader("standoff")
def _standoff(spark, **options):
    from lexiscope.sources.corpora import read_standoff

    return read_standoff(spark, **options)[0]


@reader("knowtator")
def _knowtator(spark, **options):
    from lexiscope.sources.corpora import read_knowtator

    return read_knowtator(spark, **options)


@dataclass
class Battery:
    corpora: Mapping[str, list[dict]]
    bundles: Mapping[str, list[tuple[str, str | None]]]
    metrics: list[dict]
    scopes: Mapping[str, list[str]] = field(default_factory=dict)
    filters: Mapping[str, AnnotationFilter] = field(default_factory=dict)
    terminologies: Mapping[str, dict] = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, text: str) -> Battery:
        import yaml

        raw = yaml.safe_load(text) or {}
        listed = lambda v: v if isinstance(v, list) else [v]
        scopes = {k: v.get("labels") or [] for k, v in (raw.get("entity_scopes") or {}).items() if not v.get("include_all") and v.get("labels")}
        filters = {k: AnnotationFilter.of(v or {}) for k, v in (raw.get("annotation_filters") or {}).items()}
        filters |= {k: AnnotationFilter(labels=frozenset(v)) for k, v in scopes.items()}
        bundles = {k: [(p[0], p[1] if len(p) > 1 else None) for p in v] for k, v in (raw.get("bundles") or {}).items()}
        out = cls({k: listed(v) for k, v in (raw.get("corpora") or {}).items()}, bundles, raw.get("metrics") or [], scopes, filters, raw.get("terminologies") or {})
        out.validate()
        return out

    def validate(self) -> None:
        names = [m.get("result") for m in self.metrics]
        if len(set(names)) != len(names):
            raise ValueError("result names stand twice")
        for parts in self.bundles.values():
            for corpus, _ in parts:
                if corpus not in self.corpora:
                    raise ValueError(f"unknown corpus {corpus}")
        for sources in self.corpora.values():
            for source in sources:
                if source.get("reader") not in READERS:
                    raise ValueError(f"unknown reader {source.get('reader')}")
        for name, source in self.terminologies.items():
            if source.get("reader") not in TERMINOLOGY_READERS:
                raise ValueError(f"{name}: unknown terminology reader {source.get('reader')}")
        for m in self.metrics:
            found = METRICS.get(m.get("metric"))
            more = RESOURCE_METRICS.get(m.get("metric"))
            if not found and not more:
                raise ValueError(f"unknown metric {m.get('metric')}")
            if more:
                if not m.get("bundles") or set(m["bundles"]) - set(self.bundles):
                    raise ValueError(f"{m['result']}: no or unknown bundles")
                if m.get("filter") or more.terminology != bool(m.get("terminology")):
                    raise ValueError(f"{m['result']}: takes {'a' if more.terminology else 'no'} terminology, and no filter")
                continue
            used = [t for p in m.get("pairs", []) for t in p] if found.kind == "cross" else m.get("bundles", [])
            if not used or set(used) - set(self.bundles):
                raise ValueError(f"{m['result']}: no or unknown bundles {sorted(set(used) - set(self.bundles))}")
            if m.get("filter") and (m["filter"] not in self.filters or not found.filtered):
                raise ValueError(f"{m['result']}: no filter {m['filter']} for this metric")

    def load(self, spark: SparkSession) -> Corpus:
        whole = None
        for name, sources in self.corpora.items():
            for source in sources:
                options = {k: v for k, v in source.items() if k != "reader"}
                part = READERS[source["reader"]](spark, corpus=name, **options)
                whole = part if whole is None else whole.union(part)
        return whole

    def _summed(self, m: dict) -> bool:
        """Whether a metric can be taken from a summary."""
        need = NEEDS.get(m["metric"])
        return need is not None and (need.filtered or not m.get("filter"))

    def summary(self, corpus: Corpus) -> Summary | None:
        """One reading of ``corpus`` for all metrics that can share it; None if that isn't more than one."""
        shared = [m["metric"] for m in self.metrics if self._summed(m)]
        return summary_for(corpus, shared, self.scopes) if len(shared) > 1 else None

    def run(self, spark: SparkSession, corpus: Corpus | None = None, resources: Resources | None = None, summary: Summary | None = None) -> dict[str, DataFrame]:
        """Result name -> frame.  Scopes are left out where a metric has a filter of its own.  With a ``summary`` the
        metrics that can be taken from it are; the others read the corpus."""
        corpus = corpus or self.load(spark)
        resources = resources or Resources()
        used = {m.get("terminology") for m in self.metrics}
        read = {k: read_terminology(spark, **v) for k, v in self.terminologies.items() if k in used and k not in resources.terminologies}
        resources = replace(resources, terminologies={**read, **resources.terminologies})
        linked = [m for m in self.metrics if m["metric"] in RESOURCE_METRICS and RESOURCE_METRICS[m["metric"]].scoped]
        if len(linked) > 1 and resources.leaves is None:
            resources = replace(resources, leaves=counted_leaves(corpus.annotations))
        out = {}
        for m in self.metrics:
            if more := RESOURCE_METRICS.get(m["metric"]):
                targets = target_frame(spark, {t: self.bundles[t] for t in m["bundles"]})
                out[m["result"]] = more.run(corpus, targets, self.scopes if more.scoped else {}, resources, m.get("terminology"))
                continue
            found = METRICS[m["metric"]]
            source = summary if summary is not None and self._summed(m) else corpus
            where = self.filters.get(m.get("filter"))
            scopes = self.scopes if found.scoped and where is None else {}
            if found.kind == "cross":
                pairs = [F.struct(F.lit(a).alias("target1"), F.lit(b).alias("target2")) for a, b in m["pairs"]]
                pairs = spark.range(1).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
                targets = target_frame(spark, {t: self.bundles[t] for p in m["pairs"] for t in p})
                out[m["result"]] = found.run(source, targets, pairs, scopes, where)
            else:
                out[m["result"]] = found.run(source, target_frame(spark, {t: self.bundles[t] for t in m["bundles"]}), scopes, where)
        return out


def payload(results: Mapping[str, DataFrame], metrics: Mapping[str, str]) -> dict:
    """``{target: [{metric_name, result_name, value, details?, scopes?}]}``; ``metrics`` names each result's
    metric.  Pairs are grouped under ``a|b``.  Reads at most MOST_RESULT_ROWS rows a result."""
    out: dict[str, list] = {}
    for result, frame in results.items():
        rows = frame.limit(MOST_RESULT_ROWS + 1).collect()
        if len(rows) > MOST_RESULT_ROWS:
            raise ValueError(f"{result} has too many rows for a JSON document")
        groups: dict[str, dict[str, list[dict]]] = {}
        for row in rows:
            r = {k: (math.nan if v is None and k in ("mean", "stdev", "min", "median", "max") else v) for k, v in row.asDict().items()}
            target = r.pop("target", None) or f"{r.pop('target1')}|{r.pop('target2')}"
            groups.setdefault(target, {}).setdefault(r.pop("scope"), []).append(r)
        for target, scopes in groups.items():
            shaped = {s: _shape(metrics[result], found) for s, found in scopes.items()}
            entry = {"metric_name": metrics[result], "result_name": result, **shaped.pop(ALL, {"value": None})}
            if shaped:
                entry["scopes"] = shaped
            out.setdefault(target, []).append(entry)
    return out


def _shape(metric: str, rows: list[dict]) -> dict:
    if "terminology_total" in rows[0]:
        return {"value": sorted(rows, key=lambda r: r["key"] if "key" in r else r["depth"])}
    if "key" in rows[0]:
        name = (lambda k: f"MatchType.{k.upper()}" if k != "null" else k) if metric == "match_type_distribution" else (lambda k: k)
        return {"value": {name(r["key"]): r["proportion"] for r in rows}, "details": {"counts": {name(r["key"]): r["count"] for r in rows}, "total": sum(r["count"] for r in rows)}}
    if "jaccard" in rows[0]:
        r = rows[0]
        return {"value": r["jaccard"], "details": {k: r[k] for k in ("n1", "n2", "n_intersection", "n_union")}}
    return {"value": rows[0]["value"] if "value" in rows[0] else rows[0]}


def write_json(value: dict, path: str | None = None) -> str:
    """Indented JSON with sorted keys, to ``path`` if there is one."""
    text = json.dumps(value, indent=2, sort_keys=True)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return text


def differences(a, b, at: str = "") -> list[str]:
    """Where two JSON values differ: types count, NaN equals NaN."""
    if type(a) is not type(b):
        return [f"{at or '/'}: {type(a).__name__} and {type(b).__name__}"]
    if isinstance(a, dict):
        return [x for k in sorted({*a, *b}) for x in (differences(a[k], b[k], f"{at}/{k}") if k in a and k in b else [f"{at}/{k}: only in one"])]
    if isinstance(a, list):
        short = [f"{at}: {len(a)} and {len(b)} items"] if len(a) != len(b) else []
        return short + [x for i, (p, q) in enumerate(zip(a, b)) for x in differences(p, q, f"{at}/{i}")]
    same = a == b or isinstance(a, float) and math.isnan(a) and math.isnan(b)
    return [] if same else [f"{at or '/'}: {a!r} and {b!r}"]
