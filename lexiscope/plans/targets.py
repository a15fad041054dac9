"""Targets (named bundles of corpus subsets), scopes (named label groups) and annotation filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALL = "all"
#: Bundles are configuration; more rows than this are refused before anything is broadcast.
MOST_TARGET_ROWS = 100_000


@dataclass(frozen=True)
class AnnotationFilter:
    """``None`` allows any; an empty set of labels allows nothing; an empty set of relations or match types
    allows only annotations without any."""

    labels: frozenset[str] | None = None
    relations: frozenset[str] | None = None
    match_types: frozenset[str] | None = None

    @classmethod
    def of(cls, spec: Mapping) -> AnnotationFilter:
        unknown = set(spec) - {"labels", "link_relations", "match_types"}
        if unknown:
            raise ValueError(f"unknown filter keys: {sorted(unknown)}")
        allowed = {"link_relations": {"distributive", "intersective", "related_set", "alternative"}, "match_types": {"exact", "related", "approximate", "NIL"}}
        for key, values in allowed.items():
            if set(spec.get(key) or ()) - values:
                raise ValueError(f"unknown {key}: {sorted(set(spec[key]) - values)}")
        read = lambda k: None if spec.get(k) is None else frozenset(spec[k])
        return cls(read("labels"), read("link_relations"), read("match_types"))

    def condition(self) -> Column:
        out = F.lit(True)
        if self.labels is not None:
            out = out & F.coalesce(F.col("label").isin(*self.labels), F.lit(False)) if self.labels else F.lit(False)
        for column, allowed in (("link_relations", self.relations), ("match_types", self.match_types)):
            if allowed is not None:
                found = F.coalesce(F.col(column), F.array().cast("array<string>"))
                rest = F.array_except(found, F.array(*map(F.lit, sorted(allowed)))) if allowed else found
                out = out & (F.size(rest) == 0)
        return out


def target_frame(spark: SparkSession, bundles: Mapping[str, Sequence[tuple[str, str | None]]]) -> DataFrame:
    """``(target, corpus, subset)``, one row per listed subset, repeats kept; a null subset is the whole corpus."""
    rows = [(t, c, s) for t, parts in bundles.items() for c, s in parts]
    if len(rows) > MOST_TARGET_ROWS:
        raise ValueError(f"{len(rows)} target rows")
    parts = [F.struct(F.lit(t).alias("target"), F.lit(c).alias("corpus"), F.lit(s).cast("string").alias("subset")) for t, c, s in rows]
    return spark.range(1).select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def at_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """``df`` by target instead of corpus and subset; a row comes once for each listing of its subset."""
    small = targets.select("target", F.col("corpus").alias("_corpus"), F.col("subset").alias("_subset"))
    hit = (F.col("corpus") == F.col("_corpus")) & (F.col("_subset").isNull() | (F.col("subset") == F.col("_subset")))
    return df.join(F.broadcast(small), hit).drop("corpus", "subset", "_corpus", "_subset")


def with_scopes(annotations: DataFrame, scopes: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Annotations once for the scope ``all`` and once for each scope that has their label: one pass for all
    scopes.  Scopes without labels are skipped."""
    named = [F.when(F.col("label").isin(*labels), F.lit(name)) for name, labels in (scopes or {}).items() if labels]
    return annotations.withColumn("scope", F.explode(F.array_compact(F.array(F.lit(ALL), *named))))


def every_pair(targets: DataFrame, scopes: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """All (target, scope), so that results without data still have a row."""
    names = [ALL, *(n for n, labels in (scopes or {}).items() if labels)]
    return targets.select("target").distinct().withColumn("scope", F.explode(F.array(*map(F.lit, names))))
