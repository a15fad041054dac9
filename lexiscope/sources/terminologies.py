"""Readers of terminologies: OBO files and MeSH XML, as ``concepts`` frames, and topic maps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.text import parent_tree_number

EMPTY = "array<string>"


def _all(block: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)))


def read_obo(spark: SparkSession, path: str, include_obsolete: bool = False) -> DataFrame:
    """``[Term]`` stanzas of OBO files: id, name, alternative ids, synonyms, parents; obsolete terms are left out
    unless asked for."""
    stanzas = spark.read.text(path, lineSep="\n[").select(F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"^\[", "").alias("b")).filter("b like 'Term]%'")
    b = F.col("b")
    one = lambda tag: F.nullif(F.trim(F.regexp_extract(b, rf"(?m)^{tag}:\s*([^\n]+)$", 1)), F.lit(""))
    rows = stanzas.select(
        "seq", one("id").alias("ui"), one("name").alias("name"), _all(b, r'(?m)^synonym:\s*"((?:[^"\\]|\\.)*)"').alias("synonyms"), F.array().cast(EMPTY).alias("tree_numbers"),
        _all(b, r"(?m)^is_a:\s*([^\s!{]+)").alias("parent_ids"), F.array().cast(EMPTY).alias("mapped_ui_ids"), _all(b, r"(?m)^alt_id:\s*([^\s!{]+)").alias("alt_ids"), b.rlike(r"(?m)^is_obsolete:\s*true").alias("obsolete"),
    )
    rows = rows.filter("ui is not null")
    return (rows if include_obsolete else rows.filter("not obsolete")).drop("obsolete")


def roots(concepts: DataFrame) -> DataFrame:
    """``(ui)`` of the concepts that list no parent."""
    children = concepts.filter(F.size("parent_ids") > 0).select("ui").distinct()
    return concepts.select("ui").join(children, "ui", "left_anti")


_NAME = "struct<String:string>"
_TERMS = "struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"
_DESCRIPTOR = f"DescriptorUI string, DescriptorName {_NAME}, TreeNumberList struct<TreeNumber:array<string>>, ConceptList {_TERMS}"
_REFERRED = "struct<DescriptorReferredTo:array<struct<DescriptorUI:string>>>"
_SUPPLEMENT = f"SupplementalRecordUI string, SupplementalRecordName {_NAME}, HeadingMappedToList struct<HeadingMappedTo:array<struct<DescriptorReferredTo:struct<DescriptorUI:string>>>>, IndexingInformationList struct<IndexingInformation:array<struct<DescriptorReferredTo:struct<DescriptorUI:string>>>>, ConceptList {_TERMS}"


def _synonyms(name: Column) -> Column:
    terms = F.flatten(F.transform(F.coalesce("ConceptList.Concept", F.array().cast("array<struct<TermList:struct<Term:array<struct<String:string>>>>>")), lambda c: F.coalesce(c["TermList"]["Term"], F.array().cast("array<struct<String:string>>"))))
    return F.array_except(F.array_distinct(F.transform(terms, lambda t: t["String"])), F.array(name))


def read_mesh(spark: SparkSession, descriptors: str, supplements: str | None = None) -> DataFrame:
    """MeSH descriptor records, with parents by tree number, and supplemental records, mapped to the descriptors
    they name (a leading star aside)."""
    none = F.array().cast(EMPTY)
    read = lambda path, tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    base = read(descriptors, "DescriptorRecord", _DESCRIPTOR).select(
        F.monotonically_increasing_id().alias("seq"), F.col("DescriptorUI").alias("ui"), F.col("DescriptorName.String").alias("name"), _synonyms(F.col("DescriptorName.String")).alias("synonyms"),
        F.coalesce("TreeNumberList.TreeNumber", none).alias("tree_numbers"),
    )
    trees = base.select("ui", F.explode("tree_numbers").alias("tree"))
    above = trees.select("ui", parent_tree_number(F.col("tree")).alias("above")).filter("above is not null")
    parents = above.join(trees.select(F.col("ui").alias("parent"), F.col("tree").alias("above")), "above").groupBy("ui").agg(F.array_sort(F.collect_set("parent")).alias("parent_ids"))
    out = base.join(parents, "ui", "left").select("seq", "ui", "name", "synonyms", "tree_numbers", F.coalesce("parent_ids", none).alias("parent_ids"), none.alias("mapped_ui_ids"), none.alias("alt_ids"))
    if supplements is None:
        return out
    ids = lambda c: F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<DescriptorReferredTo:struct<DescriptorUI:string>>>")), lambda x: F.regexp_replace(x["DescriptorReferredTo"]["DescriptorUI"], r"^\*", ""))))
    heading, indexing = ids("HeadingMappedToList.HeadingMappedTo"), ids("IndexingInformationList.IndexingInformation")
    more = read(supplements, "SupplementalRecord", _SUPPLEMENT).select(
        (F.monotonically_increasing_id() + F.lit(1 << 50)).alias("seq"), F.col("SupplementalRecordUI").alias("ui"), F.col("SupplementalRecordName.String").alias("name"),
        _synonyms(F.col("SupplementalRecordName.String")).alias("synonyms"), none.alias("tree_numbers"), none.alias("parent_ids"), F.when(F.size(heading) > 0, heading).otherwise(indexing).alias("mapped_ui_ids"), none.alias("alt_ids"),
    )
    return out.unionByName(more)


def topic_terms(text: str) -> dict[str, str]:
    """A YAML mapping of topics to terms as term -> topic; a term under two topics is an error."""
    import yaml

    out: dict[str, str] = {}
    for topic, terms in (yaml.safe_load(text) or {}).items():
        for term in terms or []:
            if out.setdefault(term, topic) != topic:
                raise ValueError(f"{term!r} is listed under {out[term]!r} and {topic!r}")
    return out


def name_topics(text: str) -> dict[str, list[str]]:
    """A JSON mapping of journal names to non-empty topic lists."""
    found = json.loads(text)
    bad = [k for k, v in found.items() if not (isinstance(v, list) and v and all(isinstance(x, str) for x in v))]
    if bad:
        raise ValueError(f"no topics for {bad[:5]}")
    return found


def topic_config(ids: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(topic, names)`` from ``ids(id, topic)``: the names of each topic's concepts, sorted."""
    named = ids.join(concepts.select(F.col("ui").alias("id"), "name"), "id")
    return named.groupBy("topic").agg(F.array_sort(F.collect_set("name")).alias("names"))
