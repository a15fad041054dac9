"""Completing record stores from services: documents by their identifiers, journals by identifiers and names.

A service is a function from ``(value)``, the distinct keys that are missing, to rows of a store, ``(identifiers,
<fields>)``.  What is missing is found by anti joins; what services answer is upserted, equal rows once, in the order of
their first identifiers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import clean, journal_key
from lexiscope.operators.metadata import match_journals
from lexiscope.operators.records import in_order, upsert
from lexiscope.plans.storage import settled

Service = Callable[[DataFrame], DataFrame]
JOURNAL_FIELDS = {"name": "replace", "abbreviation": "replace", "name_variants": "set_union", "mesh_topics": "set_union"}
#: The kinds of a journal's keys, in the order in which services are asked.
JOURNAL_KEYS = ("nlm", "issn", "abbreviation", "name")


def held(store: DataFrame, kind: str) -> DataFrame:
    """``(value)``: the identifiers of a kind that records have."""
    return store.select(F.explode(F.coalesce(F.try_element_at("identifiers", F.lit(kind)), F.array().cast("array<string>"))).alias("value")).distinct()


def added(store: DataFrame, rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """The store with a service's rows; those without identifiers are left out."""
    known = rows.filter(F.size(F.flatten(F.map_values("identifiers"))) > 0)
    order = "n"
    while order in fields:
        order = f"_{order}"
    return settled(upsert(store, in_order(settled(known), order), fields, order))


def complete_documents(documents: DataFrame, store: DataFrame, services: Mapping[str, Sequence[Service]], fields: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """The store with what ``services`` know of ``documents(identifiers map<string,string>)``, and ``(kind, value)``: the
    identifiers that are still without a record.

    Each kind's identifiers that the store doesn't have at first are asked of its services one after another, each time
    only those that are still missing.  Kinds without a service aren't asked for.  Null maps and values count for nothing.
    """
    asked = documents.select(F.explode("identifiers").alias("kind", "value")).filter("value IS NOT NULL").distinct()
    asked = settled(asked)
    missing = {kind: settled(asked.filter(F.col("kind") == kind).select("value").join(held(store, kind), "value", "left_anti")) for kind in services}
    left = None
    for kind, tried in services.items():
        rest = missing[kind]
        for service in tried:
            if rest.isEmpty():
                break
            store = added(store, service(rest), fields)
            rest = settled(rest.join(held(store, kind), "value", "left_anti"))
        one = rest.select(F.lit(kind).alias("kind"), "value")
        left = one if left is None else left.unionByName(one)
    return store, left if left is not None else asked.limit(0)


def journal_values(infos: DataFrame, kind: str) -> DataFrame:
    """``(value)``: the distinct keys of a kind in ``infos(identifiers, abbreviation, name)``, names cleaned."""
    if kind in ("abbreviation", "name"):
        return infos.select(clean(F.col(kind)).alias("value")).filter("value IS NOT NULL").distinct()
    return held(infos, kind).filter("value IS NOT NULL")


def unresolved_journals(values: DataFrame, store: DataFrame, kind: str) -> DataFrame:
    """Those of ``values(value)`` that no record has or, for names, that don't lead to exactly one record."""
    if kind in ("abbreviation", "name"):
        wanted = values.select(F.col("value").alias("text")).filter(journal_key(F.col("text")) != "")
        found = match_journals(wanted, store.withColumnRenamed("record_id", "journal_id"))
        return values.join(found.select(F.col("text").alias("value")), "value", "left_anti")
    return values.join(held(store, kind), "value", "left_anti")


def complete_journals(infos: DataFrame, store: DataFrame, services: Mapping[str, Service]) -> DataFrame:
    """The store ``(record_id, identifiers, name, abbreviation, name_variants, mesh_topics)`` with what ``services`` know
    of ``infos(identifiers, abbreviation, name)``: by NLM id, then ISSN, abbreviation and name, each time only keys
    that the store as it is then doesn't resolve.  Kinds without a service are passed over."""
    for kind in JOURNAL_KEYS:
        if kind not in services:
            continue
        rest = settled(unresolved_journals(journal_values(infos, kind), store, kind))
        if not rest.isEmpty():
            store = added(store, services[kind](rest), JOURNAL_FIELDS)
    return store


def refresh_journals(store: DataFrame, service: Service, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The store after asking once for the NLM ids of records without ``mesh_topics`` (an empty list is one), and
    ``(value)``: the ids that have been asked for, to be handed to the next call."""
    wanted = held(store.filter("mesh_topics IS NULL"), "nlm")
    wanted = settled(wanted if tried is None else wanted.join(tried, "value", "left_anti"))
    every = wanted if tried is None else settled(tried.unionByName(wanted))
    return (store if wanted.isEmpty() else added(store, service(wanted), JOURNAL_FIELDS)), every
