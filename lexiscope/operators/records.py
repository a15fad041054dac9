"""Record tables with identifiers: upserts with per-field merge policies, lookups and checks.

A store is ``(record_id, identifiers map<string, array<string>>, <fields>)``.  Rows are upserted as if one after another:
a row that shares no identifier with any record makes one, a row that shares some with one record is merged into it,
and a row that shares some with several is a conflict.

No row waits for another.  Each identifier points to its first holder, a record or the earliest row; a row that is the
first holder of all its identifiers starts a record, any other follows the earliest holder of one of its own.  Pointers
are halved until each row knows the start of its chain, in as many rounds as the logarithm of the longest chain.  A row
whose identifiers lead to several starts is a conflict; without any, the rows of one start are one record, whose fields
are folded in the order of the rows by aggregations.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexiscope.plans.storage import settled

IDENTIFIERS = "map<string,array<string>>"


class ConflictError(ValueError):
    """New rows share identifiers with several records, or a strict field has two values."""


#: How an old and a new value of a field become one, nulls aside: one value, in capitals or not; the first; the last; the
#: distinct values of two lists, or all of them.
POLICIES = ("strict", "strict_case_insensitive", "first_seen", "replace", "set_union", "append")


def _entries(df: DataFrame, key: str) -> DataFrame:
    flat = df.select(key, F.explode("identifiers").alias("type", "values"))
    return flat.select(key, "type", F.explode("values").alias("value")).distinct()


def _row_text(df: DataFrame) -> Column:
    """The whole row as one string, nulls told apart from absent text."""
    whole = [F.array_sort(F.map_entries("identifiers")).alias("identifiers"), *(F.col(f"`{c}`") for c in sorted(df.columns) if c != "identifiers")]
    return F.to_json(F.struct(*whole), {"ignoreNullFields": "false"})


def _numbered(starts: DataFrame, first: int) -> DataFrame:
    """``(root, record_id)``: ids from ``first`` on in the order of ``root``.  Tasks number their own ranges, and the driver
    sees one count for each task."""
    placed = settled(starts.orderBy("root").select("root", F.monotonically_increasing_id().alias("m")))
    task = F.shiftrightunsigned("m", 33)
    begins, offsets = first, {}
    for r in placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():
        offsets[r["task"]], begins = begins, begins + r["n"]
    begin = F.try_element_at(F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)), task) if offsets else F.lit(0)
    return placed.select("root", (begin + F.col("m").bitwiseAND((1 << 33) - 1)).cast("long").alias("record_id"))


def in_order(rows: DataFrame, order: str) -> DataFrame:
    """Equal rows once, with a column ``order`` that numbers them from 0 by their first identifiers and contents."""
    text = "_text"
    while text in rows.columns:
        text = f"_{text}"
    once = rows.withColumn(text, _row_text(rows)).dropDuplicates([text])
    keyed = once.select(F.struct(F.element_at(F.array_sort(F.map_entries("identifiers")), 1), F.col(text)).alias("root"))
    given = settled(_numbered(keyed, 0).select(F.col(f"root.{text}").alias(text), F.col("record_id").alias(order)))
    return once.join(given, text).drop(text)


def _nodes(store: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """``(type, value, node)``: records are numbered down from -2, in front of all rows."""
    records = _entries(store, "record_id").select("type", "value", (-1 - F.col("record_id")).cast("long").alias("node"))
    return records.unionByName(_entries(rows, order).select("type", "value", F.col(order).cast("long").alias("node")))


def resolve(store: DataFrame, rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """``(node, root)`` for each row, by its ``order``, and ``(node, root, other)`` for each identifier that leads a row
    to another start than its own.  A root below 0 is the record -1 - root, any other the first row of a new record.

    ``order`` is a whole number from 0 on that no two rows share; rows without identifiers, a null or a repeated order
    are an error.
    """
    bad = rows.agg(F.count("*").alias("n"), F.count_distinct(order).alias("d"), F.min(order).alias("least"), F.count(F.when(F.coalesce(F.size(F.flatten(F.map_values("identifiers"))), F.lit(0)) <= 0, 1)).alias("bare")).first()
    if bad["n"] != bad["d"] or bad["n"] and bad["least"] < 0:
        raise ValueError(f"{order} must be a number from 0 on that no two rows share")
    if bad["bare"]:
        raise ValueError(f"{bad['bare']} rows have no identifier")
    nodes = settled(_nodes(store, rows, order))
    holders = settled(nodes.groupBy("type", "value").agg(F.min("node").alias("first")))
    edges = settled(nodes.join(holders, ["type", "value"]).filter("node <> first").select("node", "first").distinct())
    up = settled(rows.select(F.col(order).cast("long").alias("node")).join(edges.groupBy("node").agg(F.min("first").alias("first")), "node", "left").select("node", F.coalesce("first", "node").alias("root")))
    moved = True
    while moved:
        seen, above = Observation(), up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        stepped = up.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        up = settled(stepped.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("n")).drop("moved"))
        moved = seen.get["n"] > 0
    mine = edges.join(up, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    other = mine.join(up.select(F.col("node").alias("first"), F.col("root").alias("theirs")), "first", "left").withColumn("other", F.coalesce("theirs", "first"))
    return up, other.filter("root <> other").select("node", "root", "other").distinct()


def conflicts(store: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """``(order, record_ids, first_rows)``: the rows whose identifiers belong to several records, with the old records
    and the first rows of the new ones.  A row behind another conflict of its records is judged as if that row had
    joined the record of its earliest holder."""
    apart = resolve(store, rows, order)[1].filter("node >= 0")
    flat = apart.select("node", F.explode(F.array("root", "other")).alias("root")).distinct()
    ids, firsts = F.collect_list(F.when(F.col("root") < 0, -1 - F.col("root"))), F.collect_list(F.when(F.col("root") >= 0, F.col("root")))
    return flat.groupBy(F.col("node").alias(order)).agg(F.array_sort(ids).alias("record_ids"), F.array_sort(firsts).alias("first_rows"))


def _folded(rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """``(root, identifiers, <fields>)`` of ``rows(root, at, identifiers, <fields>)``, folded in the order of ``at``."""
    ids = rows.select("root", F.explode("identifiers").alias("type", "values")).select("root", "type", F.explode("values").alias("value")).distinct()
    lists = ids.groupBy("root", "type").agg(F.sort_array(F.collect_list("value")).alias("values"))
    out = lists.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "values")))).alias("identifiers"))
    plain, given = [], {f: F.col(f"`{f}`") for f in fields}
    for f, kind in fields.items():
        c = given[f]
        known = F.when(c.isNotNull(), F.col("at"))
        if kind in ("strict", "strict_case_insensitive"):
            text = F.lower(c.cast("string")) if kind.endswith("insensitive") else c
            clash = F.raise_error(F.concat(F.lit(f"{f}: "), F.min(text).cast("string"), F.lit(" and "), F.max(text).cast("string")))
            plain.append(F.when(F.min(text) != F.max(text), clash).otherwise(F.min_by(c, known)).alias(f))
        elif kind in ("first_seen", "replace"):
            plain.append((F.min_by if kind == "first_seen" else F.max_by)(c, known).alias(f))
    if plain:
        out = out.join(rows.groupBy("root").agg(*plain), "root")
    for f, kind in fields.items():
        c, some = given[f], rows.filter(given[f].isNotNull())
        if kind == "append":
            both = some.groupBy("root").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", c.alias("v")))), lambda x: x.v)).alias(f))
            out = out.join(both, "root", "left")
        elif kind == "set_union":
            each = some.select("root", "at", F.posexplode_outer(c).alias("pos", "v")).groupBy("root", "v").agg(F.min(F.struct("at", "pos")).alias("x"))
            kept = F.filter(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda x: x.x.pos.isNotNull())
            out = out.join(each.groupBy("root").agg(F.transform(kept, lambda x: x.v).alias(f)), "root", "left")
    return out.select("root", "identifiers", *(F.col(f"`{f}`") for f in fields))


def upsert(store: DataFrame, rows: DataFrame, fields: Mapping[str, str], order: str | None = None, next_id: int | None = None) -> DataFrame:
    """The store with ``rows(identifiers, <fields>)`` merged in; ``fields`` gives each field's policy.

    With ``order``, a column of whole numbers from 0 on that no two rows share, the rows are taken in that order, and
    rows of one batch that share identifiers become one record; every row counts, also a repeated one.  Without it, equal
    rows count once, and other rows that lead to one record are a conflict, as no order is known in which to fold them.
    A null field says nothing.  New records get ids from ``next_id`` on (behind the highest, if that is higher or nothing
    is given) in the order of their first rows.  Rows without identifiers are an error; empty rows leave the store as it is.
    """
    helpers = {"record_id", "identifiers", order}
    extra = (set(rows.columns) | set(store.columns)) - helpers - set(fields)
    if extra:
        raise ValueError(f"fields without a policy: {sorted(extra)}")
    unknown = set(fields.values()) - set(POLICIES)
    if unknown:
        raise ValueError(f"unknown merge policies: {sorted(unknown)}")
    top = max(store.agg(F.coalesce(F.max("record_id"), F.lit(0)).alias("m")).first()["m"] + 1, next_id or 1)
    if order is None:
        at = "_order"
        while at in fields:
            at = f"_{at}"
        rows = in_order(rows, at)
    else:
        at = order
    rows = settled(rows)
    roots, apart = resolve(store, rows, at)
    if not apart.isEmpty():
        some = [r["node"] for r in apart.select("node").distinct().orderBy("node").limit(5).collect()]
        raise ConflictError(f"identifiers of one row belong to several records, first in rows {some}")
    if order is None and not roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ConflictError("several rows lead to one record, and no order is given")
    named = [F.col(f"`{f}`") for f in fields]
    fresh = rows.select(F.col(at).cast("long").alias("at"), "identifiers", *named).join(roots.withColumnRenamed("node", "at"), "at").select("root", "at", "identifiers", *named)
    touched = roots.filter("root < 0").select((-1 - F.col("root")).alias("record_id")).distinct()
    old = store.join(touched, "record_id").select((-1 - F.col("record_id")).cast("long").alias("root"), F.lit(-1).cast("long").alias("at"), "identifiers", *named)
    folded = _folded(settled(old.unionByName(fresh)), fields)
    numbers = _numbered(roots.filter("root = node").select("root"), top)
    ids = F.when(F.col("root") < 0, -1 - F.col("root")).otherwise(F.col("record_id"))
    merged = folded.join(numbers, "root", "left").select(ids.cast("long").alias("record_id"), "identifiers", *named)
    return store.join(touched, "record_id", "left_anti").select(F.col("record_id").cast("long").alias("record_id"), "identifiers", *named).unionByName(merged)


def get(store: DataFrame, kind: str, value: str) -> DataFrame:
    """The records with an identifier."""
    return store.filter(F.array_contains(F.try_element_at("identifiers", F.lit(kind)), value))


def delete(store: DataFrame, record_ids: DataFrame) -> DataFrame:
    return store.join(record_ids.select("record_id"), "record_id", "left_anti")


def problems(store: DataFrame) -> DataFrame:
    """``(record_id, problem)``: ids or identifiers that stand twice, and records without identifiers."""
    ids = store.groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1").select("record_id", F.lit("duplicate record id").alias("problem"))
    shared = _entries(store, "record_id").groupBy("type", "value").agg(F.count_distinct("record_id").alias("n"), F.min("record_id").alias("record_id")).filter("n > 1")
    bare = store.filter(F.coalesce(F.size("identifiers"), F.lit(0)) <= 0).select("record_id", F.lit("no identifiers").alias("problem"))
    return ids.unionByName(shared.select("record_id", F.lit("shared identifier").alias("problem"))).unionByName(bare)


def read_store(spark, path: str, fields: str) -> DataFrame:
    """A JSON store ``{format_version: 1, records: [{record_id, identifiers, data}]}``; ``fields`` is the data's
    schema.  Another version is an error."""
    schema = f"format_version int, next_record_id long, records array<struct<record_id:long,identifiers:{IDENTIFIERS},data:struct<{fields}>>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    version = F.col("format_version")
    checked = whole.withColumn("records", F.when(version == 1, F.col("records")).otherwise(F.raise_error(F.concat(F.lit("format version "), F.coalesce(version.cast("string"), F.lit("missing"))))))
    return checked.select(F.explode("records").alias("r")).select("r.record_id", "r.identifiers", "r.data.*")
