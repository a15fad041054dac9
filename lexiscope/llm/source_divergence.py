"""Divergence between the sources of each language, in every direction, and the terms that set a source apart.

A group is one (lang, source).  Its vector over the language's kept terms is cut into blocks of about ``BLOCK`` terms
and held compressed: places in the block and smoothed shares of the terms that occur; all others have one common share.
The groups of a language play a round-robin tournament by the circle method.  A block of a group stays in one
partition, and its opponents' blocks arrive there in the order of the rounds; each meeting is evaluated in both
directions, so a vector travels to about half of its opponents only.  The language's own vector comes first, and a
heap keeps the terms that diverge most from it.  A task holds one resident block, one arriving batch and one heap,
whatever the number of groups and terms.
"""

from __future__ import annotations

import zlib
from collections import Counter
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.llm.runtime import by_value, discard, materialize

by_value(__name__)

#: Terms of a block, about; (group, term) pairs that a task counts, and meetings that it sums up, before it hands them on.
BLOCK, HELD, MEETINGS = 4096, 400_000, 100_000
#: Places of the rows before the first round: the resident itself, and the language.
RESIDENT, LANGUAGE = -2, -1
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, of a text in UTF-8."""
    return text.translate(_LETTERS).split()


def group_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` of ``docs(lang, source, text)``: occurrences and rows that hold the term."""

    def count(batches):
        n: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def told():
            for (lang, source), found in n.items():
                terms = list(found)
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([held[lang, source][t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    terms, key = terms_of(text), (lang, source)
                    found = n.setdefault(key, Counter())
                    size -= len(found)
                    found.update(terms)
                    size += len(found)
                    held.setdefault(key, Counter()).update(set(terms))
                    if size > HELD:
                        yield from told()
                        n.clear()
                        held.clear()
                        size = 0
        yield from told()

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in decimals; 0 where a language has no kept term."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    whole = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(n) + 1), F.nullif(wide(total) + wide(terms), F.lit(0).cast("decimal(20,0)")))
    return F.coalesce(whole + 1, F.lit(0)).cast("int")


def opponent(seat: Column, turn: Column, seats: Column) -> Column:
    """Whom a seat meets in a round of the circle method with an even number of seats."""
    last = seats - 1
    other = F.pmod(turn * 2 - seat, last)
    return F.when(seat == last, turn).when(seat == turn, last).otherwise(other)


def is_host(seat: Column, other: Column) -> Column:
    """Which of two opponents stays: each of them in about half of its meetings."""
    return F.when((seat + other) % 2 == 1, seat < other).otherwise(seat > other)


def _pack(blocks: DataFrame) -> DataFrame:
    """The blocks with their lists of places and shares as compressed ``vector``."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                vectors = [zlib.compress(np.array(places, "<u4").tobytes() + np.array(shares, "<u4").tobytes(), 1) for places, shares in zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], part.column(7), pa.array(vectors, pa.binary())], ["lang", "seat", "block", "seats", "rest", "terms", "vector"])

    return blocks.mapInArrow(pack, "lang string, seat int, block int, seats int, rest int, terms array<string>, vector binary")


def _unpack(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(vector), "<u4").astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _play(top: int):
    """The tasks of the tournament; rows come sorted by language, host, block and round."""

    def play(batches):
        group, place, n, mine = None, None, 0, None
        resident: tuple = ()
        meetings: dict[tuple, int] = {}
        best: list[tuple] = []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            kinds = pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["lang", "seat", "other", "term", "value"])

        def settle(lang: str | None, host: int | None) -> pa.RecordBatch:
            rows = [(lang, a, b, None, value) for (a, b), value in meetings.items()] + [(lang, host, None, term, -value) for value, term in best]
            meetings.clear()
            best.clear()
            return told(rows)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if group != (row["lang"], row["host"]):
                        if group:
                            yield settle(*group)
                        group = row["lang"], row["host"]
                    if row["round"] == RESIDENT:
                        place, resident = row["block"], (*_unpack(row["vector"]), row["rest"], row["terms"])
                        continue
                    assert place == row["block"]
                    places, shares = _unpack(row["vector"])
                    if row["round"] == LANGUAGE:  # it holds every term of the block
                        n, (own, p, rest, terms) = len(places), resident
                        mine = np.full(n, rest, np.int64)
                        mine[own] = p
                        language = np.empty(n, np.int64)
                        language[places] = shares
                        q = language[own]
                        value = np.where(p > q, _divergence(p, q), -1)
                        least = -best[-1][0] if len(best) >= top else 0
                        near = np.flatnonzero((value >= least) & (p > q))
                        best[:] = nsmallest(top, [*best, *((-int(value[i]), terms[i]) for i in near)])
                        continue
                    other = np.full(n, row["rest"], np.int64)
                    other[places] = shares
                    for key, value in (((row["host"], row["seat"]), _divergence(mine, other)), ((row["seat"], row["host"]), _divergence(other, mine))):
                        meetings[key] = meetings.get(key, 0) + int(value.sum())
                    if len(meetings) > MEETINGS:
                        yield told([(row["lang"], a, b, None, value) for (a, b), value in meetings.items()])
                        meetings.clear()
        if group:
            yield settle(*group)

    return play


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has every other source of the language by the summed
    divergence of ``source`` from it, part ``term`` the ``top`` terms in which ``source`` stands out of its language.

    A language keeps the terms that stand in ``least_docs`` of its rows.  With p = 1 + floor(10^9 (n + 1) / (N + V)) for
    each of the V kept terms, the divergence of p from q is floor((p - q)^2 / q), all in whole numbers.  Null texts,
    languages and sources are empty strings, which form groups like any other.  Repeated rows count as so many
    documents.  Groups without terms take part with equal shares; in a language without kept terms all values are 0.
    Ties are ordered by item in UTF-8.  A language with one source has no pairs; an empty table gives no rows.  Other
    columns, whatever their names, are not read.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    narrow = docs.select(*named)
    term, cell = W.partitionBy("lang", "term"), W.partitionBy("lang", "block").orderBy("term")
    known = group_counts(narrow).withColumns({"held": F.sum("docs").over(term), "total": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    kept = materialize(known.filter(F.col("held") >= least_docs).select("lang", "source", "term", "n", "total", "first"), "kept-terms")

    sizes = kept.filter("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("size"))
    seated = narrow.select("lang", "source").distinct().withColumns({"seat": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1, "seats": F.count("*").over(W.partitionBy("lang"))})
    seated = seated.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = materialize(seated.select("lang", "source", F.col("seat").cast("int").alias("seat"), F.col("seats").cast("int").alias("seats"), zero("own"), zero("v"), zero("size")), "groups")

    # The language is one more vector, with seat -1.
    both = groups.select("lang", "source", "seat", "seats", "own", "v").unionByName(groups.filter("seat = 0").select("lang", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("seat"), "seats", F.col("size").alias("own"), "v"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int")
    of_groups = kept.join(groups.select("lang", "source", "seat", "own", "v"), ["lang", "source"]).select("lang", "seat", "term", "n", "own", "v")
    of_languages = kept.filter("first").join(groups.filter("seat = 0").select("lang", "size", "v"), "lang").select("lang", F.lit(-1).alias("seat"), "term", F.col("total").alias("n"), F.col("size").alias("own"), "v")
    entries = of_groups.unionByName(of_languages).withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    placed = entries.select("lang", "seat", "block", F.struct((F.dense_rank().over(cell) - 1).alias("place"), share("n", "own", "v").alias("p"), "term").alias("e"))
    filled = placed.groupBy("lang", "seat", "block").agg(F.array_sort(F.collect_list("e")).alias("e"))
    every = both.select("lang", "seat", "seats", share(F.lit(0), "own", "v").alias("rest"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    whole = every.join(filled, ["lang", "seat", "block"], "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<place:int,p:int,term:string>>")))
    terms = F.when(F.col("seat") >= 0, F.col("e.term")).otherwise(F.array().cast("array<string>"))
    packed = materialize(_pack(whole.select("lang", "seat", "block", "seats", "rest", F.col("e.place").alias("places"), F.col("e.p").alias("shares"), terms.alias("terms"))), "group-vectors")

    no_terms = F.array().cast("array<string>").alias("terms")
    row = lambda host, turn, terms: [F.col("lang"), host.cast("int").alias("host"), F.col("block"), turn.cast("int").alias("round"), F.col("seat"), F.col("rest"), F.col("vector"), terms]
    residents = packed.filter("seat >= 0").select(*row(F.col("seat"), F.lit(RESIDENT), F.col("terms")))
    languages = packed.filter("seat < 0").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("seats") - 1))).select(*row(F.col("to"), F.lit(LANGUAGE), no_terms))
    even = F.col("seats") + F.col("seats") % 2
    travels = packed.filter("seat >= 0 AND seats > 1").withColumn("round", F.explode(F.sequence(F.lit(0), even - 2))).withColumn("to", opponent(F.col("seat"), F.col("round"), even))
    peers = travels.filter((F.col("to") < F.col("seats")) & is_host(F.col("to"), F.col("seat"))).select(*row(F.col("to"), F.col("round"), no_terms))
    rounds = residents.unionByName(languages).unionByName(peers).repartition("lang", "host", "block").sortWithinPartitions("lang", "host", "block", "round")
    met = materialize(rounds.mapInArrow(_play(top), "lang string, seat int, other int, term string, value long"), "meetings")
    discard(kept, packed)

    names = groups.select("lang", "seat", "source")
    pairs = met.filter("other IS NOT NULL").groupBy("lang", "seat", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(names, ["lang", "seat"]).join(names.select("lang", F.col("seat").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    singles = met.filter("term IS NOT NULL").join(names, ["lang", "seat"])
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(singles.withColumn("item", F.col("term")), "term").filter(F.col("rank") <= top))
