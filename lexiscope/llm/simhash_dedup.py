"""SimHash near-dedup by anchor-point covering.

Anchors are the pairs of codewords of two perfect binary Golay codes [23, 12], laid over the low 46 bits of
the fingerprint: the balls of radius 3 around the codewords tile each 23-bit half, so every fingerprint has
exactly one *home* anchor.  A fingerprint is replicated to every anchor within covering radius plus
threshold, the threshold being shared between the halves (excess over 3 in the first half plus excess in
the second is at most the threshold).  If two fingerprints differ in at most ``threshold`` bits, the home
anchor of either one is among the anchors of the other, so comparing the home members of an anchor with all
its members misses no link.

Only distinct fingerprints are replicated (about 61 rows each at threshold 2), so copies of a document,
however many, are one row.  Within an anchor a union-find keeps a spanning forest instead of all pairs: what
leaves an anchor is at most one edge per member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.graph import connected_components
from lexiscope.llm.runtime import by_value, discard, hashes, materialize, own, unused

by_value(__name__)

SHINGLE_WORDS, SEED, BITS = 3, 42, 64
HALF, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1 (a fixed value).
GOLAY = 0xAE3


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - SHINGLE_WORDS])).tolist()
        stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, stops)]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, fp)`` for every row, and the long columns ``more``; ``fp`` is the fingerprint as a signed long."""
    names = ["doc_id", *(more or {}), "fp"]

    def run(batches):
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column(batch.num_columns - 1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(name) for name, c in (more or {}).items()), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, ", ".join(f"{name} long" for name in names))


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(HALF - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


class Covering:
    """For each syndrome of the Golay code, the error patterns by excess weight over the covering radius."""

    def __init__(self, threshold: int):
        patterns, weights = [], []
        for weight in range(RADIUS + threshold + 1):
            for bits in combinations(range(HALF), weight):
                patterns.append(sum(1 << b for b in bits))
                weights.append(weight)
        found = np.array(patterns, np.int64)
        excess = np.maximum(0, np.array(weights) - RADIUS)
        syndrome = _syndromes(found)
        order = np.lexsort((found, excess, syndrome))
        self.threshold, self.patterns = threshold, found[order]
        counts = np.zeros((threshold + 1, 1 << 11), np.int64)
        for e in range(threshold + 1):
            counts[e] = np.bincount(syndrome[excess == e], minlength=1 << 11)
        self.upto = np.vstack([np.zeros(1 << 11, np.int64), np.cumsum(counts, axis=0)])
        self.first = np.concatenate(([0], np.cumsum(self.upto[-1])[:-1]))

    def expand(self, syndrome: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``syndrome`` repeated for each pattern of excess low..high, and those patterns."""
        start = self.first[syndrome] + self.upto[low][syndrome]
        n = self.upto[high + 1][syndrome] - self.upto[low][syndrome]
        row = np.repeat(np.arange(len(syndrome)), n)
        return row, self.patterns[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors, and whether the anchor is the row's home."""
        mask = (1 << HALF) - 1
        first, second = (fps & np.uint64(mask)).astype(np.int64), (fps >> np.uint64(HALF) & np.uint64(mask)).astype(np.int64)
        s1, s2 = _syndromes(first), _syndromes(second)
        out = []
        for e in range(self.threshold + 1):
            row1, p1 = self.expand(s1, e, e)
            row2, p2 = self.expand(s2[row1], 0, self.threshold - e)
            row = row1[row2]
            one, two = first[row] ^ p1[row2], second[row] ^ p2
            #: A codeword's high 12 bits determine it.
            anchor = (one >> 11) << 12 | (two >> 11)
            home = (e == 0) & (np.bitwise_count(p2) <= RADIUS)
            out.append((row, anchor, home))
        return tuple(np.concatenate(x) for x in zip(*out))


def _forest(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges among rows of one anchor that differ in at most ``threshold`` bits, one of them
    at home there; rows come sorted by anchor, home first."""
    parent = np.arange(len(anchor))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    at, shift = np.flatnonzero(home), 0
    while len(at):
        shift += 1
        at = at[at + shift < len(anchor)]
        at = at[anchor[at] == anchor[at + shift]]
        hit = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= threshold]
        hit = hit[parent[hit] != parent[hit + shift]]
        for i in hit.tolist():
            x, y = find(i), find(i + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(i)
                right.append(i + shift)
        if len(hit):
            near = np.unique(np.concatenate([hit, hit + shift]))
            for i in near.tolist():
                parent[i] = find(i)
    return fp[np.array(left, np.int64)], fp[np.array(right, np.int64)]


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """``(a, b)``: links among the distinct ``fp`` that connect all that ``threshold`` bits connect.

    No fingerprints give no links.  Threshold 0 gives none, as equal fingerprints are one row already.
    """

    def replicate(batches):
        cover = Covering(threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                row, anchor, home = cover.anchors(fps)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fps[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches):
        held = None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on in the next batch
            if cut:
                a, b = _forest(*(x[:cut] for x in held), threshold)
                held = [x[cut:] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        if held is not None:
            a, b = _forest(*held, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    spread = distinct.select("fp").mapInArrow(replicate, "anchor int, fp long, home boolean")
    dealt = spread.repartition("anchor").sortWithinPartitions("anchor", F.desc("home"))
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included.  Null and blank texts have
    fingerprint zero and link like any other; repeated rows come out repeated; a null id is carried and is
    never a component's id unless all of the component's ids are null; an empty table gives no rows.  Other
    columns are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    table = fingerprint_groups(marked, threshold).select("fp", "component_id")
    return marked.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_groups(marked: DataFrame, threshold: int = 2) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct ``fp`` of ``marked(doc_id, fp)``; ``root`` is the group's
    smallest fingerprint, which unlike ``component_id`` is never null nor shared by two groups."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links(distinct, threshold), "a", "b").withColumnRenamed("node", "fp")
    joined = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.join(lowest, "root").select("fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the one with the smallest id, among those with that id
    the one with the smallest hashes.  A null id comes after all others.  Rows that share an id, or have none, are
    told apart by two hashes of the whole row, so texts that don't link all stay.  Of rows equal in all columns one
    stays.  Other columns come through, whatever they are called; an empty table gives no rows."""
    first, second = hashes(own(docs), [kind for _, kind in docs.dtypes])
    k1, k2 = unused(docs, "_k1", "_k2")
    marked = fingerprints(docs, id_col, text_col, {"_k1": first, "_k2": second}).distinct()
    marked = materialize(marked, "row-fingerprints")
    grouped = marked.join(fingerprint_groups(marked, threshold).select("fp", "root"), "fp")
    lowest = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")).alias("first"))
    kept = materialize(lowest.select(F.col("first._k1").alias(k1), F.col("first._k2").alias(k2)), "kept-rows")
    discard(marked)
    return docs.withColumns({k1: first, k2: second}).join(kept, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*own(docs))
