"""Token counts of whole texts for a byte-level BPE tokenizer file.

Byte-level BPE never merges across pre-tokens, so a text's token count is the sum over its distinct
pre-tokens of frequency times number of pieces.  A first pass counts the pre-tokens of all texts (combined per
task before they are shuffled) into one corpus-wide table, in which the pieces of each distinct pre-token are counted
once.  A second pass makes each document's pre-token frequencies and joins them with that table: the ``FREQUENT``
most frequent pre-tokens, a table of bounded size, are broadcast; all others, which are few in any one text, leave
the pass as (document, pre-token, frequency) rows and are joined by shuffle.  No ids are made for documents.  A rare
pre-token can't be a hot key: one outside the broadcast table occurs in less than a FREQUENT-th of all places.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.runtime import by_value, discard, materialize

by_value(__name__)

#: The byte-level pre-token pattern (a fixed value of that tokenizer family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these ranges may be classed by another Unicode version in the tokenizers library;
#: texts that hold one are cut by the library itself.
UNSURE = r"[^\u0000-\u052f\u2000-\u206f\u20a0-\ua7cd]"
#: Pre-tokens in the broadcast table, characters of the longest one there, and pre-tokens that a task of the first
#: pass counts before it hands them on.
FREQUENT, LONGEST, HELD = 300_000, 64, 300_000


class PieceCounter:
    """Counts tokens as ``encode(text, add_special_tokens=False)`` of the tokenizers library would."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.whole.no_truncation()
        self.whole.no_padding()
        told = json.loads(definition)
        kind = told.get("pre_tokenizer") or {}
        self.plain = (
            told.get("normalizer") is None
            and kind.get("type") == "ByteLevel"
            and not kind.get("add_prefix_space")
            and kind.get("use_regex", True)
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told.get("added_tokens", []))
        )
        added = sorted((t["content"] for t in told.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cut, self.unsure = regex.compile(PATTERN), regex.compile(UNSURE)

    def pretokens(self, text: str) -> list[str]:
        if self.unsure.search(text):
            return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut.findall(text)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """A text's pre-token frequencies, and how many added tokens (special strings) stand in it."""
        if self.added is None:
            return Counter(self.pretokens(text)), 0
        parts = self.added.split(text)
        if len(parts) == 1:
            return Counter(self.pretokens(text)), 0
        found: Counter = Counter()
        for part in parts:
            found.update(self.pretokens(part))
        return found, len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        """Number of pieces of each pre-token."""
        return [len(x.ids) for x in self.whole.encode_batch(pretokens, add_special_tokens=False)]


def pretoken_table(narrow: DataFrame, definition) -> DataFrame:
    """``(pretoken, n, pieces)``, written: how often each pre-token stands in all texts, and its number of pieces."""

    def count(batches):
        cutter, found = PieceCounter(definition.value), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                found.update(cutter.frequencies(text)[0])
                if len(found) > HELD:
                    yield told()
                    found.clear()
        yield told()

    def segment(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter.pieces(part.column(0).to_pylist()), pa.int32())], ["pretoken", "n", "pieces"])

    counted = narrow.mapInArrow(count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return materialize(counted.mapInArrow(segment, "pretoken string, n long, pieces int"), "pretokens")


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent of the pre-tokens that aren't very long, about: those above a count that at most
    so many reach."""
    short = table.filter(F.length("pretoken") <= LONGEST)
    counts = short.groupBy("n").agg(F.count("*").alias("k"))
    # One row per distinct count, of which there are few; the running sum is over those.
    least = counts.orderBy(F.desc("n")).limit(1 << 16).toPandas()
    reached = least[least["k"].cumsum() <= most]["n"]
    return short.filter(F.col("n") >= (int(reached.min()) if len(reached) else 1 << 62)).select("pretoken", "pieces")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``tokenizer_path`` is a tokenizer.json that the driver can read; its content (a file of fixed size) is
    broadcast, and so are ``frequent`` pre-tokens at most.  Null and empty texts have zero bytes and tokens; special
    strings inside a text count as the library counts them; repeated rows come out repeated; an empty table gives no
    rows.  Other columns are not read.  With a tokenizer of another kind pieces may cross pre-tokens, and the library
    counts whole texts.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        told = f.read()
    definition = spark.sparkContext.broadcast(told)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def whole(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counter.pieces(part.column(1).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    if not PieceCounter(told).plain:
        counted = narrow.mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")
        return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

    table = pretoken_table(narrow, definition)
    known = spark.sparkContext.broadcast({r["pretoken"]: r["pieces"] for r in _frequent(table, frequent).toLocalIterator()})

    def look_up(batches):
        from pyspark import TaskContext

        cutter, pieces = PieceCounter(definition.value), known.value
        row = TaskContext.get().partitionId() << 40  # numbers of this pass, which is written once
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, rare = [], []
                for text in part.column(1).to_pylist():
                    frequencies, n = cutter.frequencies(text)
                    rest = []
                    for pretoken, times in frequencies.items():
                        got = pieces.get(pretoken)
                        if got is None:
                            rest.append({"pretoken": pretoken, "times": times})
                        else:
                            n += got * times
                    counts.append(n)
                    rare.append(rest)
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                kind = pa.list_(pa.struct([("pretoken", pa.string()), ("times", pa.int64())]))
                yield pa.RecordBatch.from_arrays([rows, part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(rare, kind)], ["row", "doc_id", "n_bytes", "n", "rare"])

    passed = narrow.mapInArrow(look_up, "row long, doc_id long, n_bytes long, n long, rare array<struct<pretoken:string,times:bigint>>")
    passed = materialize(passed, "frequencies")
    rare = passed.select("row", F.inline("rare")).join(table.select("pretoken", "pieces"), "pretoken")
    more = materialize(rare.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more")), "rare-counts")
    discard(table)
    n = F.col("n") + F.coalesce("more", F.lit(0))
    out = passed.select("row", "doc_id", "n_bytes", "n").join(more, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
