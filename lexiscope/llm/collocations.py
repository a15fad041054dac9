"""Phrases whose words stand together more often than their parts would by chance, mined with suffix arrays.

Texts are encoded once into shards: the word ids of many texts of one language, with breaks between pieces.  The
suffix array of a shard is built by prefix doubling to the longest phrase; runs of suffixes with a common prefix of n
words (its LCP intervals) are the shard's n-grams and their counts, which are then summed by key over all shards.

The order goes up one word at a time.  An n-gram that occurs ``least`` times has only parts that do, so before the
shards are counted for n words, their places whose parts are too rare become breaks.  Which parts are frequent is told
by a bit table of hashes of fixed size; it may let a rare one through, which costs a row and changes no result.  A
word is keyed by a 64-bit hash of language and word; before it is used, the keys of frequent words are checked
to be nobody else's, and another salt is taken if they aren't.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.llm.runtime import by_value, discard, materialize

by_value(__name__)

#: Bytes of text in a shard, about; hash bits of the broadcast table, at most and for each frequent n-gram; salts tried;
#: parts in which a language's phrases are ranked first.
SHARD, MOST_BITS, BITS_EACH, SALTS, PARTS = 2_000_000, 1 << 28, 16, 8, 64
_BREAK = b"\xff"  # never in UTF-8
_CLASSES = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def encode(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of some texts, and the place of each word in that list; -1 stands between pieces and texts."""
    words = _BREAK.join(texts).translate(_CLASSES).replace(_BREAK, b" \xff ").split()
    known: dict[bytes, int] = defaultdict(numbers().__next__)
    known[_BREAK]  # noqa: B018  it gets the first number
    ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return list(known)[1:], ids - 1


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin with a word, in the order of their first ``depth`` words, and with how many words (at
    most ``depth``) each agrees with the one before it.  A suffix ends at the next break."""
    size, width = len(ids), 1
    rank = ids.astype(np.int64) + 1  # 0 is a break or the end, below any word
    order = np.argsort(rank, kind="stable")
    while width < depth:
        then = np.zeros(size, np.int64)
        then[: max(0, size - width)] = rank[width:]
        pair = np.where(rank > 0, rank * (rank.max(initial=0) + 1) + then, 0)
        order = np.argsort(pair, kind="stable")
        in_order = pair[order]
        after = np.empty(size, np.int64)
        after[order] = np.cumsum(np.diff(in_order, prepend=in_order[:1]) != 0) + 1
        rank = np.where(rank > 0, after, 0)
        width *= 2
    suffixes = order[np.count_nonzero(rank == 0) :]
    agree, padded = np.zeros(len(suffixes), np.int64), np.append(ids, np.full(depth, -1, ids.dtype))
    inside, alike = np.ones(len(suffixes), bool), np.ones(max(0, len(suffixes) - 1), bool)
    for k in range(depth):
        word = padded[suffixes + k]
        inside &= word >= 0
        alike &= (word[1:] == word[:-1]) & inside[1:] & inside[:-1]
        agree[1:] += alike
    return suffixes, agree


def intervals(ids: np.ndarray, n: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of all n-grams (among ``starts``, if given), those of one n-gram together, and where in them each
    distinct n-gram begins: the suffix array's LCP intervals of depth ``n``."""
    suffixes, agree = suffix_array(ids, n)
    padded = np.append(ids, np.full(n, -1, ids.dtype))
    full = np.ones(len(suffixes), bool) if starts is None else starts[suffixes]
    for k in range(1, n):
        full &= padded[suffixes + k] >= 0
    interval = np.cumsum(agree < n)[full]
    return suffixes[full], np.flatnonzero(np.diff(interval, prepend=-1))


def folded(keys: list) -> np.ndarray | Column:
    """One 64-bit hash of the keys of an n-gram's words, which are hashes themselves; on columns or on arrays."""
    h = keys[0]
    for key in keys[1:]:
        if isinstance(h, Column):
            h = F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43)).bitwiseXOR(key)
        else:
            h = ((h << np.uint64(21)) | (h >> np.uint64(43))) ^ key
    return h


def word_key(lang: Column, word: Column, salt: int) -> Column:
    """The key of a word: xxHash64 of the word, seeded by that of salt and language."""
    return F.xxhash64(F.concat(F.lit(f"{salt}:"), lang), word)


def _keys(lang: str, words: list[bytes], salt: int) -> np.ndarray:
    """``word_key`` of many words of one language."""
    seed = xxhash.xxh64_intdigest(f"{salt}:{lang}".encode(), 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _shards(docs: DataFrame, salt: int) -> DataFrame:
    """``(lang, words array<string>, counts array<long>, keys binary, ids binary)`` of ``docs(lang, text)``, written."""

    def run(batches):
        held: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)

        def shard(lang: str) -> pa.RecordBatch:
            words, ids = encode(held.pop(lang))
            del sizes[lang]
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            packed = [pa.array([lang], pa.string()), pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
            packed += [pa.array([x], pa.binary()) for x in (_keys(lang, words, salt).tobytes(), zlib.compress(ids.tobytes(), 1))]
            return pa.RecordBatch.from_arrays(packed, ["lang", "words", "counts", "keys", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    held[lang].append(text)
                    sizes[lang] += len(text)
                    if sizes[lang] >= SHARD or sum(sizes.values()) >= 4 * SHARD:
                        yield shard(max(sizes, key=sizes.get))
        for lang in list(held):
            yield shard(lang)

    return materialize(docs.select("lang", "text").mapInArrow(run, "lang string, words array<string>, counts array<long>, keys binary, ids binary"), "shards")


def _bits(frequent: DataFrame, n: int) -> np.ndarray:
    """A table of bits in which those of the n-grams' hashes are set, of at most MOST_BITS / 64 numbers."""
    rows, size = frequent.count(), 1 << 16
    while size < min(MOST_BITS, rows * BITS_EACH):
        size *= 2
    bit = F.pmod(folded([F.col(f"w{k}") for k in range(1, n + 1)]), F.lit(size))
    told = frequent.select(F.floor(bit / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits"))
    table = np.zeros(size // 64, np.int64)
    for batch in told.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.view(np.uint64)


def _hits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of some hashes are set."""
    bit = hashes % np.uint64(len(table) * 64)
    return (table[(bit // np.uint64(64)).astype(np.int64)] >> (bit % np.uint64(64))) & np.uint64(1) > 0


def _counted(shards: DataFrame, tables: dict, n: int) -> DataFrame:
    """``(w1..wn, a)``: the n-grams of all shards whose parts may be frequent, by the bit ``tables`` of the shorter
    ones, and their counts."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                keys, ids, starts = np.frombuffer(batch.column(0)[at].as_py(), np.uint64), np.frombuffer(zlib.decompress(batch.column(1)[at].as_py()), np.int32), None
                ids = np.where(np.append(_hits(tables[1].value, keys), False)[ids], ids, -1)
                if n > 2:  # an n-gram starts where a frequent (n-1)-gram does, and another one word later
                    places, begins = intervals(ids, n - 1)
                    first = places[begins]
                    hits = _hits(tables[n - 1].value, folded([keys[ids[first + k]] for k in range(n - 1)]))
                    part = np.zeros(len(ids) + 1, bool)
                    part[places] = np.repeat(hits, np.diff(np.append(begins, len(places))))
                    starts, covered = part[:-1] & part[1:], np.zeros(len(ids) + n, bool)
                    for k in range(n):
                        covered[k : k + len(ids)] |= starts
                    ids = np.where(covered[: len(ids)], ids, -1)
                places, begins = intervals(ids, n, starts)
                first = places[begins]
                counts = np.diff(np.append(begins, len(places)))
                columns = [pa.array(keys[ids[first + k]].view(np.int64)) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*_words(1, n), "a"])

    kinds = ", ".join(f"{w} long" for w in [*_words(1, n), "a"])
    return shards.select("keys", "ids").mapInArrow(run, kinds).groupBy(*_words(1, n)).agg(F.sum("a").alias("a"))


def _words(first: int, last: int) -> list[str]:
    return [f"w{k}" for k in range(first, last + 1)]


def _scored(grams: dict[int, DataFrame], n: int) -> DataFrame:
    """``(lang, phrase, a, l, r, score, w1..wn)`` of the frequent phrases of ``n`` words, by their worst cut."""
    out = grams[n]
    for k in range(1, n + 1):
        names = {"w1": f"w{k}", "a": f"f{k}_{k}", "word": f"t{k}"}
        out = out.join(grams[1].select(*(F.col(c).alias(names[c]) for c in names), *(["lang"] if k == 1 else [])), f"w{k}")
    for first, last in sorted({(1, k) for k in range(2, n)} | {(k, n) for k in range(2, n)}):
        part = grams[last - first + 1]
        out = out.join(part.select(*(F.col(f"w{k}").alias(f"w{first + k - 1}") for k in range(1, last - first + 2)), F.col("a").alias(f"f{first}_{last}")), _words(first, last))
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: int) -> Column:
        left, right, a = F.col(f"f1_{k}"), F.col(f"f{k + 1}_{n}"), F.col("a")
        score = F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    worst = F.array_min(F.array(*(cut(k) for k in range(1, n))))
    return out.withColumn("worst", worst).select("lang", F.concat_ws(" ", *(f"t{k}" for k in range(1, n + 1))).alias("phrase"), "a", "worst.l", "worst.r", "worst.score", *_words(1, n))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, covered: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``most`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased; texts fall into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs.  A
    phrase that stands ``least`` times (a) within pieces is cut where floor(10^6 a^2 / (l r)) is lowest, l and r being
    the counts of its two parts; ties go to the first cut.  Phrases inside a longer one that stands at least ``covered``
    per cent as often are dropped.  Order: score, a, both descending, then the phrase in UTF-8.  n is the number of all
    words of the language.  Null texts are empty, a null language is ``und``; repeated rows count as often as they
    stand; an empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    spark = docs.sparkSession
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for salt in range(SALTS):
        shards = _shards(narrow, salt)
        flat = shards.select(F.col("lang"), F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("word", "n"))
        words = materialize(flat.groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
        key = word_key(F.col("lang"), F.col("word"), salt)
        shared = words.groupBy(key.alias("w1")).agg(F.count("*").alias("n"), F.max("a").alias("a")).filter((F.col("n") > 1) & (F.col("a") >= least))
        if shared.isEmpty():
            break
        discard(shards, words)
    else:
        raise ValueError(f"frequent words share 64-bit keys under each of {SALTS} salts")
    grams = {1: materialize(words.filter(F.col("a") >= least).select(key.alias("w1"), "lang", "word", "a"), "grams-1")}
    tables = {}
    for n in range(2, longest + 1):
        tables[n - 1] = spark.sparkContext.broadcast(_bits(grams[n - 1], n - 1))
        grams[n] = materialize(_counted(shards, tables, n).filter(F.col("a") >= least), f"grams-{n}")
    found = None
    for n in range(2, longest + 1):
        scored = _scored(grams, n)
        inside = None
        for longer in range(n + 1, longest + 1):
            for shift in range(longer - n + 1):
                part = grams[longer].select(*(F.col(f"w{k + shift}").alias(f"w{k}") for k in range(1, n + 1)), F.col("a").alias("above"))
                inside = part if inside is None else inside.unionByName(part)
        if inside is not None:
            above = inside.groupBy(*_words(1, n)).agg(F.max("above").alias("above"))
            scored = scored.join(above, _words(1, n), "left").filter(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * covered))
        scored = scored.select("lang", "phrase", "a", "l", "r", "score")
        found = scored if found is None else found.unionByName(scored)
    sizes = words.groupBy("lang").agg(F.sum("a").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The first of a language are among the first of each of its parts, so no task sorts all of them.
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    best = materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(shards, words, *grams.values())
    return best
