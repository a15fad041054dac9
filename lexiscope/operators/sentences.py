"""Sentence boundaries learned from the text itself, without labels (Kiss and Strunk, Computational Linguistics 32(4), 2006).

A full stop ends a sentence unless the word before it is an abbreviation, an initial or a number, and what follows
doesn't begin a sentence.  One aggregation counts every word together with what stands before it
(``context_counts``); all statistics follow from those counts:

    abbreviations   words whose full stops are too regular to be chance, by log-likelihood, length and inner stops
    collocations    pairs over a full stop that belong together
    starters        words that begin sentences more often than chance
    case            whether a word is seen in capitals or not, at the beginning and in the middle of sentences

A model is two tables.  A sentence ends at every possible boundary but those behind an ellipsis, an initial, a number or
an abbreviation that the model decides otherwise; only these few are joined with it, and back to their texts.

Tasks look for chunks and boundaries (``functions/chunks.py``) and count pairs of chunks between spaces, of which the
first is kept only if it may end a sentence; expressions that look into a word run on distinct words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.functions import chunks
from lexiscope.plans.storage import removed, written

SPACE = r"[ \t\n\x0B\f\r]"
DARK = r"[^ \t\n\x0B\f\r]"
OPENING = r"""^["'(\[{«“‘*]+"""
CLOSING = r"""["')\]}»”’*]"""
#: Marks a cut; it is no character, and a text that holds it loses it.
CUT = "\uffff"
NUMBER = "##number##"
#: Thresholds of the published method: score of abbreviations, log-likelihoods of collocations and starters, and the
#: least times that a pair and a starter are seen.
ABBREVIATION, COLLOCATION, STARTER, LEAST_PAIR, LEAST_STARTER = 0.3, 7.88, 30.0, 2, 5


@dataclass(frozen=True)
class SentenceModel:
    """``words(word, abbreviation, starter, upper_middle, upper, lower, lower_begin)`` and ``pairs(word, next)``."""

    words: DataFrame
    pairs: DataFrame

    def save(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        self.pairs.write.mode("overwrite").parquet(f"{path}/pairs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SentenceModel:
        return SentenceModel(spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/pairs"))


# --- words ------------------------------------------------------------------------------------------------


def core(chunk: Column) -> Column:
    """What stands between spaces, without quotes, brackets and commas around it."""
    return F.regexp_replace(F.regexp_replace(chunk, OPENING, ""), r"""["')\]}»”’*,;:]+$""", "")


def word(core: Column) -> Column:
    """Lower case without the stop; numbers are one word."""
    bare = F.regexp_replace(core, "[.!?]+$", "")
    return F.when(bare.rlike("^[+-]?[0-9][0-9.,]*$"), NUMBER).otherwise(F.lower(bare))


def case(core: Column) -> Column:
    """U or L by the first character, - if it has no case."""
    first = F.substring(core, 1, 1)
    return F.when(first.between("a", "z"), "L").when(first.between("A", "Z"), "U").when(core.rlike(r"^\p{Lu}"), "U").when(core.rlike(r"^\p{Ll}"), "L").otherwise("-")


def stop(chunk: Column, core: Column) -> Column:
    """How a chunk may end a sentence: ``!`` for ! and ?, ``e`` for an ellipsis, ``.`` and the word, ``-`` for not at all."""
    ended = ~chunk.rlike(f"[,;:]{CLOSING}*$")
    return F.when(ended & core.rlike("[!?]$"), "!").when(ended & core.rlike(r"\.\.$"), "e").when(ended & core.rlike(r"\.$"), F.concat(F.lit("."), word(core))).otherwise("-")


def context_counts(text: DataFrame, column: str = "text") -> DataFrame:
    """``(before, word, period, case, n)``: how often each word stands with and without a stop behind it, in capitals or
    not, behind what (empty at the beginning of a text; else the stop of the chunk before it)."""
    rows = text.select(F.col(column).cast("string").cast("binary").alias("text")).mapInArrow(chunks.pair_counts, "y binary, chunk binary, n bigint")
    pairs = rows.select(F.col("y").cast("string").alias("y"), F.col("chunk").cast("string").alias("chunk"), "n").groupBy("y", "chunk").agg(F.sum("n").alias("n"))
    # Letters with at most a stop or comma behind them, which most chunks are, need no stripping.
    y, plain = F.col("y"), F.col("plain")
    pairs = pairs.withColumn("plain", F.col("chunk").rlike(r"^\p{L}+[.,]?\z")).withColumn("y_plain", F.coalesce(y.rlike(r"^\p{L}+\.\z"), F.lit(True)) | (y == "-"))
    pairs = pairs.select("y", "y_plain", F.when(~F.col("y_plain"), core(y)).alias("y_core"), "plain", F.when(plain, F.col("chunk")).otherwise(core(F.col("chunk"))).alias("core"), "n")
    x = F.col("core")
    before = F.when(y.isNull(), "").when(y == "-", "-").when(F.col("y_plain"), F.concat(F.lit("."), F.lower(F.rtrim(y, F.lit("."))))).otherwise(stop(y, F.col("y_core")))
    told = F.when(plain, F.lower(F.rtrim(x, F.lit(".,")))).otherwise(word(x))
    period = F.when(plain, x.endswith(".")).otherwise(x.rlike(r"\.$"))
    return pairs.select(before.alias("before"), told.alias("word"), period.alias("period"), case(x).alias("case"), "n").groupBy("before", "word", "period", "case").agg(F.sum("n").alias("n"))


# --- statistics -------------------------------------------------------------------------------------------


def _times_log(n: Column, p: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(n * F.log(F.greatest(p, F.lit(1e-300))))


def _binomial(hits: Column, tries: Column, p: Column) -> Column:
    return _times_log(hits, p) + _times_log(tries - hits, 1 - p)


def abbreviation_score(with_stop: Column, without: Column, stops: Column, total: Column, text: Column) -> Column:
    """Log-likelihood that the word always has its stop against that of chance, damped by its length, raised by its
    inner stops, and damped for every time that it stands without a stop."""
    seen = with_stop + without
    likelihood = -2 * (_binomial(with_stop, seen, stops / total) - _binomial(with_stop, seen, F.lit(0.99)))
    inner = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    letters = F.length(text) - inner
    return likelihood * F.exp(-letters) * (inner + 1) * F.pow(letters, -without)


def pair_likelihood(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two events with counts ``a`` and ``b`` that occur together ``both`` times."""
    free = _binomial(both, a, b / total) + _binomial(b - both, total - a, b / total)
    bound = _binomial(both, a, both / a) + _binomial(b - both, total - a, F.when(total > a, (b - both) / (total - a)).otherwise(0.0))
    return -2 * (free - bound)


def _special(word: Column) -> Column:
    """Initials and numbers."""
    return ((F.length(word) <= 2) & word.rlike(r"^\p{L}$")) | (word == NUMBER)


def _lettered() -> Column:
    return F.col("word").rlike(r"\p{L}") & (F.col("word") != NUMBER)


def learn(text: DataFrame, column: str = "text") -> SentenceModel:
    """The model of all texts of a column.  Null and empty texts say nothing; no texts give empty tables."""
    counts = written(context_counts(text, column), "context-counts")
    n = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    stopped = n(F.col("period")).alias("with_stop"), n(~F.col("period")).alias("without")
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), n(F.col("period")).alias("stops")).first()
    total = F.lit(sizes["total"])
    score = abbreviation_score(F.col("with_stop"), F.col("without"), F.lit(sizes["stops"]), total, F.col("word"))
    abbreviation = (F.col("with_stop") > 0) & _lettered() & (score >= ABBREVIATION)
    short = written(counts.groupBy("word").agg(*stopped).filter(abbreviation).select(F.col("word").alias("left")), "abbreviations")

    # What stands before a word, now that abbreviations are known: a boundary, maybe one, or none.
    left = F.when(F.substring("before", 1, 1) == ".", F.expr("substring(before, 2)"))
    # No word holds a space, so rows without a word before the stop meet nothing, and are spread if the join is shuffled.
    met = counts.withColumn("left", left).withColumn("_at", F.coalesce("left", F.concat(F.lit(" "), F.col("word"))))
    placed = met.join(short.select(F.col("left").alias("_at"), F.lit(True).alias("known")), "_at", "left").drop("_at")
    doubtful = F.col("known") | _special(F.col("left"))
    place = F.when(F.col("before") == "-", "middle").when((F.col("before") == "e") | F.coalesce(doubtful, F.lit(False)), "unknown").otherwise("begin")
    placed = placed.withColumn("place", place)
    upper, lower = F.col("case") == "U", F.col("case") == "L"
    after_stop = (F.col("place") == "begin") & (F.col("before") != "")
    stats = placed.groupBy("word").agg(
        *stopped, F.sum("n").alias("seen"), F.max(upper & (F.col("place") == "middle")).alias("upper_middle"), F.max(upper).alias("upper"), F.max(lower).alias("lower"),
        F.max(lower & (F.col("place") == "begin")).alias("lower_begin"), n(after_stop).alias("begins"),
    )
    stats = written(stats, "word-counts")
    breaks = F.lit(stats.agg(F.sum("begins").alias("breaks")).first()["breaks"] or 0)
    starter = (F.col("begins") >= LEAST_STARTER) & _lettered() & (total * F.col("begins") > F.col("seen") * breaks) & (pair_likelihood(breaks, F.col("seen"), F.col("begins"), total) >= STARTER)
    model = stats.select("word", abbreviation.alias("abbreviation"), F.coalesce(starter, F.lit(False)).alias("starter"), "upper_middle", "upper", "lower", "lower_begin")
    model = written(model, "sentence-words")
    over = counts.filter(F.col("before").startswith(".")).withColumn("left", left).join(short.withColumn("known", F.lit(True)), "left", "left").filter(F.col("known") | _special(F.col("left"))).filter(_lettered()).groupBy("left", "word").agg(F.sum("n").alias("both"))
    over = written(over.filter(F.col("both") >= LEAST_PAIR), "pairs-over-stops")
    joined = over.join(stats.select("word", "seen"), "word").join(stats.select(F.col("word").alias("left"), F.col("seen").alias("left_seen")), "left")
    bound = (total * F.col("both") > F.col("left_seen") * F.col("seen")) & (pair_likelihood(F.col("left_seen"), F.col("seen"), F.col("both"), total) >= COLLOCATION)
    pairs = written(joined.filter(bound).select(F.col("left").alias("word"), F.col("word").alias("next")), "word-pairs")
    removed(counts, short, over, stats)
    return SentenceModel(model, pairs)


# --- decisions --------------------------------------------------------------------------------------------


def _cut(text: Column) -> Column:
    """The segments of a text: it is cut behind every stop and the spaces after it."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), CUT, ""), f"([.!?]{CLOSING}*{SPACE}+)", f"$1{CUT}")
    return F.filter(F.split(marked, CUT), lambda s: s != "")


def _last(segment: Column) -> Column:
    """The last chunk.  The expression sees only what stands behind the last blank, and starts at the beginning of a chunk
    and never goes back in it, so it is linear."""
    piece = F.substring_index(F.rtrim(segment, F.lit(" \t\n\x0B\f\r")), " ", -1)
    return F.regexp_extract(piece, f"(?<!{DARK})({DARK}++)$", 1)


def undecided(model: SentenceModel, around: DataFrame) -> DataFrame:
    """Those of the pairs ``(before, word, case)`` that don't end a sentence."""
    left = F.when(F.substring("before", 1, 1) == ".", F.expr("substring(before, 2)"))
    wanted = around.select(F.explode(F.array("word", left)).alias("word")).filter("word IS NOT NULL").distinct()
    words = written(model.words.join(wanted, "word", "left_semi"), "words-asked")
    flags = ("starter", "upper_middle", "upper", "lower", "lower_begin")
    known = words.select("word", *flags)
    rows = around.filter("before NOT IN ('!', '-')").withColumn("left", left).join(known, "word", "left").na.fill(False, list(flags))
    rows = rows.join(words.select(F.col("word").alias("left"), "abbreviation"), "left", "left").na.fill(False, ["abbreviation"])
    rows = rows.join(model.pairs.select(F.col("word").alias("left"), F.col("next").alias("word"), F.lit(True).alias("pair")), ["left", "word"], "left").na.fill(False, ["pair"])
    initial, number = F.col("left").rlike(r"^\p{L}$"), F.col("left") == NUMBER
    upper, lower = F.col("case") == "U", F.col("case") == "L"
    yes = upper & F.col("lower") & ~F.col("upper_middle")
    no = lower & (F.col("upper") | ~F.col("lower_begin"))
    begins = yes | (upper & F.col("starter"))
    ends = (
        F.when(F.col("before") == "e", begins).when(F.col("pair"), False).when(F.col("abbreviation"), begins & ~initial)
        .when(number, ~no).when(initial, ~no & ~(upper & ~F.col("lower"))).otherwise(True)
    )
    return rows.filter(~ends).select("before", "word", "case")


def going_on(passages: DataFrame, keys: Sequence[str], model: SentenceModel, column: str = "text") -> DataFrame:
    """``(*keys, _text, at)``, written: the possible boundaries, numbered from 0 in each text, at which no sentence ends.
    ``_text`` is a hash of the text, so that rows of the same keys stay apart."""
    named = [*keys, "_text"]
    rows = passages.select(*keys, _text_hash(column).alias("_text"), F.col(column).cast("string").cast("binary").alias("_bytes"))
    schema = T.StructType([*rows.select(*named).schema.fields, T.StructField("at", T.IntegerType()), T.StructField("last", T.BinaryType()), T.StructField("first", T.BinaryType())])
    around = rows.mapInArrow(chunks.doubtful_boundaries(named), schema).select(*named, "at", *(F.col(c).cast("string").alias(c) for c in ("last", "first")))
    # A sentence goes on only behind an ellipsis, an initial, a number or an abbreviation; so few boundaries are looked at.
    simple = F.col("last").rlike(r"^[A-Za-z]+\.\z")
    around = around.withColumn("last_core", F.when(~simple, core(F.col("last"))))
    before = F.when(simple, F.lower(F.concat(F.lit("."), F.expr("substring(last, 1, length(last) - 1)")))).otherwise(stop(F.col("last"), F.col("last_core")))
    around = around.select(*named, "at", "first", before.alias("before"))
    around = around.withColumn("left", F.when(F.substring("before", 1, 1) == ".", F.expr("substring(before, 2)")))
    short = written(model.words.filter("abbreviation").select(F.col("word").alias("left"), F.lit(True).alias("known")), "abbreviations")
    around = around.join(short, "left", "left").filter((F.col("before") == "e") | F.col("known") | _special(F.col("left")))
    around = around.select(*named, "at", "before", core(F.col("first")).alias("core"))
    judged = written(around.select(*named, "at", "before", word(F.col("core")).alias("word"), case(F.col("core")).alias("case")), "boundaries")
    going = undecided(model, judged.select("before", "word", "case").distinct())
    kept = written(judged.join(going, ["before", "word", "case"]).select(*named, "at").distinct(), "undecided")
    removed(short, judged)
    return kept


def _text_hash(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("string"))


def _met(keys: Sequence[str], going: DataFrame, found: Column, name: str):
    """``going`` by row under other names, and the condition that joins it, null keys included."""
    named = [*keys, "_text"]
    by_row = going.groupBy(*named).agg(found.alias(name)).select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate(named)), name)
    return by_row, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(named)))


def sentence_counts(passages: DataFrame, keys: Sequence[str], model: SentenceModel, column: str = "text", **measures: Column) -> DataFrame:
    """``(*keys, *measures, sentences)``: the number of sentences of each row, without the texts, beside other expressions of it."""
    going = going_on(passages, keys, model, column)
    text = F.replace(F.coalesce(column, F.lit("")), F.lit(CUT), F.lit(""))
    boundary = f"[.!?]{CLOSING}*{SPACE}+"
    closed = F.substring(text, -1, 1).isin(*" \t\n\x0b\f\r") & F.rtrim(text, F.lit(" \t\n\x0b\f\r")).rlike(f"[.!?]{CLOSING}*\\z")
    most = F.when(text.rlike(DARK), F.regexp_count(text, F.lit(boundary)) + F.when(closed, 0).otherwise(1)).otherwise(0)
    sizes = passages.select(*keys, _text_hash(column).alias("_text"), *(c.alias(n) for n, c in measures.items()), most.alias("_most"))
    on, same = _met(keys, going, F.count("*"), "_on")
    return sizes.join(on, same, "left").select(*keys, *measures, (F.col("_most") - F.coalesce("_on", F.lit(0))).alias("sentences"))


def split(passages: DataFrame, keys: Sequence[str], model: SentenceModel, column: str = "text") -> DataFrame:
    """``(*keys, sentence_no, sentence)``: the sentences of each text in order, from 0, trimmed; blank ones are left out."""
    going = going_on(passages, keys, model, column)
    rows = passages.select(*keys, _text_hash(column).alias("_text"), F.col(column).cast("string").cast("binary").alias("_bytes"))
    on, same = _met(keys, going, F.collect_list("at"), "_on")
    rows = rows.join(on, same, "left").select(*keys, "_bytes", "_on")
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("sentence_no", T.IntegerType()), T.StructField("sentence", T.BinaryType())])
    return rows.mapInArrow(chunks.split_sentences(list(keys)), schema).withColumn("sentence", F.col("sentence").cast("string"))
