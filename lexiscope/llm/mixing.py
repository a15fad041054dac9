"""Mixing sources to target weights, in DataFrame operations only.

Documents of a source, in a pseudorandom order, are one stream of words packed into blocks of ``block_words``
words (the last of a source may be shorter).  The mix is a row of slots, dealt to output shards of
``shard_slots`` slots.  Each shard draws its source counts multinomially; a source's slots, numbered through
all shards, go through the source's pseudorandom permutation of its block indexes, once per pass over the
source; and the blocks are joined by index.  Draws beyond a source's quota (its target in blocks) are void,
and what a source drew short of its quota fills closing shards, so that each source ends at its target to
within a block, and never takes a block more often than ``most_passes`` times.

Only the table of sources is broadcast; it is bounded by ``MOST_SOURCES`` rows, which is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.llm.runtime import hashes, materialize, own, unused

BLOCK_WORDS, SHARD_SLOTS, WEIGHTS, MOST_PASSES, SEED = 64, 1024, (5, 2, 1), 3, 20240607
MOST_SOURCES = 100_000
#: What a row of the mix is found again by.
ROW = ("doc_id", "source", "text")
#: Slots of the plan that one task makes, about.
SLOTS_A_TASK = 1 << 16
#: Cells of the unit interval, through which a uniform draw finds its source by equality.
CELLS = 4096
SPACE = r" \t\n\x0B\f\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab, line feed, vertical tab, form feed, return."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def _uniform(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def permuted(index: Column, size: Column, *keys) -> Column:
    """A keyed pseudorandom permutation of 0 .. size - 1: four Feistel rounds over a grid of about the square
    root of ``size`` both ways, walked on from the few cells of the grid that lie outside."""
    wide = F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt(size.cast("double"))).cast("long"))
    high = F.ceil(size / wide).cast("long")

    def rounds(at: Column) -> Column:
        cell = F.struct((at % wide).alias("a"), F.floor(at / wide).cast("long").alias("b"))
        for k in range(4):
            mixed = lambda v, n, k=k: F.pmod(F.xxhash64(F.lit(SEED), F.lit(k), *keys, v), n)
            cell = F.struct(
                ((cell["a"] + mixed(cell["b"], wide)) % wide if k % 2 == 0 else cell["a"]).alias("a"),
                (cell["b"] if k % 2 == 0 else (cell["b"] + mixed(cell["a"], high)) % high).alias("b"),
            )
        return cell["b"] * wide + cell["a"]

    # A cell outside has at most sqrt(size) companions, so a walk of 40 steps that never enters has a chance
    # below size^-20, and for sizes up to 1600 it can't exist.
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), rounds(index), lambda at, _: F.when(at < size, at).otherwise(rounds(at)))


def source_table(sized: DataFrame, weights=WEIGHTS, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source of ``sized(source, size)``: rank by code point (null last), size, target, quota.

    Targets share all sizes by weight and stop at ``most_passes`` times the source's size; the excess is
    shared again by weight.  The closed form: with sources in order of cap over weight and the first k capped,
    the common rate is (total - caps) / (weights left), and the right k is the one with the highest rate.
    """
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if (n := table.count()) > MOST_SOURCES:
        raise ValueError(f"{n} sources; at most {MOST_SOURCES} are supported")
    order = W.orderBy(F.col("source").asc_nulls_last())
    table = table.withColumn("rank", F.row_number().over(order) - 1)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    table = table.withColumn("cap", (F.col("source_size") * most_passes).cast("double"))
    every = W.partitionBy(F.lit(0))
    before = every.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rate = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    table = table.withColumn("rate", rate).withColumn("rate", F.max("rate").over(every))
    table = table.withColumn("target", F.least("cap", F.col("rate") * F.col("weight")))
    table = table.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    quota = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.round(F.col("target") * F.col("blocks") / F.col("source_size")))
    table = table.withColumn("quota", F.least(quota.cast("long"), F.col("blocks") * most_passes))
    spent = W.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return table.select("source", "rank", "source_size", "weight", "target", "blocks", "quota", F.sum("quota").over(spent).alias("quota_end"))


def positions(sized: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """``sized`` with the source's rank and the row's first word position in its source's stream.

    The order is by a hash of the id, in two levels, so that no task sorts a whole source.
    """
    buckets = 16
    while buckets < 1 << 16 and buckets * 512 < n_rows:
        buckets *= 2
    rows = sized.join(F.broadcast(sources.select(F.col("source").alias("_source"), "rank")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(buckets)).cast("int"))
    within = W.partitionBy("rank", "bucket").orderBy("doc_id", "size", "k1", "k2").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = whole.withColumn("bucket_start", F.sum("bucket_size").over(W.partitionBy("rank").orderBy("bucket")) - F.col("bucket_size")).drop("bucket_size")
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(starts, ["rank", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("offset")).drop("bucket", "bucket_start", "offset")


def plan(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, rank, slot, pass, block)``: which block of which source stands in which shard."""
    total = sources.agg(F.sum("quota")).first()[0] or 0
    spark = sources.sparkSession
    shards = -(-total // shard_slots)
    small = F.broadcast(sources)
    # each shard's draws, counted by source
    cdf = sources.select("rank", ((F.col("quota_end") - F.col("quota")) / F.lit(float(max(total, 1)))).alias("low"), (F.col("quota_end") / F.lit(float(max(total, 1)))).alias("high")).filter("high > low")
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    cells = cdf.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), last)))
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), _uniform(F.lit(SEED), F.lit("draw"), "id").alias("u"))
    draws = draws.withColumn("cell", F.floor(F.col("u") * CELLS)).join(F.broadcast(cells), "cell").filter("u >= low and u < high")
    counts = materialize(draws.groupBy("shard", "rank").agg(F.count("*").alias("n")), "mix-counts")
    # number a source's draws through all shards, in two levels
    counts = counts.withColumn("run", F.floor(F.col("shard") / 256))
    runs = counts.groupBy("rank", "run").agg(F.sum("n").alias("run_n"))
    runs = runs.withColumn("run_start", F.sum("run_n").over(W.partitionBy("rank").orderBy("run")) - F.col("run_n")).drop("run_n")
    inner = F.sum("n").over(W.partitionBy("rank", "run").orderBy("shard")) - F.col("n")
    spans = counts.withColumn("inner", inner).join(runs, ["rank", "run"]).withColumn("low", F.col("run_start") + F.col("inner"))
    spans = spans.join(small.select("rank", "quota"), "rank").withColumn("high", F.least(F.col("low") + F.col("n"), F.col("quota"))).filter("high > low")
    # A few spans stand for very many slots: deal them out by the number of slots, not by their own size.
    spans = spans.repartition(max(1, -(-total // SLOTS_A_TASK)), "shard", "rank")
    slots = spans.select("shard", "rank", F.explode(F.sequence("low", F.col("high") - 1)).alias("slot"))
    # closing shards, for what was drawn short
    drawn = sources.select("rank", "quota").join(counts.groupBy("rank").agg(F.sum("n").alias("drawn")), "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    short = drawn.filter("quota > drawn").withColumn("lack", F.col("quota") - F.col("drawn"))
    short = short.withColumn("ahead", F.sum("lack").over(W.partitionBy(F.lit(0)).orderBy("rank")) - F.col("lack"))
    closing = short.select("rank", "drawn", "ahead", F.explode(F.sequence("drawn", F.col("quota") - 1)).alias("slot"))
    closing = closing.select((F.lit(shards) + F.floor((F.col("ahead") + F.col("slot") - F.col("drawn")) / shard_slots)).cast("long").alias("shard"), "rank", "slot")
    taken = slots.unionByName(closing).join(small.select("rank", "blocks"), "rank").withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("int"))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("rank"), F.col("pass"))
    return taken.select("shard", "rank", "slot", "pass", block.alias("block"))


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The parts of each document that has words, by block: ``block``, ``skip`` words before it in the document,
    ``words`` in it."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    low = F.greatest("start", F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.withColumn("skip", (low - F.col("start")).cast("int")).withColumn("words", (high - low).cast("int"))


def _sized(docs: DataFrame) -> DataFrame:
    """Narrow rows: id, source, size, and two hashes of the whole row by which it is found again."""
    k1, k2 = _row_keys(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        k1.alias("k1"), k2.alias("k2"),
    )


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    kinds = dict(docs.dtypes)
    return hashes([F.col(c) for c in ROW], [kinds[c] for c in ROW])


def _placed(docs: DataFrame, weights, block_words: int) -> tuple[DataFrame, DataFrame]:
    sized = materialize(_sized(docs), "mix-sizes")
    sources = materialize(source_table(sized, weights, MOST_PASSES, block_words), "mix-sources")
    return positions(sized, sources, sized.count()), sources


def mix_report(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, source, text)``.

    ``taken`` counts the words that the mix takes of the row, repeats included.  Null texts and texts without
    words have size and taken 0; the null source is a source, last in order; of repeated rows each counts for
    itself; with no words at all, targets are 0; an empty table gives no rows.  Other columns are not read.
    """
    placed, sources = _placed(docs, weights, block_words)
    times = plan(sources, shard_slots).groupBy("rank", "block").agg(F.count("*").alias("times"))
    # The planner can't know how many slots a plan has: never broadcast it.
    cut = pieces(placed, block_words).join(times.hint("merge"), ["rank", "block"], "left")
    taken = cut.groupBy("rank", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    wordless = placed.filter("size = 0").select("rank", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    small = F.broadcast(sources.select("rank", "source_size", "target"))
    return taken.unionByName(wordless).join(small, "rank").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row per document and pass over its source that
    takes words of it; ``text`` holds just the words taken in that pass, with the white space behind each
    (the whole text if all are taken), and ``n_chars``, where it is a column, is its length.

    Rows without words are in no mix.  Nulls, repeats and empty tables as in ``mix_report``; rows with one id, source and
    text take their other columns from any of them.  Other columns come through, whatever they are called.
    """
    placed, sources = _placed(docs, weights, block_words)
    taken = pieces(placed, block_words).join(plan(sources, shard_slots).select("rank", "block", "pass").hint("merge"), ["rank", "block"])
    rows = taken.groupBy("rank", "start", "k1", "k2", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("parts"), F.sum("words").alias("taken"))
    k1, k2, size, parts, took = unused(docs, "_k1", "_k2", "_size", "_parts", "_taken")
    rows = rows.select(*(F.col(c).alias(name) for c, name in (("k1", k1), ("k2", k2), ("size", size), ("parts", parts), ("taken", took))))
    first, second = _row_keys(docs)
    texts = docs.withColumns({k1: first, k2: second}).dropDuplicates([k1, k2])
    joined = texts.join(rows, [k1, k2])
    words = F.regexp_extract_all(F.col("text"), F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    # Bound to a variable, so that a text is cut into words once and not for each of its parts.
    joined_parts = lambda w: F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(w, p["skip"] + 1, p["words"]))), "")
    some = F.get(F.transform(F.array(words), joined_parts), F.lit(0))
    out = joined.withColumn("text", F.when(F.col(took) == F.col(size), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own(docs))
