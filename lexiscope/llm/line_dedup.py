"""Fuzzy line dedup, in DataFrame operations only.

Lines are normalised (lower case, punctuation and white space runs to one space, trimmed) and hashed; equal
ones are one *line* from there on.  Two lines link if the edit similarity of their characters, 1 - distance /
longer length, is at least 0.8; each connected group keeps the first occurrence (smallest document id, then line
number) of any of its lines.

Candidates come from MinHash: ``MINIMA`` minima per line, and as many bands of some of them; lines meet in the
buckets of the bands in which they agree.  The minima are over the line's words, weighted by their length, so two
lines agree in one with the probability that is the shared characters' part of all; short lines also have minima
over their character trigrams, as one changed letter leaves few of their words the same.  (Pigeonhole blocks of a
SimHash can't do this: the blocks that two lines at similarity 0.8 share are far too short to tell lines apart.
README has the figures.)  The SimHash of a candidate's words then keeps unrelated lines from verification: a pair
of lines that aren't short may differ in CLOSE of its 64 bits, or in DISTANCE if it meets in several buckets.

A bucket with many variants of one line must not yield all its pairs.  A line's buckets' sizes tell how many variants
it is near to: the original more than copies with changes at different places.  Each line is first compared with the
most central line of one of its buckets, the one that it meets most often; then with up to HUBS central lines of each of
its buckets, as far as it isn't connected with them; and only pairs that are still in different components after that
are looked at, all of them.  Two short lines are compared where they meet, as their buckets tell little.
Buckets are found by counting, so a crowded one is combined before it is shuffled, and joins on buckets, lines and
groups have a plain exchange on both sides, so that adaptive execution can split a crowded key.  Texts and bucket
rows that no candidate needs are dropped before the shuffle by a bitmap of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.llm.graph import connected_components
from lexiscope.llm.runtime import discard, hashes, materialize, own, unused

#: Unrelated lines' SimHashes differ in 28 +- 4 bits, those of lines with a fifth of their characters changed in 13 +- 4.
SIMILARITY, CLOSE, DISTANCE = 0.8, 17, 23
#: Characters up to which a line is short, and from which it is long.
SHORT, LONG = 64, 200
#: Characters of a chunk of a long line, without and with the space behind it.
CHUNK, CHUNK_SPACE = 6, 7
#: Share of the longer line that is compared on its own, from either end; unrelated texts of that length already differ by too much.
WINDOW = 0.3
#: Minima of a line, and the places that make up a band (counted from its own), of words and of trigrams.
MINIMA, BANDS = 20, ((0, 1, 4, 6), (0, 1, 4, 6, 11))
#: Hubs of a bucket.
HUBS = 8
#: Numbers of equal rows that are told off at a time.
RUN = 65536
#: A bitmap: so many parts of 32,768 bits (4 KB) each, 4 MB in all.
BITMAP_PARTS = 1024


def normalised(text: Column) -> Column:
    """Lower case, with each run of ASCII punctuation and white space other than line feeds as one space."""
    return F.regexp_replace(F.lower(text), r"[\x00-\x09\x0B-/:-@\[-`{-\x7F]+", " ")


def row_key() -> Column:
    """Tells rows with one id, or none, apart by their text."""
    return F.xxhash64(F.col("text").cast("string"))


def line_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, line_no, line, norm)`` for every line that isn't blank after normalisation; ``line`` is a hash
    of the normalised text ``norm``, ``row`` the row's key."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.posexplode(F.split(normalised(F.col("text").cast("string")), "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "row", "line_no", F.trim("raw").alias("norm")).filter("norm != ''")
    return lines.select("doc_id", "row", "line_no", F.xxhash64("norm").alias("line"), "norm")


def _minima() -> list[Column]:
    """The minima over the hashes ``h`` of values that are uniform up to 1 / weight; ``scale`` is 1 / weight."""
    return [F.min(F.expr(f"cast((xxhash64(h ^ {(i + 1) * 0x1E3779B97F4A7C1}L) >>> 11) * scale as float)")).alias(f"m{i}") for i in range(MINIMA)]


def signatures(lines: DataFrame) -> DataFrame:
    """``(line, chars, copies)`` and ``m0``, ``m1``, ... (the minima over its words) per distinct line.

    Words are counted with the minima, over all copies of a line; the number of a line's words divides them into
    its copies.  So a line with any number of copies is one row of each input partition, and nothing is made
    distinct beforehand.
    """
    words = lines.select("line", F.length("norm").alias("chars"), F.split("norm", " ").alias("words"))
    words = words.select("line", "chars", F.size("words").alias("length"), F.explode("words").alias("word"))
    words = words.select("line", "chars", "length", F.xxhash64("word").alias("h"), (F.lit(1.0) / F.length("word")).alias("scale"))
    counted = words.groupBy("line").agg(F.count("*").alias("n"), F.min("length").alias("length"), F.min("chars").alias("chars"), *_minima())
    return counted.select("line", "chars", (F.col("n") / F.col("length")).cast("long").alias("copies"), *(f"m{i}" for i in range(MINIMA)))


def _banded(marks: DataFrame, kind: int) -> DataFrame:
    """``(key, line)`` for each band of each line."""
    bands = [F.xxhash64(F.lit(kind), F.lit(i), *(F.col(f"m{(i + at) % MINIMA}") for at in BANDS[kind])) for i in range(MINIMA)]
    return marks.select(F.explode(F.array(*bands)).alias("key"), "line")


def trigram_signatures(lines: DataFrame) -> DataFrame:
    """``(line, m0, m1, ...)``: the minima over the trigrams of each short line."""
    short = lines.filter(F.length("norm") <= SHORT).groupBy("line").agg(F.concat(F.lit(" "), F.min("norm"), F.lit(" ")).alias("norm"))
    grams = short.select("line", F.lit(1.0).alias("scale"), F.explode(F.expr("transform(sequence(1, length(norm) - 2), i -> xxhash64(substring(norm, i, 3)))")).alias("h"))
    return grams.groupBy("line").agg(*_minima())


def filtered(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose long ``column`` is in the one column of ``wanted``, and a few more that a bitmap of them
    can't tell from those; the bitmap is broadcast and has BITMAP_PARTS rows at most."""
    bits = BITMAP_PARTS << 15
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(bits))
    marked = wanted.select(place(F.col(wanted.columns[0])).alias("_place"))
    marked = marked.groupBy(F.shiftright("_place", 15).alias("_part")).agg(F.expr("bitmap_construct_agg(_place & 32767)").alias("bits"))
    # As an array of longs, which is read by position; byte 0 of a long is its highest.
    words = F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(bits, 8 * i + 1, 8)), 16, -10) as bigint))")
    bitmap = marked.select("_part", words.alias("_words"))
    mine = rows.withColumn("_place", place(F.col(column))).withColumn("_part", F.shiftright("_place", 15))
    met = mine.join(F.broadcast(bitmap), "_part")
    bit = "shiftrightunsigned(get(_words, cast((_place & 32767) >> 6 as int)), cast(8 * (7 - ((_place >> 3) & 7)) + (_place & 7) as int)) & 1L"
    return met.filter(F.expr(f"({bit}) = 1")).select(*rows.columns)


def candidate_texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(line, norm, chars, fp)`` of the lines in ``wanted`` (and a few more), written; ``fp`` is the SimHash of the line's words,
    weighted by their length."""
    texts = filtered(lines.select("line", "norm"), "line", wanted).groupBy("line").agg(F.min("norm").alias("norm"))
    texts = materialize(texts, "norms")
    words = texts.select("line", F.explode(F.split("norm", " ")).alias("word"))
    words = words.select("line", F.xxhash64("word").alias("h"), F.length("word").alias("weight"))
    # Two bits to a sum: its halves count the weights of bits i and i + 32.
    ones = [F.sum(F.expr(f"((h >>> {i}) & {1 << 32 | 1}L) * weight")).alias(f"b{i}") for i in range(32)]
    counted = words.groupBy("line").agg(F.sum("weight").alias("total"), *ones)
    # An array and a loop, as one expression of 64 branches makes a method too long for the JIT.
    half = f"{(1 << 32) - 1}L"
    bit = f"shiftleft(if(2 * (b & {half}) > total, 1L, 0L), i) | shiftleft(if(2 * (b >>> 32) > total, 1L, 0L), i + 32)"
    sums = ", ".join(f"b{i}" for i in range(32))
    fp = F.expr(f"aggregate(transform(array({sums}), (b, i) -> {bit}), 0L, (a, x) -> a | x)")
    marked = materialize(counted.select("line", fp.alias("fp")).join(texts, "line").select("line", "norm", F.length("norm").alias("chars"), "fp"), "line-texts")
    discard(texts)
    return marked


def _near(a: str, b: str) -> Column:
    """Lengths that similar lines can have, and fingerprints that similar lines have unless they are short."""
    longer = F.greatest(f"chars{a}", f"chars{b}")
    return (_bits(a, b) <= DISTANCE) & (F.abs(F.col(f"chars{a}") - F.col(f"chars{b}")) <= longer * (1 - SIMILARITY) + 1e-9)


def _bits(a: str, b: str) -> Column:
    """Differing bits of the fingerprints; none if both lines are short."""
    short = F.greatest(f"chars{a}", f"chars{b}") <= SHORT
    return F.when(short, 0).otherwise(F.bit_count(F.col(f"fp{a}").bitwiseXOR(F.col(f"fp{b}")))).cast("int")


def _asked(pairs: DataFrame) -> DataFrame:
    """The distinct pairs of ``pairs(a, b, bits, root_a, root_b)``, a row for each bucket, that are to be verified."""
    met = pairs.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in ("bits", "root_a", "root_b")), F.count("*").alias("n"))
    return met.filter((F.col("bits") <= CLOSE) | (F.col("n") > 1)).drop("n")


def edit_similar(likely: bool = True) -> Column:
    """Whether 1 - distance / longer length of the columns ``one`` and ``two`` is at least SIMILARITY, at any length.

    Two upper bounds of the distance are tried, as they cost much less: words set against each other by position; and
    the edit distance of long lines cut into chunks, of which an edit costs CHUNK_SPACE characters at most.  So are two
    lower bounds, the distances of what is left of both texts without equally many of their last, or first, characters
    (they never exceed that of the texts): lines that share a long passage mostly differ by too much on one side of it.
    Beyond them the exact distance decides.  Lower bounds come first unless pairs are ``likely`` to be similar.
    """
    allowed = f"cast(floor(greatest(length(one), length(two)) * {1 - SIMILARITY:.6f}D + 1e-9D) as int)"
    words = "split(one, ' ')", "split(two, ' ')"
    by_word = f"aggregate(zip_with({words[0]}, {words[1]}, (x, y) -> if(x = y, 0, greatest(length(x), length(y)))), 0, (s, d) -> s + d)"
    # Each distinct chunk becomes one character; those of surrogates are passed over.
    cut = lambda x: f"regexp_extract_all({x}, '[^ ]{{1,{CHUNK}}} ?', 0)"
    place = "array_position(w.z, v) + 255"
    as_text = lambda x: f"decode(unhex(array_join(transform(w.{x}, v -> lpad(hex({place} + if({place} >= 55296, 2048, 0)), 4, '0')), '')), 'utf-16be')"
    bound = f"transform(array(struct({cut('one')} as x, {cut('two')} as y)), c -> struct(c.x as x, c.y as y, array_distinct(concat(c.x, c.y)) as z))"
    by_chunk = f"get(transform({bound}, w -> size(w.z) < 60000 and levenshtein({as_text('x')}, {as_text('y')}, cast(floor({allowed} / {CHUNK_SPACE}) as int)) >= 0), 0)"
    # Texts that the cut leaves nothing of differ in length by more than is allowed.
    cut_off = f"cast(floor(greatest(length(one), length(two)) * {1 - WINDOW:.6f}D) as int)"
    ends = " and ".join(f"levenshtein({side}(one, length(one) - {cut_off}), {side}(two, length(two) - {cut_off}), {allowed}) >= 0" for side in ("left", "right"))
    in_words = f"(size({words[0]}) = size({words[1]}) and {by_word} <= {allowed})"
    in_chunks, exactly = f"(length(one) > {LONG} and {by_chunk})", f"levenshtein(one, two, {allowed}) >= 0"
    return F.expr(f"{in_words} or {in_chunks} or ({ends} and {exactly})" if likely else f"{in_words} or ({ends} and ({in_chunks} or {exactly}))")


def verified(texts: DataFrame, pairs: DataFrame, likely: bool = True) -> DataFrame:
    """The pairs ``(a, b)`` of lines whose texts are similar, written; ``likely`` as in ``edit_similar``."""
    left = pairs.join(texts.select(F.col("line").alias("a"), F.col("norm").alias("one")), "a")
    both = left.join(texts.select(F.col("line").alias("b"), F.col("norm").alias("two")), "b")
    return materialize(both.filter(edit_similar(likely)).select(*pairs.columns), "line-links")


def links_across(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among ``pairs(a, b, bits, root_a, root_b)``, written, that connect all that the similar ones
    of the pairs connect.

    Each line's nearest pair is verified first.  In a large group of near copies that connects most lines, and of
    the other pairs only those whose ends are still in different components are verified, all of them.
    """
    end = lambda c: F.struct(F.col(c).alias("line"), F.struct("bits", "a", "b", "root_a", "root_b").alias("pair"))
    ends = pairs.select(F.explode(F.array(end("a"), end("b"))).alias("x")).select("x.*")
    nearest = materialize(ends.groupBy("line").agg(F.min("pair").alias("pair")).select("pair.*").distinct(), "nearest-pairs")
    first = verified(texts, nearest, likely=False)
    moved = materialize(connected_components(first, "root_a", "root_b"), "moved-roots")
    to = lambda c: moved.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
    left = pairs.join(nearest.select("a", "b"), ["a", "b"], "left_anti").join(to("root_a"), "root_a", "left").join(to("root_b"), "root_b", "left")
    left = left.filter(F.coalesce("root_a_to", "root_a") != F.coalesce("root_b_to", "root_b"))
    left = materialize(left.select("a", "b"), "pairs-left")
    second = verified(texts, left, likely=False)
    out = materialize(first.select("a", "b").unionByName(second), "links-across")
    discard(nearest, first, moved, left, second)
    return out


def line_groups(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """``(line, root)`` for every line that is linked with another text, written; ``lines`` from ``line_table`` and
    ``marks`` from ``signatures``, both written."""
    met = line_meetings(lines, marks)
    return linked_groups(met, candidate_texts(lines, met.select("line").distinct()))


def line_meetings(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """``(key, line, n)`` for each bucket of several lines and each line in it, written."""
    grams = materialize(trigram_signatures(lines), "line-trigrams")
    keyed = _banded(marks, 0).unionByName(_banded(grams, 1))
    crowded = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "line-buckets")
    met = materialize(filtered(keyed, "key", crowded.select("key")).join(crowded, "key"), "line-meetings")
    discard(grams, crowded)
    return met


def linked_groups(met: DataFrame, texts: DataFrame) -> DataFrame:
    """``(line, root)`` for every line that is linked with another text, written; ``met`` from ``line_meetings`` and
    ``texts`` from ``candidate_texts``, both deleted."""
    brief = F.when(F.col("chars") <= SHORT, F.col("norm")).alias("brief")
    central = materialize(met.groupBy("line").agg(F.sum("n").alias("central")), "line-centres")
    spots = materialize(met.select("key", "line").join(texts.select("line", "chars", "fp", brief).join(central, "line"), "line"), "line-spots")
    discard(central)
    # Each line and the hub that it meets most often.
    ends = lambda end: [F.col(c).alias(c + end) for c in ("line", "chars", "fp", "brief")]
    middle = spots.groupBy("key").agg(F.max(F.struct("central", "line", "chars", "fp", "brief")).alias("hub")).select("key", "hub.*").select("key", *ends("_a"))
    starred = spots.select("key", *ends("_b")).join(middle, "key").filter((F.col("line_a") != F.col("line_b")) & _near("_a", "_b"))
    starred = starred.groupBy(F.col("line_a").alias("a"), F.col("line_b").alias("b")).agg(F.min(_bits("_a", "_b")).alias("bits"), F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("bits")).alias("bits"), "a")).alias("top")
    starred = starred.filter((F.col("bits") <= CLOSE) | (F.col("n") > 1)).groupBy("b").agg(best).select("top.a", "b")
    starred = materialize(starred, "hub-pairs")
    links = verified(texts, starred)
    # Each line and the hubs of its buckets that it isn't connected with yet.
    placed = _placed(spots, links)
    leading = F.max(F.struct("central", "line", "chars", "fp", "brief", "root")).alias("hub")
    hubs = materialize(placed.groupBy("key", "slot").agg(leading).select("key", "slot", "hub.*").drop("central"), "bucket-hubs")
    spoke = placed.join(hubs.select("key", "slot", F.col("line").alias("first")), ["key", "slot"]).withColumn("leads", F.col("line") == F.col("first"))
    spoke = materialize(spoke.select("key", "line", "leads", "chars", "fp", "brief", "root"), "placed-buckets")
    discard(spots, placed)
    rooted = lambda end: [*ends(end), F.col("root").alias(f"root{end}")]
    once = ~F.col("leads") | (F.col("line_b") < F.col("line_a"))
    apart = F.col("root_a") != F.col("root_b")
    around = spoke.select("key", "leads", *rooted("_b")).join(hubs.select("key", *rooted("_a")), "key").filter(apart & once & _worth("_a", "_b"))
    around = materialize(_asked(_unasked(around, starred)), "star-pairs")
    discard(hubs)
    more = links_across(texts, around)
    # All other pairs that are still apart, each in the first bucket where it meets: of lines that both lead nothing,
    # or whose nearness the number of their buckets decides.
    links_so_far = materialize(links.select("a", "b").unionByName(more), "links-so-far")
    again = _placed(spoke.drop("root"), links_so_far)
    discard(spoke)
    several = again.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    several = materialize(several, "open-buckets")
    keys = met.groupBy("line").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    opened = materialize(again.join(several, "key").join(keys, "line"), "open-lines")
    discard(met, again, several)
    rooted = lambda end: [*ends(end), *(F.col(c).alias(c + end) for c in ("root", "leads", "keys"))]
    one, two = opened.select("key", *rooted("_a")), opened.select("key", *rooted("_b"))
    shared = F.array_intersect("keys_a", "keys_b")
    first = (F.array_min(shared) == F.col("key")) & F.when(_bits("_a", "_b") <= CLOSE, ~(F.col("leads_a") | F.col("leads_b"))).otherwise(F.size(shared) > 1)
    rest = one.join(two, "key").filter((F.col("root_a") < F.col("root_b")) & _worth("_a", "_b") & first)
    rest = materialize(_unasked(rest, starred.unionByName(around.select("a", "b"))), "line-pairs")
    last = links_across(texts, rest)
    out = materialize(connected_components(links_so_far.unionByName(last), "a", "b").withColumnRenamed("node", "line"), "line-roots")
    discard(texts, starred, links, around, more, links_so_far, opened, rest, last)
    return out


def _placed(spots: DataFrame, links: DataFrame) -> DataFrame:
    """``spots`` with ``root``, the component of each line, and ``slot``, by which a bucket's lines are dealt out, written."""
    roots = materialize(connected_components(links, "a", "b").withColumnRenamed("node", "line"), "hub-roots")
    placed = spots.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line")).withColumn("slot", F.pmod(F.xxhash64("line"), F.lit(HUBS)))
    out = materialize(placed, "placed-lines")
    discard(roots)
    return out


def _worth(a: str, b: str) -> Column:
    """Near lines; of two short ones, which have no fingerprints, only similar ones, as their texts are at hand."""
    longer = F.greatest(f"chars{a}", f"chars{b}")
    alike = F.expr(f"levenshtein(brief{a}, brief{b}, cast(floor(greatest(chars{a}, chars{b}) * {1 - SIMILARITY:.6f}D + 1e-9D) as int)) >= 0")
    return _near(a, b) & F.when(longer <= SHORT, alike).otherwise(True)


def _unasked(met: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs ``(a, b, bits, root_a, root_b)`` that are to be verified, of pairs in buckets, without those ``asked(a, b)``."""
    swapped = F.col("line_a") > F.col("line_b")
    end = lambda c, x, y: F.when(swapped, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    pairs = met.select(
        end("line", "a", "b").alias("a"), end("line", "b", "a").alias("b"), end("root", "a", "b").alias("root_a"), end("root", "b", "a").alias("root_b"), _bits("_a", "_b").alias("bits")
    )
    return pairs.join(asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def row_decisions(docs: DataFrame) -> DataFrame:
    """``line_decisions`` with the row's key, ``row``, and ``twin``: true on rows of groups whose first occurrence
    stands in a row that is repeated."""
    lines = materialize(line_table(docs), "lines")
    marks = materialize(signatures(lines), "line-signatures")
    met = line_meetings(lines, marks)
    copied = materialize(marks.filter("copies > 1").select("line"), "copied-lines")
    discard(marks)
    # Texts and minima are most of what is on disk, so they go as soon as they have been read.
    texts = candidate_texts(lines, met.select("line").distinct())
    places = materialize(lines.select("doc_id", "row", "line_no", "line"), "line-places")
    discard(lines)
    roots = linked_groups(met, texts)
    # Lines that occur once and are linked with nothing are kept; only the others are grouped.
    repeated = copied.join(roots, "line", "full").select("line", F.coalesce("root", "line").alias("root"))
    repeated = materialize(repeated, "line-groups")
    tagged = materialize(places.join(repeated, "line", "left"), "tagged-lines")
    discard(places, copied, roots, repeated)
    at = ("doc_id", "row", "line_no")
    alone = tagged.filter("root is null").select(*at, F.col("line").alias("line_group"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept"))
    several = tagged.filter("root is not null").select(*at, F.col("root").alias("line_group"))
    place = F.struct("doc_id", "line_no", "row")
    # Written, so that the join reads two plain tables and a line with very many copies can be split.
    firsts = several.groupBy("line_group").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    again = repeated_rows(docs)
    same = F.col("first.doc_id").eqNullSafe(F.col("_again_id")) & (F.col("first.row") == F.col("_again_row"))
    firsts = materialize(firsts.join(again, same, "left").select("line_group", "first", "copies", F.col("_times").alias("times")), "line-firsts")
    out = several.join(firsts, "line_group").withColumn("kept", place.eqNullSafe(F.col("first"))).filter("not (kept and times is not null)")
    # Of equal rows that hold a group's first occurrence, one keeps it: as many rows as they are, told off in runs.
    told = firsts.filter("times is not null").select("first.*", "line_group", "copies", "times", F.explode(F.expr(f"sequence(0L, (times - 1) div {RUN})")).alias("run"))
    told = told.withColumn("at", F.explode(F.expr(f"sequence(run * {RUN}, least(times, (run + 1) * {RUN}) - 1)")))
    no, yes = F.lit(False).alias("twin"), F.lit(True).alias("twin")
    columns = (*at, "line_group", "copies", "kept")
    return alone.select(*columns, no).unionByName(out.select(*columns, F.col("times").isNotNull().alias("twin"))).unionByName(told.withColumn("kept", F.col("at") == 0).select(*columns, yes))


def repeated_rows(docs: DataFrame) -> DataFrame:
    """``(_again_id, _again_row, _times)``: ids and row keys that more than one row has, written."""
    keys = docs.select(F.col("doc_id").cast("long").alias("_again_id"), row_key().alias("_again_row"))
    return materialize(keys.groupBy("_again_id", "_again_row").agg(F.count("*").alias("_times")).filter("_times > 1"), "repeated-rows")


def line_decisions(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line_group, copies, kept)`` for every line of ``docs(doc_id, text)`` that has a letter
    or digit (or any character beyond ASCII).

    ``line_group`` is the hash of the group's representative text, ``copies`` the group's number of
    occurrences; ``kept`` marks the occurrence with the smallest (doc_id, line_no).  A null id comes before all
    others.  Null, empty and blank texts have no such lines.  Different texts that share an id, or have none, are
    different documents, of which the smaller text hash comes first; of rows with the same id and the same text
    just one keeps what is kept.  An empty table gives no rows.  Other columns are not read.
    """
    return row_decisions(docs).drop("row", "twin")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``line_decisions`` drops; columns as they came, ``n_chars`` (if there)
    brought up to date.  Rows stay even if no line does; blank lines stay; null texts stay null.  Of rows with one id
    (or none) and one text, the one whose other columns have the smallest hash keeps the lines that are kept."""
    decided = materialize(row_decisions(docs).filter("not kept or twin").select("doc_id", "row", "line_no", "kept"), "line-decisions")
    again = repeated_rows(docs)
    ident = F.col("doc_id").cast("long")
    repeated = ident.eqNullSafe(again["_again_id"]) & (row_key() == again["_again_row"])
    dropped = decided.filter("not kept")
    once = _without(docs.join(again, repeated, "left_anti"), dropped, F.lit(False))
    # Rows that are repeated are numbered; their copies lose all lines.
    (number,) = unused(docs, "_number")
    order = hashes(own(docs), [kind for _, kind in docs.dtypes])
    twins = docs.join(again, repeated, "left_semi").withColumn(number, F.row_number().over(W.partitionBy(ident, row_key()).orderBy(*order)))
    held = decided.groupBy("doc_id", "row", "line_no").agg(F.max("kept").alias("held"), F.min("kept").alias("kept")).filter("not kept")
    several = _without(twins, held, F.col(number) == 1)
    return once.select(*own(docs)).unionByName(several.select(*own(docs)))


def _without(docs: DataFrame, dropped: DataFrame, first: Column) -> DataFrame:
    """``docs`` without the lines ``dropped(doc_id, row, line_no)``; where ``first`` is true, lines that are ``held``
    there stay."""
    ident, row, gone, held = unused(docs, "_id", "_row", "_gone", "_held")
    marks = F.collect_set(F.when(F.col("held"), F.col("line_no"))) if "held" in dropped.columns else F.array().cast("array<int>")
    sets = dropped.groupBy(F.col("doc_id").alias(ident), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone), marks.alias(held))
    lines = F.split(F.col("text"), "\n")
    lost = F.when(first, F.array_except(gone, held)).otherwise(F.col(gone))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = docs.join(sets, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (row_key() == F.col(row)), "left")
    out = out.withColumn("text", F.when(F.col(gone).isNull() | F.col("text").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
