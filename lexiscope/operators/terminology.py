"""Terminologies as graphs: resolving ids, depth, tops, branches, and topic weights.

A terminology is a frame ``concepts(seq, ui, name, tree_numbers, parent_ids, mapped_ui_ids, alt_ids)``.  All
walks go level by level over an edge table, one join and one aggregate a level, so the work follows the number
of edges and not the number of paths.

With a ``home`` folder, what follows from the concepts alone (the id index, depths, top ancestors and weights) is kept
there under a digest of the concepts and of the configured topics, and read by whoever asks for the same again.  A
changed concept or topic has another digest; a table that nothing names any more may be deleted at any time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import concept_key, folded, resource_key, tree_prefixes
from lexiscope.plans.storage import content_digest, persisted, removed, settled, written
from lexiscope.plans.targets import at_targets, with_scopes

DIGITS = 8
#: Levels after which a graph is taken to have a cycle.
MOST_LEVELS = 200


class CycleError(ValueError):
    """The parent graph has a cycle."""


@dataclass(frozen=True, eq=False)
class Terminology:
    concepts: DataFrame
    prefix: str | None = None
    aliases: tuple[str, ...] = ()
    home: str | None = None

    @cached_property
    def _stamp(self) -> str:
        return content_digest(self.concepts)

    def _kept(self, name: str, build: Callable[[], DataFrame], *given: DataFrame | None) -> DataFrame:
        """``build()``, or the same from an earlier call over equal concepts, prefix and ``given`` tables."""
        if self.home is None:
            return build()
        told = [str(self.prefix), self._stamp, *("" if df is None else content_digest(df) for df in given)]
        return persisted(self.concepts.sparkSession, f"{self.home}/{name}-{hashlib.sha256(chr(0).join(told).encode()).hexdigest()[:32]}", build)

    @cached_property
    def index(self) -> DataFrame:
        """``(candidate, ui)``: every id and alternative id; where one stands for several concepts, the last."""
        return self._kept("index", self._index)

    def _index(self) -> DataFrame:
        ids = self.concepts.select("seq", "ui", F.explode(F.concat(F.array("ui"), F.coalesce("alt_ids", F.array().cast("array<string>")))).alias("id"))
        return settled(ids.select(concept_key(F.col("id")).alias("candidate"), "seq", "ui").groupBy("candidate").agg(F.max_by("ui", "seq").alias("ui")))

    def resolved(self, rows: DataFrame, column: str, out: str = "ui") -> DataFrame:
        """``rows`` with the concept that ``column`` names, as it stands or behind the prefix; null if none."""
        key = concept_key(F.col(column))
        first = self.index.select(F.col("candidate").alias("_one"), F.col("ui").alias("_ui1"))
        found = rows.withColumn("_key", key).join(first, F.col("_key") == F.col("_one"), "left")
        if not self.prefix:
            return found.withColumn(out, F.col("_ui1")).drop("_key", "_one", "_ui1")
        start = f"{self.prefix}:"
        second = self.index.select(F.col("candidate").alias("_two"), F.col("ui").alias("_ui2"))
        longer = F.when(~F.col("_key").startswith(start), F.concat(F.lit(start), "_key"))
        found = found.join(second, longer == F.col("_two"), "left")
        return found.withColumn(out, F.coalesce("_ui1", "_ui2")).drop("_key", "_one", "_ui1", "_two", "_ui2")

    def accepts(self, resource):
        """Whether a resource name, reduced to letters and digits, is one of the aliases."""
        keys = sorted({k for a in self.aliases if (k := "".join(ch for ch in a.lower() if ch.isascii() and ch.isalnum()))})
        return F.coalesce(resource_key(resource).isin(*keys), F.lit(False)) if keys else F.lit(False)

    @cached_property
    def parents(self) -> DataFrame:
        """``(ui, place, parent)``: listed parents (or mapped concepts, where no parent is listed); ``parent`` is
        null where the listed one doesn't exist."""
        listed = F.when(F.size(F.coalesce("parent_ids", F.array().cast("array<string>"))) > 0, F.col("parent_ids")).otherwise(F.col("mapped_ui_ids"))
        rows = self.concepts.select("ui", F.posexplode(listed).alias("place", "listed"))
        return settled(self.resolved(rows, "listed", "parent").select("ui", "place", "parent"))

    @cached_property
    def edges(self) -> DataFrame:
        return self.parents.filter("parent is not null and parent != ui").select("ui", "parent")

    @cached_property
    def trees(self) -> DataFrame:
        return self.concepts.select("ui", "seq", F.explode("tree_numbers").alias("tree"))

    def depths(self) -> DataFrame:
        """``(ui, depth)``: fewest tree-number segments; else one more than the shallowest existing parent; 1
        for concepts with neither, and for those on a cycle that nothing leads out of."""
        return self._kept("depths", self._depths)

    def _depths(self) -> DataFrame:
        treed = self.trees.groupBy("ui").agg(F.min(F.size(F.split("tree", r"\."))).alias("depth"))
        rest = self.concepts.select("ui").join(treed, "ui", "left_anti")
        open_edges = settled(self.edges.join(rest, "ui", "left_semi"))
        tops = rest.join(open_edges.select("ui").distinct(), "ui", "left_anti").withColumn("depth", F.lit(1))
        known = settled(treed.unionByName(tops))
        for _ in range(MOST_LEVELS):
            offered = open_edges.join(known.withColumnRenamed("ui", "parent"), "parent").groupBy("ui").agg((F.min("depth") + 1).alias("depth"))
            better = offered.join(known.withColumnRenamed("depth", "old"), "ui", "left").filter("old is null or depth < old").select("ui", "depth")
            better = settled(better)
            if better.isEmpty():
                break
            known = settled(known.join(better, "ui", "left_anti").unionByName(better))
        else:
            raise ValueError(f"more than {MOST_LEVELS} levels")
        lost = rest.join(known, "ui", "left_anti").withColumn("depth", F.lit(1))
        return known.unionByName(lost)

    def top_ancestors(self) -> DataFrame:
        """``(ui, top)``: for concepts with tree numbers the concepts at the first segments (themselves if there
        are none), for concepts without parents themselves, else the tops of their parents, each once."""
        return self._kept("top_ancestors", self._top_ancestors)

    def _top_ancestors(self) -> DataFrame:
        first = self.trees.select("ui", F.substring_index("tree", ".", 1).alias("tree")).distinct()
        at = self.trees.select(F.col("ui").alias("top"), "tree")
        heads = first.join(at, "tree", "left").select("ui", F.coalesce("top", "ui").alias("top")).distinct()
        treed = self.concepts.filter(F.size("tree_numbers") > 0).select("ui")
        childless = self.concepts.select("ui").join(self.parents.select("ui").distinct(), "ui", "left_anti").join(treed, "ui", "left_anti")
        sinks = settled(heads.unionByName(childless.select("ui", F.col("ui").alias("top"))))
        return self._walk(sinks.withColumnRenamed("ui", "at"), weighted=False)

    def _walk(self, sinks: DataFrame, weighted: bool, edges: DataFrame | None = None) -> DataFrame:
        """From every concept along ``edges(ui, parent[, w])`` to the nodes in ``sinks(at, top[, w])``: the tops
        that are reached, or with weights the products summed over paths."""
        stops = sinks.select("at").distinct()
        steps = edges if edges is not None else self.edges
        steps = settled(steps.withColumnRenamed("ui", "at").join(stops, "at", "left_anti"))
        here = self.concepts.select("ui", F.col("ui").alias("at"), *([F.lit(1.0).alias("w")] if weighted else []))
        parts = []
        for _ in range(MOST_LEVELS):
            here = settled(here)
            ends = here.join(sinks.withColumnRenamed("w", "v") if weighted else sinks, "at")
            parts.append(settled(ends.select("ui", "top", (F.col("w") * F.col("v")).alias("w")) if weighted else ends.select("ui", "top")))
            moved = here.join(steps.withColumnRenamed("w", "v") if weighted else steps, "at")
            if weighted:
                here = moved.select("ui", F.col("parent").alias("at"), (F.col("w") * F.col("v")).alias("w")).groupBy("ui", "at").agg(F.sum("w").alias("w"))
            else:
                here = moved.select("ui", F.col("parent").alias("at")).distinct()
            if here.isEmpty():
                break
        else:
            raise CycleError(f"no end after {MOST_LEVELS} levels")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.groupBy("ui", "top").agg(F.sum("w").alias("w")) if weighted else out.distinct()

    @cached_property
    def tree_concepts(self) -> DataFrame:
        """``(ui, concept)``: a concept itself if it has tree numbers, parents or no mapping, else the mapped
        concepts that have tree numbers (perhaps none)."""
        empty = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
        mapped = empty("tree_numbers") & empty("parent_ids") & ~empty("mapped_ui_ids")
        own = self.concepts.filter(~mapped).select("ui", F.col("ui").alias("concept"))
        through = self.resolved(self.concepts.filter(mapped).select("ui", F.explode("mapped_ui_ids").alias("id")), "id", "concept")
        treed = self.concepts.filter(F.size("tree_numbers") > 0).select(F.col("ui").alias("concept"))
        return settled(own.unionByName(through.filter("concept is not null").select("ui", "concept").join(treed, "concept", "left_semi").select("ui", "concept")))

    def branch_weights(self) -> DataFrame:
        """``(ui, key, w)``: each top ancestor of a concept's tree concepts, with equal shares, repeats kept."""
        return self._kept("branch_weights", self._branch_weights)

    def _branch_weights(self) -> DataFrame:
        keys = self.tree_concepts.join(self.top_ancestors().select(F.col("ui").alias("concept"), F.col("top").alias("key")), "concept")
        return _shared(keys.select("ui", "key"))

    def depth_weights(self) -> DataFrame:
        """``(ui, key, w)``: the depths of a concept's tree concepts, with equal shares."""
        return self._kept("depth_weights", self._depth_weights)

    def _depth_weights(self) -> DataFrame:
        keys = self.tree_concepts.join(self.depths().withColumnRenamed("ui", "concept"), "concept")
        return _shared(keys.select("ui", F.col("depth").alias("key")))

    def named(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` joined to the concepts that have the preferred name in ``column`` (case and white space
        aside), and ``share``, one over their number."""
        asked = rows.withColumn("_name", folded(F.col(column)))
        # Only concepts that are asked for, one a row, as very many may have one name.
        held = self.concepts.select(folded(F.col("name")).alias("_name"), "ui").filter("ui is not null").join(asked.select("_name").distinct(), "_name", "left_semi").distinct()
        shares = held.groupBy("_name").agg((1.0 / F.count("*")).alias("share"))
        return asked.join(shares, "_name").join(held, "_name").drop("_name")

    def anchor_weights(self, term_topics: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
        """``(ui, key, w)``: how a concept's unit of mass falls on topics.

        ``term_topics(term, topic)`` makes the concepts of that name stand for the topic; ``anchors(id, label)``
        makes single concepts stand for a label (null: the concept's name).  A concept that is neither, but
        has tree numbers under such a term, shares equally over all terms on each tree number's path, averaged
        over the tree numbers that have any.  Others take the mean over their parents, leaving out parents
        without any weight; roots have none.  If nothing is configured, or nothing that is resolves, mass goes to the
        parentless concepts by name, in equal parts over all listed parents, existing or not.
        """
        return self._kept("anchor_weights", lambda: self._anchor_weights(term_topics, anchors), term_topics, anchors)

    def _anchor_weights(self, term_topics: DataFrame | None, anchors: DataFrame | None) -> DataFrame:
        direct = None
        override = None
        if term_topics is not None:
            override = settled(self.named(term_topics, "term").groupBy("ui").agg(F.max("topic").alias("key")))
            direct = override
        if anchors is not None:
            labels = self.concepts.select("ui", "name")
            own = self.resolved(anchors, "id").filter("ui is not null").join(labels, "ui").groupBy("ui").agg(F.max(F.coalesce("label", "name")).alias("key"))
            direct = own if direct is None else direct.unionByName(own.join(direct, "ui", "left_anti"))
        if direct is None or settled(direct).isEmpty():
            roots = self.concepts.join(self.parents.select("ui").distinct(), "ui", "left_anti")
            sinks = settled(roots.select(F.col("ui").alias("at"), F.col("name").alias("top"), F.lit(1.0).alias("w")))
            listed = self.parents.groupBy("ui").agg(F.count("*").alias("n"))
            steps = self.edges.groupBy("ui", "parent").agg(F.count("*").alias("k")).join(listed, "ui").select("ui", "parent", (F.col("k") / F.col("n")).alias("w"))
            return self._walk(sinks, True, steps).withColumnRenamed("top", "key")
        fixed = direct.select(F.col("ui").alias("at"), F.col("key").alias("top"), F.lit(1.0).alias("w"))
        if override is not None:
            marks = self.trees.join(override, "ui").select(F.col("tree").alias("prefix"), "key").distinct()
            paths = self.trees.join(direct.select("ui"), "ui", "left_anti").select("ui", "tree", F.explode(tree_prefixes(F.col("tree"))).alias("prefix"))
            hits = paths.join(marks, "prefix").select("ui", "tree", "key")
            each = hits.groupBy("ui", "tree").agg(F.count("*").alias("n"))
            trees = each.groupBy("ui").agg(F.count("*").alias("m"))
            shares = hits.join(each, ["ui", "tree"]).join(trees, "ui").groupBy(F.col("ui").alias("at"), F.col("key").alias("top")).agg(F.sum(1.0 / F.col("n") / F.col("m")).alias("w"))
            fixed = fixed.unionByName(shares)
        sinks = settled(fixed)
        reach = sinks.select(F.col("at").alias("ui")).distinct()
        upward = self.edges.join(reach, "ui", "left_anti")
        reach = settled(reach)
        for _ in range(MOST_LEVELS):
            more = settled(upward.join(reach.withColumnRenamed("ui", "parent"), "parent", "left_semi").select("ui").distinct().join(reach, "ui", "left_anti"))
            if more.isEmpty():
                break
            reach = settled(reach.unionByName(more))
        else:
            raise ValueError(f"more than {MOST_LEVELS} levels")
        kept = upward.join(reach.withColumnRenamed("ui", "parent"), "parent", "left_semi")
        count = kept.groupBy("ui").agg(F.count("*").alias("n"))
        steps = kept.groupBy("ui", "parent").agg(F.count("*").alias("k")).join(count, "ui").select("ui", "parent", (F.col("k") / F.col("n")).alias("w"))
        return self._walk(sinks, True, steps).withColumnRenamed("top", "key")

    def topic_weights(self, terms: DataFrame, column: str, weights: DataFrame) -> DataFrame:
        """``(term, key, w)`` for the distinct terms in ``column``: the mean over the concepts of that name.  Terms and
        result are written, so that the terms are found once and the result is broadcast if it is small."""
        wanted = written(terms.select(F.col(column).alias("term")).distinct(), "terms")
        found = written(self.named(wanted, "term").join(weights, "ui").groupBy("term", "key").agg(F.sum(F.col("share") * F.col("w")).alias("w")), "term-weights")
        removed(wanted)
        return found

    def labels(self) -> DataFrame:
        """``(key, label)``: a concept's name, else the first concept's with that tree number."""
        own = self.concepts.select(F.col("ui").alias("key"), F.col("name").alias("label"))
        by_tree = self.trees.join(self.concepts.select("ui", "name"), "ui").groupBy(F.col("tree").alias("key")).agg(F.min_by("name", "seq").alias("label"))
        return own.unionByName(by_tree.join(own, "key", "left_anti"))

    def treetops(self, names: DataFrame, by: str = "segment") -> DataFrame:
        """``(ui, top)``: names of a concept's tree tops by ``names(code, name)``, looked up by the first dotted
        segment or, with ``by="letter"``, by its first letter; codes without a name give nothing."""
        first = F.substring_index("tree", ".", 1)
        code = F.substring(first, 1, 1) if by == "letter" else first
        heads = self.trees.select("ui", code.alias("code")).distinct()
        return heads.join(names.select("code", F.col("name").alias("top")), "code").select("ui", "top").distinct()

    def totals(self, weights: DataFrame) -> DataFrame:
        """``(key, total)``: the weights of all concepts together."""
        return weights.groupBy("key").agg(F.sum("w").alias("total"))


def _shared(keys: DataFrame) -> DataFrame:
    count = keys.groupBy("ui").agg(F.count("*").alias("n"))
    return keys.groupBy("ui", "key").agg(F.count("*").alias("k")).join(count, "ui").select("ui", "key", (F.col("k") / F.col("n")).alias("w"))


BY = ["target", "scope"]


def _for_each_target(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """``rows`` once for each (target, scope) of ``measured``.  What is broadcast is one row with the pairs of
    configured targets and scopes, however many ``rows`` there are."""
    pairs = measured.select(*BY).distinct().agg(F.collect_list(F.struct(*BY)).alias("_at"))
    return rows.join(F.broadcast(pairs), F.lit(True)).withColumn("_at", F.explode("_at")).select("_at.*", *rows.columns)


def accepted_ids(leaves: DataFrame, terminology: Terminology) -> DataFrame:
    """``(target, scope, id, n)`` of ``leaves(target, scope, identifier, resource)``: ids of accepted resources
    and how often each occurs."""
    kept = leaves.filter(F.col("identifier").isNotNull() & terminology.accepts(F.col("resource")))
    return kept.groupBy(*BY, F.col("identifier").alias("id")).agg(F.count("*").alias("n"))


def counted_leaves(annotations: DataFrame) -> DataFrame:
    """``(corpus, subset, label, id, resource, n)``: how often each identifier is linked, written.  Annotations are read
    once for all terminologies, and counted before targets and scopes multiply them or resources are looked at."""
    flat = annotations.select("corpus", "subset", "label", F.explode("links").alias("leaf")).filter("leaf.identifier is not null")
    counted = flat.groupBy("corpus", "subset", "label", F.col("leaf.identifier").alias("id"), F.col("leaf.resource").alias("resource")).agg(F.count("*").alias("n"))
    return written(counted, "leaves")


def linked_ids(counted: DataFrame, targets: DataFrame, scopes: Mapping[str, Sequence[str]] | None, terminology: Terminology) -> DataFrame:
    """``(target, scope, id, n)``: the identifiers of the terminology's resources in ``counted_leaves``."""
    kept = with_scopes(counted.filter(terminology.accepts(F.col("resource"))), scopes)
    return at_targets(kept, targets).groupBy(*BY, "id").agg(F.sum("n").alias("n"))


def branch_coverage(ids: DataFrame, terminology: Terminology, weights: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Per target, scope and branch (or topic): mass of unique concepts, of mentions, and of the terminology,
    and the two proportions.  ``topics(key)`` are listed even without any mass; then so is every key of the
    terminology.  Ids that don't resolve stay in the mentions' denominator."""
    at = settled(terminology.resolved(ids, "id"))
    total = at.groupBy(*BY).agg(F.sum("n").alias("n_ids"))
    mass = at.groupBy(*BY, "ui").agg(F.sum("n").alias("n")).filter("ui is not null").join(weights, "ui")
    mass = mass.groupBy(*BY, "key").agg(F.sum("w").alias("count"), F.sum(F.col("w") * F.col("n")).alias("annotation_count"))
    whole = terminology.totals(weights)
    if topics is not None:
        keys = whole.select("key").unionByName(topics.select("key")).distinct()
        every = _for_each_target(keys, total)
        mass = every.join(mass, [*BY, "key"], "left")
    rows = mass.join(whole, "key", "left").join(total, BY)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rounded = lambda c: F.round(c, DIGITS)
    return rows.select(
        *BY, "key", rounded(zero("count")).alias("count"), rounded(zero("annotation_count")).alias("annotation_count"), rounded(zero("total")).alias("terminology_total"),
        rounded(F.when(F.col("total") > 0, zero("count") / F.col("total")).otherwise(0.0)).alias("terminology_proportion"),
        rounded(zero("annotation_count") / F.col("n_ids")).alias("annotation_proportion"),
    )


def depth_coverage(ids: DataFrame, terminology: Terminology) -> DataFrame:
    """Per target, scope and depth: mass of all mentions, of the terminology, and the share of the mentions'."""
    weights, ids = settled(terminology.depth_weights()), settled(ids)
    mass = terminology.resolved(ids, "id").filter("ui is not null").join(weights, "ui").groupBy(*BY, F.col("key").alias("depth")).agg(F.sum(F.col("w") * F.col("n")).alias("count"))
    whole = terminology.totals(weights).select(F.col("key").alias("depth"), "total")
    every = _for_each_target(whole, ids)
    rows = every.join(mass, [*BY, "depth"], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    return rows.withColumn("all", F.expr("sum(count) over (partition by target, scope)")).select(
        *BY, "depth", F.round("count", DIGITS).alias("count"), F.round("total", DIGITS).alias("terminology_total"),
        F.round(F.when(F.col("all") > 0, F.col("count") / F.col("all")).otherwise(0.0), DIGITS).alias("share"),
    )


def coverage_summary(ids: DataFrame, terminology: Terminology) -> DataFrame:
    """Per target and scope: ids, distinct concepts (unresolved ids by their normal form) and distinct ids that
    no concept has."""
    at = terminology.resolved(ids, "id").withColumn("concept", F.coalesce("ui", concept_key(F.col("id"))))
    return at.groupBy(*BY).agg(
        F.sum("n").cast("long").alias("n_input_ids"), F.count_distinct("concept").alias("n_unique_ids"), F.count_distinct(F.when(F.col("ui").isNull(), F.col("id"))).alias("n_missing_ids")
    )


def missing_ids(ids: DataFrame, terminology: Terminology) -> DataFrame:
    """``(target, scope, id)``: distinct ids without a concept."""
    return terminology.resolved(ids, "id").filter("ui is null").select(*BY, "id").distinct()
