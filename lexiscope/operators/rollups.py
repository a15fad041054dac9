"""Second-level queries over result frames: summaries per corpus, overlaps, metadata, coverage, heat maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.operators.metrics import METRICS
from lexiscope.plans.frames import Corpus
from lexiscope.plans.targets import ALL

UNKNOWN = "Unknown"
BY = ["target", "scope"]


def entropy(shares: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, entropy)`` in bits over positive proportions, two digits."""
    p = F.col("proportion")
    return shares.groupBy(*keys).agg(F.round(-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)), 2).alias("entropy"))


def identifier_status(resources: DataFrame) -> DataFrame:
    """``(target, scope, status)``: none without identifiers, partial where null and NIL have over a twentieth,
    else full."""
    lacking = F.sum(F.when(F.col("key").isin("null", "<NIL>"), F.col("proportion")).otherwise(0.0))
    named = F.sum(F.when(~F.col("key").isin("null", "<NIL>"), F.col("proportion")).otherwise(0.0))
    got = resources.groupBy(*BY).agg(lacking.alias("lacking"), named.alias("named"))
    return got.select(*BY, F.when(F.col("named") == 0, "none").when(F.col("lacking") > 0.05, "partial").otherwise("full").alias("status"))


def corpus_summary(counts: DataFrame, labels: DataFrame, per_document: DataFrame, ambiguity: DataFrame, resources: DataFrame) -> DataFrame:
    """One row per target and scope: documents, mentions, entity types, label entropy, mentions per document (two
    digits), ambiguity (three digits), identifier status."""
    mentions = labels.groupBy(*BY).agg(F.sum("count").alias("n_mentions"), F.count("*").alias("n_labels"))
    out = per_document.select(*BY, F.round("mean", 2).alias("mentions_per_document"))
    out = out.join(counts.select("target", F.col("value").alias("n_documents")), "target", "left").join(mentions, BY, "left").join(entropy(labels, BY), BY, "left")
    out = out.join(ambiguity.select(*BY, F.round("mean", 3).alias("ambiguity")), BY, "left").join(identifier_status(resources), BY, "left")
    filled = F.coalesce("n_mentions", F.round(F.col("mentions_per_document") * F.col("n_documents")).cast("long"), F.lit(0))
    return out.withColumn("n_mentions", filled).withColumn("status", F.coalesce("status", F.lit("none"))).withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))


def scope_summary(summary: Corpus, targets: DataFrame, scopes: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per target and scope, all figures recomputed from a summary: entity types, annotations, their label
    entropy; annotations per document and per 1000 tokens, distinct mentions and identifiers per document (two
    digits); ambiguity (three digits); variation where there are identifiers; identifier status.  A scope without
    annotations has no row, the scope ``all`` always has one."""
    get = lambda name: METRICS[name].run(summary, targets, scopes)
    mean = lambda name, digits, to: get(name).select(*BY, (F.round("mean", digits) if digits else F.col("mean")).alias(to))
    labels = get("label_distribution")
    out = get("annotations_per_document_stats").select(*BY, F.round("mean", 2).alias("annotations_per_document"))
    for name, digits, to in (("annotations_per_1000_tokens_stats", 2, "annotations_per_1000_tokens"), ("unique_mentions_per_document_stats", 2, "mentions_per_document"),
                             ("unique_identifiers_per_document_stats", 2, "identifiers_per_document"), ("ambiguity_degree_stats", 3, "ambiguity"), ("variation_degree_stats", None, "variation")):
        out = out.join(mean(name, digits, to), BY, "left")
    counts = labels.groupBy(*BY).agg(F.count("*").alias("n_types"), F.sum("count").alias("n_annotations"))
    out = out.join(counts, BY, "left").join(entropy(labels, BY), BY, "left").join(identifier_status(get("identifier_resource_distribution")), BY, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_types", "n_annotations")}
    out = out.withColumns(zero).withColumn("status", F.coalesce("status", F.lit("none"))).withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))
    return out.withColumn("variation", F.when(F.col("status") != "none", F.col("variation"))).filter((F.col("scope") == ALL) | (F.col("n_annotations") > 0))


def overlap_summary(overlaps: DataFrame) -> DataFrame:
    """``overlaps(metric, target1, target2, scope, n1, n2, ..., jaccard)``: one row per pair with a column of
    percentages per metric; the split sizes are those of the token vocabularies."""
    pairs = ["target1", "target2", "scope"]
    kinds = ["token_overlap", "mention_overlap", "mention_token_overlap", "identifier_overlap"]
    value = lambda k: F.max(F.when(F.col("metric") == k, F.round(F.col("jaccard") * 100, 2))).alias(k)
    size = lambda c: F.max(F.when(F.col("metric") == "token_overlap", F.col(c))).alias(c)
    return overlaps.groupBy(*pairs).agg(*map(value, kinds), size("n1"), size("n2"))


def journal_summary(journals: DataFrame) -> DataFrame:
    """Per target: number of known journals and the shares of the first and the first three of them."""
    known = journals.filter(F.col("key") != UNKNOWN)
    ranked = known.withColumn("place", F.row_number().over(W.partitionBy("target").orderBy(F.desc("proportion"), "key")))
    top = lambda k: F.round(F.sum(F.when(F.col("place") <= k, F.col("proportion"))) * 100, 1)
    return ranked.groupBy("target").agg(F.count("*").alias("n_journals"), top(1).alias("top1"), top(3).alias("top3"))


def year_summary(years: DataFrame) -> DataFrame:
    """Per target: first and last known year, the span, and the most frequent year."""
    known = years.withColumn("year", F.col("key").try_cast("int")).filter("year is not null")
    mode = F.max_by("year", F.struct("proportion", -F.col("year")))
    return known.groupBy("target").agg(F.min("year").alias("first"), F.max("year").alias("last"), (F.max("year") - F.min("year")).alias("span"), mode.alias("mode"))


def decade_shares(years: DataFrame) -> DataFrame:
    known = years.withColumn("year", F.col("key").try_cast("int")).filter("year is not null")
    return known.groupBy("target", (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.round(F.sum("proportion") * 100, 1).alias("percent"))


def coverage_summary(branches: DataFrame, depths: DataFrame, counts: DataFrame) -> DataFrame:
    """Per target and scope: covered share of the terminology, share of ids that are missing, mean depth.

    Missing ids are counted once, input ids each time, as the counts frame has them."""
    covered = branches.groupBy(*BY).agg(F.round(F.sum("count") / F.sum("terminology_total") * 100, 2).alias("coverage"))
    deep = depths.groupBy(*BY).agg(F.round(F.sum(F.col("depth") * F.col("count")) / F.sum("count"), 2).alias("mean_depth"))
    missing = F.round(F.col("n_missing_ids") / F.col("n_input_ids") * 100, 2)
    return counts.select(*BY, missing.alias("missing")).join(covered, BY, "left").join(deep, BY, "left")


def topic_heat_map(topics: DataFrame, configured: list[str], least: float = 0.01) -> DataFrame:
    """``(target, topic, percent, place)`` of topics that reach ``least`` in some target: configured ones in their
    order, then the others by name."""
    strong = topics.groupBy("key").agg(F.max("proportion").alias("m")).filter(F.col("m") >= least)
    order = F.array_position(F.array(*map(F.lit, configured)), F.col("key")) if configured else F.lit(0)
    ranked = strong.withColumn("at", F.when(order == 0, len(configured) + 1).otherwise(order))
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("at", "key")))
    # One row with the configured targets is broadcast, however many topics there are.
    targets = topics.select("target").distinct().agg(F.collect_list("target").alias("targets"))
    grid = ranked.join(F.broadcast(targets), F.lit(True)).select(F.explode("targets").alias("target"), "key", "place")
    return grid.join(topics.select("target", "key", "proportion"), ["target", "key"], "left").select("target", F.col("key").alias("topic"), F.round(F.coalesce("proportion", F.lit(0.0)) * 100, 1).alias("percent"), "place")


def branch_profiles(branches: DataFrame, terminology: str) -> DataFrame:
    """Branches of one terminology by scope and target, in the order of their summed mention shares."""
    total = branches.groupBy("scope", "key").agg(F.sum("annotation_proportion").alias("all"))
    place = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("all"), "key"))
    return branches.join(total.withColumn("place", place), ["scope", "key"]).select(F.lit(terminology).alias("terminology"), "scope", "target", "key", "place", F.round(F.col("annotation_proportion") * 100, 2).alias("percent"))


def entity_profiles(labels: DataFrame) -> DataFrame:
    """Labels of each target and scope by count, with their percentage and the running percentage."""
    by = W.partitionBy(*BY).orderBy(F.desc("count"), "key")
    return labels.select(*BY, F.col("key").alias("label"), "count", F.row_number().over(by).alias("place"), F.round(F.col("proportion") * 100, 1).alias("percent"), F.round(F.sum("proportion").over(by) * 100, 1).alias("running"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two result frames of one schema that are in only one of them, with the side they are on."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def keyed_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, change, fields)``: rows ``added``, ``removed`` or ``changed`` by key, and the names of the fields that
    differ.  NaN equals NaN and null equals null; a field that one side lacks, or has in another type, differs in every row
    of both.  Equal rows are left out.  A key that stands twice on one side is an error."""
    one, two = dict(old.dtypes), dict(new.dtypes)
    sides = []
    for df, mark in ((old, "_a"), (new, "_b")):
        n = F.count("*").over(W.partitionBy(*keys))
        once = F.when(n > 1, F.raise_error(F.lit("a key stands twice"))).otherwise(True)
        sides.append(df.select(*keys, *(F.col(f"`{c}`").alias(f"{mark}_{c}") for c in df.columns if c not in keys), once.cast("boolean").alias(mark)))
    both = sides[0].join(sides[1], keys, "full")
    same = lambda c: F.col(f"`_a_{c}`").eqNullSafe(F.col(f"`_b_{c}`")) if one.get(c) == two.get(c) else F.lit(False)
    fields = F.array_compact(F.array(*(F.when(~same(c), F.lit(c)) for c in sorted((set(one) | set(two)) - set(keys)))))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(fields) > 0, "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", fields).otherwise(F.array().cast("array<string>")).alias("fields")).filter("change IS NOT NULL")
