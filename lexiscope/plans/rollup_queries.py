"""Registered queries of filters, text functions, roll-ups and the streaming profile, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions import text as tx
from lexiscope.operators import metrics as mt
from lexiscope.operators import offsets as of
from lexiscope.operators import records
from lexiscope.operators import rollups as ru
from lexiscope.operators import summaries as sm
from lexiscope.plans import graph_queries as gq
from lexiscope.plans import queries as mq
from lexiscope.plans.frames import Corpus
from lexiscope.plans.storage import written
from lexiscope.plans.targets import AnnotationFilter, target_frame
from lexiscope.sources import tables as tb
from lexiscope.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def _of(name: str) -> str:
    return f"({mq.ORACLES.get(name) or gq.ORACLES[name]})"


def _run(name: str, spark, sf_dir) -> DataFrame:
    return (mq.QUERIES.get(name) or gq.QUERIES[name])(spark, sf_dir)


# --- filters ----------------------------------------------------------------------------------------------

_FILTERS = {
    "labels": AnnotationFilter(labels=frozenset({"R"})), "no_labels": AnnotationFilter(labels=frozenset()), "relations": AnnotationFilter(relations=frozenset({"alternative"})),
    "no_relations": AnnotationFilter(relations=frozenset()), "exact": AnnotationFilter(match_types=frozenset({"exact"})), "unmatched": AnnotationFilter(match_types=frozenset()),
    "both": AnnotationFilter(labels=frozenset({"N", "A"}), match_types=frozenset({"exact", "NIL"})),
}


@query("f01_f03_filtered_mention_counts", f"""{mq._ORDERS}, kept AS (
    SELECT target, 'labels' AS filter FROM mentions WHERE label = 'R' UNION ALL SELECT target, 'relations' FROM mentions WHERE kind <> 'both' UNION ALL SELECT target, 'no_relations' FROM mentions WHERE kind <> 'both'
    UNION ALL SELECT target, 'exact' FROM mentions WHERE kind = 'none' OR (kind <> 'nil' AND match_type = 'exact') UNION ALL SELECT target, 'unmatched' FROM mentions WHERE kind = 'none'
    UNION ALL SELECT target, 'both' FROM mentions WHERE label IN ('N', 'A') AND (kind IN ('none', 'nil') OR match_type = 'exact')),
    n AS (SELECT filter, target, count(*) AS c FROM kept GROUP BY ALL)
    SELECT filter, target, CAST(coalesce(c, 0) AS BIGINT) AS value FROM (SELECT unnest(['labels', 'no_labels', 'relations', 'no_relations', 'exact', 'unmatched', 'both']) AS filter) CROSS JOIN (SELECT DISTINCT target FROM names) LEFT JOIN n USING (filter, target)""")
def filtered_mention_counts(spark, sf_dir):
    corpus = tb.order_corpus(spark, sf_dir)
    targets = target_frame(spark, mq.ORDER_TARGETS)
    out = None
    for name, where in _FILTERS.items():
        one = mt.mention_count(corpus, targets, None, where).select(F.lit(name).alias("filter"), "target", "value")
        out = one if out is None else out.unionByName(one)
    return out


# --- text functions ---------------------------------------------------------------------------------------


@query("s01_tokens", r"SELECT doc_id, regexp_extract_all(lower(replace(text, '_', ' ')), '[\p{L}\p{N}_]+') AS tokens FROM documents")
def token_lists(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query("s03_sentences", r"SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS sentences FROM documents")
def sentence_lists(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("sentences"))


@query("s04_clean_text", r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM documents")
def cleaned(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select("doc_id", tx.clean(F.col("text")).alias("text"))


@query("s07_identifier_normal_forms", """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderkey AS VARCHAR) AS t, o_orderkey % 9 AS m FROM orders)
    SELECT k, CASE WHEN m < 2 THEN 'pmid' WHEN m < 5 THEN 'pmcid' WHEN m < 8 THEN 'doi' ELSE 'other' END AS kind,
        CASE m WHEN 0 THEN t WHEN 2 THEN 'PMC' || t WHEN 3 THEN 'PMC' || t WHEN 5 THEN '10.1/ab' || t WHEN 6 THEN '10.2/c' || t END AS normal FROM o""")
def identifier_forms(spark, sf_dir):
    """Order keys written as identifiers are found in the wild, by nine patterns."""
    k, m = F.col("k").cast("string"), F.col("k") % 9
    kind = F.when(m < 2, "pmid").when(m < 5, "pmcid").when(m < 8, "doi").otherwise("other")
    forms = {0: F.concat(F.lit(" "), k), 1: F.concat(F.lit("PMID:"), k), 2: k, 3: F.concat(F.lit("pmc"), k), 4: F.concat(F.lit("x"), k), 5: F.concat(F.lit("https://doi.org/10.1/AB"), k), 6: F.concat(F.lit("doi: 10.2/C"), k), 7: F.lit(""), 8: k}
    given = F.coalesce(*(F.when(m == n, form) for n, form in forms.items()))
    return tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")).select("k", kind.alias("kind"), tx.normal_identifier(kind, given).alias("normal"))


@query("j14_corpus_keys", """SELECT n.source || n.suffix AS name, n.source AS key, CASE WHEN CAST(substring(n.source, 4) AS INTEGER) % 2 = 0 THEN upper(n.source) || '-_train' END AS result
    FROM (SELECT DISTINCT source, CASE doc_id % 5 WHEN 0 THEN '_corpus' WHEN 1 THEN '_train' WHEN 2 THEN '_test' WHEN 3 THEN '_dev' ELSE '' END AS suffix FROM documents) n""")
def corpus_keys(spark, sf_dir):
    """Sources with the suffixes of their splits, and the results that stand under another spelling of every second one."""
    docs = tb.read(spark, sf_dir, "documents")
    m = F.col("doc_id") % 5
    suffix = F.when(m == 0, "_corpus").when(m == 1, "_train").when(m == 2, "_test").when(m == 3, "_dev").otherwise("")
    names = docs.select(F.concat("source", suffix).alias("name")).distinct().withColumn("key", tx.corpus_key(F.col("name")))
    results = docs.filter(F.substring("source", 4, 9).cast("int") % 2 == 0).select(F.concat(F.upper("source"), F.lit("-_train")).alias("result")).distinct().withColumn("key", tx.corpus_key(F.col("result")))
    return names.join(results, "key", "left").select("name", "key", "result")


_SPANS = """spans AS (SELECT doc_id, k, 37 * k AS s, least(37 * k + 1 + (7 * k) % 90, n) AS e FROM (SELECT doc_id, n, unnest(range(CAST(ceil(n / 37.0) AS BIGINT))) AS k FROM (SELECT doc_id, length(text) AS n FROM documents)))"""


@query("j13_spans_by_offset", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
    p AS (SELECT doc_id, no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l), {_SPANS}
    SELECT CAST(s.doc_id AS BIGINT) AS doc_id, s.k, CAST(a.no AS INTEGER) AS passage_no, CAST(b.no AS INTEGER) AS last_passage_no, CAST(s.s - a.o AS BIGINT) AS inner_start FROM spans s
    LEFT JOIN p a ON a.doc_id = s.doc_id AND s.s >= a.o AND s.s < a.o + length(a.line) LEFT JOIN p b ON b.doc_id = s.doc_id AND s.e - 1 >= b.o AND s.e - 1 < b.o + length(b.line)""")
def spans_by_offset(spark, sf_dir):
    """A span every 37 characters of each document, of 1 to 90 characters, and the lines that it begins and ends in."""
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = F.length("text")
    ks = docs.filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / 37) - 1)).alias("k"))
    spans = ks.select("doc_id", "k", (F.col("k") * 37).alias("start"), F.least(F.col("k") * 37 + 1 + F.col("k") * 7 % 90, F.col("n")).alias("end"))
    return of.located(spans, of.line_offsets(docs, ["doc_id"]), ["doc_id"]).select("doc_id", "k", "passage_no", "last_passage_no", "inner_start")


@query("j08_tree_prefixes", "SELECT 'R' || n_regionkey || '.N' || n_nationkey AS tree, unnest(['R' || n_regionkey || '.N' || n_nationkey, 'R' || n_regionkey]) AS prefix FROM nation")
def tree_prefixes(spark, sf_dir):
    nation = tb.read(spark, sf_dir, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(".N"), F.col("n_nationkey").cast("string")).alias("tree"))
    return nation.select("tree", F.explode(tx.tree_prefixes(F.col("tree"))).alias("prefix"))


# --- records ----------------------------------------------------------------------------------------------


@query("r01_upsert", """SELECT c_custkey + 1 AS record_id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN ['old', 'new'] ELSE ['old'] END AS tags FROM customer""")
def upserted(spark, sf_dir):
    customer = tb.read(spark, sf_dir, "customer")
    ids = F.create_map(F.lit("key"), F.array(F.col("c_custkey").cast("string")))
    store = customer.select((F.col("c_custkey") + 1).alias("record_id"), ids.alias("identifiers"), F.col("c_name").alias("title"), F.array(F.lit("old")).alias("tags"))
    rows = customer.filter("c_custkey % 3 = 0").select(ids.alias("identifiers"), F.upper("c_name").alias("title"), F.array(F.lit("old"), F.lit("new")).alias("tags"))
    return records.upsert(store, rows, {"title": "replace", "tags": "set_union"}).select("record_id", "title", "tags")


@query("r03_lookup", "SELECT c_custkey + 1 AS record_id, c_name AS title FROM customer WHERE c_custkey = 7")
def looked_up(spark, sf_dir):
    customer = tb.read(spark, sf_dir, "customer")
    store = customer.select((F.col("c_custkey") + 1).alias("record_id"), F.create_map(F.lit("key"), F.array(F.col("c_custkey").cast("string"))).alias("identifiers"), F.col("c_name").alias("title"))
    return records.get(store, "key", "7").select("record_id", "title")


# --- roll-ups ---------------------------------------------------------------------------------------------

_STATUS = f"""SELECT target, scope, CASE WHEN sum(proportion) FILTER (key NOT IN ('null', '<NIL>')) IS NULL THEN 'none' WHEN coalesce(sum(proportion) FILTER (key IN ('null', '<NIL>')), 0) > 0.05 THEN 'partial' ELSE 'full' END AS status
    FROM {_of('m37_identifier_resource_distribution')} GROUP BY target, scope"""
_ENTROPY = f"SELECT target, scope, abs(round(sum(proportion * log2(proportion)), 2)) AS entropy FROM {_of('m36_label_distribution')} GROUP BY target, scope"


@query("s19_label_entropy", _ENTROPY)
def label_entropy(spark, sf_dir):
    return ru.entropy(_run("m36_label_distribution", spark, sf_dir), ["target", "scope"])


@query("d03_identifier_status", _STATUS)
def identifier_status(spark, sf_dir):
    return ru.identifier_status(_run("m37_identifier_resource_distribution", spark, sf_dir))


@query("d02_corpus_summary", f"""WITH docs_of AS (SELECT 'orders' AS target, count(*) AS n FROM orders UNION ALL SELECT CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END, count(*) FROM orders GROUP BY 1),
    lab AS (SELECT target, scope, CAST(sum(count) AS BIGINT) AS n_mentions, count(*) AS n_labels FROM {_of('m36_label_distribution')} GROUP BY ALL)
    SELECT a.target, a.scope, round(a.mean, 2) AS mentions_per_document, d.n AS n_documents, lab.n_mentions, lab.n_labels, e.entropy, round(b.mean, 3) AS ambiguity, s.status
    FROM {_of('m11_annotations_per_document_stats')} a JOIN docs_of d USING (target) JOIN lab USING (target, scope) JOIN ({_ENTROPY}) e USING (target, scope) JOIN {_of('m30_ambiguity_degree_stats')} b USING (target, scope) JOIN ({_STATUS}) s USING (target, scope)""")
def corpus_summary(spark, sf_dir):
    counts = mt.document_count(tb.order_corpus(spark, sf_dir), target_frame(spark, mq.ORDER_TARGETS))
    get = lambda n: _run(n, spark, sf_dir)
    return ru.corpus_summary(counts, get("m36_label_distribution"), get("m11_annotations_per_document_stats"), get("m30_ambiguity_degree_stats"), get("m37_identifier_resource_distribution"))


@query("d05_overlap_summary", f"""WITH o AS (SELECT 't' AS k, * FROM {_of('m44_token_overlap')} UNION ALL SELECT 'm', * FROM {_of('m45_mention_overlap')} UNION ALL SELECT 'w', * FROM {_of('m46_mention_token_overlap')} UNION ALL SELECT 'i', * FROM {_of('m47_identifier_overlap')})
    SELECT target1, target2, scope, max(round(jaccard * 100, 2)) FILTER (k = 't') AS token_overlap, max(round(jaccard * 100, 2)) FILTER (k = 'm') AS mention_overlap, max(round(jaccard * 100, 2)) FILTER (k = 'w') AS mention_token_overlap,
        max(round(jaccard * 100, 2)) FILTER (k = 'i') AS identifier_overlap, max(n1) FILTER (k = 't') AS n1, max(n2) FILTER (k = 't') AS n2 FROM o GROUP BY target1, target2, scope""")
def overlap_summary(spark, sf_dir):
    out = None
    for name in ("m44_token_overlap", "m45_mention_overlap", "m46_mention_token_overlap", "m47_identifier_overlap"):
        one = _run(name, spark, sf_dir).withColumn("metric", F.lit(name[4:]))
        out = one if out is None else out.unionByName(one)
    return ru.overlap_summary(out)


@query("d06_journal_summary", f"""SELECT target, count(*) AS n_journals, round(sum(proportion) FILTER (r <= 1) * 100, 1) AS top1, round(sum(proportion) FILTER (r <= 3) * 100, 1) AS top3
    FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY proportion DESC, key) AS r FROM {_of('m39_journal_distribution')} WHERE key <> 'Unknown') GROUP BY target""")
def journal_summary(spark, sf_dir):
    return ru.journal_summary(_run("m39_journal_distribution", spark, sf_dir))


@query("d06_year_summary", f"""SELECT target, min(y) AS first, max(y) AS last, max(y) - min(y) AS span, arg_max(y, (proportion, -y)) AS mode
    FROM (SELECT target, CAST(key AS INT) AS y, proportion FROM {_of('m43_publication_year_distribution')}) GROUP BY target""")
def year_summary(spark, sf_dir):
    return ru.year_summary(_run("m43_publication_year_distribution", spark, sf_dir))


@query("d06_decade_shares", f"SELECT target, CAST(CAST(key AS INT) // 10 * 10 AS INT) AS decade, round(sum(proportion) * 100, 1) AS percent FROM {_of('m43_publication_year_distribution')} GROUP BY ALL")
def decade_shares(spark, sf_dir):
    return ru.decade_shares(_run("m43_publication_year_distribution", spark, sf_dir))


@query("d07_terminology_summary", f"""SELECT target, scope, round(n_missing_ids / n_input_ids * 100, 2) AS missing, coverage, mean_depth FROM {_of('d07_coverage_summary')}
    JOIN (SELECT target, scope, round(sum(count) / sum(terminology_total) * 100, 2) AS coverage FROM {_of('m48_high_level_concept_counts')} GROUP BY ALL) USING (target, scope)
    JOIN (SELECT target, scope, round(sum(depth * count) / sum(count), 2) AS mean_depth FROM {_of('m49_concept_depth_counts')} GROUP BY ALL) USING (target, scope)""")
def terminology_summary(spark, sf_dir):
    """All three parts from leaves that are counted once; two of them from the same ids."""
    counted = gq.leaves(spark, sf_dir)
    of_parts = written(gq.ids(spark, sf_dir, gq.parts(spark, sf_dir), counted), "part-ids")
    of_places = gq.ids(spark, sf_dir, gq.places(spark, sf_dir), counted)
    return ru.coverage_summary(gq.high_level_concept_counts(spark, sf_dir, of_parts), gq.concept_depth_counts(spark, sf_dir, of_places), gq.coverage_summary(spark, sf_dir, of_parts))


@query("d08_scope_summary", f"""WITH lab AS (SELECT target, scope, count(*) AS n_types, CAST(sum(count) AS BIGINT) AS n_annotations FROM {_of('m36_label_distribution')} GROUP BY ALL)
    SELECT a.target, a.scope, lab.n_types, lab.n_annotations, e.entropy, round(a.mean, 2) AS annotations_per_document, round(k.mean, 2) AS annotations_per_1000_tokens, round(m.mean, 2) AS mentions_per_document,
        round(i.mean, 2) AS identifiers_per_document, round(b.mean, 3) AS ambiguity, CASE WHEN s.status <> 'none' THEN v.mean END AS variation, s.status
    FROM {_of('m11_annotations_per_document_stats')} a JOIN {_of('m12_annotations_per_1000_tokens_stats')} k USING (target, scope) JOIN {_of('m13_unique_mentions_per_document_stats')} m USING (target, scope)
    JOIN {_of('m14_unique_identifiers_per_document_stats')} i USING (target, scope) JOIN {_of('m30_ambiguity_degree_stats')} b USING (target, scope) JOIN {_of('m29_variation_degree_stats')} v USING (target, scope)
    JOIN lab USING (target, scope) JOIN ({_ENTROPY}) e USING (target, scope) JOIN ({_STATUS}) s USING (target, scope)""")
def scope_summary(spark, sf_dir):
    """Every figure from one summary of the corpus, whose tables are read instead of it."""
    summary = sm.summarised(tb.order_corpus(spark, sf_dir), mq.SCOPES, ("profiles", "mentions"))
    return ru.scope_summary(summary, target_frame(spark, mq.ORDER_TARGETS), mq.SCOPES)


@query("d08_merged_statistics", f"SELECT * FROM {_of('m11_annotations_per_document_stats')}")
def merged_statistics(spark, sf_dir):
    """Annotations per document by scope, from the added summaries of three parts of the corpus."""
    whole = tb.order_corpus(spark, sf_dir)
    part = lambda k: (F.pmod(F.xxhash64("document_id"), F.lit(3)) == k)
    parts = [sm.summarised(Corpus(whole.documents.filter(part(k)), whole.passages.filter(part(k)), whole.annotations.filter(part(k))), None, ("profiles",)) for k in range(3)]
    return mt.annotations_per_document_stats(parts[0].union(parts[1]).union(parts[2]), target_frame(spark, mq.ORDER_TARGETS), mq.SCOPES)


@query("d09_entity_profiles", f"""SELECT target, scope, key AS label, count, CAST(row_number() OVER w AS INT) AS place, round(proportion * 100, 1) AS percent, round(sum(proportion) OVER (PARTITION BY target, scope ORDER BY count DESC, key ROWS UNBOUNDED PRECEDING) * 100, 1) AS running
    FROM {_of('m36_label_distribution')} WINDOW w AS (PARTITION BY target, scope ORDER BY count DESC, key)""")
def entity_profiles(spark, sf_dir):
    return ru.entity_profiles(_run("m36_label_distribution", spark, sf_dir))


@query("d10_topic_heat_map", f"""WITH t AS (SELECT * FROM {_of('m42_article_mesh_topic_distribution')}), s AS (SELECT key, row_number() OVER (ORDER BY CASE key WHEN 'size' THEN 1 WHEN 'price' THEN 2 ELSE 3 END, key) AS place FROM t GROUP BY key HAVING max(proportion) >= 0.01)
    SELECT target, key AS topic, round(coalesce(proportion, 0) * 100, 1) AS percent, CAST(place AS INT) AS place FROM (SELECT DISTINCT target FROM t) CROSS JOIN s LEFT JOIN t USING (target, key)""")
def topic_heat_map(spark, sf_dir):
    return ru.topic_heat_map(_run("m42_article_mesh_topic_distribution", spark, sf_dir), ["size", "price"])


@query("d12_branch_profiles", f"""WITH b AS (SELECT * FROM {_of('m48_high_level_concept_counts')}), p AS (SELECT scope, key, row_number() OVER (PARTITION BY scope ORDER BY sum(annotation_proportion) DESC, key) AS place FROM b GROUP BY scope, key)
    SELECT 'parts' AS terminology, scope, target, key, CAST(place AS INT) AS place, round(annotation_proportion * 100, 2) AS percent FROM b JOIN p USING (scope, key)""")
def branch_profiles(spark, sf_dir):
    return ru.branch_profiles(_run("m48_high_level_concept_counts", spark, sf_dir), "parts")


@query("d14_result_changes", f"SELECT *, 'new' AS side FROM {_of('m36_label_distribution')} WHERE scope = 'open'")
def result_changes(spark, sf_dir):
    new = _run("m36_label_distribution", spark, sf_dir)
    return ru.changes(new.filter("scope != 'open'"), new)


@query("d14_keyed_changes", f"""WITH m AS {_of('m36_label_distribution')}, a AS (SELECT * FROM m WHERE target = 'train' AND scope <> 'open'), b AS (SELECT * FROM m WHERE target = 'test' AND scope <> 'returned')
    SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN a.key IS NULL OR b.key IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN a.count <> b.count THEN 'count' END, CASE WHEN a.proportion <> b.proportion THEN 'proportion' END], lambda x: x IS NOT NULL) END AS fields
    FROM a FULL JOIN b ON a.scope = b.scope AND a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.count <> b.count OR a.proportion <> b.proportion""")
def keyed_changes(spark, sf_dir):
    """From the labels of one subset to those of another, each without one scope."""
    rows = _run("m36_label_distribution", spark, sf_dir)
    old, new = rows.filter("target = 'train' AND scope <> 'open'").drop("target"), rows.filter("target = 'test' AND scope <> 'returned'").drop("target")
    return ru.keyed_changes(old, new, ["scope", "key"])


# --- streaming and windows --------------------------------------------------------------------------------


@query("x01_source_profile", r"""SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars,
    CAST(sum(len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda s: s <> ''))) AS BIGINT) AS sentences,
    CAST(sum(len(regexp_extract_all(lower(replace(text, '_', ' ')), '[\p{L}\p{N}_]+'))) AS BIGINT) AS tokens FROM documents GROUP BY source""")
def source_profile(spark, sf_dir):
    return refresh.profile(tb.read(spark, sf_dir, "documents"))


@query("x02_windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    out = refresh.windowed_events(tb.read(spark, sf_dir, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
