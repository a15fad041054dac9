"""Registered queries of the metrics over the plain tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators.metrics import METRICS
from lexiscope.plans.targets import target_frame
from lexiscope.sources.tables import order_corpus, text_corpus

TEXT_TARGETS = {
    "train": [("documents", "train")], "test": [("documents", "test")], "documents": [("documents", None)],
    "everything": [("documents", "train"), ("documents", "test"), ("benchmark", None), ("conversations", None)], "nothing": [("absent", None)],
}
TEXT_PAIRS = [("train", "test"), ("documents", "everything")]
ORDER_TARGETS = {"train": [("orders", "train")], "dev": [("orders", "dev")], "test": [("orders", "test")], "orders": [("orders", None)]}
ORDER_PAIRS = [("train", "test"), ("dev", "test")]
SCOPES = {"returned": ["R"], "open": ["N", "A"], "unlabelled": []}

# --- SQL --------------------------------------------------------------------------------------------------

_TEXT = r"""
WITH targets(target, corpus, subset) AS (VALUES ('train', 'documents', 'train'), ('test', 'documents', 'test'), ('documents', 'documents', NULL),
    ('everything', 'documents', 'train'), ('everything', 'documents', 'test'), ('everything', 'benchmark', NULL), ('everything', 'conversations', NULL), ('nothing', 'absent', NULL)),
pairs(target1, target2) AS (VALUES ('train', 'test'), ('documents', 'everything')),
names AS (SELECT DISTINCT target FROM targets),
passages0 AS (
    SELECT 'documents' AS corpus, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS subset, CAST(doc_id AS VARCHAR) AS document_id, unnest(string_split(text, chr(10))) AS text FROM documents
    UNION ALL SELECT 'benchmark', 'heldout', CAST(item_id AS VARCHAR), unnest(string_split(text, chr(10))) FROM benchmark
    UNION ALL SELECT 'conversations', 'chat', CAST(conv_id AS VARCHAR), text FROM conversations),
passages AS (SELECT t.target, p.corpus, p.document_id, p.text FROM passages0 p JOIN targets t ON t.corpus = p.corpus AND (t.subset IS NULL OR t.subset = p.subset)),
sized AS (
    SELECT *, length(text) AS chars, regexp_extract_all(lower(replace(text, '_', ' ')), '[\p{L}\p{N}_]+') AS tokens,
        list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS sentences
    FROM passages),
docs AS (SELECT target, corpus, document_id, count(*) AS passages, sum(chars) AS chars, sum(len(tokens)) AS tokens, sum(len(sentences)) AS sentences FROM sized GROUP BY ALL)
"""

_ORDERS = r"""
WITH targets(target, subset) AS (VALUES ('train', 'train'), ('dev', 'dev'), ('test', 'test'), ('orders', NULL)),
pairs(target1, target2) AS (VALUES ('train', 'test'), ('dev', 'test')),
scopes(scope, label) AS (VALUES ('all', 'R'), ('all', 'N'), ('all', 'A'), ('returned', 'R'), ('open', 'N'), ('open', 'A')),
names AS (SELECT DISTINCT target, scope FROM targets, scopes),
docs AS (SELECT t.target, o_orderkey AS document_id, len(regexp_extract_all(lower(replace(concat_ws(' ', o_orderpriority, o_orderstatus), '_', ' ')), '[\p{L}\p{N}_]+')) AS tokens
    FROM orders JOIN targets t ON t.subset IS NULL OR t.subset = CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END),
items AS (
    SELECT t.target, l_orderkey AS document_id, concat_ws(' ', p_name, lower(l_linestatus)) AS text, l_returnflag AS label, 1 + l_linenumber % 2 AS spans,
        CASE WHEN l_tax = 0 THEN 'none' WHEN l_quantity >= 49 THEN 'nil' WHEN l_discount >= 0.09 THEN 'both' ELSE 'part' END AS kind,
        CAST(l_partkey AS VARCHAR) AS part_id, p_brand, CAST(l_suppkey AS VARCHAR) AS supp_id, CASE l_linestatus WHEN 'F' THEN 'exact' ELSE 'related' END AS match_type
    FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN targets t ON t.subset IS NULL OR t.subset = CASE l_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END),
mentions AS (
    SELECT *, regexp_extract_all(lower(replace(text, '_', ' ')), '[\p{L}\p{N}_]+') AS tokens, CASE kind WHEN 'none' THEN 0 WHEN 'both' THEN 2 ELSE 1 END AS links,
        CASE kind WHEN 'none' THEN 'None' WHEN 'nil' THEN 'NIL' WHEN 'part' THEN concat_ws('|', part_id, p_brand, match_type)
            ELSE 'distributive(' || concat_ws('|', part_id, p_brand, match_type) || ';' || concat_ws('|', supp_id, 'supplier', match_type) || ')' END AS link_key
    FROM items),
leaves AS (
    SELECT target, document_id, label, part_id AS identifier, p_brand AS resource, match_type FROM mentions WHERE kind IN ('part', 'both')
    UNION ALL SELECT target, document_id, label, supp_id, 'supplier', match_type FROM mentions WHERE kind = 'both'
    UNION ALL SELECT target, document_id, label, NULL, '<NIL>', 'NIL' FROM mentions WHERE kind = 'nil')
"""

_STATS = (
    "round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS stdev, CAST(min(value) AS DOUBLE) AS min, round(median(value), 8) AS median, "
    "round(CAST(max(value) AS DOUBLE), 8) AS max, count(value) AS count"
)


def _scalar(base: str, value: str, table: str) -> str:
    names = "names" if base is _TEXT else "(SELECT DISTINCT target FROM names)"
    return f"{base} SELECT target, 'all' AS scope, CAST(coalesce(v, 0) AS BIGINT) AS value FROM {names} LEFT JOIN (SELECT target, {value} AS v FROM {table} GROUP BY target) USING (target)"


def _stats(base: str, values: str, scoped: bool = False) -> str:
    """``values``: a query for (target[, scope], value)."""
    if scoped:
        return f"{base}, vals AS ({values}) SELECT target, scope, {_STATS} FROM names LEFT JOIN vals USING (target, scope) GROUP BY target, scope"
    names = "names" if base is _TEXT else "(SELECT DISTINCT target FROM names)"
    return f"{base}, vals AS ({values}) SELECT target, 'all' AS scope, {_STATS} FROM {names} LEFT JOIN vals USING (target) GROUP BY target"


def _per_doc(value: str, table: str = "mentions") -> str:
    return f"""SELECT d.target, n.scope, CAST(coalesce(v, 0) AS DOUBLE) AS value, d.tokens FROM docs d JOIN names n USING (target)
        LEFT JOIN (SELECT target, document_id, scope, {value} AS v FROM {table} JOIN scopes USING (label) GROUP BY ALL) c USING (target, document_id, scope)"""


def _distribution(base: str, key: str, table: str, scoped: bool = True) -> str:
    scope, join = ("scope", "JOIN scopes USING (label)") if scoped else ("'all' AS scope", "")
    return f"""{base}, counted AS (SELECT target, {scope}, coalesce(CAST({key} AS VARCHAR), 'null') AS key, count(*) AS count FROM {table} {join} GROUP BY ALL)
        SELECT *, round(count / sum(count) OVER (PARTITION BY target, scope), 8) AS proportion FROM counted"""


def _overlap(base: str, keys: str) -> str:
    return f"""{base}, k AS (SELECT DISTINCT * FROM ({keys})),
        sides AS (SELECT target1, target2, 1 AS side, target1 AS target FROM pairs UNION ALL SELECT target1, target2, 2, target2 FROM pairs),
        each_key AS (SELECT target1, target2, scope, key, max(CAST(side = 1 AS INT)) AS a, max(CAST(side = 2 AS INT)) AS b FROM k JOIN sides USING (target) GROUP BY ALL)
        SELECT target1, target2, scope, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, CAST(sum(a * b) AS BIGINT) AS n_intersection, count(*) AS n_union,
            round(sum(a * b) / count(*), 8) AS jaccard FROM each_key GROUP BY target1, target2, scope"""


_TOK, _SENT = "SELECT target, unnest(tokens) AS key FROM sized", "SELECT target, unnest(sentences) AS key FROM sized"
_MTOK = "SELECT target, label, unnest(tokens) AS key FROM mentions"


def _lengths(q: str) -> str:
    return f"SELECT target, length(key) AS value FROM ({q})"


def _times(q: str) -> str:
    return f"SELECT target, count(*) AS value FROM ({q}) GROUP BY target, key"


def _uniques(base: str, q: str) -> str:
    return _scalar(base, "count(*)", f"(SELECT DISTINCT target, key FROM ({q}))")


_DEGREE = "SELECT target, scope, count(*) AS value FROM (SELECT DISTINCT target, scope, label, link_key, text FROM mentions JOIN scopes USING (label)) GROUP BY target, scope"

#: Query name -> (metric, corpus, SQL).
METRIC_QUERIES: dict[str, tuple[str, str, str]] = {
    "m01_document_count": ("document_count", "text", _scalar(_TEXT, "count(*)", "docs")),
    "m02_passage_count": ("passage_count", "text", _scalar(_TEXT, "count(*)", "passages")),
    "m03_sentence_count": ("sentence_count", "text", _scalar(_TEXT, "sum(len(sentences))", "sized")),
    "m04_token_count": ("token_count", "text", _scalar(_TEXT, "sum(len(tokens))", "sized")),
    "m05_mention_count": ("mention_count", "orders", _scalar(_ORDERS, "count(*)", "mentions")),
    "m06_mention_token_count": ("mention_token_count", "orders", _scalar(_ORDERS, "sum(len(tokens))", "mentions")),
    "m07_identifier_count": ("identifier_count", "orders", _scalar(_ORDERS, "sum(links)", "mentions")),
    "m08_passages_per_document_stats": ("passages_per_document_stats", "text", _stats(_TEXT, "SELECT target, passages AS value FROM docs")),
    "m09_sentences_per_document_stats": ("sentences_per_document_stats", "text", _stats(_TEXT, "SELECT target, sentences AS value FROM docs")),
    "m10_tokens_per_document_stats": ("tokens_per_document_stats", "text", _stats(_TEXT, "SELECT target, tokens AS value FROM docs")),
    "m11_annotations_per_document_stats": ("annotations_per_document_stats", "orders", _stats(_ORDERS, _per_doc("count(*)"), True)),
    "m12_annotations_per_1000_tokens_stats": (
        "annotations_per_1000_tokens_stats", "orders", _stats(_ORDERS, f"SELECT target, scope, CASE WHEN tokens > 0 THEN value / tokens * 1000 ELSE 0 END AS value FROM ({_per_doc('count(*)')})", True)),
    "m13_unique_mentions_per_document_stats": ("unique_mentions_per_document_stats", "orders", _stats(_ORDERS, _per_doc("count(DISTINCT text)"), True)),
    "m14_unique_identifiers_per_document_stats": (
        "unique_identifiers_per_document_stats", "orders", _stats(_ORDERS, _per_doc("count(DISTINCT identifier) + max(CAST(identifier IS NULL AS INT))", "leaves"), True)),
    "m15_spans_per_annotation_stats": ("spans_per_annotation_stats", "orders", _stats(_ORDERS, "SELECT target, spans AS value FROM mentions")),
    "m16_identifiers_per_annotation_stats": ("identifiers_per_annotation_stats", "orders", _stats(_ORDERS, "SELECT target, links AS value FROM mentions")),
    "m17_document_length_stats": ("document_length_stats", "text", _stats(_TEXT, "SELECT target, chars AS value FROM docs")),
    "m18_passage_length_stats": ("passage_length_stats", "text", _stats(_TEXT, "SELECT target, chars AS value FROM sized")),
    "m19_sentence_length_stats": ("sentence_length_stats", "text", _stats(_TEXT, _lengths(_SENT))),
    "m20_token_length_stats": ("token_length_stats", "text", _stats(_TEXT, _lengths(_TOK))),
    "m21_mention_length_stats": ("mention_length_stats", "orders", _stats(_ORDERS, "SELECT target, length(text) AS value FROM mentions")),
    "m22_mention_token_length_stats": ("mention_token_length_stats", "orders", _stats(_ORDERS, _lengths(_MTOK))),
    "m23_passage_redundancy_stats": ("passage_redundancy_stats", "text", _stats(_TEXT, _times("SELECT target, text AS key FROM sized"))),
    "m24_sentence_redundancy_stats": ("sentence_redundancy_stats", "text", _stats(_TEXT, _times(_SENT))),
    "m25_token_redundancy_stats": ("token_redundancy_stats", "text", _stats(_TEXT, _times(_TOK))),
    "m26_mention_redundancy_stats": ("mention_redundancy_stats", "orders", _stats(_ORDERS, _times("SELECT target, text AS key FROM mentions"))),
    "m27_mention_token_redundancy_stats": ("mention_token_redundancy_stats", "orders", _stats(_ORDERS, _times(_MTOK))),
    "m28_identifier_redundancy_stats": ("identifier_redundancy_stats", "orders", _stats(_ORDERS, _times("SELECT target, identifier AS key FROM leaves"))),
    "m29_variation_degree_stats": ("variation_degree_stats", "orders", _stats(_ORDERS, _DEGREE + ", label, link_key", True)),
    "m30_ambiguity_degree_stats": ("ambiguity_degree_stats", "orders", _stats(_ORDERS, _DEGREE + ", text", True)),
    "m31_unique_tokens": ("unique_tokens", "text", _uniques(_TEXT, _TOK)),
    "m32_unique_sentences": ("unique_sentences", "text", _uniques(_TEXT, _SENT)),
    "m33_unique_mentions": ("unique_mentions", "orders", _uniques(_ORDERS, "SELECT target, text AS key FROM mentions")),
    "m34_unique_mention_tokens": ("unique_mention_tokens", "orders", _uniques(_ORDERS, _MTOK)),
    "m35_unique_identifiers": ("unique_identifiers", "orders", _uniques(_ORDERS, "SELECT target, identifier AS key FROM leaves")),
    "m36_label_distribution": ("label_distribution", "orders", _distribution(_ORDERS, "label", "mentions")),
    "m37_identifier_resource_distribution": ("identifier_resource_distribution", "orders", _distribution(_ORDERS, "resource", "leaves")),
    "m38_match_type_distribution": ("match_type_distribution", "orders", _distribution(_ORDERS, "match_type", "leaves", False)),
    "m44_token_overlap": ("token_overlap", "text", _overlap(_TEXT, f"SELECT target, 'all' AS scope, key FROM ({_TOK})")),
    "m45_mention_overlap": ("mention_overlap", "orders", _overlap(_ORDERS, "SELECT target, scope, text AS key FROM mentions JOIN scopes USING (label)")),
    "m46_mention_token_overlap": ("mention_token_overlap", "orders", _overlap(_ORDERS, f"SELECT target, scope, key FROM ({_MTOK}) JOIN scopes USING (label)")),
    "m47_identifier_overlap": ("identifier_overlap", "orders", _overlap(_ORDERS, "SELECT target, scope, identifier AS key FROM leaves JOIN scopes USING (label)")),
}


def run_metric(name: str, corpus_kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = corpus_kind == "text"
    corpus = (text_corpus if text else order_corpus)(spark, sf_dir)
    targets = target_frame(spark, TEXT_TARGETS if text else ORDER_TARGETS)
    found = METRICS[name]
    if found.kind == "cross":
        pairs = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("target1"), F.lit(b).alias("target2")) for a, b in (TEXT_PAIRS if text else ORDER_PAIRS)))).alias("x")).select("x.*")
        return found.run(corpus, targets, pairs, SCOPES)
    return found.run(corpus, targets, SCOPES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q: partial(run_metric, m, c) for q, (m, c, _) in METRIC_QUERIES.items()}
ORACLES: dict[str, str] = {q: sql for q, (_, _, sql) in METRIC_QUERIES.items()}
