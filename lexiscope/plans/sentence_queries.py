"""Registered queries of learned sentences: the model of the documents, the sentences, and the metrics that use them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators import sentences as st
from lexiscope.operators.metrics import METRICS
from lexiscope.plans import queries as mq
from lexiscope.plans.targets import target_frame
from lexiscope.sources.tables import text_corpus

_SPACE, _CLOSING = r"[ \t\n\x0B\f\r]", r"""["'')\]}»”’*]"""


def _core(chunk: str) -> str:
    return rf"""regexp_replace(regexp_replace({chunk}, '^["''(\[{{«“‘*]+', ''), '["'')\]}}»”’*,;:]+$', '')"""


def _word(core: str) -> str:
    bare = f"regexp_replace({core}, '[.!?]+$', '')"
    return f"CASE WHEN regexp_matches({bare}, '^[+-]?[0-9][0-9.,]*$') THEN '##number##' ELSE lower({bare}) END"


def _case(core: str) -> str:
    return rf"CASE WHEN regexp_matches({core}, '^\p{{Lu}}') THEN 'U' WHEN regexp_matches({core}, '^\p{{Ll}}') THEN 'L' ELSE '-' END"


def _stop(chunk: str, core: str) -> str:
    return rf"""CASE WHEN regexp_matches({chunk}, '[,;:]{_CLOSING}*$') THEN '-' WHEN regexp_matches({core}, '[!?]$') THEN '!' WHEN regexp_matches({core}, '\.\.$') THEN 'e'
        WHEN regexp_matches({core}, '\.$') THEN '.' || {_word(core)} ELSE '-' END"""


def _xlog(n: str, p: str) -> str:
    return f"(CASE WHEN {n} <= 0 THEN 0.0 ELSE ({n}) * ln(greatest(CAST({p} AS DOUBLE), 1e-300)) END)"


def _binomial(hits: str, tries: str, p: str) -> str:
    return f"({_xlog(hits, p)} + {_xlog(f'({tries} - {hits})', f'1 - {p}')})"


def _pair(a: str, b: str, both: str, total: str) -> str:
    free, rest, left = f"CAST({b} AS DOUBLE) / {total}", f"({b} - {both})", f"({total} - {a})"
    alone = f"(CASE WHEN {total} > {a} THEN CAST({rest} AS DOUBLE) / {left} ELSE 0.0 END)"
    return f"-2 * ({_binomial(both, a, f'({free})')} + {_binomial(rest, left, f'({free})')} - {_binomial(both, a, f'(CAST({both} AS DOUBLE) / {a})')} - {_binomial(rest, left, alone)})"


_LETTERED = r"regexp_matches(word, '\p{L}') AND word <> '##number##'"
_SCORE = f"""-2 * ({_binomial('with_stop', '(with_stop + without)', '(CAST(stops AS DOUBLE) / total)')} - {_binomial('with_stop', '(with_stop + without)', '0.99')})
    * exp(-(length(word) - (length(word) - length(replace(word, '.', ''))))) * (length(word) - length(replace(word, '.', '')) + 1) * pow(CAST(length(replace(word, '.', '')) AS DOUBLE), -without)"""

_MODEL = rf"""
WITH targets(target, corpus, subset) AS (VALUES ('train', 'documents', 'train'), ('test', 'documents', 'test'), ('documents', 'documents', NULL),
    ('everything', 'documents', 'train'), ('everything', 'documents', 'test'), ('everything', 'benchmark', NULL), ('everything', 'conversations', NULL), ('nothing', 'absent', NULL)),
names AS (SELECT DISTINCT target FROM targets),
whole AS (
    SELECT 'documents' AS corpus, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS subset, CAST(doc_id AS VARCHAR) AS document_id, string_split(text, chr(10)) AS l FROM documents
    UNION ALL SELECT 'benchmark', 'heldout', CAST(item_id AS VARCHAR), string_split(text, chr(10)) FROM benchmark),
lines AS (SELECT row_number() OVER () AS pid, * FROM (SELECT corpus, subset, document_id, unnest(l) AS text FROM whole UNION ALL SELECT 'conversations', 'chat', CAST(conv_id AS VARCHAR), text FROM conversations)),
chunks AS (SELECT pid, unnest(l) AS chunk, generate_subscripts(l, 1) AS i FROM (SELECT pid, regexp_split_to_array(text, '{_SPACE}+') AS l FROM lines WHERE corpus = 'documents')),
cores AS (SELECT pid, i, chunk, core FROM (SELECT *, {_core('chunk')} AS core FROM chunks) WHERE core <> ''),
stops AS (SELECT pid, i, core, {_stop('chunk', 'core')} AS stop FROM cores),
counts AS (
    SELECT before, {_word('core')} AS word, regexp_matches(core, '\.$') AS period, {_case('core')} AS kind, count(*) AS n
    FROM (SELECT core, coalesce(lag(stop) OVER (PARTITION BY pid ORDER BY i), '') AS before FROM stops) GROUP BY ALL),
sizes AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (period) AS BIGINT) AS stops FROM counts),
scored AS (SELECT *, {_SCORE} AS score FROM (SELECT word, CAST(coalesce(sum(n) FILTER (period), 0) AS BIGINT) AS with_stop, CAST(coalesce(sum(n) FILTER (NOT period), 0) AS BIGINT) AS without FROM counts GROUP BY word), sizes),
words AS (SELECT word, with_stop + without AS seen, total, {_LETTERED} AND with_stop > 0 AND score >= 0.3 AS abbreviation FROM scored),
placed AS (
    SELECT c.*, w.seen AS left_seen, CASE WHEN c.before = '-' THEN 'middle' WHEN c.before = 'e' OR coalesce(w.abbreviation OR regexp_matches(c.lhs, '^\p{{L}}$') OR c.lhs = '##number##', false) THEN 'unknown' ELSE 'begin' END AS place
    FROM (SELECT *, CASE WHEN before[1] = '.' THEN before[2:] END AS lhs FROM counts) c LEFT JOIN words w ON w.word = c.lhs),
breaks AS (SELECT CAST(sum(n) AS BIGINT) AS breaks FROM placed WHERE place = 'begin' AND before <> ''),
cases AS (
    SELECT word, bool_or(kind = 'U' AND place = 'middle') AS upper_middle, bool_or(kind = 'U') AS upper, bool_or(kind = 'L') AS lower, bool_or(kind = 'L' AND place = 'begin') AS lower_begin,
        CAST(coalesce(sum(n) FILTER (place = 'begin' AND before <> ''), 0) AS BIGINT) AS begins FROM placed GROUP BY word),
model AS (
    SELECT word, abbreviation, CASE WHEN {_LETTERED} AND begins >= 5 AND total * begins > seen * breaks THEN {_pair('breaks', 'seen', 'begins', 'total')} >= 30 ELSE false END AS starter, upper_middle, upper, lower, lower_begin
    FROM words JOIN cases USING (word), breaks),
bound AS (
    SELECT lhs, word FROM (SELECT lhs, left_seen, word, CAST(sum(n) AS BIGINT) AS both_seen FROM placed WHERE place = 'unknown' AND lhs IS NOT NULL AND {_LETTERED} GROUP BY ALL) o JOIN (SELECT word, seen, total FROM words) w USING (word)
    WHERE both_seen >= 2 AND total * both_seen > left_seen * seen AND {_pair('left_seen', 'seen', 'both_seen', 'total')} >= 7.88)
"""

_SENTENCES = rf"""{_MODEL},
cuts AS (SELECT pid, unnest(s) AS segment, generate_subscripts(s, 1) AS i FROM (SELECT pid, list_filter(string_split(regexp_replace(text, '([.!?]{_CLOSING}*{_SPACE}+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM lines)),
nexts AS (SELECT pid, i, segment, regexp_extract(segment, '([^ \t\n\x0B\f\r]+){_SPACE}*$', 1) AS last, lead(segment) OVER (PARTITION BY pid ORDER BY i) AS upcoming FROM cuts),
around AS (SELECT pid, i, segment, upcoming, last, {_core('last')} AS last_core, {_core(f"regexp_extract(upcoming, '^{_SPACE}*([^ \t\n\x0B\f\r]+)', 1)")} AS core FROM nexts),
edges AS (SELECT pid, i, segment, CASE WHEN upcoming IS NULL THEN '' ELSE {_stop('last', 'last_core')} END AS before, {_word('core')} AS word, {_case('core')} AS kind FROM around),
known AS (
    SELECT e.*, CASE WHEN e.before[1] = '.' THEN e.before[2:] END AS lhs, coalesce(a.abbreviation, false) AS abbreviation, b.lhs IS NOT NULL AS pair, coalesce(m.starter, false) AS starter, coalesce(m.upper_middle, false) AS upper_middle,
        coalesce(m.upper, false) AS upper, coalesce(m.lower, false) AS lower, coalesce(m.lower_begin, false) AS lower_begin
    FROM edges e LEFT JOIN model m ON m.word = e.word LEFT JOIN model a ON e.before[1] = '.' AND a.word = e.before[2:] LEFT JOIN bound b ON e.before[1] = '.' AND b.lhs = e.before[2:] AND b.word = e.word),
judged AS (SELECT *, kind = 'U' AND lower AND NOT upper_middle AS yes, kind = 'L' AND (upper OR NOT lower_begin) AS no, coalesce(regexp_matches(lhs, '^\p{{L}}$'), false) AS initial FROM known),
ended AS (
    SELECT pid, i, segment, CASE WHEN before IN ('', '!', '-') THEN true WHEN before = 'e' THEN yes OR (kind = 'U' AND starter) WHEN pair THEN false WHEN abbreviation THEN (yes OR (kind = 'U' AND starter)) AND NOT initial
        WHEN lhs = '##number##' THEN NOT no WHEN initial THEN NOT no AND NOT (kind = 'U' AND NOT lower) ELSE true END AS ends FROM judged),
numbered AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY pid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended),
sents AS (
    SELECT corpus, subset, document_id, pid, no, sentence FROM (SELECT pid, no, regexp_replace(string_agg(segment, '' ORDER BY i), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS sentence FROM numbered GROUP BY pid, no) JOIN lines USING (pid) WHERE sentence <> ''),
tsents AS (SELECT t.target, s.corpus, s.document_id, s.sentence AS key FROM sents s JOIN targets t ON t.corpus = s.corpus AND (t.subset IS NULL OR t.subset = s.subset)),
tdocs AS (SELECT DISTINCT t.target, l.corpus, l.document_id FROM lines l JOIN targets t ON t.corpus = l.corpus AND (t.subset IS NULL OR t.subset = l.subset))
"""

_KEYS = "SELECT target, key FROM tsents"
#: Query name -> (metric, SQL).
METRIC_QUERIES = {
    "m03_learned_sentence_count": ("sentence_count", mq._scalar(_SENTENCES, "count(*)", "tsents")),
    "m09_learned_sentences_per_document_stats": ("sentences_per_document_stats", mq._stats(_SENTENCES, "SELECT d.target, count(s.key) AS value FROM tdocs d LEFT JOIN tsents s USING (target, corpus, document_id) GROUP BY d.target, d.corpus, d.document_id")),
    "m19_learned_sentence_length_stats": ("sentence_length_stats", mq._stats(_SENTENCES, mq._lengths(_KEYS))),
    "m24_learned_sentence_redundancy_stats": ("sentence_redundancy_stats", mq._stats(_SENTENCES, mq._times(_KEYS))),
    "m32_learned_unique_sentences": ("unique_sentences", mq._uniques(_SENTENCES, _KEYS)),
}


def learned_corpus(spark: SparkSession, sf_dir: str):
    """The text corpus with the sentence model of its documents."""
    corpus = text_corpus(spark, sf_dir)
    return replace(corpus, sentence_model=st.learn(corpus.passages.filter("corpus = 'documents'")))


def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = st.context_counts(text_corpus(spark, sf_dir).passages.filter("corpus = 'documents'"))
    return counts.withColumnRenamed("case", "kind")


def model_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_corpus(spark, sf_dir).sentence_model.words


def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_corpus(spark, sf_dir).sentence_model.pairs


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = learned_corpus(spark, sf_dir)
    keys = ["corpus", "subset", "document_id", "passage_no"]
    found = st.split(corpus.passages.filter("corpus = 'documents'"), keys, corpus.sentence_model)
    return found.groupBy("document_id", "sentence").agg(F.count("*").alias("n"))


def run_metric(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return METRICS[name].run(learned_corpus(spark, sf_dir), target_frame(spark, mq.TEXT_TARGETS), mq.SCOPES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s03_context_counts": context_counts, "s03_sentence_model_words": model_words, "s03_sentence_model_pairs": model_pairs, "s03_learned_sentences": document_sentences,
} | {q: partial(run_metric, m) for q, (m, _) in METRIC_QUERIES.items()}
ORACLES: dict[str, str] = {
    "s03_context_counts": f"{_MODEL} SELECT * FROM counts", "s03_sentence_model_words": f"{_MODEL} SELECT * FROM model", "s03_sentence_model_pairs": f"{_MODEL} SELECT lhs AS word, word AS next FROM bound",
    "s03_learned_sentences": f"{_SENTENCES} SELECT document_id, sentence, count(*) AS n FROM sents WHERE corpus = 'documents' GROUP BY document_id, sentence",
} | {q: sql for q, (_, sql) in METRIC_QUERIES.items()}
