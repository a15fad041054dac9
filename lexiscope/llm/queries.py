"""The registered queries of this subpackage: each applies one operator, with production parameters, to
its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm import byte_bpe_ids, collocations, embedding_dedup, hamming_search, line_dedup, mixing, secret_scan, source_divergence
from lexiscope.llm.html_text import extract_text
from lexiscope.llm.quality import quality_scores
from lexiscope.llm.sentencepiece_ids import encode_decode
from lexiscope.llm.simhash_dedup import near_duplicates
from lexiscope.llm.token_counts import token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(_read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _read(spark, sf_dir, "embeddings").select("vec_id", hamming_search.sign_code(F.col("embedding")).alias("code"))
    return hamming_search.top_k(codes, codes.filter("vec_id % 100 = 0"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_ids.encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_text": op4_html_text,
    "op5_token_counts": op5_token_counts,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_hamming_search": op8_hamming_search,
    "op9_quality": op9_quality,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

#: The top-k search as brute force over all pairs of a query row and a row; the divergence as dense vectors joined by term;
#: the collocations as n-grams by window functions.
ORACLES: dict[str, str] = {
    "op8_hamming_search": """
        WITH pairs AS (
            SELECT q.vec_id AS query_id, e.vec_id,
                   CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
            FROM embeddings q, embeddings e
            WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
        )
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
    """,
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
        c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term),
        sizes AS (SELECT lang, source, sum(n) AS own FROM c GROUP BY lang, source),
        groups AS (SELECT g.lang, g.source, coalesce(sizes.own, 0) AS own FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes USING (lang, source)),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(g.own + l.v AS HUGEINT) AS p,
                   1 + (CAST(1000000000 AS HUGEINT) * (k.total + 1)) // CAST(l.size + l.v AS HUGEINT) AS q
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), summed AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ), found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
        ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op12_collocations": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        tokens AS (SELECT doc, lang, unnest(x) AS token, generate_subscripts(x, 1) AS i FROM (SELECT doc, lang, regexp_extract_all(text, '[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+') AS x FROM d)),
        placed AS (SELECT *, regexp_full_match(token, '[.,;:!?\x0A-\x0D]') AS break FROM tokens),
        nexts AS (
            SELECT lang, token AS w1, break, lead(token) OVER o AS w2, lead(break) OVER o AS break2, lead(token, 2) OVER o AS w3, lead(break, 2) OVER o AS break3
            FROM placed WINDOW o AS (PARTITION BY doc ORDER BY i)
        ),
        one AS (SELECT lang, w1, count(*) AS a FROM nexts WHERE NOT break GROUP BY lang, w1),
        two AS (SELECT lang, w1, w2, count(*) AS a FROM nexts WHERE NOT break AND NOT break2 GROUP BY lang, w1, w2),
        three AS (SELECT lang, w1, w2, w3, count(*) AS a FROM nexts WHERE NOT break AND NOT break2 AND NOT break3 GROUP BY lang, w1, w2, w3),
        sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM one GROUP BY lang),
        triples AS (SELECT * FROM three WHERE a >= 10),
        above AS (
            SELECT lang, w1, w2, max(a) AS b FROM (SELECT lang, w1, w2, a FROM triples UNION ALL SELECT lang, w2, w3, a FROM triples) GROUP BY lang, w1, w2
        ), scored AS (
            SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.a, x.a AS l, y.a AS r, (CAST(1000000 AS HUGEINT) * t.a * t.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
            FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2 LEFT JOIN above v ON v.lang = t.lang AND v.w1 = t.w1 AND v.w2 = t.w2
            WHERE t.a >= 10 AND (v.b IS NULL OR 100 * v.b < 50 * t.a)
            UNION ALL
            SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
            FROM (
                SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, x.a AS l1, yz.a AS r1, xy.a AS l2, z.a AS r2,
                       (CAST(1000000 AS HUGEINT) * t.a * t.a) // (CAST(x.a AS HUGEINT) * yz.a) AS s1, (CAST(1000000 AS HUGEINT) * t.a * t.a) // (CAST(xy.a AS HUGEINT) * z.a) AS s2
                FROM triples t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one z ON z.lang = t.lang AND z.w1 = t.w3
                    JOIN two xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN two yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3
            )
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
    """,
}
