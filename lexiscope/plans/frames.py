"""The corpus model as lazy frames.

    documents    corpus, subset, document_id
    passages     corpus, subset, document_id, passage_no, text
    annotations  corpus, subset, document_id, text, spans, label, links, link_key, link_relations, match_types

With a ``sentence_model``, sentences end where it says; without one, at every closing punctuation.  Passages are then
told apart by all their keys, passage_no included.

``links`` holds the leaves of a mention's link in order, each (identifier, resource, match_type); a null
identifier is NIL.  ``link_key`` stands for the whole link and is null for unlinked mentions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import sentences, tokens
from lexiscope.operators.sentences import CUT, SentenceModel, sentence_counts, split

KEYS = ["corpus", "subset", "document_id"]
LEAF = "struct<identifier:string,resource:string,match_type:string>"


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    passages: DataFrame
    annotations: DataFrame | None = None
    sentence_model: SentenceModel | None = None

    def passage_sizes(self) -> DataFrame:
        """Per passage: characters, sentences and tokens, without the texts."""
        if self.sentence_model:
            text = F.replace(F.coalesce("text", F.lit("")), F.lit(CUT), F.lit(""))
            return sentence_counts(self.passages, [*KEYS, "passage_no"], self.sentence_model, chars=F.length(text), tokens=F.size(tokens(text))).drop("passage_no")
        return self.passages.select(*KEYS, F.length("text").alias("chars"), F.size(sentences(F.col("text"))).alias("sentences"), F.size(tokens(F.col("text"))).alias("tokens"))

    def document_sizes(self) -> DataFrame:
        """Per document, those without passages included: passages, characters, sentences, tokens."""
        sums = self.passage_sizes().groupBy(*KEYS).agg(F.count("*").alias("passages"), *(F.sum(c).alias(c) for c in ("chars", "sentences", "tokens")))
        out = self.documents.select(*KEYS).join(sums, KEYS, "left")
        return out.select(*KEYS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("passages", "chars", "sentences", "tokens")))

    def exploded(self, what: str) -> DataFrame:
        """One row per sentence or token of the passages, as (corpus, subset, key)."""
        if what == "sentence" and self.sentence_model:
            return split(self.passages, [*KEYS, "passage_no"], self.sentence_model).select("corpus", "subset", F.col("sentence").alias("key"))
        units = {"sentence": sentences, "token": tokens}[what]
        return self.passages.select("corpus", "subset", F.explode(units(F.col("text"))).alias("key"))

    def union(self, other: Corpus) -> Corpus:
        both = None
        if self.annotations is not None and other.annotations is not None:
            both = self.annotations.unionByName(other.annotations)
        return Corpus(self.documents.unionByName(other.documents), self.passages.unionByName(other.passages), both if both is not None else self.annotations if self.annotations is not None else other.annotations, self.sentence_model)


def save(corpus: Corpus, path: str) -> None:
    """Write the frames under ``path``, partitioned by corpus and subset so that readers skip other splits."""
    for name in ("documents", "passages", "annotations"):
        frame = getattr(corpus, name)
        if frame is not None:
            frame.write.mode("overwrite").partitionBy("corpus", "subset").parquet(f"{path}/{name}")


def load(spark, path: str, annotated: bool = True) -> Corpus:
    """Frames that ``save`` wrote."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in ("corpus", "subset")})
    return Corpus(text(read("documents")), text(read("passages")), text(read("annotations")) if annotated else None)
