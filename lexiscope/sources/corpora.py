"""Readers of annotated corpora: BioC XML, PubTator, standoff, Knowtator; each gives the frames of ``Corpus``.

Paths may be files, folders or globs on any storage Spark reads.  ``subset`` names the split of what is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.functions.text import iri_concept
from lexiscope.plans.frames import LEAF, Corpus
from lexiscope.sources.links import Grammar, leaves, link_key, relations

SPANS = "array<struct<start:int,end:int>>"
_INFON = "array<struct<_key:string,_VALUE:string>>"
_ANNOTATION = f"array<struct<_id:string,infon:{_INFON},location:array<struct<_offset:int,_length:int>>,text:string>>"
BIOC = f"id string, infon {_INFON}, passage array<struct<infon:{_INFON},offset:int,text:string,annotation:{_ANNOTATION}>>"


def _infons(column: Column) -> Column:
    entries = F.transform(F.coalesce(column, F.array().cast(_INFON)), lambda x: F.struct(x["_key"].alias("key"), x["_VALUE"].alias("value")))
    return F.map_from_entries(entries)


def _mentions(rows: DataFrame, grammar: Grammar | None, identifier: Column | None) -> DataFrame:
    """Adds the link columns to ``rows(corpus, subset, document_id, mention_id, text, spans, label[, ...])``."""
    empty = F.array().cast(f"array<{LEAF}>")
    if grammar is None or identifier is None:
        return rows.withColumns({"links": empty, "link_key": F.lit(None).cast("string"), "link_relations": F.array().cast("array<string>"), "match_types": F.array().cast("array<string>")})
    linked = rows.withColumn("_id", F.nullif(F.trim(identifier), F.lit("")))
    text = F.col("_id")
    out = linked.withColumns({
        "links": F.when(text.isNull(), empty).otherwise(leaves(text, grammar)), "link_key": link_key(text, grammar),
        "link_relations": F.coalesce(relations(text, grammar), F.array().cast("array<string>")),
    })
    return out.withColumn("match_types", F.array_distinct(F.array_compact(F.transform("links", lambda x: x["match_type"])))).drop("_id")


def read_bioc(
    spark: SparkSession, path: str, corpus: str, subset: str = "all", label_key: str = "type", id_key: str = "identifier", label_map: dict | None = None,
    grammar: Grammar | None = None, document_id: tuple[str, str] | None = None, whole_folder: bool = False,
) -> Corpus:
    """BioC XML.  Of the documents of one file with the same id the last counts, in the first one's place; in a
    folder nothing is dropped.  A label that ``label_map`` maps to None drops the mention.  ``document_id`` is
    ("header" or "document", infon key) where the id stands in an infon."""
    docs = spark.read.format("xml").option("rowTag", "document").schema(BIOC).load(path)
    docs = docs.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    where = F.col("id")
    if document_id:
        source = F.get("passage", F.lit(0))["infon"] if document_id[0] == "header" else F.col("infon")
        where = F.try_element_at(_infons(source), F.lit(document_id[1]))
        where = F.coalesce(where, F.raise_error(F.concat(F.lit("no document id in "), F.coalesce("id", F.lit("?")))).cast("string"))
    docs = docs.withColumn("document_id", where)
    if not whole_folder:
        last = W.partitionBy("_file", "document_id").orderBy(F.desc("_at"))
        docs = docs.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    docs = docs.select(F.lit(corpus).alias("corpus"), F.lit(subset).alias("subset"), "document_id", "passage")
    passages = docs.select("corpus", "subset", "document_id", F.posexplode("passage").alias("passage_no", "p"))
    found = passages.select("corpus", "subset", "document_id", "passage_no", F.explode("p.annotation").alias("a"))
    marks = _infons(F.col("a.infon"))
    label = F.try_element_at(marks, F.lit(label_key))
    rows = found.select(
        "corpus", "subset", "document_id", "passage_no", F.col("a._id").alias("mention_id"), F.col("a.text").alias("text"),
        F.transform("a.location", lambda x: F.struct(x["_offset"].alias("start"), (x["_offset"] + x["_length"]).alias("end"))).cast(SPANS).alias("spans"),
        label.alias("label"), F.try_element_at(marks, F.lit(id_key)).alias("_identifier"),
    )
    rows = map_labels(rows, label_map, drop=True)
    annotations = _mentions(rows, grammar, F.col("_identifier")).drop("_identifier")
    return Corpus(docs.drop("passage"), passages.select("corpus", "subset", "document_id", "passage_no", "p.text", "p.offset"), annotations)


def map_labels(rows: DataFrame, label_map: dict | None, drop: bool) -> DataFrame:
    """Labels replaced by ``label_map``; those mapped to None are dropped, or kept as null."""
    if not label_map:
        return rows
    gone = [k for k, v in label_map.items() if v is None]
    if drop and gone:
        rows = rows.filter(F.coalesce(~F.col("label").isin(*gone), F.lit(True)))
    named = [F.lit(x) for k, v in label_map.items() for x in (k, v)]
    table = F.create_map(*named).cast("map<string,string>")
    known = F.col("label").isin(*label_map)
    return rows.withColumn("label", F.when(known, F.try_element_at(table, F.col("label"))).otherwise(F.col("label")))


def read_pubtator(spark: SparkSession, path: str, corpus: str, subset: str = "all", label_map: dict | None = None, grammar: Grammar | None = None, separator: str = "\n\n") -> Corpus:
    """PubTator: blocks between blank lines with ``id|t|title``, ``id|a|abstract`` and tab-separated mentions;
    the abstract starts one past the title, and a mention belongs to the title if it starts before that.

    Files are cut at ``separator``, so that several tasks share a large one, and what is between at blank lines of any
    kind; a file that doesn't hold it (as one with carriage returns) is one task's work."""
    records = spark.read.text(path, lineSep=separator)
    blocks = records.select(F.explode(F.split(F.regexp_replace("value", "\r\n", "\n"), r"\n\s*\n")).alias("block")).filter("trim(block) != ''")
    blocks = blocks.select(F.regexp_replace("block", r"^(\s*\n)+", "").alias("block"))
    title = F.regexp_extract("block", r"(?m)^([^|\n]+)\|t\|(.*)$", 2)
    docs = blocks.select(
        F.lit(corpus).alias("corpus"), F.lit(subset).alias("subset"), F.trim(F.regexp_extract("block", r"(?m)^\s*([^|\n]+)\|t\|", 1)).alias("document_id"),
        title.alias("title"), F.regexp_extract("block", r"(?m)^([^|\n]+)\|a\|(.*)$", 2).alias("abstract"), F.split("block", "\n").alias("lines"),
    )
    second = (F.length("title") + 1).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("passage_no"), F.col("title").alias("text"), F.lit(0).alias("offset")), F.struct(F.lit(1).alias("passage_no"), F.col("abstract").alias("text"), second.alias("offset")))
    passages = docs.select("corpus", "subset", "document_id", F.explode(parts).alias("p")).select("corpus", "subset", "document_id", "p.*")
    cells = docs.select("corpus", "subset", "document_id", second.alias("second"), F.posexplode("lines").alias("no", "line")).withColumn("c", F.split("line", "\t")).filter("size(c) >= 5")
    start, end = F.col("c")[1].cast("int"), F.col("c")[2].cast("int")
    rows = cells.select(
        "corpus", "subset", "document_id", F.when(start < F.col("second"), 0).otherwise(1).alias("passage_no"), F.concat_ws("_", "document_id", "no").alias("mention_id"), F.col("c")[3].alias("text"),
        F.array(F.struct(start.alias("start"), end.alias("end"))).cast(SPANS).alias("spans"), F.col("c")[4].alias("label"), F.get("c", F.lit(5)).alias("_identifier"),
    )
    annotations = _mentions(map_labels(rows, label_map, drop=True), grammar, F.col("_identifier")).drop("_identifier")
    return Corpus(docs.select("corpus", "subset", "document_id"), passages, annotations)


def read_standoff(spark: SparkSession, path: str, corpus: str, subset: str = "all", ids: DataFrame | None = None, label_map: dict | None = None) -> tuple[Corpus, DataFrame]:
    """Pairs of ``.txt`` and ``.ann`` files; the whole text is one passage.  ``ids(stem, document_id)`` gives
    document ids by the file stem before the first hyphen; without it PMID-n and PMC-n are read off the name.
    Returns the corpus and the lines that were rejected, each with its reason."""
    files = lambda end: spark.read.option("pathGlobFilter", f"*.{end}").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), rf"([^/]+)\.{end}$", 1).alias("stem"), "value")
    texts, marks = files("txt").withColumnRenamed("value", "text"), files("ann")
    if ids is not None:
        keyed = texts.withColumn("_k", F.substring_index("stem", "-", 1)).join(ids.withColumnRenamed("stem", "_k"), "_k", "left").drop("_k")
    else:
        found = F.regexp_extract("stem", r"^(?:PMID-([0-9]+)|(PMC)-?([0-9]+))", 0)
        number = F.regexp_replace(found, r"^PMID-", "")
        keyed = texts.withColumn("document_id", F.nullif(F.regexp_replace(number, "^PMC-?", "PMC"), F.lit("")))
    missing = F.raise_error(F.concat(F.lit("no document id for "), F.col("stem"))).cast("string")
    docs = keyed.select(F.lit(corpus).alias("corpus"), F.lit(subset).alias("subset"), F.coalesce("document_id", missing).alias("document_id"), "stem", "text")
    lines = marks.select("stem", F.posexplode(F.split("value", "\r?\n")).alias("no", "line")).filter("trim(line) != ''").join(docs, "stem")
    cells = F.split("line", "\t")
    middle = F.split(F.get(cells, F.lit(1)), " ")
    start, end = F.get(middle, F.lit(1)).try_cast("int"), F.get(middle, F.lit(2)).try_cast("int")
    lines = lines.withColumns({"cells": cells, "middle": middle, "start": start, "end": end})
    quoted = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    reason = (
        F.when(F.size("cells") != 3, "not three fields").when(F.get("cells", F.lit(1)).contains(";"), "discontinuous span").when(F.size("middle") != 3, "span is not label, start, end")
        .when(F.col("start").isNull() | F.col("end").isNull(), "offsets are not numbers").when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "empty or negative span")
        .when(quoted != F.get("cells", F.lit(2)), "text differs from the span's")
    )
    lines = lines.withColumn("reason", reason)
    good = lines.filter("reason is null").select(
        "corpus", "subset", "document_id", F.lit(0).alias("passage_no"), F.concat_ws("_", "document_id", "no").alias("mention_id"), F.get("cells", F.lit(2)).alias("text"),
        F.array(F.struct("start", "end")).cast(SPANS).alias("spans"), F.get("middle", F.lit(0)).alias("label"),
    )
    passages = docs.select("corpus", "subset", "document_id", F.lit(0).alias("passage_no"), "text", F.lit(0).alias("offset"))
    return Corpus(docs.select("corpus", "subset", "document_id"), passages, _mentions(map_labels(good, label_map, drop=True), None, None)), lines.filter("reason is not null").select("stem", "no", "line", "reason")


_CLASS_MENTION = "_id string, mentionClass struct<_id:string,_VALUE:string>"
_KNOWTATOR1 = "mention struct<_id:string>, span array<struct<_start:int,_end:int>>, spannedText string"
_KNOWTATOR2 = "_id string, class struct<_id:string>, span array<struct<_start:int,_end:int,_VALUE:string>>"


def read_knowtator(spark: SparkSession, texts: str, ontologies: dict[str, str], corpus: str, subset: str = "all", label_map: dict | None = None, version: int = 1) -> Corpus:
    """Texts and, for each ontology, a folder of Knowtator XML files named after them.  The ontology is the
    label (through ``label_map``; one mapped to None stays null), the concept the link, of match type exact;
    spans without length are left out."""
    stem = lambda: F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?(?:\.knowtator)?(?:\.xml|\.txt)?$", 1)
    docs = spark.read.option("pathGlobFilter", "*.txt").text(texts, wholetext=True).select(F.lit(corpus).alias("corpus"), F.lit(subset).alias("subset"), stem().alias("document_id"), F.col("value").alias("text"))
    every = None
    for ontology, path in ontologies.items():
        marks = spark.read.format("xml").option("rowTag", "annotation").schema(_KNOWTATOR1 if version == 1 else _KNOWTATOR2).load(path).withColumn("document_id", stem())
        if version == 1:
            classes = spark.read.format("xml").option("rowTag", "classMention").schema(_CLASS_MENTION).load(path).select(stem().alias("document_id"), F.col("_id").alias("mention_id"), F.col("mentionClass._id").alias("concept"))
            rows = marks.select("document_id", F.col("mention._id").alias("mention_id"), "span").join(classes, ["document_id", "mention_id"], "left")
        else:
            rows = marks.select("document_id", F.col("_id").alias("mention_id"), "span", F.col("class._id").alias("concept"))
        rows = rows.withColumn("label", F.lit(ontology))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    spans = F.transform(F.filter("span", lambda s: s["_end"] > s["_start"]), lambda s: F.struct(s["_start"].alias("start"), s["_end"].alias("end")))
    found = every.withColumn("spans", spans.cast(SPANS)).filter("size(spans) > 0").join(docs, "document_id")
    text = F.array_join(F.transform("spans", lambda s: F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])), " ... ")
    concept = iri_concept(F.col("concept"))
    leaf = F.struct(concept.alias("identifier"), F.col("label").alias("resource"), F.lit("exact").alias("match_type")).cast(LEAF)
    rows = found.select("corpus", "subset", "document_id", F.lit(0).alias("passage_no"), "mention_id", text.alias("text"), "spans", "label", F.array(leaf).alias("links"), F.concat_ws("|", concept, "label", F.lit("exact")).alias("link_key"))
    rows = rows.withColumns({"link_relations": F.array().cast("array<string>"), "match_types": F.array(F.lit("exact"))})
    passages = docs.select("corpus", "subset", "document_id", F.lit(0).alias("passage_no"), "text", F.lit(0).alias("offset"))
    return Corpus(docs.drop("text"), passages, map_labels(rows, label_map, drop=False))


def resplit(corpus: Corpus, splits: DataFrame, require_all: bool = True, allow_unknown: bool = False) -> Corpus:
    """The corpus with subsets from ``splits(document_id, subset)``.  Of documents with one id the first counts.
    An id in two splits, an unknown id (unless allowed) and a document without a split (unless not required:
    then it is left out) are errors."""
    twice = splits.groupBy("document_id").agg(F.count_distinct("subset").alias("n")).filter("n > 1").select("document_id").limit(5).collect()
    if twice:
        raise ValueError(f"ids in two splits: {[r[0] for r in twice]}")
    known = corpus.documents.select("document_id").distinct()
    if not allow_unknown and (rows := splits.join(known, "document_id", "left_anti").select("document_id").limit(5).collect()):
        raise ValueError(f"unknown ids in splits: {[r[0] for r in rows]}")
    if require_all and (rows := known.join(splits, "document_id", "left_anti").limit(5).collect()):
        raise ValueError(f"documents without a split: {[r[0] for r in rows]}")
    wanted = splits.select("document_id", F.col("subset").alias("_subset")).distinct()
    first = corpus.documents.groupBy("document_id").agg(F.min("subset").alias("subset"))
    move = lambda df: df.join(first, ["document_id", "subset"], "left_semi").join(wanted, "document_id").withColumn("subset", F.col("_subset")).drop("_subset").select(*df.columns)
    return Corpus(move(corpus.documents).dropDuplicates(["corpus", "document_id"]), move(corpus.passages), None if corpus.annotations is None else move(corpus.annotations))


# Identifier prefixes of one corpus and the label each stands for.
PREFIX_LABELS = {
    "BAO:": "bioassay", "CHEBI:": "chemical", "CL:": "cell_type", "CVCL:": "cell_line", "Corum:": "gene", "GO:": "GO term", "NCBI gene:": "gene",
    "NCBI taxon:": "species", "PubChem:": "chemical", "Rfam:": "gene", "Uberon:": "anatomy", "Uniprot:": "gene", "cell:": "cell_type", "gene:": "gene",
    "molecule:": "chemical", "organism:": "species", "protein:": "gene", "subcellular:": "anatomy", "tissue:": "anatomy",
}


def infer_labels(rows: DataFrame, column: str = "_identifier") -> DataFrame:
    """Labels from identifier lists separated by bars: the first in order of the labels that the prefixes stand
    for; rows without any are dropped; identifiers come out separated by commas."""
    fixed = F.transform(F.split(column, r"\|"), lambda x: F.regexp_replace(F.regexp_replace(x, "^Uberon:UBERON:", "Uberon:UBERON_"), "^CVCL_", "CVCL:CVCL_"))
    labels = [F.when(F.exists(fixed, _starts(prefix)), F.lit(label)) for prefix, label in PREFIX_LABELS.items()]
    return rows.withColumn("label", F.array_min(F.array_compact(F.array(*labels)))).withColumn(column, F.array_join(fixed, ",")).filter("label is not null")


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)
