"""Parsers of publication metadata: PubMed, PMC and NLM catalogue XML and Crossref JSON, as rows.

Only what is read from files; fetching is somebody else's business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.text import clean, normal_identifier

_ID = "struct<_IdType:string,_VALUE:string>"
_TEXTY = "struct<_VALUE:string>"
_PUBMED = f"""MedlineCitation struct<PMID:{_TEXTY},Article:struct<Journal:struct<ISSN:array<{_TEXTY}>,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>,Title:string,ISOAbbreviation:string>>,
    MedlineJournalInfo:struct<MedlineTA:string,NlmUniqueID:string,ISSNLinking:string>,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string>>>>>,
    PubmedData struct<ArticleIdList:struct<ArticleId:array<{_ID}>>>"""


def _identifiers(**columns: Column) -> Column:
    """A map of the identifiers that there are, each in a list."""
    pairs = [F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), F.array(c).alias("value"))) for k, c in columns.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """``(identifiers, pub_year, journal, journal_identifiers, mesh_topics)`` per article."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(_PUBMED).load(path)
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    of = lambda kind: F.get(F.transform(F.filter(ids, lambda x: x["_IdType"] == kind), lambda x: x["_VALUE"]), F.lit(0))
    date = F.col("MedlineCitation.Article.Journal.JournalIssue.PubDate")
    year = F.coalesce(date["Year"], F.nullif(F.regexp_extract(date["MedlineDate"], r"^(\d{4})", 1), F.lit("")))
    info, journal = F.col("MedlineCitation.MedlineJournalInfo"), F.col("MedlineCitation.Article.Journal")
    issns = F.array_distinct(F.array_compact(F.concat(F.transform(F.coalesce(journal["ISSN"], F.array().cast(f"array<{_TEXTY}>")), lambda x: x["_VALUE"]), F.array(info["ISSNLinking"]))))
    headings = F.transform(F.coalesce("MedlineCitation.MeshHeadingList.MeshHeading", F.array().cast("array<struct<DescriptorName:struct<_VALUE:string,_UI:string>>>")), lambda h: h["DescriptorName"]["_VALUE"])
    pmid = normal_identifier(F.lit("pmid"), F.col("MedlineCitation.PMID._VALUE"))
    return rows.select(
        _identifiers(pmid=pmid, pmcid=normal_identifier(F.lit("pmcid"), of("pmc")), doi=normal_identifier(F.lit("doi"), of("doi"))).alias("identifiers"), year.alias("pub_year"),
        clean(F.coalesce(info["MedlineTA"], journal["ISOAbbreviation"], journal["Title"])).alias("journal"), F.create_map(F.lit("nlm"), F.array_compact(F.array(info["NlmUniqueID"])), F.lit("issn"), issns).alias("journal_identifiers"),
        F.array_distinct(F.array_compact(headings)).alias("mesh_topics"),
    )


_PMC = """front struct<`journal-meta`:struct<`journal-id`:array<struct<`_journal-id-type`:string,_VALUE:string>>,issn:array<struct<_VALUE:string>>,`journal-title-group`:struct<`journal-title`:string>>,
    `article-meta`:struct<`article-id`:array<struct<`_pub-id-type`:string,_VALUE:string>>,`pub-date`:array<struct<year:string>>>>"""


def read_pmc(spark: SparkSession, path: str) -> DataFrame:
    """``(identifiers, pub_year, journal)`` per article of PMC full-text XML."""
    rows = spark.read.format("xml").option("rowTag", "article").schema(_PMC).load(path)
    ids = F.col("front.`article-meta`.`article-id`")
    of = lambda *kinds: F.get(F.transform(F.filter(ids, lambda x: x["_pub-id-type"].isin(*kinds)), lambda x: x["_VALUE"]), F.lit(0))
    names = F.col("front.`journal-meta`.`journal-id`")
    short = F.get(F.transform(F.filter(names, lambda x: x["_journal-id-type"] == "nlm-ta"), lambda x: x["_VALUE"]), F.lit(0))
    years = F.transform(F.coalesce(F.col("front.`article-meta`.`pub-date`"), F.array().cast("array<struct<year:string>>")), lambda d: d["year"])
    return rows.select(
        _identifiers(pmid=normal_identifier(F.lit("pmid"), of("pmid")), pmcid=normal_identifier(F.lit("pmcid"), of("pmc", "pmcid")), doi=normal_identifier(F.lit("doi"), of("doi"))).alias("identifiers"),
        F.array_min(F.array_compact(years)).alias("pub_year"), clean(F.coalesce(short, F.col("front.`journal-meta`.`journal-title-group`.`journal-title`"))).alias("journal"),
    )


_CATALOGUE = """NlmUniqueID string, TitleMain struct<Title:struct<_VALUE:string>>, MedlineTA string, ISSN array<struct<_VALUE:string>>,
    TitleAlternate array<struct<Title:struct<_VALUE:string>>>, MeshHeadingList struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>"""


def read_nlm_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(identifiers, name, abbreviation, name_variants, mesh_topics)`` per journal."""
    rows = spark.read.format("xml").option("rowTag", "NLMCatalogRecord").schema(_CATALOGUE).load(path)
    values = lambda c, kind, get: F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col(c), F.array().cast(kind)), get)))
    title = clean(F.regexp_replace("TitleMain.Title._VALUE", r"\s*\.$", ""))
    return rows.select(
        F.create_map(F.lit("nlm"), F.array("NlmUniqueID"), F.lit("issn"), values("ISSN", "array<struct<_VALUE:string>>", lambda x: x["_VALUE"])).alias("identifiers"), title.alias("name"), F.col("MedlineTA").alias("abbreviation"),
        values("TitleAlternate", "array<struct<Title:struct<_VALUE:string>>>", lambda x: clean(F.regexp_replace(x["Title"]["_VALUE"], r"\s*\.$", ""))).alias("name_variants"),
        values("MeshHeadingList.MeshHeading", "array<struct<DescriptorName:struct<_VALUE:string>>>", lambda x: x["DescriptorName"]["_VALUE"]).alias("mesh_topics"),
    )


_CROSSREF = "message struct<items:array<struct<DOI:string,`container-title`:array<string>,`short-container-title`:array<string>,ISSN:array<string>,issued:struct<`date-parts`:array<array<int>>>>>>"


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    """``(identifiers, pub_year, journal, journal_identifiers)`` per work of a Crossref works response."""
    items = spark.read.schema(_CROSSREF).json(path, multiLine=True).select(F.explode("message.items").alias("w"))
    year = F.get(F.get(F.col("w.issued.`date-parts`"), F.lit(0)), F.lit(0)).cast("string")
    return items.select(
        _identifiers(doi=normal_identifier(F.lit("doi"), F.col("w.DOI"))).alias("identifiers"), year.alias("pub_year"),
        clean(F.coalesce(F.get(F.col("w.`short-container-title`"), F.lit(0)), F.get(F.col("w.`container-title`"), F.lit(0)))).alias("journal"), F.create_map(F.lit("issn"), F.coalesce("w.ISSN", F.array().cast("array<string>"))).alias("journal_identifiers"),
    )


def first_source(*tables: DataFrame) -> DataFrame:
    """Rows of several sources, in order of preference: a row counts if no earlier source has its identifiers."""
    out = tables[0]
    for later in tables[1:]:
        known = out.select(F.explode("identifiers").alias("k", "v")).select("k", F.explode("v").alias("v")).distinct()
        marked = later.withColumn("_row", F.xxhash64(F.to_json("identifiers")))
        seen = marked.select("_row", F.explode("identifiers").alias("k", "v")).select("_row", "k", F.explode("v").alias("v")).join(known, ["k", "v"], "left_semi").select("_row").distinct()
        out = out.unionByName(marked.join(seen, "_row", "left_anti").drop("_row"), allowMissingColumns=True)
    return out
