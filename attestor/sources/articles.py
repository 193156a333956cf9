"""Articles: bibliographic XML to publication rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attestor.functions.once import add_once
from attestor.functions.text import blank_to_null, collapse, flatten_markup, text, year_in

ROW_TAG = "PubmedArticle"


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S = T.StringType()
_VALUE = _struct(_VALUE=_S)
# Titles and abstracts may hold inline markup. Read as plain strings they keep their inner XML in
# order; read as structs, the text around the markup would be lost.
ARTICLE_SCHEMA = _struct(
    MedlineCitation=_struct(
        PMID=_VALUE,
        Article=_struct(
            ArticleTitle=_S,
            Abstract=_S,
            AuthorList=_struct(Author=T.ArrayType(_struct(LastName=_S))),
            Journal=_struct(
                Title=_S, JournalIssue=_struct(PubDate=_struct(Year=_S, MedlineDate=_S))
            ),
            ArticleDate=T.ArrayType(_struct(Year=_S)),
            PublicationTypeList=_struct(PublicationType=T.ArrayType(_VALUE)),
            DataBankList=_struct(
                DataBank=T.ArrayType(_struct(AccessionNumberList=_struct(AccessionNumber=T.ArrayType(_S))))
            ),
        ),
        MedlineJournalInfo=_struct(MedlineTA=_S),
        MeshHeadingList=_struct(MeshHeading=T.ArrayType(_struct(DescriptorName=_VALUE))),
    )
)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article elements of XML files; large files are split at the row tag."""
    return (
        spark.read.format("xml").option("rowTag", ROW_TAG).option("attributePrefix", "_").option("valueTag", "_VALUE")
        .schema(ARTICLE_SCHEMA).load(path)
    )


_PART = r'(?s)<AbstractText((?:[^>"/]|"[^"]*")*)>(.*?)</AbstractText>'


def abstract_parts(abstract: Column) -> Column:
    """Non-empty parts of an abstract's inner XML as ``(label, body)``, labels in upper case."""
    attributes = F.regexp_extract_all(abstract, F.lit(_PART), F.lit(1))
    bodies = F.regexp_extract_all(abstract, F.lit(_PART), F.lit(2))
    parts = F.zip_with(
        attributes,
        bodies,
        lambda a, b: F.struct(
            F.upper(F.trim(F.regexp_extract(a, r'\bLabel\s*=\s*"([^"]*)"', 1))).alias("label"),
            flatten_markup(b).alias("body"),
        ),
    )
    return F.filter(parts, lambda p: p["body"] != "")


def sections_map(parts: Column) -> Column:
    """Label to text; of a repeated label the last part counts."""
    labelled = F.filter(parts, lambda p: p["label"] != "")
    names = F.array_distinct(F.transform(labelled, lambda p: p["label"]))
    last = F.transform(
        names, lambda n: F.element_at(F.transform(F.filter(labelled, lambda p: p["label"] == n), lambda p: p["body"]), -1)
    )
    return F.map_from_arrays(names, last)


def abstract_body(parts: Column) -> Column:
    """All parts, one per line, labelled ones with their label."""
    lines = F.transform(
        parts, lambda p: F.when(p["label"] != "", F.concat(p["label"], F.lit(": "), p["body"])).otherwise(p["body"])
    )
    return F.array_join(lines, "\n")


def publication_year(pub_date: Column, article_dates: Column) -> Column:
    """Issue year, else the first year in the free-text date, else the article date's year."""
    return F.coalesce(
        blank_to_null(pub_date["Year"]),
        year_in(pub_date["MedlineDate"]),
        blank_to_null(F.get(article_dates, 0)["Year"]),
        F.lit(""),
    )


def _texts(values: Column) -> Column:
    return F.coalesce(F.filter(F.transform(values, collapse), lambda v: v != ""), F.array().cast("array<string>"))


def to_publications(articles: DataFrame) -> DataFrame:
    """Publication rows in :data:`attestor.schemas.PUBLICATION_SCHEMA`."""
    c, a = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    parts = F.coalesce(
        abstract_parts(a["Abstract"]), F.array().cast("array<struct<label:string,body:string>>")
    )
    rows = add_once(articles, {"_parts": parts})
    return rows.select(
        collapse(c["PMID"]["_VALUE"]).alias("pmid"),
        flatten_markup(a["ArticleTitle"]).alias("title"),
        abstract_body(F.col("_parts")).alias("abstract_text"),
        sections_map(F.col("_parts")).alias("abstract_sections"),
        _texts(F.transform(a["AuthorList"]["Author"], lambda x: flatten_markup(x["LastName"]))).alias("authors"),
        publication_year(a["Journal"]["JournalIssue"]["PubDate"], a["ArticleDate"]).alias("pub_year"),
        F.coalesce(blank_to_null(flatten_markup(c["MedlineJournalInfo"]["MedlineTA"])), flatten_markup(a["Journal"]["Title"])).alias("journal"),
        _texts(F.transform(c["MeshHeadingList"]["MeshHeading"], lambda x: x["DescriptorName"]["_VALUE"])).alias("mesh_terms"),
        F.array_distinct(_texts(F.transform(a["PublicationTypeList"]["PublicationType"], lambda x: x["_VALUE"]))).alias("pub_types"),
        F.array_distinct(
            _texts(F.flatten(F.transform(a["DataBankList"]["DataBank"], lambda x: F.coalesce(x["AccessionNumberList"]["AccessionNumber"], F.array().cast("array<string>")))))
        ).alias("secondary_ids"),
    )
