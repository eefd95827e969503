"""Payloads of each source as rows of one schema, by path expressions that stay in the JVM.

A payload that is broken, empty or has no title gives no row.  Payloads wrapped in a JSON
string are unwrapped.  Lists and single values in their place read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.functions.text import truthy, year_of
from folioweave.operators.documents import inverted_text
from folioweave.session import materialise

COLUMNS = ("title", "authors", "abstract", "doi", "year", "journal", "url", "pdf_url", "citations_count", "references_count", "open_access", "keywords")


def _unwrapped(payload: Column) -> Column:
    inner = F.get_json_object(F.concat(F.lit('{"x":'), payload, F.lit("}")), "$.x")
    return F.when(F.ltrim(payload).startswith('"'), inner).otherwise(payload)


def _at(path: str) -> Column:
    """The value at a path of the parsed payload ``v``, lists and objects as JSON."""
    return F.try_variant_get("v", "$." + path, "string")


def _text(path: str) -> Column:
    return truthy(_at(path))


def _int(path: str) -> Column:
    return _at(path).try_cast("bigint")


def _list(path: str, element: str = "STRING") -> Column:
    """The values at a path as a list; a single value is a list of one, NULL entries are kept."""
    raw = F.ltrim(_at(path))
    if element == "STRING":
        return F.when(raw.startswith("["), F.from_json(raw, "ARRAY<STRING>")).when(raw.isNotNull(), F.array(raw))
    listed = F.when(raw.startswith("["), raw).when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]")))
    return F.from_json(listed, f"ARRAY<{element}>")


def _names(items: Column, name: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.filter(F.transform(items, name), lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _split_names(path: str, pattern: str = r"\s*;\s*") -> Column:
    return F.coalesce(F.filter(F.split(_text(path), pattern), lambda n: n != ""), F.array().cast("array<string>"))


def _openalex() -> dict[str, Column]:
    oa = _text("open_access.oa_url")
    return {
        "title": _text("title"),
        "authors": _names(_list("authorships", "STRUCT<author: STRUCT<display_name: STRING>>"), lambda a: a["author"]["display_name"]),
        "abstract": inverted_text(F.from_json(_at("abstract_inverted_index"), "MAP<STRING, ARRAY<INT>>")),
        "doi": F.regexp_replace(_text("doi"), r"^https?://[^/]+/", ""), "year": _int("publication_year").cast("int"), "journal": _text("primary_location.source.display_name"),
        "url": F.coalesce(_text("primary_location.landing_page_url"), _text("id")), "pdf_url": F.coalesce(F.when(F.lower(oa).endswith(".pdf"), oa), _text("primary_location.pdf_url")),
        "citations_count": _int("cited_by_count"), "references_count": F.nullif(F.size(_list("referenced_works")), F.lit(-1)).cast("long"), "open_access": _at("open_access.is_oa").try_cast("boolean"),
        "keywords": F.slice(_names(_list("concepts", "STRUCT<display_name: STRING>"), lambda c: c["display_name"]), 1, 5),
    }


def _crossref() -> dict[str, Column]:
    dates = [_first(_first(F.from_json(_at(f"{d}.date-parts"), "ARRAY<ARRAY<INT>>"))) for d in ("published-print", "published-online", "published", "issued", "created")]
    licences = F.from_json(_at("license"), "ARRAY<STRUCT<URL: STRING>>")
    links = F.from_json(_at("link"), "ARRAY<STRUCT<URL: STRING, `content-type`: STRING>>")
    person = lambda a: F.when(truthy(a["family"]).isNotNull(), F.concat_ws(" ", truthy(a["given"]), a["family"]))
    return {
        "title": truthy(_first(_list("title"))), "authors": _names(_list("author", "STRUCT<given: STRING, family: STRING>"), person), "abstract": _text("abstract"), "doi": _text("DOI"), "year": F.coalesce(*dates),
        "journal": truthy(_first(_list("container-title"))), "url": _text("URL"), "pdf_url": _first(F.filter(links, lambda x: x["content-type"] == "application/pdf"))["URL"], "citations_count": _int("is-referenced-by-count"),
        "references_count": F.coalesce(_int("references-count"), F.nullif(F.size(F.from_json(_at("reference"), "ARRAY<STRUCT<key: STRING>>")), F.lit(-1)).cast("long")),
        "open_access": F.nullif(F.exists(licences, lambda x: F.lower(x["URL"]).rlike("creativecommons|open")), F.lit(False)), "keywords": F.coalesce(F.slice(_list("subject"), 1, 10), F.array().cast("array<string>")),
    }


def _semantic_scholar() -> dict[str, Column]:
    return {
        "title": _text("title"), "authors": _names(_list("authors", "STRUCT<name: STRING>"), lambda a: a["name"]), "abstract": _text("abstract"), "doi": _text("externalIds.DOI"), "year": _int("year").cast("int"), "journal": _text("venue"),
        "url": _text("url"), "pdf_url": _text("openAccessPdf.url"), "citations_count": _int("citationCount"), "references_count": _int("referenceCount"), "open_access": _at("isOpenAccess").try_cast("boolean"),
        "keywords": F.coalesce(_list("fieldsOfStudy"), F.array().cast("array<string>")),
    }


def _pubmed() -> dict[str, Column]:
    a = "MedlineCitation.Article."
    person = lambda x: F.coalesce(truthy(x["CollectiveName"]), F.when(truthy(x["LastName"]).isNotNull(), F.concat_ws(" ", F.coalesce(truthy(x["ForeName"]), truthy(x["Initials"])), x["LastName"])))
    return {
        "title": _text(a + "ArticleTitle"), "authors": _names(_list(a + "AuthorList", "STRUCT<LastName: STRING, ForeName: STRING, Initials: STRING, CollectiveName: STRING>"), person),
        "abstract": _text(a + "Abstract.AbstractText"), "doi": _text(a + "ELocationID"), "year": year_of(F.coalesce(_text(a + "Journal.JournalIssue.PubDate.Year"), _text(a + "Journal.JournalIssue.PubDate.MedlineDate"))),
        "journal": F.coalesce(_text(a + "Journal.Title"), _text(a + "Journal.ISOAbbreviation")),
    }


def _doaj() -> dict[str, Column]:
    ids = F.from_json(_at("bibjson.identifier"), "ARRAY<STRUCT<type: STRING, id: STRING>>")
    links = F.filter(F.from_json(_at("bibjson.link"), "ARRAY<STRUCT<type: STRING, url: STRING>>"), lambda x: x["type"] == "fulltext")
    return {
        "title": _text("bibjson.title"), "authors": _names(_list("bibjson.author", "STRUCT<name: STRING>"), lambda a: a["name"]), "abstract": _text("bibjson.abstract"), "doi": _first(F.filter(ids, lambda x: F.lower(x["type"]) == "doi"))["id"],
        "year": _int("bibjson.year").cast("int"), "journal": _text("bibjson.journal.title"), "url": F.try_element_at(links, F.lit(-1))["url"], "open_access": F.lit(True), "keywords": F.coalesce(F.slice(_list("bibjson.keywords"), 1, 10), F.array().cast("array<string>")),
    }


def _core() -> dict[str, Column]:
    urls = F.filter(F.array(_text("downloadUrl"), _first(_list("sourceFulltextUrls"))), lambda u: u.isNotNull())
    is_pdf = lambda u: F.lower(u).endswith(".pdf")
    return {
        "title": _text("title"), "authors": _names(_list("authors", "STRUCT<name: STRING>"), lambda a: a["name"]), "abstract": _text("abstract"), "doi": _text("doi"), "year": _int("yearPublished").cast("int"), "journal": _text("publisher"),
        "url": _first(F.filter(urls, lambda u: ~is_pdf(u))), "pdf_url": _first(F.filter(urls, is_pdf)), "citations_count": _int("citationCount"), "open_access": F.lit(True), "keywords": F.coalesce(F.slice(_list("topics"), 1, 10), F.array().cast("array<string>")),
    }


def _dblp() -> dict[str, Column]:
    ee = _list("info.ee")
    return {
        "title": truthy(F.regexp_replace(_text("info.title"), r"\.$", "")), "authors": _names(_list("info.authors.author", "STRUCT<text: STRING>"), lambda a: a["text"]), "doi": _text("info.doi"), "year": _int("info.year").cast("int"), "journal": _text("info.venue"),
        "url": F.coalesce(_text("info.url"), _first(F.filter(ee, lambda u: ~F.lower(u).endswith(".pdf")))), "pdf_url": _first(F.filter(ee, lambda u: F.lower(u).endswith(".pdf"))), "keywords": F.filter(F.array(_text("info.type")), lambda k: k.isNotNull()),
    }


def _flat(separator: str = r"\s*;\s*", journal: str | None = None) -> Callable[[], dict[str, Column]]:
    """Payloads of a title, authors in one text or as a list of names, and a date."""

    def parse() -> dict[str, Column]:
        listed = _names(_list("authors", "STRUCT<name: STRING>"), lambda a: a["name"])
        authors = F.when(F.ltrim(_at("authors")).startswith("["), listed).otherwise(_split_names("authors", separator))
        return {"title": truthy(F.regexp_replace(_text("title"), r"\s*\n\s*", " ")), "authors": authors, "abstract": _text("abstract"), "doi": _text("doi"), "year": year_of(_text("date")), "journal": F.lit(journal) if journal else _text("journal")}

    return parse


PARSERS: dict[str, Callable[[], dict[str, Column]]] = {
    "openalex": _openalex, "crossref": _crossref, "semantic_scholar": _semantic_scholar, "pubmed": _pubmed, "doaj": _doaj, "core": _core, "dblp": _dblp,
    "arxiv": _flat(), "biorxiv": _flat(journal="bioRxiv"), "medrxiv": _flat(journal="medRxiv"), "elsevier": _flat(), "wos": _flat(), "google_scholar": _flat(),
}
_TYPES = {"title": "string", "authors": "array<string>", "abstract": "string", "doi": "string", "year": "int", "journal": "string", "url": "string", "pdf_url": "string", "citations_count": "bigint", "references_count": "bigint", "open_access": "boolean", "keywords": "array<string>"}


def reader(source: str) -> Callable[[], dict[str, Column]]:
    if source not in PARSERS:
        raise ValueError(f"unknown source: {source}")
    return PARSERS[source]


def readable(landing: DataFrame, record_id: str, payload: str) -> DataFrame:
    """(record_id, source, p, v): payloads that are JSON, unwrapped, as text and parsed, under the first of their sources."""
    rows = landing.select(F.col(record_id), F.trim(F.split("source", ",")[0]).alias("source"), _unwrapped(F.col(payload)).alias("p"))
    return parsed(rows)


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``v``, the payload ``p`` parsed once for all paths that are read; those that are no JSON are left out."""
    return rows.withColumn("v", F.try_parse_json("p")).filter("v IS NOT NULL")


def _parsed(rows: DataFrame, source: str, record_id: str) -> DataFrame:
    fields = reader(source)()
    columns = [fields.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in COLUMNS]
    out = rows.filter(F.col("source") == source).select(record_id, F.lit(source).alias("source"), *columns)
    return out.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))).filter("title IS NOT NULL")


def parse(landing: DataFrame, source: str, record_id: str = "paper_id", payload: str = "raw_data") -> DataFrame:
    """(record_id, source, the canonical columns) of one source's payloads."""
    return _parsed(readable(landing, record_id, payload), source, record_id)


def parse_all(landing: DataFrame, record_id: str = "paper_id", payload: str = "raw_data", sources: tuple[str, ...] = tuple(PARSERS)) -> DataFrame:
    """The rows of all sources, each by its own parser.

    Payloads are written once, a folder for each source, so every parser reads its own only.
    """
    rows = materialise(readable(landing, record_id, payload).filter(F.col("source").isin(*sources)), by="source")
    out = None
    for s in sources:
        part = _parsed(rows, s, record_id)
        out = part if out is None else out.unionByName(part)
    return out


def concepts(landing: DataFrame, record_id: str = "paper_id", payload: str = "raw_data", least: float = 0.3) -> DataFrame:
    """(record_id, concept, score) of the concepts payloads name with a score of ``least`` or more."""
    rows = parsed(landing.select(F.col(record_id), _unwrapped(F.col(payload)).alias("p")))
    each = rows.select(record_id, F.explode(F.from_json(_at("concepts"), "ARRAY<STRUCT<display_name: STRING, score: DOUBLE>>")).alias("c"))
    return each.filter(F.col("c.score") >= least).select(record_id, F.col("c.display_name").alias("concept"), F.col("c.score").alias("score"))
