"""Payloads of authors and institutions as rows of one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.functions.score import institution_type
from folioweave.sources.records import _at, _int, _list, _names, _text, readable
from folioweave.session import materialise

AUTHOR = ("name", "source_id", "affiliations", "orcid", "url", "paper_count", "citation_count", "h_index")
_AUTHOR_TYPES = {"affiliations": "array<string>", "paper_count": "bigint", "citation_count": "bigint", "h_index": "int"}


def bare_orcid(path: str) -> Column:
    return F.regexp_replace(_text(path), r"^https?://[^/]+/", "")


def _openalex() -> dict[str, Column]:
    homes = _names(_list("affiliations", "STRUCT<institution: STRUCT<display_name: STRING>>"), lambda a: a["institution"]["display_name"])
    last = _names(_list("last_known_institutions", "STRUCT<display_name: STRING>"), lambda a: a["display_name"])
    return {
        "name": _text("display_name"), "source_id": F.regexp_replace(_text("id"), "^.*/", ""), "affiliations": F.when(F.size(last) > 0, last).otherwise(homes), "orcid": F.coalesce(bare_orcid("orcid"), bare_orcid("ids.orcid")),
        "url": _text("id"), "paper_count": _int("works_count"), "citation_count": _int("cited_by_count"), "h_index": _int("summary_stats.h_index"),
    }


def _semantic_scholar() -> dict[str, Column]:
    return {"name": _text("name"), "source_id": _text("authorId"), "affiliations": _names(_list("affiliations"), lambda a: a), "orcid": bare_orcid("externalIds.ORCID"), "url": _text("url"), "paper_count": _int("paperCount"), "citation_count": _int("citationCount"), "h_index": _int("hIndex")}


def _elsevier() -> dict[str, Column]:
    indexed = F.get_json_object("p", "$['preferred-name']['ced:indexed-name']")
    given = F.concat_ws(" ", F.get_json_object("p", "$['preferred-name']['given-name']"), F.get_json_object("p", "$['preferred-name']['surname']"))
    homes = _names(_list("affiliation-current", "STRUCT<`affiliation-name`: STRING>"), lambda a: a["affiliation-name"])
    at = lambda key: F.get_json_object("p", f"$.coredata['{key}']")
    count = lambda key: F.expr(f"try_cast(get_json_object(p, \"$.coredata['{key}']\") AS BIGINT)")
    return {"name": F.coalesce(F.nullif(given, F.lit("")), indexed), "source_id": F.regexp_replace(at("dc:identifier"), "^AUTHOR_ID:", ""), "affiliations": F.slice(homes, 1, 3), "orcid": at("orcid"), "paper_count": count("document-count"), "citation_count": count("citation-count")}


def _dblp() -> dict[str, Column]:
    notes = F.filter(_list("notes.note", "STRUCT<`@type`: STRING, text: STRING>"), lambda n: n["@type"] == "affiliation")
    return {"name": _text("author"), "source_id": F.regexp_replace(_text("url"), "^.*/pid/", ""), "affiliations": _names(notes, lambda n: n["text"]), "url": _text("url")}


def _google_scholar() -> dict[str, Column]:
    homes = F.filter(F.array(_text("affiliations")), lambda a: a.isNotNull())
    return {"name": _text("name"), "source_id": _text("author_id"), "affiliations": homes, "url": _text("link"), "citation_count": _int("cited_by")}


def _plain() -> dict[str, Column]:
    return {"name": _text("name"), "affiliations": _names(_list("affiliations"), lambda a: a)}


AUTHORS: dict[str, Callable[[], dict[str, Column]]] = {"openalex": _openalex, "semantic_scholar": _semantic_scholar, "elsevier": _elsevier, "dblp": _dblp, "google_scholar": _google_scholar, "pubmed": _plain, "wos": _plain}


def parse_authors(landing: DataFrame, record_id: str = "author_id", payload: str = "raw_data") -> DataFrame:
    """(record_id, source, the author columns) of every readable payload with a name; each parser reads its own source only."""
    base = materialise(readable(landing, record_id, payload).filter(F.col("source").isin(*AUTHORS)), by="source")
    out = None
    for source, fields in AUTHORS.items():
        f = fields()
        columns = [f.get(c, F.lit(None)).cast(_AUTHOR_TYPES.get(c, "string")).alias(c) for c in AUTHOR]
        part = base.filter(F.col("source") == source).select(record_id, "source", *columns).filter("name IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("affiliations", F.coalesce("affiliations", F.array().cast("array<string>")))


def parse_institutions(landing: DataFrame, record_id: str, payload: str = "raw_data") -> DataFrame:
    """(record_id, name, source_id, country, type, url, paper_count, citation_count) of payloads of either known shape."""
    rows = readable(landing.withColumn("source", F.lit("")), record_id, payload)
    scopus = lambda key: F.get_json_object("p", f"$['{key}']")
    name = F.coalesce(_text("display_name"), scopus("affiliation-name"))
    return rows.select(
        record_id, name.alias("name"), F.coalesce(F.regexp_replace(_text("id"), "^.*/", ""), F.regexp_replace(scopus("dc:identifier"), "^AFFILIATION_ID:", "")).alias("source_id"), F.coalesce(_text("country_code"), _at("country")).alias("country"),
        F.coalesce(_text("type"), institution_type(name)).alias("type"), _text("homepage_url").alias("url"), F.coalesce(_int("works_count"), F.expr("try_cast(get_json_object(p, \"$['document-count']\") AS BIGINT)")).alias("paper_count"), _int("cited_by_count").alias("citation_count"),
    ).filter("name IS NOT NULL")
