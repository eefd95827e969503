"""Filters, sorting, paging and fair interleaving of ranked record sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.operators.ranking import row_numbers


# Where payloads of the sources hold what a filter asks for, and whether a part of a value is enough.
PAYLOAD_FIELDS: dict[str, tuple[tuple[str, ...], bool]] = {
    "work_type": (("type", "info.type", "subtypeDescription"), False), "concept": (("concepts[*].display_name",), False), "category": (("category", "categories"), True), "mesh": (("MedlineCitation.MeshHeadingList[*].DescriptorName",), False),
    "field_of_study": (("fieldsOfStudy",), False), "language": (("language", "bibjson.journal.language"), False), "issn": (("ISSN", "bibjson.journal.issns"), False),
    "institution": (("authorships[*].institutions[*].display_name", "author[*].affiliation[*].name", "bibjson.author[*].affiliation", "MedlineCitation.Article.AuthorList[*].AffiliationInfo[*].Affiliation"), True),
}


def payload_holds(paths: Sequence[str], value: str, part: bool = False, payload: str = "raw_data") -> Column:
    """Whether one of the values at ``paths`` of a JSON payload is ``value``, or holds it, whatever the case; a broken payload holds nothing."""
    whole = F.try_parse_json(payload)
    plain = F.when(F.ltrim(payload).startswith('"'), F.try_variant_get(whole, "$", "string")).otherwise(F.col(payload))  # wrapped twice
    wanted = value.lower()
    out = F.lit(False)
    for path in paths:
        raw = F.get_json_object(plain, "$." + path)
        quoted = F.transform(F.regexp_extract_all(raw, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda v: F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
        values = F.when(raw.startswith("[") | raw.startswith('"'), quoted).otherwise(F.array(raw))  # lists within lists are read as one
        meets = lambda v: F.coalesce(F.lower(v).contains(wanted) if part else F.lower(v) == wanted, F.lit(False))
        out = out | F.coalesce(F.exists(values, meets), F.lit(False))
    return F.when(whole.isNotNull(), out).otherwise(False)


@dataclass(frozen=True)
class Filter:
    """A conjunction of conditions on records; a field left at None sets none.

    ``year`` is a year or an inclusive (first, last); ``cited_more_than`` is strict; ``venue`` is a
    whole journal title.  Conditions from ``work_type`` on are read from the payload in ``raw_data``.
    """

    text: str | None = None
    year: int | tuple[int | None, int | None] | None = None
    author: str | None = None
    journal: str | None = None
    source: str | None = None
    keyword: str | None = None
    open_access: bool | None = None
    cited_more_than: int | None = None
    has_abstract: bool | None = None
    has_references: bool | None = None
    has_doi: bool | None = None
    has_pdf: bool | None = None
    venue: str | None = None
    work_type: str | None = None
    concept: str | None = None
    category: str | None = None
    mesh: str | None = None
    field_of_study: str | None = None
    language: str | None = None
    institution: str | None = None
    issn: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.text:
            out = out & text_match(self.text)
        if isinstance(self.year, tuple):
            low, high = self.year
            out = out & F.col("year").between(low if low is not None else 0, high if high is not None else 9999)
        elif self.year is not None:
            out = out & (F.col("year") == self.year)
        if self.author:
            out = out & author_match(self.author)
        if self.journal:
            out = out & F.lower("journal").contains(self.journal.lower())
        if self.source:
            out = out & F.array_contains(F.split("source", r"\s*,\s*"), self.source)
        if self.keyword:
            out = out & F.exists("keywords", lambda k: F.lower(k) == self.keyword.lower())
        if self.open_access is not None:
            out = out & (F.col("open_access") == self.open_access)
        if self.cited_more_than is not None:
            out = out & (F.col("citations_count") > self.cited_more_than)
        if self.venue:
            out = out & (F.lower("journal") == self.venue.lower())
        for name, (paths, part) in PAYLOAD_FIELDS.items():
            if getattr(self, name):
                out = out & payload_holds(paths, getattr(self, name), part)
        for wanted, c in ((self.has_pdf, F.length("pdf_url") > 0), (self.has_abstract, F.length("abstract") > 0), (self.has_references, F.col("references_count") > 0), (self.has_doi, F.length("doi") > 0)):
            if wanted is not None:
                out = out & (F.coalesce(c, F.lit(False)) == wanted)
        return out


def text_match(query: str) -> Column:
    """Whether title, abstract or an author holds the query, whatever the case; an empty query matches all."""
    q = query.lower()
    holds = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return F.lit(True) if not q else holds(F.col("title")) | holds(F.col("abstract")) | F.coalesce(F.exists("authors", holds), F.lit(False))


def author_match(query: str) -> Column:
    return F.coalesce(F.exists("authors", lambda a: F.lower(a).contains(query.lower())), F.lit(False))


def sort_order(by: str, ord: str = "ord") -> list[Column]:
    """The order of a sort keyword; NULL counts as 0, ties keep the order of ``ord``; an unknown keyword keeps it too."""
    count, year = F.coalesce("citations_count", F.lit(0)), F.coalesce("year", F.lit(0))
    return {"citations": [count.desc()], "date": [year.desc()], "date_asc": [year.asc()]}.get(by, []) + [F.col(ord).asc()]


def arxiv_sort(by: str | None) -> tuple[str, str]:
    """Field and direction the preprint server is asked to sort by; what it cannot sort by comes by relevance and is sorted afterwards."""
    return {"date": ("submittedDate", "descending"), "date_asc": ("submittedDate", "ascending")}.get(by or "relevance", ("relevance", "descending"))


def ranked(records: DataFrame, by: str, ord: str = "ord", name: str = "rank") -> DataFrame:
    """``records`` with their place under a sort keyword."""
    return row_numbers(records, sort_order(by, ord), name)


def page(records: DataFrame, limit: int, offset: int = 0, by: str = "relevance", ord: str = "ord") -> DataFrame:
    """A page of the records under a sort keyword; the offset counts rows, not pages."""
    return records.orderBy(*sort_order(by, ord)).offset(offset).limit(limit)


def two_step(records: DataFrame, condition: Column, limit: int, factor: int = 5, ord: str = "ord") -> DataFrame:
    """The first ``factor * limit`` records, of those the ones that meet a condition, of those the first ``limit``."""
    return records.orderBy(ord).limit(factor * limit).filter(condition).orderBy(ord).limit(limit)


def interleave(records: DataFrame, sources: Sequence[str], source: str = "source", ord: str = "ord", name: str = "place") -> DataFrame:
    """The first record of each source in turn, then the second of each, and so on; ``name`` is the place from 1.

    A place follows from the rank within the source and the sources' sizes alone, a row each,
    so the merged list is never sorted as a whole.  A record of several sources counts for the
    first it names; records of other sources are left out.
    """
    own = records.withColumn("_own", F.trim(F.split(source, ",")[0])).filter(F.col("_own").isin(*sources))
    own = row_numbers(own, [F.col(ord)], "_rank", ["_own"])
    sizes = {r["_own"]: r["count"] for r in own.groupBy("_own").count().collect()}  # a row per source asked for
    place = F.lit(1).cast("long")
    pos = F.array_position(F.array(*map(F.lit, sources)), F.col("_own"))
    for i, s in enumerate(sources, 1):
        n = sizes.get(s, 0)
        place = place + F.least(F.lit(n), F.col("_rank") - 1) + F.when((pos > i) & (F.col("_rank") <= n), 1).otherwise(0)
    return own.withColumn(name, place).drop("_rank", "_own")


def distinct_authors(records: DataFrame, query: str = "", ord: str = "ord") -> DataFrame:
    """(name, ord): each author name once, at its first record, of those that hold ``query``."""
    names = records.select(ord, F.explode("authors").alias("name")).filter(F.col("name").isNotNull() & F.lower("name").contains(query.lower()))
    return names.groupBy("name").agg(F.min(ord).alias(ord))


def author_records(records: DataFrame, author: str, limit: int | None = None, ord: str = "ord") -> DataFrame:
    """Records of which ``author`` is named exactly, most cited first."""
    out = records.filter(F.coalesce(F.array_contains("authors", author), F.lit(False))).orderBy(*sort_order("citations", ord))
    return out.limit(limit) if limit is not None else out


def lookup(records: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Records whose ``on`` is in a list of identifiers; the optimiser broadcasts the list if its size allows."""
    return records.join(ids.select(on).distinct(), on, "left_semi")
