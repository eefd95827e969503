"""Searches of authors, institutions and journals, and of the records that belong to them.

All are filters and joins of tables: they push down to the scan, and joins with a table of fixed size are left to the
optimiser's size check.  A condition left at None or empty sets none; NULL values meet no condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.operators.search import sort_order, text_match


def _holds(column: str, query: str | None) -> Column:
    return F.coalesce(F.lower(column).contains(query.lower()), F.lit(False)) if query else F.lit(True)


def _equals(column: str, value) -> Column:
    if value is None:
        return F.lit(True)
    c, v = (F.lower(column), value.lower()) if isinstance(value, str) else (F.col(column), value)
    return F.coalesce(c == v, F.lit(False))


def find_authors(authors: DataFrame, query: str | None = None, institution: str | None = None, has_orcid: bool | None = None) -> DataFrame:
    """Author rows whose name holds ``query``, of an affiliation that holds ``institution``, with or without an ORCID."""
    out = authors.filter(_holds("name", query))
    if institution:
        out = out.filter(F.coalesce(F.exists("affiliations", lambda a: F.coalesce(F.lower(a).contains(institution.lower()), F.lit(False))), F.lit(False)))
    if has_orcid is not None:
        out = out.filter(F.coalesce(F.length(F.trim("orcid")) > 0, F.lit(False)) == has_orcid)
    return out


def find_institutions(institutions: DataFrame, query: str | None = None, country: str | None = None, kind: str | None = None) -> DataFrame:
    return institutions.filter(_holds("name", query) & _equals("country", country) & _equals("type", kind))


def find_journals(journals: DataFrame, query: str | None = None, publisher: str | None = None, country: str | None = None, open_access: bool | None = None) -> DataFrame:
    return journals.filter(_holds("title", query) & _holds("publisher", publisher) & _equals("country", country) & _equals("is_oa", open_access))


def journal(journals: DataFrame, issn: str) -> DataFrame:
    """The journal of an ISSN, with or without its hyphen."""
    return journals.filter(F.upper(F.regexp_replace("issn", r"[\s-]", "")) == issn.replace("-", "").strip().upper())


def works_in(records: DataFrame, journals: DataFrame, query: str = "", limit: int | None = None, by: str = "relevance", ord: str = "ord") -> DataFrame:
    """Records that appeared in one of ``journals`` and hold ``query``; the first ``limit`` under a sort keyword."""
    titles = journals.select(F.lower("title").alias("_journal")).distinct()
    out = records.filter(text_match(query)).withColumn("_journal", F.lower("journal")).join(titles, "_journal", "left_semi").drop("_journal")
    return out if limit is None else out.orderBy(*sort_order(by, ord)).limit(limit)


def works_about(records: DataFrame, concepts: DataFrame, concept: str, query: str = "", record_id: str = "paper_id") -> DataFrame:
    """Records to which ``concepts`` (record_id, concept, score) gives a concept, and that hold ``query``."""
    ids = concepts.filter(F.lower("concept") == concept.lower()).select(record_id)
    return records.filter(text_match(query)).join(ids, record_id, "left_semi")


def related(records: DataFrame, links: DataFrame, limit: int = 10, record_id: str = "paper_id", others: str = "related_ids") -> DataFrame:
    """(record_id, nth, other_id) of the first ``limit`` entries of each record's list of related ids, in the list's order; ids that are no records are left out after the cut."""
    each = links.select(record_id, F.posexplode(F.slice(others, 1, limit)).alias("nth", "other_id"))
    return each.join(records.select(F.col(record_id).alias("other_id")), "other_id", "left_semi").select(record_id, "nth", "other_id")
