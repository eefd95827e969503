"""Text expressions: identifiers, titles, years, truncation, markup."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Hosts that resolve a DOI.
RESOLVERS = ("doi.org", "dx.doi.org")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truthy(value: Column) -> Column:
    """The text unless it is empty."""
    return F.nullif(value, F.lit(""))


def normalize_doi(doi: Column, resolvers: tuple[str, ...] = RESOLVERS) -> Column:
    """Lower case without one leading resolver address or ``doi:``; NULL for nothing."""
    hosts = "|".join(h.replace(".", r"\.") for h in resolvers)
    return truthy(F.regexp_replace(F.lower(strip(doi)), rf"^(?:https?://(?:{hosts})/|doi:)", ""))


def normalize_title(title: Column) -> Column:
    """Lower case, stripped, runs of white space as one blank."""
    return F.regexp_replace(strip(F.lower(title)), r"(?U)\s+", " ")


def year_of(date: Column) -> Column:
    """The first year of 1900 to 2099 in a text."""
    return F.try_to_number(truthy(F.regexp_extract(date, r"\b((?:19|20)\d{2})\b", 1)), F.lit("9999")).cast("int")


def truncate(text: Column, length: int, suffix: str = "...") -> Column:
    """Text of more than ``length`` characters cut to that length, suffix included."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.left(text, F.lit(max(0, length - len(suffix)))), F.lit(suffix)))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def clean_html(text: Column) -> Column:
    """Entities resolved, then tags removed, white space collapsed; empty for NULL."""
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(_unescape(text), r"<[^>]+>", ""), r"(?U)\s+", " ")), F.lit(""))


def citation_word(text: Column) -> Column:
    """ASCII letters and digits in lower case, accents dropped."""
    return F.lower(F.regexp_replace(_ascii(text), r"[^A-Za-z0-9]", ""))


def safe_title(title: Column) -> Column:
    """A file name made from a title: word characters, hyphens and underscores, 100 at most."""
    return F.left(F.regexp_replace(F.regexp_replace(title, r"(?U)[^\w\s-]", ""), r"(?U)\s+", "_"), F.lit(100))


def listing(title: Column, authors: Column, year: Column, journal: Column, abstract: Column, citations: Column) -> Column:
    """A record as lines of plain text; fields that are empty, and zero citations, are left out."""
    names = F.array_join(F.slice(authors, 1, 5), ", ")
    count = F.size(authors)
    people = F.when(count > 5, F.concat(names, F.lit(" et al. ("), count.cast("string"), F.lit(" authors)"))).when(count > 0, names)
    place = truthy(F.concat_ws(" | ", F.when(year != 0, year.cast("string")), truthy(journal)))
    short = F.when(truthy(abstract).isNotNull(), truncate(abstract, 303))
    return F.concat_ws("\n", title, people, place, F.when(citations > 0, F.concat(F.lit("Citations: "), citations.cast("string"))), short)
