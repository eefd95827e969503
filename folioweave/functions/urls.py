"""Expressions on web addresses and on the identifiers in them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions of documents that are no web pages.
_DOCUMENTS = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx")


def is_url(text: Column) -> Column:
    """Whether a text has a scheme and a host; false for NULL."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), F.lit(False))


def is_pdf_url(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(low.endswith(".pdf") | low.contains("/pdf/"), F.lit(False))


def extension(source: Column) -> Column:
    """What follows the last dot before any query, in lower case; empty without a dot."""
    path = F.substring_index(F.lower(source), "?", 1)
    return F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise("")


def reads_pdf(source: Column) -> Column:
    return F.coalesce((extension(source) == "pdf") | F.lower(source).contains("/pdf/"), F.lit(False))


def reads_html(source: Column) -> Column:
    known = extension(source).isin("html", "htm")
    page = F.lower(source).rlike("^https?://") & ~extension(source).isin(*_DOCUMENTS)
    return F.coalesce(known | page, F.lit(False))


def extractor(source: Column) -> Column:
    """The extractor that takes a source: pdf before html; NULL for none."""
    return F.when(reads_pdf(source), "pdf").when(reads_html(source), "html")


def arxiv_id(text: Column) -> Column:
    """A preprint number of the new or the old form anywhere in a text, without its version."""
    new = F.nullif(F.regexp_extract(text, r"(\d{4}\.\d{4,5})(?:v\d+)?", 1), F.lit(""))
    old = F.nullif(F.regexp_extract(text, r"([a-z-]+/\d{7})(?:v\d+)?", 1), F.lit(""))
    return F.coalesce(new, old)


def normalize_arxiv_id(identifier: Column) -> Column:
    """The identifier without prefixes, if the rest is of a valid form, version included."""
    bare = F.trim(identifier)
    for prefix in ("arxiv:", "arXiv:", "https://arxiv.org/abs/", "http://arxiv.org/abs/", "https://arxiv.org/pdf/", ".pdf"):
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    return F.when(bare.rlike(r"^(?:\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?$"), bare)


def pdf_url(url: Column) -> Column:
    """The direct address of a PDF as far as rules tell it; any other address unchanged."""
    bare = F.regexp_replace(url, "/+$", "")
    return (
        F.when(F.lower(url).endswith(".pdf"), url)
        .when(url.contains("arxiv.org/abs/"), F.concat(F.lit("https://arxiv.org/pdf/"), F.substring_index(F.substring_index(url, "/abs/", -1), "v", 1), F.lit(".pdf")))
        .when(url.contains("arxiv.org/pdf/"), F.concat(url, F.lit(".pdf")))
        .when(url.contains("biorxiv.org/content/") | url.contains("medrxiv.org/content/"), F.concat(bare, F.lit(".full.pdf")))
        .when(url.contains("ncbi.nlm.nih.gov/pmc/articles/"), F.when(url.endswith("/pdf/"), url).otherwise(F.concat(bare, F.lit("/pdf/"))))
        .otherwise(url)
    )


def file_name(original: Column, direct: Column) -> Column:
    """A file name without extension from the identifiers in two addresses, the direct one first; else from a digest."""

    def of(url: Column) -> Column:
        preprint = F.nullif(F.regexp_extract(url, r"10\.1101/[\d.]+", 0), F.lit(""))
        central = F.nullif(F.regexp_extract(url, r"(?i)PMC\d+", 0), F.lit(""))
        return F.coalesce(F.concat(F.lit("arxiv_"), F.replace(arxiv_id(url), F.lit("/"), F.lit("_"))), F.concat(F.lit("preprint_"), F.translate(preprint, "/.", "__")), F.lower(central))

    return F.coalesce(of(direct), of(original), F.concat(F.lit("paper_"), F.left(F.md5(original), F.lit(12))))
