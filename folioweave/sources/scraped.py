"""Web pages of a scholarly search engine: result lists and author profiles, read in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioweave.functions.text import normalize_doi
from folioweave.operators.documents import page_tree

_RESULT = {"gs_r", "gs_or", "gs_scl"}


def _flat(node) -> str:
    return re.sub(r"\s+", " ", node.text()).strip()


def _first(node, tag: str, **attrs: str):
    """The first descendant of a tag that has a class, or another attribute of a value."""
    for n in node.nodes():
        if n.tag == tag and all(v in n.attrs.get("class", "").split() if k == "cls" else n.attrs.get(k) == v for k, v in attrs.items()):
            return n
    return None


def read_results(page: str) -> list[dict]:
    """The results of a page: title, address, authors, journal and year of the line below it, snippet, citations, PDF address, id."""
    out = []
    for div in page_tree(page).nodes():
        if div.tag != "div" or not _RESULT <= set(div.attrs.get("class", "").split()):
            continue
        head = _first(div, "h3", cls="gs_rt")
        link = _first(head, "a") if head else None
        title = _flat(link or head) if head else ""
        if not title:
            continue
        line, snippet, files = (_first(div, "div", cls=c) for c in ("gs_a", "gs_rs", "gs_or_ggsm"))
        parts = line.text().split(" - ") if line else [""]
        authors = [a for a in (x.strip() for x in parts[0].replace("…", "").strip().split(",")) if a]
        year = re.search(r"\b(?:19|20)\d{2}\b", parts[1]) if len(parts) > 1 else None
        cited = next((m for n in div.nodes() if n.tag == "a" and (m := re.search(r"Cited by (\d+)", n.text()))), None)
        file = _first(files, "a") if files else None
        out.append({
            "title": title, "url": link.attrs.get("href") if link else None, "authors": authors, "year": int(year[0]) if year else None, "journal": parts[1].replace(year[0], "").strip(" ,") if year else None,
            "abstract": _flat(snippet) if snippet else None, "citations_count": int(cited[1]) if cited else None, "pdf_url": file.attrs.get("href") if file else None, "result_id": div.attrs.get("data-cid") or None,
        })
    return out


def read_profile(page: str) -> dict | None:
    """Name, affiliation, citations and h-index of a profile page; None for a page of nobody."""
    root = page_tree(page)
    name = _first(root, "div", id="gsc_prf_in")
    if name is None:
        return None
    home, stats = _first(root, "div", cls="gsc_prf_il"), _first(root, "table", id="gsc_rsb_st")
    found: dict[str, int | None] = {"citations": None, "h-index": None}
    for row in stats.nodes() if stats else ():
        cells = [c for c in row.nodes() if c.tag == "td"] if row.tag == "tr" else []
        if len(cells) >= 2:
            label, number = cells[0].text().lower(), cells[1].text().replace(",", "").strip()
            kind = next((k for k in found if k in label), None)
            if kind and number.isdigit():
                found[kind] = int(number)
    return {"name": _flat(name), "affiliations": [_flat(home)] if home and _flat(home) else [], "citation_count": found["citations"], "h_index": found["h-index"]}


_RESULTS = "ARRAY<STRUCT<title: STRING, url: STRING, authors: ARRAY<STRING>, year: INT, journal: STRING, abstract: STRING, citations_count: BIGINT, pdf_url: STRING, result_id: STRING>>"
_PROFILE = "name STRING, affiliations ARRAY<STRING>, citation_count BIGINT, h_index INT"


def results(pages: DataFrame, page_id: str, page: str) -> DataFrame:
    """(page_id, nth, source, title, ...): a row for each result of each page; a NULL page has none."""

    @F.pandas_udf(_RESULTS)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: read_results(t or ""))

    rows = pages.select(F.col(page_id), F.posexplode(read(F.col(page))).alias("nth", "r")).select(page_id, "nth", F.lit("google_scholar").alias("source"), "r.*")
    return rows.withColumn("doi", F.when(F.col("url").contains("doi.org/"), normalize_doi(F.col("url"))))


def profiles(pages: DataFrame, author_id: str, page: str) -> DataFrame:
    """(author_id, source, name, affiliations, citation_count, h_index) of each profile page that names somebody."""

    @F.pandas_udf(_PROFILE)
    def read(texts: pd.Series) -> pd.DataFrame:
        none = {"name": None, "affiliations": None, "citation_count": None, "h_index": None}
        return pd.DataFrame([read_profile(t or "") or none for t in texts], columns=list(none)).astype({"citation_count": "Int64", "h_index": "Int32"})

    return pages.select(F.col(author_id), F.lit("google_scholar").alias("source"), read(F.col(page)).alias("p")).select(author_id, "source", "p.*").filter("name IS NOT NULL")
