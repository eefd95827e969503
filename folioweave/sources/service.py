"""Entries in the forms services answer with: PubMed and arXiv XML, Scopus, Scholar, preprint and citation-index JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.functions.text import normalize_doi, strip, truthy, year_of
from folioweave.sources.records import _list, _names, _text, parsed

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _canonical(rows: DataFrame, record_id: str, source: str, **columns: Column) -> DataFrame:
    types = {"authors": _NONE, "keywords": _NONE, "year": "int", "citations_count": "bigint", "references_count": "bigint", "open_access": "boolean"}
    names = ("title", "authors", "abstract", "doi", "year", "journal", "url", "pdf_url", "citations_count", "references_count", "open_access", "keywords")
    out = rows.select(record_id, F.lit(source).alias("source"), *(columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in names))
    return out.withColumn("authors", F.coalesce("authors", _empty())).withColumn("keywords", F.coalesce("keywords", _empty())).filter("title IS NOT NULL AND title <> ''")


def pubmed_articles(pages: DataFrame, record_id: str, xml: str) -> DataFrame:
    """A row for each article element: one a row of ``pages``.

    Parts of an abstract are joined, each behind its label if it has one, with the text of the
    elements inside them; an author is a group's name, or the given name, else the initials, and
    the family name; the year falls back to a free date, a full-text archive number gives the PDF address and open access.
    """
    # each element is read by itself, so its own parts stay together and in order
    elements = lambda tag, within: F.regexp_extract_all(within, F.lit(rf"(?s)<{tag}(?:\s[^<>]*)?(?<!/)>.*?</{tag}>"), F.lit(0))
    inner = lambda x, path: strip(F.call_function("xpath_string", x, F.lit(path)))
    has = lambda x, path: F.call_function("xpath_boolean", x, F.lit(path))
    given = lambda x: F.when(has(x, "/Author/ForeName"), inner(x, "/Author/ForeName")).otherwise(inner(x, "/Author/Initials"))
    single = lambda x: F.when(has(x, "/Author/LastName"), truthy(F.concat_ws(" ", truthy(given(x)), truthy(inner(x, "/Author/LastName")))))
    person = lambda x: F.when(has(x, "/Author/CollectiveName"), inner(x, "/Author/CollectiveName")).otherwise(single(x))
    listed = F.get(elements("AuthorList", F.col(xml)), F.lit(0))
    names = F.filter(F.transform(elements("Author", listed), person), lambda n: n.isNotNull())
    part = lambda x: F.when(truthy(inner(x, "/AbstractText")).isNotNull(), F.concat_ws(": ", truthy(F.call_function("xpath_string", x, F.lit("/AbstractText/@Label"))), inner(x, "/AbstractText")))
    said = F.get(elements("Abstract", F.col(xml)), F.lit(0))
    abstract = F.array_join(F.transform(elements("AbstractText", said), part), " ")
    archive = truthy(F.expr(f"xpath_string({xml}, '//ArticleIdList/ArticleId[@IdType=\"pmc\"]')"))
    at = lambda path: truthy(F.expr(f"xpath_string({xml}, '{path}')"))
    number = at("//PMID")
    return _canonical(
        pages, record_id, "pubmed", title=truthy(strip(F.expr(f"xpath_string({xml}, '//ArticleTitle')"))), authors=names, abstract=truthy(abstract), doi=F.lower(at('//ArticleIdList/ArticleId[@IdType="doi"]')),
        year=F.coalesce(year_of(at("//JournalIssue/PubDate/Year")), year_of(at("//JournalIssue/PubDate/MedlineDate"))), journal=F.coalesce(at("//Journal/Title"), at("//Journal/ISOAbbreviation")), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), number, F.lit("/")),
        pdf_url=F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), archive, F.lit("/pdf/")), open_access=archive.isNotNull(), keywords=F.slice(F.expr(f"xpath({xml}, '//MeshHeading/DescriptorName/text()')"), 1, 10),
    )


def arxiv_entries(pages: DataFrame, record_id: str, xml: str) -> DataFrame:
    """A row for each entry element of an Atom feed: one a row of ``pages``; the version is taken off the number."""
    every = lambda path: F.expr(f"xpath({xml}, '{path}')")
    at = lambda path: truthy(strip(F.regexp_replace(F.expr(f"xpath_string({xml}, '{path}')"), r"\s*\n\s*", " ")))
    local = lambda name: f"//*[local-name()=\"{name}\"]"
    number = F.regexp_replace(F.regexp_extract(at("/*" + local("id")), r"/abs/(.+)$", 1), r"v\d+$", "")
    terms = every(local("category") + "/@term")
    return _canonical(
        pages, record_id, "arxiv", title=at(local("title")), authors=every(local("author") + "/*[local-name()=\"name\"]/text()"), abstract=at(local("summary")), doi=normalize_doi(F.coalesce(at(local("doi")), at(local("link") + "[@title=\"doi\"]/@href"))),
        year=F.expr(f"try_cast(left(xpath_string({xml}, '{local('published')}'), 4) AS INT)"), journal=F.concat(F.lit("arXiv:"), F.get(terms, F.lit(0))), url=F.concat(F.lit("https://arxiv.org/abs/"), truthy(number)), pdf_url=F.concat(F.lit("https://arxiv.org/pdf/"), truthy(number), F.lit(".pdf")),
        open_access=F.lit(True), keywords=terms,
    )


def _payload(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    return parsed(rows.select(F.col(record_id), F.col(payload).alias("p")))


def _key(name: str) -> Column:
    return truthy(F.get_json_object("p", f"$['{name}']"))


def scopus_entries(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    """Search entries: creators split on commas, the year from the cover date, a count of 0 is unknown, open access if flagged 1."""
    count = F.nullif(F.expr("try_cast(get_json_object(p, \"$['citedby-count']\") AS BIGINT)"), F.lit(0))
    authors = F.filter(F.transform(F.split(_key("dc:creator"), ","), strip), lambda a: a != "")
    return _canonical(
        _payload(rows, record_id, payload), record_id, "elsevier", title=_key("dc:title"), authors=authors, abstract=_key("dc:description"), doi=normalize_doi(_key("prism:doi")), year=F.expr("try_cast(left(get_json_object(p, \"$['prism:coverDate']\"), 4) AS INT)"),
        journal=_key("prism:publicationName"), url=_key("prism:url"), citations_count=count, open_access=_key("openaccess") == "1",
    )


def scopus_records(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    """Abstract records: a list of authors or a single one, by indexed name, else the indexed name they prefer; the address is the first link."""
    own, preferred = "ce:indexed-name", "preferred-name"
    name = lambda a: F.coalesce(truthy(a[own]), truthy(a[preferred][own]))
    at = lambda key: truthy(F.get_json_object("p", f"$.coredata['{key}']"))
    links = F.from_json(F.get_json_object("p", "$.coredata.link"), "ARRAY<STRUCT<`@href`: STRING>>")
    return _canonical(
        _payload(rows, record_id, payload), record_id, "elsevier", title=at("dc:title"), authors=_names(_list("authors.author", f"STRUCT<`{own}`: STRING, `{preferred}`: STRUCT<`{own}`: STRING>>"), name), abstract=at("dc:description"), doi=normalize_doi(at("prism:doi")),
        year=F.expr("try_cast(left(get_json_object(p, \"$.coredata['prism:coverDate']\"), 4) AS INT)"), journal=at("prism:publicationName"), url=F.get(links, F.lit(0))["@href"], citations_count=F.nullif(F.expr("try_cast(get_json_object(p, \"$.coredata['citedby-count']\") AS BIGINT)"), F.lit(0)),
    )


def cited_references(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    """References of a citation index: authors set apart by semicolons, a cited work for the journal."""
    authors = F.transform(F.split(_text("citedAuthor"), ";"), strip)
    return _canonical(
        _payload(rows, record_id, payload), record_id, "wos", title=_text("citedTitle"), authors=authors, doi=normalize_doi(_text("doi")), year=F.expr("try_cast(get_json_object(p, '$.year') AS INT)"), journal=_text("citedWork"),
    )


def directory_journals(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    """(record_id, journal_id, title, eissn, pissn, publisher, subjects, has_apc, licenses, url) of a directory's journals; those without a title are left out."""
    p = _payload(rows, record_id, payload)
    terms = lambda path, field: _names(_list(path, f"STRUCT<{field}: STRING>"), lambda x: x[field])
    out = p.select(
        record_id, _text("id").alias("journal_id"), _text("bibjson.title").alias("title"), _text("bibjson.eissn").alias("eissn"), _text("bibjson.pissn").alias("pissn"), _text("bibjson.publisher.name").alias("publisher"),
        terms("bibjson.subject", "term").alias("subjects"), F.coalesce(F.expr("try_cast(get_json_object(p, '$.bibjson.apc.has_apc') AS BOOLEAN)"), F.lit(False)).alias("has_apc"), terms("bibjson.license", "type").alias("licenses"), _text("bibjson.ref.journal").alias("url"),
    )
    return out.filter("title IS NOT NULL")


def scholar_results(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    """Result entries: authors, journal and year from a summary in parts set apart by dashes; a PDF among the resources."""
    parts = F.split(_text("publication_info.summary"), r"\s-\s")
    middle = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - F.when(F.size(parts) > 2, 2).otherwise(1)))
    named = _names(_list("publication_info.authors", "STRUCT<name: STRING>"), lambda a: a["name"])
    listed = F.filter(F.transform(F.split(F.get(parts, F.lit(0)), ","), strip), lambda a: (a != "") & (a != "…"))
    before = strip(F.substring_index(middle, ",", 1))
    link = _text("link")
    files = F.filter(_list("resources", "STRUCT<file_format: STRING, link: STRING>"), lambda r: F.upper(r["file_format"]) == "PDF")
    return _canonical(
        _payload(rows, record_id, payload), record_id, "google_scholar", title=_text("title"), authors=F.when(F.size(named) > 0, named).otherwise(listed), abstract=_text("snippet"), doi=F.when(link.contains("doi.org/"), normalize_doi(link)), year=year_of(middle),
        journal=F.when(~before.rlike(r"^\d+$"), truthy(before)), url=link, pdf_url=F.get(files, F.lit(0))["link"], citations_count=F.expr("try_cast(get_json_object(p, '$.inline_links.cited_by.total') AS BIGINT)"),
    )


def preprint_entries(rows: DataFrame, record_id: str, payload: str, server: str = "biorxiv") -> DataFrame:
    """Entries of a preprint server: authors set apart by semicolons, or by commas where there are none; addresses follow from the DOI."""
    written = _text("authors")
    authors = F.filter(F.transform(F.when(written.contains(";"), F.split(written, ";")).otherwise(F.split(written, ",")), strip), lambda a: a != "")
    label = {"biorxiv": "bioRxiv", "medrxiv": "medRxiv"}[server]
    page = F.concat(F.lit(f"https://www.{server}.org/content/"), _text("doi"))
    category = _text("category")
    return _canonical(
        _payload(rows, record_id, payload), record_id, server, title=_text("title"), authors=authors, abstract=_text("abstract"), doi=normalize_doi(_text("doi")), year=year_of(_text("date")),
        journal=F.when(category.isNotNull(), F.concat(F.lit(f"{label} - "), category)).otherwise(label), url=page, pdf_url=F.concat(page, F.lit(".full.pdf")), open_access=F.lit(True), keywords=F.filter(F.array(category), lambda k: k.isNotNull()),
    )


def citation_index_records(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    """Full records of a citation index: the title of type item, names in order, abstract parts joined."""
    s, f = "static_data.summary.", "static_data.fullrecord_metadata."
    title = F.get(F.filter(_list(s + "titles.title", "STRUCT<type: STRING, content: STRING>"), lambda t: t["type"] == "item"), F.lit(0))["content"]
    names = _names(_list(s + "names.name", "STRUCT<full_name: STRING, display_name: STRING>"), lambda n: F.coalesce(truthy(n["full_name"]), n["display_name"]))
    parts = _list(f + "abstracts.abstract.abstract_text", "STRUCT<p: STRING>")
    ids = F.filter(_list("dynamic_data.cluster_related.identifiers.identifier", "STRUCT<type: STRING, value: STRING>"), lambda i: i["type"] == "doi")
    source = F.filter(_list(s + "titles.title", "STRUCT<type: STRING, content: STRING>"), lambda t: t["type"] == "source")
    return _canonical(
        _payload(rows, record_id, payload), record_id, "wos", title=truthy(strip(F.regexp_replace(title, r"<[^>]+>", ""))), authors=names, abstract=truthy(F.array_join(F.transform(parts, lambda p: p["p"]), " ")), doi=normalize_doi(F.get(ids, F.lit(0))["value"]),
        year=F.expr(f"try_cast(get_json_object(p, '$.{s}pub_info.pubyear') AS INT)"), journal=F.get(source, F.lit(0))["content"], citations_count=F.expr("try_cast(get_json_object(p, '$.dynamic_data.citation_related.tc_list.silo_tc.local_count') AS BIGINT)"),
        keywords=_list(f + "keywords.keyword"), open_access=_text(f + "fund_ack.fund_text").isNotNull(),
    )


def author_addresses(rows: DataFrame, record_id: str, payload: str) -> DataFrame:
    """(record_id, name, address): the names of a citation-index record with the addresses their number points to."""
    p = _payload(rows, record_id, payload)
    names = p.select(record_id, F.explode(_list("static_data.summary.names.name", "STRUCT<full_name: STRING, addr_no: STRING>")).alias("n"))
    places = p.select(F.col(record_id), F.explode(_list("static_data.fullrecord_metadata.addresses.address_name", "STRUCT<address_spec: STRUCT<addr_no: STRING, full_address: STRING>>")).alias("a"))
    places = places.select(record_id, F.col("a.address_spec.addr_no").alias("addr_no"), F.col("a.address_spec.full_address").alias("address"))
    return names.select(record_id, F.col("n.full_name").alias("name"), F.col("n.addr_no").alias("addr_no")).join(places, [record_id, "addr_no"], "left").select(record_id, "name", "address")
