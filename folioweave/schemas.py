"""Schemas of the entities, as DDL; a payload is a JSON text, a tree is rows with a parent."""

PAPER = (
    "title STRING, authors ARRAY<STRING>, abstract STRING, doi STRING, year INT, journal STRING, url STRING, pdf_url STRING, source STRING, raw_data STRING,"
    " citations_count BIGINT, references_count BIGINT, open_access BOOLEAN, keywords ARRAY<STRING>"
)
AUTHOR = "name STRING, source_id STRING, source STRING, affiliations ARRAY<STRING>, orcid STRING, url STRING, paper_count BIGINT, citation_count BIGINT, h_index INT, raw_data STRING"
INSTITUTION = "name STRING, source_id STRING, source STRING, country STRING, type STRING, url STRING, paper_count BIGINT, citation_count BIGINT, raw_data STRING"
CONTENT_BLOCK = "doc_id BIGINT, ord BIGINT, type STRING, content STRING, level INT, page INT"
SECTION = "doc_id BIGINT, section BIGINT, title STRING, level INT, text STRING"
CHAPTER = "doc_id BIGINT, ord BIGINT, title STRING, level INT, parent BIGINT"
CITATION_NODE = "paper_id BIGINT, title STRING, year INT, citations_count BIGINT"
CITATION_EDGE = "citing_id BIGINT, cited_id BIGINT"
SCORE = "paper_id BIGINT, score DOUBLE"
