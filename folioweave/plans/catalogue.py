"""All queries of the core, by name, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioweave.functions import cite, score, text, urls
from folioweave.operators import directory, documents as docs, graph, nested, resolve, search
from folioweave.operators.ranking import row_numbers
from folioweave.plans import oracle
from folioweave.sources import files, people, records
from folioweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
# The test tables' resolver stands where the public ones do.
RESOLVERS = ("doi.test", "dx.doi.test")


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "papers").withColumn("ord", F.col("paper_id"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _table(spark, sf_dir, "papers").select("paper_id", "title", "year", "citations_count")
    return nodes, graph.edge_set(_table(spark, sf_dir, "citation_edges"), nodes)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.markdown_blocks(_table(spark, sf_dir, "documents"))


def _rounded(df: DataFrame, column: str = "score", digits: int = 9) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def _logged(df: DataFrame) -> DataFrame:
    """Scores as logarithms: scores of small graphs are short decimals that would lie on the edge of rounding."""
    return df.select("paper_id", F.round(F.log("score"), 9).alias("log_score"))


# --- scalars


@_query
def norm_title_keys(spark, sf_dir):
    return _papers(spark, sf_dir).select("paper_id", text.normalize_title(F.col("title")).alias("title_norm"))


@_query
def norm_doi_keys(spark, sf_dir):
    return _papers(spark, sf_dir).select("paper_id", text.normalize_doi(F.col("doi"), RESOLVERS).alias("doi_norm"))


@_query
def year_from_text(spark, sf_dir):
    return _papers(spark, sf_dir).select("paper_id", text.year_of(F.col("doi")).alias("year_found"))


@_query
def url_predicates(spark, sf_dir):
    u = F.col("u")
    rows = _papers(spark, sf_dir).select("paper_id", F.explode(F.array("url", "pdf_url")).alias("u")).filter("u IS NOT NULL")
    return rows.select("paper_id", "u", urls.is_url(u).alias("is_url"), urls.is_pdf_url(u).alias("is_pdf"), urls.extension(u).alias("ext"), urls.extractor(u).alias("extractor"))


@_query
def pdf_url_resolve(spark, sf_dir):
    u = F.coalesce("pdf_url", "url")
    rows = _papers(spark, sf_dir).filter(u.isNotNull())
    return rows.select("paper_id", urls.pdf_url(u).alias("pdf"), urls.file_name(F.coalesce("url", "pdf_url"), u).alias("file_name"), text.safe_title(F.col("title")).alias("title_file"))


@_query
def truncate_abstract(spark, sf_dir):
    return _papers(spark, sf_dir).select("paper_id", text.truncate(F.col("abstract"), 200).alias("short"))


@_query
def clean_markup(spark, sf_dir):
    return _papers(spark, sf_dir).select("paper_id", text.clean_html(F.col("abstract")).alias("plain"))


@_query
def record_listing(spark, sf_dir):
    c = F.col
    return _papers(spark, sf_dir).select("paper_id", text.listing(c("title"), c("authors"), c("year"), c("journal"), c("abstract"), c("citations_count")).alias("listing"))


@_query
def backoff_schedule(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("attempt"), score.backoff(F.col("id")).alias("seconds"))


@_query
def institution_types(spark, sf_dir):
    return _table(spark, sf_dir, "institutions").select("institution_id", score.institution_type(F.col("name")).alias("inferred"))


# --- filters, sorting, paging, interleaving


@_query
def text_match_filter(spark, sf_dir):
    return _papers(spark, sf_dir).filter(search.text_match("Harbour")).select("paper_id", "title")


@_query
def filter_conjunction(spark, sf_dir):
    wanted = search.Filter(year=(2000, 2015), cited_more_than=5, open_access=True, has_abstract=True)
    return _papers(spark, sf_dir).filter(wanted.condition()).select("paper_id", "year", "citations_count")


@_query
def source_author_filter(spark, sf_dir):
    wanted = search.Filter(source="openalex", author="wanda", year=(None, 2020))
    return _papers(spark, sf_dir).filter(wanted.condition()).select("paper_id", "source", "year")


@_query
def date_range_scan(spark, sf_dir):
    at = F.col("fetched_at")
    return _papers(spark, sf_dir).filter((at >= F.lit("2024-03-01").cast("timestamp_ntz")) & (at < F.lit("2024-06-01").cast("timestamp_ntz"))).select("paper_id", F.date_format(at, "yyyy-MM-dd").alias("day"))


@_query
def recent_papers(spark, sf_dir):
    as_of = F.lit("2024-12-31").cast("date")
    return _papers(spark, sf_dir).filter(F.col("fetched_at").cast("date").between(F.date_sub(as_of, 30), as_of)).select("paper_id")


@_query
def category_two_step_limit(spark, sf_dir):
    return search.two_step(_papers(spark, sf_dir), F.lower("journal").contains("letters"), 50).select("paper_id", "journal")


@_query
def sort_citations(spark, sf_dir):
    return search.ranked(_papers(spark, sf_dir).select("paper_id", "ord", "citations_count", "year"), "citations").select("paper_id", "rank")


@_query
def sort_date(spark, sf_dir):
    return search.ranked(_papers(spark, sf_dir).select("paper_id", "ord", "citations_count", "year"), "date").select("paper_id", "rank")


@_query
def sort_date_asc(spark, sf_dir):
    return search.ranked(_papers(spark, sf_dir).select("paper_id", "ord", "citations_count", "year"), "date_asc").select("paper_id", "rank")


@_query
def page_offset(spark, sf_dir):
    return search.page(_papers(spark, sf_dir), 50, 120, "citations").select("paper_id", "citations_count")


SOURCES = ("openalex", "crossref", "semantic_scholar", "pubmed", "core", "arxiv", "dblp", "doaj", "elsevier", "google_scholar", "wos", "biorxiv", "medrxiv")


@_query
def interleave_round_robin(spark, sf_dir):
    return search.interleave(_papers(spark, sf_dir).select("paper_id", "source", "ord"), SOURCES).select("paper_id", "source", "place")


@_query
def source_counts(spark, sf_dir):
    return _papers(spark, sf_dir).select(F.explode(F.split("source", r"\s*,\s*")).alias("source")).groupBy("source").agg(F.count("*").alias("papers"))


@_query
def distinct_authors(spark, sf_dir):
    return search.distinct_authors(_papers(spark, sf_dir), "wanda").withColumnRenamed("ord", "first_ord")


@_query
def author_papers(spark, sf_dir):
    return search.author_records(_papers(spark, sf_dir), "Aiko Zovipibran").select("paper_id", "citations_count")


@_query
def author_search(spark, sf_dir):
    return directory.find_authors(_table(spark, sf_dir, "authors"), "wanda", has_orcid=True).select("author_id", "name")


@_query
def author_institution_search(spark, sf_dir):
    return directory.find_authors(_table(spark, sf_dir, "authors"), "albert", institution="hospital").select("author_id", "name")


@_query
def institution_search(spark, sf_dir):
    return directory.find_institutions(_table(spark, sf_dir, "institutions"), country="MX", kind="healthcare").select("institution_id", "name")


@_query
def journal_search(spark, sf_dir):
    return directory.find_journals(_table(spark, sf_dir, "journals"), "letters", open_access=True).select("journal_id", "title", "issn")


@_query
def journal_articles(spark, sf_dir):
    chosen = directory.find_journals(_table(spark, sf_dir, "journals"), open_access=True)
    return directory.works_in(_papers(spark, sf_dir), chosen, "gels").select("paper_id", "journal")


@_query
def concept_works(spark, sf_dir):
    p = _papers(spark, sf_dir)
    return directory.works_about(p, records.concepts(p), "medicine").select("paper_id", "title")


@_query
def related_works(spark, sf_dir):
    links = _table(spark, sf_dir, "citation_edges").groupBy(F.col("citing_id").alias("paper_id")).agg(F.array_sort(F.collect_set("cited_id")).alias("related_ids"))
    return directory.related(_papers(spark, sf_dir), links, 3).select("paper_id", F.col("nth").cast("long").alias("nth"), "other_id")


@_query
def payload_filter(spark, sf_dir):
    wanted = search.Filter(concept="medicine", institution="Hospital")
    return _papers(spark, sf_dir).filter(wanted.condition()).select("paper_id", "source")


@_query
def page_number(spark, sf_dir):
    return files.numbered_page(_papers(spark, sf_dir), 125, 50).select("paper_id", "title")


@_query
def journal_works(spark, sf_dir):
    j, p = _table(spark, sf_dir, "journals"), _papers(spark, sf_dir)
    works = p.select("paper_id", F.col("journal").alias("title"), "citations_count").join(j.select("journal_id", "title"), "title")
    return works.groupBy("journal_id").agg(F.count("*").alias("works"), F.sum(F.coalesce("citations_count", F.lit(0))).alias("citations"))


@_query
def batch_lookup_semi(spark, sf_dir):
    ids = _table(spark, sf_dir, "citation_edges").select(F.col("cited_id").alias("paper_id"))
    return search.lookup(_papers(spark, sf_dir), ids, "paper_id").select("paper_id", "title")


# --- duplicates and fusion


@_query
def dedup_keep_first(spark, sf_dir):
    return resolve.keep_first(_papers(spark, sf_dir), resolvers=RESOLVERS)


@_query
def dedup_first_records(spark, sf_dir):
    return resolve.first_records(_papers(spark, sf_dir), resolvers=RESOLVERS).select("paper_id", "title", "source", "year")


@_query
def lookup_merge_all(spark, sf_dir):
    fused = resolve.fuse(_papers(spark, sf_dir), resolvers=RESOLVERS)
    return fused.filter("key_kind = 'doi' AND n > 1").select("key", "n", "title", "year", "journal", "citations_count", "source")


@_query
def dedup_merge(spark, sf_dir):
    fused = resolve.fuse(_papers(spark, sf_dir), resolvers=RESOLVERS)
    return fused.withColumn("authors", F.array_join("authors", "|")).withColumn("keywords", F.array_join("keywords", "|"))


@_query
def dedup_order(spark, sf_dir):
    first = resolve.keep_first(_papers(spark, sf_dir), resolvers=RESOLVERS)
    return row_numbers(first, [F.col("key_kind"), F.col("first_ord")], "place").select("key", "place")


@_query
def merge_keywords(spark, sf_dir):
    merged = resolve.merged_keywords(resolve.keyed(_papers(spark, sf_dir), RESOLVERS))
    return merged.withColumn("keywords", F.array_join("keywords", "|"))


@_query
def merge_provenance(spark, sf_dir):
    return resolve.provenance(_papers(spark, sf_dir), RESOLVERS).select("key_kind", "key", "ord", "source", F.md5("raw_data").alias("raw_md5"))


@_query
def lookup_first_source(spark, sf_dir):
    return resolve.first_source_wins(_papers(spark, sf_dir), ("semantic_scholar", "openalex", "crossref"), resolvers=RESOLVERS)


# --- graph


@_query
def citing_papers(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.citing(nodes, edges)


@_query
def cited_papers(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.cited(nodes, edges)


@_query
def degree_counts(spark, sf_dir):
    return graph.degrees(*_graph(spark, sf_dir))


@_query
def degree_centrality(spark, sf_dir):
    out = graph.degree_centrality(*_graph(spark, sf_dir))
    return _rounded(_rounded(out, "in_centrality"), "out_centrality")


@_query
def h_index_contribution(spark, sf_dir):
    return _rounded(graph.h_contribution(*_graph(spark, sf_dir)))


@_query
def pagerank_10(spark, sf_dir):
    return _logged(graph.pagerank(*_graph(spark, sf_dir), rounds=10, tolerance=None))


@_query
def pagerank_dangling_10(spark, sf_dir):
    return _logged(graph.pagerank(*_graph(spark, sf_dir), rounds=10, tolerance=None, dangling=True))


@_query
def pagerank_converged(spark, sf_dir):
    return _logged(graph.pagerank(*_graph(spark, sf_dir)))


@_query
def betweenness_all(spark, sf_dir):
    return _rounded(graph.betweenness(*_graph(spark, sf_dir)))


@_query
def influential_top_10(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.top(graph.degrees(nodes, edges).select("paper_id", F.col("in_degree").alias("score")), 10)


@_query
def influence_ranking(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.top(graph.degrees(nodes, edges).select("paper_id", F.col("in_degree").alias("score")))


@_query
def citation_burst(spark, sf_dir):
    return _rounded(graph.bursts(_graph(spark, sf_dir)[0]))


@_query
def bfs_depth2(spark, sf_dir):
    edges = _table(spark, sf_dir, "citation_edges")
    most = edges.distinct().groupBy("cited_id").count().orderBy(F.desc("count"), "cited_id").limit(1).select(F.col("cited_id").alias("paper_id"))
    return graph.expand(edges, most, 2, 10)[0]


@_query
def graph_nodes(spark, sf_dir):
    return graph.node_set(_papers(spark, sf_dir)).select("node_id", F.col("ord").alias("first_ord"), "title", "year")


@_query
def graph_json(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.as_json(nodes.select("paper_id", "year"), edges)


# --- documents


@_query
def section_text(spark, sf_dir):
    out = docs.sections(_blocks(spark, sf_dir))
    return out.select("doc_id", "section", "title", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@_query
def section_full_text(spark, sf_dir):
    out = docs.full_sections(_blocks(spark, sf_dir))
    return out.select("doc_id", "section", "title", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@_query
def section_lookup(spark, sf_dir):
    out = docs.find_section(docs.sections(_blocks(spark, sf_dir)), "method", top_only=False)
    return out.select("doc_id", "section", "title", F.md5("text").alias("text_md5"))


@_query
def standard_sections(spark, sf_dir):
    return docs.standard_sections(_blocks(spark, sf_dir)).select("doc_id", "kind", F.md5("text").alias("text_md5"))


@_query
def chapter_parents(spark, sf_dir):
    return docs.chapters(_blocks(spark, sf_dir)).withColumn("level", F.col("level").cast("long"))


@_query
def doc_type(spark, sf_dir):
    return docs.document_type(_blocks(spark, sf_dir)).select("doc_id", F.col("paper_points").cast("long").alias("paper_points"), F.col("book_points").cast("long").alias("book_points"), "type")


@_query
def doc_titles(spark, sf_dir):
    return docs.titles(_blocks(spark, sf_dir))


@_query
def abstract_finder(spark, sf_dir):
    return docs.abstracts(_blocks(spark, sf_dir)).select("doc_id", F.md5("abstract").alias("abstract_md5"))


@_query
def html_markdown(spark, sf_dir):
    pages = _table(spark, sf_dir, "documents").filter(F.col("text").rlike("<[a-zA-Z/][^>]*>"))
    out = docs.extract_pages(pages, "doc_id", "text")
    return out.select("doc_id", "title", "markdown", F.size("figures").alias("n_figures"), F.size("tables").alias("n_tables"))


# --- records and exports


@_query
def parse_records(spark, sf_dir):
    out = records.parse_all(_table(spark, sf_dir, "papers"))
    return out.withColumn("authors", F.array_join("authors", "|")).withColumn("keywords", F.array_join("keywords", "|"))


@_query
def parse_authors(spark, sf_dir):
    return people.parse_authors(_table(spark, sf_dir, "authors")).withColumn("affiliations", F.array_join("affiliations", "|"))


@_query
def inverted_index_text(spark, sf_dir):
    index = F.from_json(F.get_json_object("p", "$.abstract_inverted_index"), "MAP<STRING, ARRAY<INT>>")
    rows = records.readable(_papers(spark, sf_dir), "paper_id", "raw_data").select("paper_id", docs.inverted_text(index).alias("text")).filter("text IS NOT NULL")
    return rows.select("paper_id", F.md5("text").alias("text_md5"))


@_query
def concept_scores(spark, sf_dir):
    return records.concepts(_table(spark, sf_dir, "papers"))


def _export(spark, sf_dir, form):
    return _papers(spark, sf_dir).select("paper_id", cite.formatter(form)(F.col).alias("entry"))


@_query
def bibtex_export(spark, sf_dir):
    return _export(spark, sf_dir, "bibtex")


@_query
def ris_export(spark, sf_dir):
    return _export(spark, sf_dir, "ris")


@_query
def endnote_export(spark, sf_dir):
    return _export(spark, sf_dir, "endnote")


# --- streams


@_query
def stream_first_seen(spark, sf_dir):
    return ingest.first_seen(spark, f"{sf_dir}/papers.parquet", RESOLVERS)


# --- nested records


@_query
def p3_found(spark, sf_dir):
    return nested.organisations(_table(spark, sf_dir, "papers"), _table(spark, sf_dir, "authors"))


@_query
def p3_authors(spark, sf_dir):
    return nested.paper_authors(_table(spark, sf_dir, "papers"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
