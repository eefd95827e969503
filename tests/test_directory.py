import json

from pyspark.sql import functions as F

from folioweave.operators import directory, documents as docs, graph, search
from folioweave.sources import scraped, service


def test_find_authors(spark):
    df = spark.createDataFrame([(1, "Wanda A", ["City Hospital", None], "0000"), (2, "wanda b", None, " "), (3, "Otto", ["HOSPITAL of X"], None), (4, None, [], "1")], "author_id bigint, name string, affiliations array<string>, orcid string")
    ids = lambda d: sorted(r.author_id for r in d.collect())
    assert ids(directory.find_authors(df, "wanda")) == [1, 2] and ids(directory.find_authors(df, institution="hospital")) == [1, 3]
    assert ids(directory.find_authors(df, has_orcid=True)) == [1, 4] and ids(directory.find_authors(df, has_orcid=False)) == [2, 3] and ids(directory.find_authors(df)) == [1, 2, 3, 4]
    assert directory.find_authors(df.limit(0), "x").count() == 0


def test_journals_and_works(spark):
    j = spark.createDataFrame([(1, "Annals of Sand", "1234-567x", "P", "NL", True), (2, "Letters", None, None, None, None)], "journal_id int, title string, issn string, publisher string, country string, is_oa boolean")
    assert [r.journal_id for r in directory.journal(j, "1234567X").collect()] == [1]
    assert [r.journal_id for r in directory.find_journals(j, open_access=True, country="nl").collect()] == [1] and directory.find_journals(j, "sand", publisher="q").count() == 0
    p = spark.createDataFrame([(1, 1, "Dunes", "ANNALS OF SAND", 3, 2000), (2, 2, "Rivers", "Annals of Sand", 9, 2001), (3, 3, "Dunes", None, 1, 2002)], "paper_id bigint, ord bigint, title string, journal string, citations_count bigint, year int").withColumn("abstract", F.lit(None).cast("string")).withColumn("authors", F.array().cast("array<string>"))
    assert [r.paper_id for r in directory.works_in(p, j, limit=1, by="citations").collect()] == [2] and [r.paper_id for r in directory.works_in(p, j, "dune").collect()] == [1]
    c = spark.createDataFrame([(1, "Geology", 0.9), (3, "geology", 0.4)], "paper_id bigint, concept string, score double")
    assert sorted(r.paper_id for r in directory.works_about(p, c, "GEOLOGY").collect()) == [1, 3]
    links = spark.createDataFrame([(1, [3, 99, 2, 1]), (2, None)], "paper_id bigint, related_ids array<bigint>")
    assert sorted(tuple(r) for r in directory.related(p, links, 3).collect()) == [(1, 0, 3), (1, 2, 2)]


def test_payload_filters(spark):
    payloads = [{"type": "Article", "concepts": [{"display_name": "Medi\"cine"}, {"display_name": "X"}], "language": "en"}, {"concepts": [{"display_name": "medicine"}], "ISSN": ["1", "2"]}, json.dumps({"fieldsOfStudy": ["Art", "Law"], "category": "Neuro Science"}), None, "{broken", {"MedlineCitation": {"MeshHeadingList": [{"DescriptorName": "Mice"}]}}]
    df = spark.createDataFrame([(i, p if p is None or p == "{broken" else json.dumps(p)) for i, p in enumerate(payloads)], "i int, raw_data string")
    got = lambda **k: [r.i for r in df.filter(search.Filter(**k).condition()).collect()]
    assert got(concept='medi"cine') == [0] and got(concept="Medicine") == [1] and got(work_type="article") == [0] and got(issn="2") == [1] and got(language="EN") == [0]
    assert got(field_of_study="law") == [2] and got(category="neuro") == [2] and got(mesh="mice") == [5] and got(institution="x") == []
    assert search.arxiv_sort("date_asc") == ("submittedDate", "ascending") and search.arxiv_sort("citations") == search.arxiv_sort(None) == ("relevance", "descending")


def test_layouts_and_full_sections(spark):
    line = lambda *s: {"spans": [{"type": t, "content": c} for t, c in s]}
    layout = {"pdf_info": [
        {"page_idx": 0, "para_blocks": [{"type": "text", "text_level": 1, "text": "One"}, {"type": "text", "lines": [line(("text", "a"), ("equation", "x")), line(("text", "b"))]}, {"type": "text", "lines": []}, {"type": "image", "lines": []}]},
        {"page_idx": 1, "para_blocks": [{"type": "text", "text_level": 2, "text": "Below"}, {"text": "c"}, {"type": "text", "text_level": 1, "text": "Two Methods"}, {"type": "text", "text": " "}]},
    ]}
    df = spark.createDataFrame([("d", json.dumps(layout)), ("e", None), ("f", "{")], "doc_id string, content string")
    blocks = docs.parse_layout(df, "doc_id", "content")
    assert [(r.type, r.content, r.level, r.page) for r in blocks.orderBy("ord").collect()] == [("title", "One", 1, 0), ("text", "a b", 0, 0), ("image", "", 0, 0), ("title", "Below", 2, 1), ("text", "c", 0, 1), ("title", "Two Methods", 1, 1)]
    assert {(r.title, r.text) for r in docs.full_sections(blocks).collect()} == {("One", "a b\n\nc"), ("Below", "c"), ("Two Methods", "")}
    assert [r.title for r in docs.find_section(docs.sections(blocks), "METHOD").collect()] == ["Two Methods"]
    assert docs.find_section(docs.sections(blocks), "below").count() == 0 and docs.find_section(docs.sections(blocks), "below", top_only=False).count() == 1
    deep = spark.createDataFrame([("d", i, "title", f"t{i}", i, 0) for i in range(1, 10)], "doc_id string, ord int, type string, content string, level int, page int")
    assert {r.ord: r.parent for r in docs.chapters(deep).collect()} == {i: (i - 1 if i > 1 else None) for i in range(1, 10)}
    assert docs.chapters(deep.limit(0)).count() == 0 and docs.full_sections(deep.limit(0)).count() == 0


PAGE = """<div class="gs_r gs_or gs_scl" data-cid="c1"><div class="gs_or_ggsm"><a href="u.pdf">PDF</a></div><h3 class="gs_rt"><a href="https://doi.org/10.1/Q">On  sand</a></h3><div class="gs_a">A Quill, B Reed… - Annals of Sand, 2011 - x.test</div>
<div class="gs_rs">We look at
sand.</div><a>Cited by 42</a></div><div class="gs_r gs_or gs_scl"><p>no title</p></div><div class="gs_r gs_or gs_scl"><h3 class="gs_rt">[BOOK] Bare</h3></div>"""
PROFILE = """<div id="gsc_prf_in">Mara Quill</div><div class="gsc_prf_il">Sand Institute</div><table id="gsc_rsb_st"><tr><th>x</th></tr><tr><td>Citations</td><td>1,234</td></tr><tr><td>h-index</td><td>17</td></tr></table>"""


def test_scraped_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>")], "i int, page string")
    rows = scraped.results(df, "i", "page").orderBy("nth").collect()
    assert [(r.title, r.authors, r.journal, r.year, r.citations_count, r.pdf_url, r.doi, r.result_id, r.abstract) for r in rows] == [("On sand", ["A Quill", "B Reed"], "Annals of Sand", 2011, 42, "u.pdf", "10.1/q", "c1", "We look at sand."), ("[BOOK] Bare", [], None, None, None, None, None, None, None)]
    p = scraped.profiles(spark.createDataFrame([("a", PROFILE), ("b", "<p>"), ("c", None)], "i string, page string"), "i", "page").collect()
    assert [tuple(r) for r in p] == [("a", "google_scholar", "Mara Quill", ["Sand Institute"], 1234, 17)]


def test_more_service_records(spark):
    rows = lambda *p: spark.createDataFrame([(i, json.dumps(x) if x is not None else None) for i, x in enumerate(p)], "i int, raw string")
    one, many = {"coredata": {"dc:title": "T", "prism:coverDate": "1999-01", "citedby-count": "0", "link": [{"@href": "h"}]}, "authors": {"author": {"ce:indexed-name": "A B."}}}, {"coredata": {"dc:title": "U", "citedby-count": "5"}, "authors": {"author": [{"ce:indexed-name": "C D."}, {"preferred-name": {"ce:indexed-name": "E F."}}, {}]}}
    got = {r.i: (r.title, r.authors, r.year, r.url, r.citations_count) for r in service.scopus_records(rows(one, many, {}, None), "i", "raw").collect()}
    assert got == {0: ("T", ["A B."], 1999, "h", None), 1: ("U", ["C D.", "E F."], None, None, 5)}
    r = service.cited_references(rows({"citedTitle": "T", "citedAuthor": "A; B ", "year": "x", "citedWork": "W", "doi": "10.1/Z"}, {"citedAuthor": "A"}), "i", "raw").collect()
    assert [(x.title, x.authors, x.year, x.journal, x.doi) for x in r] == [("T", ["A", "B"], None, "W", "10.1/z")]
    j = service.directory_journals(rows({"id": 1, "bibjson": {"title": "J", "eissn": "1", "publisher": {"name": "P"}, "subject": [{"term": "S"}, {}], "apc": {"has_apc": True}, "license": [{"type": "CC"}], "ref": {"journal": "u"}}}, {"bibjson": {}}), "i", "raw").collect()
    assert [tuple(x)[1:] for x in j] == [("1", "J", "1", None, "P", ["S"], True, ["CC"], "u")]


def test_node_set(spark):
    df = spark.createDataFrame([(2, "10.1/A", "t2", 2001), (1, "10.1/A", "t1", None), (3, "", "Same", 1), (4, None, "SAME", 2), (5, None, None, 3)], "ord bigint, doi string, title string, year int").withColumn("citations_count", F.lit(0)).withColumn("source", F.lit("s"))
    rows = graph.node_set(df).collect()
    assert {(r.ord, r.title, r.year) for r in rows} == {(1, "t1", None), (3, "Same", 1)} and {r.node_id[:6] for r in rows} == {"10.1/A", "title:"}
