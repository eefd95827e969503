import json

from folioweave import config
from folioweave.sources import files, people, service


def rows(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)], "i int, p0 string").withColumnRenamed("p0", "raw")


def test_pubmed(spark):
    xml = """<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1999 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>On <i>E. coli</i></ArticleTitle>
    <Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText Label="END">y</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F G</ForeName></Author><Author><CollectiveName>Team</CollectiveName></Author></AuthorList></Article>
    <MeshHeadingList><MeshHeading><DescriptorName>M</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/X</ArticleId><ArticleId IdType="pmc">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
    r = service.pubmed_articles(rows(spark, xml), "i", "raw").first()
    assert (r.title.replace("  ", " "), r.authors, r.abstract, r.doi, r.year, r.journal, r.open_access, r.keywords) == ("On E. coli", ["F G L", "Team"], "AIM: x END: y", "10.1/x", 1999, "J", True, ["M"])
    assert r.pdf_url.endswith("/PMC7/pdf/")


def test_pubmed_elements_by_themselves(spark):
    xml = """<PubmedArticle><MedlineCitation><PMID>3</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">See <i>E. coli</i> grow.</AbstractText><AbstractText>Rest.</AbstractText><AbstractText/></Abstract>
    <AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author><Author><CollectiveName>The Team</CollectiveName></Author><Author><LastName>Plato</LastName></Author><Author><LastName>Ott</LastName><Initials>B</Initials></Author><Author><ForeName>Nobody</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"""
    r = service.pubmed_articles(rows(spark, xml), "i", "raw").first()
    assert (r.authors, r.abstract) == (["Jane Doe", "The Team", "Plato", "B Ott"], "AIM: See E. coli grow. Rest.")


def test_limits(spark):
    assert [config.Config().scan_limit(s) for s in ("openalex", "semantic_scholar", "arxiv", "google_scholar_scraper")] == [10_000, 1_000, 1_000, 1_000]
    assert config.CAPABILITIES["arxiv"] == (2_000, None, False) and config.CAPABILITIES["google_scholar_scraper"] == (10, None, False)
    many = spark.range(30_000).withColumnRenamed("id", "ord")
    wide = config.Config(limits={"pubmed": 20_000, "openalex": 20_000})
    assert files.scan_all(many, "pubmed", config=wide).count() == 10_000 and files.scan_all(many, "openalex", config=wide).count() == 20_000
    assert [r.ord for r in files.numbered_page(many, 25, 10).collect()] == list(range(20, 30))


def test_arxiv(spark):
    xml = """<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/2201.04567v5</id><published>2022-06-12T00:00:00Z</published><title>Lanterns
      at sea</title><summary> s </summary><author><name>A B</name></author><author><name>C D</name></author><link title="doi" href="http://dx.doi.org/10.1/Y"/><category term="cs.CL"/></entry>"""
    r = service.arxiv_entries(rows(spark, xml), "i", "raw").first()
    assert (r.title, r.authors, r.abstract, r.year, r.doi, r.journal, r.pdf_url, r.keywords) == ("Lanterns at sea", ["A B", "C D"], "s", 2022, "10.1/y", "arXiv:cs.CL", "https://arxiv.org/pdf/2201.04567.pdf", ["cs.CL"])


def test_service_json(spark):
    r = service.scopus_entries(rows(spark, {"dc:title": "T", "dc:creator": "Last, F.", "prism:coverDate": "2011-01-02", "citedby-count": "0", "openaccess": "1"}, {"dc:title": ""}, "{"), "i", "raw").collect()
    assert len(r) == 1 and (r[0].authors, r[0].year, r[0].citations_count, r[0].open_access) == (["Last", "F."], 2011, None, True)
    r = service.scholar_results(rows(spark, {"title": "T", "link": "https://doi.org/10.1/z", "publication_info": {"summary": "A Bee, C Dee - Nature, 2015 - nature.com"}, "resources": [{"file_format": "PDF", "link": "u"}]}), "i", "raw").first()
    assert (r.authors, r.journal, r.year, r.doi, r.pdf_url) == (["A Bee", "C Dee"], "Nature", 2015, "10.1/z", "u")
    r = service.preprint_entries(rows(spark, {"title": "T", "authors": "A, B.; C, D.", "doi": "10.1101/1", "date": "2020-05-01", "category": "neuro"}), "i", "raw").first()
    assert (r.authors, r.journal, r.pdf_url) == (["A, B.", "C, D."], "bioRxiv - neuro", "https://www.biorxiv.org/content/10.1101/1.full.pdf")
    wos = {"static_data": {"summary": {"titles": {"title": [{"type": "source", "content": "J"}, {"type": "item", "content": "<b>T</b>"}]}, "names": {"name": [{"full_name": "A", "addr_no": 1}, {"full_name": "B"}]}, "pub_info": {"pubyear": 2001}}, "fullrecord_metadata": {"abstracts": {"abstract": {"abstract_text": {"p": "x"}}}, "addresses": {"address_name": [{"address_spec": {"addr_no": 1, "full_address": "Here"}}]}}}}
    r = service.citation_index_records(rows(spark, wos), "i", "raw").first()
    assert (r.title, r.authors, r.abstract, r.year, r.journal, r.open_access) == ("T", ["A", "B"], "x", 2001, "J", False)
    assert {(x.name, x.address) for x in service.author_addresses(rows(spark, wos), "i", "raw").collect()} == {("A", "Here"), ("B", None)}


def test_people(spark):
    payloads = [("openalex", {"display_name": "A", "id": "https://x.test/A1", "ids": {"orcid": "https://orcid.test/1"}, "affiliations": [{"institution": {"display_name": "U"}}, None], "summary_stats": {"h_index": 3}}), ("elsevier", {"preferred-name": {"ced:indexed-name": "B C."}, "affiliation-current": {"affiliation-name": "V"}, "coredata": {"dc:identifier": "AUTHOR_ID:9", "document-count": "4"}}), ("dblp", {"author": "D", "url": "https://x.test/pid/7", "notes": {"note": {"@type": "affiliation", "text": "W"}}}), ("openalex", {})]
    df = spark.createDataFrame([(i, s, json.dumps(p)) for i, (s, p) in enumerate(payloads)], "author_id int, source string, raw_data string")
    got = {r.author_id: (r.name, r.source_id, r.affiliations, r.orcid, r.paper_count, r.h_index) for r in people.parse_authors(df).collect()}
    assert got == {0: ("A", "A1", ["U"], "1", None, 3), 1: ("B C.", "9", ["V"], None, 4, None), 2: ("D", "7", ["W"], None, None, None)}
    r = people.parse_institutions(rows(spark, {"display_name": "General Hospital", "id": "https://x.test/I1", "country_code": "MX"}), "i", "raw").first()
    assert (r.name, r.source_id, r.country, r.type) == ("General Hospital", "I1", "MX", "healthcare")


def test_config(tmp_path, monkeypatch):
    f = tmp_path / "folioweave.json"
    f.write_text('{"sources": ["arxiv"], "search_limit": 3}')
    monkeypatch.setenv("FOLIOWEAVE_CONFIG", str(f))
    config.reset()
    assert config.current().sources == ("arxiv",) and config.current().search_limit == 3 and config.current().scan_limit("elsevier") == 5000
    config.reset()
