from pyspark.sql import functions as F

from folioweave.functions import cite, score, text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_normalize_doi(spark):
    cases = {
        "10.1000/ABC": "10.1000/abc", " https://doi.org/10.1/x ": "10.1/x", "http://dx.doi.org/10.1/x": "10.1/x", "doi:10.1/x": "10.1/x", "": None, None: None, "https://doi.org/": None,
        "doi:https://doi.org/10.1/x": "https://doi.org/10.1/x",
    }
    for raw, want in cases.items():
        assert one(spark, raw, text.normalize_doi) == want, raw


def test_normalize_title_and_year(spark):
    assert one(spark, "  Deep\n\tLearning ", text.normalize_title) == "deep learning"
    assert one(spark, None, text.normalize_title) is None
    for raw, want in {"2015-05-01": 2015, "May 1999": 1999, "x20155": None, "1899": None, "": None, None: None}.items():
        assert one(spark, raw, text.year_of) == want, raw


def test_truncate_and_markup(spark):
    assert one(spark, "abcdefghij", lambda c: text.truncate(c, 10)) == "abcdefghij"
    assert one(spark, "abcdefghijk", lambda c: text.truncate(c, 10)) == "abcdefg..."
    assert one(spark, "<p>a &amp; <b>b</b>\n c</p>", text.clean_html) == "a & b c"
    assert one(spark, "a &lt;x&gt; b", text.clean_html) == "a b"
    assert one(spark, None, text.clean_html) == ""
    assert one(spark, "A/B: c  d!", text.safe_title) == "AB_c_d"


def test_urls(spark):
    assert one(spark, "https://x.test/a", urls.is_url) and not one(spark, "x.test/a", urls.is_url) and not one(spark, None, urls.is_url)
    assert one(spark, "https://x.test/A.PDF", urls.is_pdf_url) and one(spark, "https://x.test/pdf/1", urls.is_pdf_url) and not one(spark, "https://x.test/1", urls.is_pdf_url)
    for raw, want in {
        "https://arxiv.org/abs/2201.04567v5": "https://arxiv.org/pdf/2201.04567.pdf", "https://arxiv.org/pdf/2201.04567": "https://arxiv.org/pdf/2201.04567.pdf", "https://www.biorxiv.org/content/10.1101/1/": "https://www.biorxiv.org/content/10.1101/1.full.pdf",
        "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC1": "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC1/pdf/", "https://x.test/y": "https://x.test/y", "https://x.test/Y.pdf": "https://x.test/Y.pdf",
    }.items():
        assert one(spark, raw, urls.pdf_url) == want
    assert one(spark, "https://arxiv.org/pdf/2201.04567.pdf", lambda c: urls.file_name(c, c)) == "arxiv_2201.04567"
    assert one(spark, "https://x.test/PMC77/", lambda c: urls.file_name(c, c)) == "pmc77"
    assert one(spark, "https://x.test/", lambda c: urls.file_name(c, c)).startswith("paper_")
    assert one(spark, "arXiv:2201.04567v2", urls.normalize_arxiv_id) == "2201.04567v2" and one(spark, "x", urls.normalize_arxiv_id) is None


def test_scores(spark):
    burst = lambda y, c: spark.createDataFrame([(y, c)], "y int, c bigint").select(score.citation_burst(F.col("y"), F.col("c"), F.lit(2024)).alias("s")).first().s
    assert burst(2024, 7) == 7 and burst(None, 7) == 0 and burst(2023, 0) == 0
    assert abs(burst(2022, 6) - 3 * (1 + 1 / 3)) < 1e-12 and abs(burst(2018, 6) - 1 * 3 / 6) < 1e-12
    assert [one(spark, i, score.backoff, "int") for i in (0, 1, 5, 9)] == [1, 2, 32, 60]
    assert one(spark, "12", score.retry_after) == 12 and one(spark, "soon", score.retry_after) is None
    assert one(spark, 503, score.retryable, "int") and not one(spark, 404, score.retryable, "int")
    for raw, want in {"1. Introduction": "introduction", "METHODS": "methods", "Materials & Methods": "methods", "Results and Discussion": "results", "Acknowledgements": "acknowledgments", "Intro": None, "2 Methods": "methods", "Materials&Methods": "methods", "Results&Discussion": "results", "ExperimentalSection": "methods", "literaturecited": "references", "acknowledgmnts": None}.items():
        assert one(spark, raw, score.section_kind) == want, raw
    assert one(spark, "University Hospital", score.institution_type) == "education"


ROW = {"title": "Deep & wide", "authors": ["Mara Quill", "Núria Ål"], "abstract": None, "doi": "10.1/x", "year": 2015, "journal": "Nature", "url": None, "pdf_url": None, "source": "crossref", "keywords": ["a", "b"]}
DDL = "title string, authors array<string>, abstract string, doi string, year int, journal string, url string, pdf_url string, source string, keywords array<string>"


def test_citations(spark):
    df = spark.createDataFrame([ROW], DDL)
    assert df.select(cite.bibtex(F.col).alias("e")).first().e == "@article{quill2015deep,\n    title = {Deep \\& wide},\n    author = {Mara Quill and Núria Ål},\n    year = {2015},\n    journal = {Nature},\n    doi = {10.1/x},\n    keywords = {a, b}\n}"
    assert df.select(cite.ris(F.col).alias("e")).first().e.split("\n") == ["TY  - JOUR", "TI  - Deep & wide", "AU  - Mara Quill", "AU  - Núria Ål", "PY  - 2015", "JO  - Nature", "DO  - 10.1/x", "KW  - a", "KW  - b", "DB  - crossref", "ER  -"]
    xml = df.select(cite.endnote(F.col).alias("e")).first().e
    assert "<title>Deep &amp; wide</title>" in xml and xml.startswith("<record>\n    <ref-type name=\"Journal Article\">17") and "<urls>" not in xml
    empty = spark.createDataFrame([{k: None for k in ROW}], DDL)
    assert empty.select(cite.bibtex(F.col).alias("e")).first().e == "@misc{unknown\n}"
    assert empty.select(cite.endnote(F.col).alias("e")).first().e == "<record>\n    <ref-type name=\"Generic\">13</ref-type>\n    <titles>\n    </titles>\n</record>"
