from pyspark.sql import functions as F

from folioweave.operators import resolve, search
from folioweave.operators.joins import skew_safe_left_join
from folioweave.operators.ranking import row_numbers

DDL = "ord bigint, title string, authors array<string>, abstract string, doi string, year int, journal string, url string, pdf_url string, source string, citations_count bigint, references_count bigint, open_access boolean, keywords array<string>"


def paper(ord, source, **k):
    base = {"ord": ord, "title": "T", "authors": [], "abstract": None, "doi": "10.1/x", "year": None, "journal": None, "url": None, "pdf_url": None, "source": source, "citations_count": None, "references_count": None, "open_access": None, "keywords": []}
    return {**base, **k}


def fuse(spark, *rows):
    return resolve.fuse(spark.createDataFrame(list(rows), DDL)).collect()


def test_fusion_rules(spark):
    (r,) = fuse(
        spark,
        paper(1, "openalex", journal="A", year=2000, authors=["a"], citations_count=5, keywords=["X", " y "], url="u1"),
        paper(2, "crossref", journal="", year=2001, authors=["a", "b"], citations_count=0, keywords=["x", "Z"], open_access=False, url="u2"),
        paper(3, "crossref", journal="C", year=2002, authors=["a", "b", "c"], references_count=3, open_access=True),
        paper(4, "core", authors=["p", "q", "r", "s"], abstract="text"),
    )
    assert (r.journal, r.year, r.url) == ("A", 2001, "u1")  # the first crossref record speaks for crossref, though its journal is empty
    assert r.authors == ["p", "q", "r", "s"] and r.citations_count == 5 and r.references_count == 3 and r.open_access is True
    assert r.keywords == ["X", "y", "Z"] and r.source == "core,crossref,openalex" and r.n == 4 and r.abstract == "text"


def test_singleton_and_comma_source(spark):
    (r,) = fuse(spark, paper(1, "arxiv", authors=None, open_access=None))
    assert r.open_access is None and r.authors is None and r.keywords == []
    words = [f" Word {i}" for i in range(28)] + ["word 1"]
    (r,) = fuse(spark, paper(7, "arxiv, core", abstract="", year=0, title="", keywords=words, url=" u "))
    assert (r.abstract, r.year, r.title, r.keywords, r.source, r.url, r.n) == ("", 0, "", words, "arxiv, core", " u ", 1)
    (r,) = fuse(spark, paper(1, "wos,crossref", journal="J1"), paper(2, "openalex", journal="J2"))
    assert r.journal == "J1" and r.open_access is False


def test_keys_never_mix(spark):
    rows = fuse(spark, paper(1, "a", doi=None, title="Same  Title"), paper(2, "b", doi="10.1/Y", title="same title"), paper(3, "c", doi="", title="SAME TITLE"))
    assert sorted((r.key_kind, r.n) for r in rows) == [("doi", 1), ("title", 2)]


def test_first_records(spark):
    df = spark.createDataFrame([paper(3, "b", title="Late"), paper(1, "a", title="Early", year=0), paper(2, "c", doi="10.1/Z")], DDL)
    assert {(r.ord, r.title, r.year) for r in resolve.first_records(df).collect()} == {(1, "Early", 0), (2, "T", None)}


def test_authors_of_unlisted_sources(spark):
    (r,) = fuse(spark, paper(1, "core", authors=["a"]), paper(2, "arxiv", authors=["b", "c"]), paper(3, "dblp", authors=["d", "e"]), paper(4, "pubmed", authors=None, title=""))
    assert r.authors == ["b", "c"]
    (r,) = fuse(spark, paper(1, "core", authors=None, title=""), paper(2, "pubmed", authors=[], title=""))
    assert r.authors is None and r.title == ""


def test_empty(spark):
    assert fuse(spark) == []


def test_interleave(spark):
    rows = [(i, s) for i, s in enumerate("aababcca")]
    df = spark.createDataFrame(rows, "ord bigint, source string")
    got = [r.ord for r in search.interleave(df, ["b", "a", "c"]).orderBy("place").collect()]
    assert got == [2, 0, 5, 4, 1, 6, 3, 7]
    places = sorted(r.place for r in search.interleave(df, ["b", "a", "c"]).collect())
    assert places == list(range(1, 9))
    merged = spark.createDataFrame([(1, "b,a"), (2, "a"), (3, " b , c"), (4, "x,a")], "ord bigint, source string")
    assert [(r.ord, r.source) for r in search.interleave(merged, ["a", "b"]).orderBy("place").collect()] == [(2, "a"), (1, "b,a"), (3, " b , c")]


def test_row_numbers_match_windows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), F.lit(50)).alias("v"))
    got = row_numbers(df, [F.col("v"), F.col("id")], "n", ["g"])
    assert got.selectExpr("*", "row_number() over (partition by g order by v, id) as m").filter("n <> m").count() == 0
    assert got.count() == 1000 and row_numbers(df.limit(0), [F.col("id")], "n").count() == 0


def test_filters_and_sort(spark):
    df = spark.createDataFrame([paper(1, "a", title="Harbours", year=2001, citations_count=3), paper(2, "a", abstract="HARBOUR", year=None), paper(3, "b", authors=["Al Harbour"], year=1999, citations_count=9)], DDL)
    ids = lambda d: [r.ord for r in d.collect()]
    assert ids(df.filter(search.text_match("harbour")).orderBy("ord")) == [1, 2, 3] and ids(df.filter(search.text_match("")).orderBy("ord")) == [1, 2, 3]
    assert ids(search.page(df, 2, 1, "citations")) == [1, 2] and ids(search.page(df, 3, 0, "date_asc")) == [2, 3, 1] and ids(search.page(df, 3, 0, "nonsense")) == [1, 2, 3]
    assert ids(df.filter(search.Filter(year=(2000, None), cited_more_than=2).condition())) == [1]
    assert ids(df.filter(search.Filter(has_abstract=False).condition()).orderBy("ord")) == [1, 3]


def test_skew_safe_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else ("k%d" % (i % 5) if i % 7 else None)) for i in range(300)], "id bigint, key string")
    groups = spark.createDataFrame([("hot", 1, 200), ("k0", 2, 3), ("k1", 3, 3), ("zz", 4, 1)], "key string, v int, rows bigint")
    for top in (0, 1, 10):
        got = skew_safe_left_join(rows, groups, "key", F.col("id"), "rows", top)
        want = rows.join(groups.drop("rows"), "key", "left").select("id", "key", "v")
        assert got.count() == 300 and got.exceptAll(want).isEmpty()
