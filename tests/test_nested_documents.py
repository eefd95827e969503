import json

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from folioweave.operators import documents as docs, nested
from folioweave.sources import records

json_values = st.recursive(st.none() | st.booleans() | st.integers(-10**9, 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=6), v, max_size=4), max_leaves=20)


def strings(x):
    """(path, text) of every non-empty string, lists transparent; in order of appearance."""
    out = []

    def walk(v, path):
        if isinstance(v, dict):
            for k, w in v.items():
                walk(w, nested._step_path(np.array([path], np.uint64), np.array([nested._hash_key(k) if k else np.uint64(0)], np.uint64))[0])
        elif isinstance(v, list):
            for w in v:
                walk(w, path)
        elif isinstance(v, str) and v:
            out.append((int(path), v))

    walk(x, np.uint64(1))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(json_values, min_size=1, max_size=5), st.sampled_from([None, 0, 2]), st.booleans())
def test_index_matches_json(values, indent, plain):
    texts = [json.dumps(v, indent=indent, ensure_ascii=plain) for v in values]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ix = nested.index(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert ix.readable.all()
    for i, v in enumerate(values):
        own = np.flatnonzero((ix.record == i) & (ix.mark == ord('"')) & (ix.end > ix.start))
        assert [(int(p), t) for p, t in zip(ix.path[own], nested._texts(ix, own))] == strings(json.loads(texts[i]))


@settings(max_examples=200, deadline=None)
@given(json_values.filter(lambda v: isinstance(v, (dict, list))), st.data())
def test_broken_texts_are_unreadable(value, data):
    text = json.dumps(value)
    cut = data.draw(st.integers(0, len(text) - 1))
    broken = data.draw(st.sampled_from([text[:cut], text[:cut] + text[cut + 1 :], text + "]", text[:cut] + "," + text[cut:]]))
    try:
        json.loads(broken)
        fine = True
    except ValueError:
        fine = False
    raw = broken.encode()
    ix = nested.index(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert bool(ix.readable[0]) == fine, broken


def test_a_cut_escape_does_not_reach_into_the_next_text():
    good = b'{"authors": [{"affiliations": ["A", "B\\"c"]}]}'
    for cut in (b'{"a": "b\\', b'{"a": "\\', b"\\", b'{"a": "b\\\\\\'):
        raw = [good, cut, good, cut, b'"' + good.replace(b"\\", b"\\\\").replace(b'"', b'\\"') + b'"', good]
        ix = nested.index(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        assert sorted(set(ix.record.tolist())) == [0, 2, 4, 5]


def test_linked_rows(spark):
    rows = [
        (1, json.dumps({"authorships": [{"institutions": [None, {"display_name": "A"}, {"display_name": ""}]}, {"institutions": {"display_name": "B\n\"é"}}]})),
        (2, json.dumps(json.dumps({"authors": [{"affiliations": "C"}, {"affiliations": ["D", None, "E"]}]}))),
        (3, '{"authors": [{"affiliations": "F"'), (4, None), (5, ""), (6, "{}"), (7, json.dumps({"author": {"affiliation": {"name": "G"}}})), (8, "  "), (9, '"x"'),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "paper_id bigint, raw_data string, name string")
    got = {tuple(r) for r in nested.linked_rows(df, "paper_id", "raw_data", nested.PAPER_ORGANISATIONS).collect()}
    assert got == {(1, 0, 1, "A"), (1, 1, 0, 'B\n"é'), (2, 0, 0, "C"), (2, 1, 0, "D"), (2, 1, 2, "E"), (7, 0, 0, "G")}
    assert nested.linked_rows(df.limit(0), "paper_id", "raw_data", nested.PAPER_ORGANISATIONS).count() == 0
    # every value as a row, linked to its parent
    flat = nested.nodes(df.filter("paper_id = 2"), "paper_id", "raw_data").orderBy("node").collect()
    assert [(r.node, r.parent, r.kind, r.value) for r in flat][:3] == [(0, None, "object", None), (1, 0, "list", None), (2, 1, "object", None)]
    long = spark.createDataFrame([(1, json.dumps({"authors": [{"affiliations": ["N" * 6_000_000]}] * 2}))], "paper_id bigint, raw_data string")
    assert nested.linked_rows(long, "paper_id", "raw_data", nested.PAPER_ORGANISATIONS).count() == 2


def test_author_notes(spark):
    df = spark.createDataFrame([(1, json.dumps({"notes": {"note": [{"@type": "award", "text": "P"}, {"@type": "affiliation", "text": "Q"}]}}))], "author_id bigint, raw_data string")
    assert [tuple(r) for r in nested.linked_rows(df, "author_id", "raw_data", nested.AUTHOR_ORGANISATIONS).collect()] == [(1, 0, 1, "Q")]


def test_chunks_of_a_batch():
    values = pa.array([json.dumps({"authors": [{"affiliations": "x%d" % i}]}) for i in range(50)] + [None])
    old, nested._CHUNK = nested._CHUNK, 100
    try:
        names = [n for _, ix in nested.indexed(values) for n in nested.linked(ix, nested.PAPER_ORGANISATIONS[2])[3]]
    finally:
        nested._CHUNK = old
    assert names == ["x%d" % i for i in range(50)]


TEXT = "# Title\n\nIntro words.\n\n## Methods\nfirst\n\nsecond\n\n### Deep\nx\n\n## 2. Results\ny"


def test_document_structure(spark):
    b = docs.markdown_blocks(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id bigint, text string"))
    s = {r.section: (r.title, r.text) for r in docs.sections(b).collect()}
    assert s[2] == ("Methods", "first\n\nsecond") and s[1] == ("Title", "Intro words.")
    parents = {r.title: r.parent for r in docs.chapters(b).collect()}
    ords = {r.title: r.ord for r in docs.chapters(b).collect()}
    assert parents == {"Title": None, "Methods": ords["Title"], "Deep": ords["Methods"], "2. Results": ords["Title"]}
    assert {r.kind: r.text for r in docs.standard_sections(b).collect()} == {"methods": "first\n\nsecond", "results": "y"}
    assert docs.document_type(b).first().type == "paper" and docs.titles(b).first().title == "Title"


def test_block_lists(spark):
    blocks = [{"type": "text", "text": "Chapter 1", "text_level": 1, "page_idx": 0}, {"type": "text", "text": ""}, {"type": "image", "img_path": "a.png"}, {"type": "table", "table_body": "<table></table>", "page_idx": 60}]
    b = docs.parse_blocks(spark.createDataFrame([("d", json.dumps(blocks))], "doc string, content string"), "doc", "content")
    assert [(r.type, r.content) for r in b.orderBy("ord").collect()] == [("title", "Chapter 1"), ("image", "a.png"), ("table", "<table></table>")]
    t = docs.document_type(b).first()
    assert (t.paper_points, t.book_points, t.type) == (0, 4, "book")


def test_pages():
    page = docs.read_page("<html><head><title>T &amp; U</title><meta name='citation_author' content='A B'><meta name=keywords content='x, y'></head><body><nav>no</nav><article><h2>H</h2><p>One <b>two</b><ul><li>a<li>b</ul><img src=i.png><table><tr><td>1</table><div class='ads'>no</div></article></body>")
    assert page["title"] == "T & U" and page["authors"] == ["A B"] and page["keywords"] == ["x", "y"] and page["figures"] == ["i.png"]
    assert page["markdown"].startswith("## H\n\nOne two") and "no" not in page["markdown"].split() and len(page["tables"]) == 1
    assert docs.read_page("")["markdown"] == ""


def test_record_parsers(spark):
    rows = [
        (1, "openalex", json.dumps({"title": "T", "id": "W", "doi": "https://doi.test/10.1/x", "publication_year": 2001, "authorships": [{"author": {"display_name": "A"}}], "abstract_inverted_index": {"b": [2], "a": [0]}, "concepts": [{"display_name": "c", "score": 0.9}]})),
        (2, "crossref", json.dumps({"title": ["U"], "author": {"given": "G", "family": "F"}, "issued": {"date-parts": [[1999, 2]]}, "DOI": "10.1/y", "license": [{"URL": "http://creativecommons.test"}]})),
        (3, "dblp", json.dumps(json.dumps({"info": {"title": "V.", "year": "2000", "authors": {"author": {"text": "X Y"}}}}))),
        (4, "pubmed", json.dumps({"MedlineCitation": {"Article": {"ArticleTitle": "W", "AuthorList": [{"LastName": "L", "ForeName": "F"}, {"CollectiveName": "Team"}]}}})),
        (5, "openalex", '{"title": "cut'), (6, "openalex", None), (7, "arxiv", json.dumps({"title": "a\n b", "authors": "P; Q", "date": "2009-06-15"})), (8, "core", json.dumps({"authors": []})),
    ]
    got = {r.paper_id: r for r in records.parse_all(spark.createDataFrame(rows, "paper_id bigint, source string, raw_data string")).collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    assert (got[1].doi, got[1].year, got[1].authors, got[1].abstract, got[1].keywords) == ("10.1/x", 2001, ["A"], "a  b", ["c"])
    assert (got[2].title, got[2].year, got[2].authors, got[2].open_access) == ("U", 1999, ["G F"], True)
    assert (got[3].title, got[3].authors) == ("V", ["X Y"]) and got[4].authors == ["F L", "Team"] and (got[7].title, got[7].authors, got[7].year) == ("a b", ["P", "Q"], 2009)
