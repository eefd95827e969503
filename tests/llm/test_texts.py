import os
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioweave.llm import languages, names, packing, queries, tokens

DATA = "/root/testdata"


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert names.lcs(a, b) == rows[-1][-1]


def test_parse_person():
    one = lambda n: names.parse_person(n)[0]
    assert one("Wanda S. Bákevagas") == ("bakevagas", ("wanda", "s")) and one("Bákevagas, Wanda S.") == ("bakevagas", ("wanda", "s"))
    assert one("WS Bákevagas") == ("bakevagas", ("w", "s")) and one("Bakevagas W.S.") == ("bakevagas", ("w", "s")) and one("Dr. Wanda BÁKEVAGAS, PhD*") == ("bakevagas", ("wanda",))
    assert ("ziligraple", ("robert",)) in names.parse_person("Ziligraple Robert")
    for none in ("", "  ", "Bákevagas", "W. S.", "123"):
        assert names.parse_person(none) == []
    assert names.split_names("A B; The X Collaboration; et al.") == ["A B"]
    fit = lambda a, b: names.form_fit(names.form(a), names.form(b)) > 0
    assert fit("Bill K. Tamaskakel", "Tamaskakel, W. K.") and fit("William Tamaskakel", "W Tamaskakle") and fit("Robert Ziligraple", "Ziligraple Robert")
    assert not fit("William A. Tamaskakel", "William K. Tamaskakel") and not fit("Wanda Tamaskakel", "Walter Tamaskakel") and not fit("William Tamaskakel", "William Zebihobam")


def test_parse_organisation():
    same = ["General Hospital of Gadetokograd", "Gadetokograd Gen. Hosp., MX", "GADETOKOGRAD GENERAL HOSPITAL", "Hospital General de Gadetokograd", "Dept. of Physics, Gadetokograd General Hospital"]
    assert {names.parse_organisation(n) for n in same} == {("hospital", "gadetokograd")}
    assert names.parse_organisation("Gadetokograd Teachers' College") == ("college", "gadetokograd") and names.parse_organisation("Institute of Technology, Gadetokograd")[0] == "technology"
    assert names.parse_organisation("Gadetokograd-Analytics") == ("company", "gadetokograd") and names.parse_organisation("University of Gadetokograd")[0] == "university"
    assert names.parse_organisation("Computing Group") is None and names.parse_organisation("") is None


def test_names(spark, clash):
    hospital, college = "General Hospital of Gadetokograd", "Gadetokograd Teachers College"
    authors = [
        (1, "Wanda Bákevagas", [hospital], None), (2, "W Bákevagas", ["Gadetokograd Gen Hosp"], None), (3, "Bákevagsa W.", ["Gadetokogrd General Hospital"], "9999-0000-0000-0001"), (4, "Wanda Bakevagas", None, "https://orcid.test/9999000000000001"),
        (5, "Walter Bákevagas", [college], None), (6, "Wanda Bákevagas", [college], None), (7, None, [hospital], None), (8, "", [], ""), (9, "The Wanda Collaboration", [hospital], None), (10, "Kate Zebihobam", [None, college], None), (11, "Kate Zebihobam", [college], None),
    ]
    institutions = [(1, hospital, None), (2, "Gadetokograd Gen. Hosp.", None), (3, college, None), (4, "Gadetokograd Teachers Coll", "https://www.g-coll.test/"), (5, None, None), (6, "", None), (7, "Gadtokoograd Teachers Coll", "www.g-coll.test")]
    papers = [(1, ["Catherine Zebihobam", "Bákevagas, Wanda"], None), (2, None, None), (3, [], None), (4, [None, "", "et al.", "The X Consortium"], None), (5, ["Zebihobam K.; W. Bákevagas"], '{"authors": [{"affiliations": ["Gadetokograd Teachers College"]}]}'), (6, ["Nobody Knownatall"], "{")]
    a = clash(spark.createDataFrame(authors, "author_id bigint, name string, affiliations array<string>, orcid string"))
    i = clash(spark.createDataFrame(institutions, "institution_id bigint, name string, url string"))
    p = clash(spark.createDataFrame(papers, "paper_id bigint, authors array<string>, raw_data string"))
    got = {tuple(r) for r in names.found(p, a, i).collect()}
    of = lambda k: {(x, y) for kind, x, y in got if kind == k}
    assert of("institution") == {(1, 2), (3, 4), (3, 7), (4, 7)}
    assert of("author") == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)}
    assert {x for x, _ in of("paper_author")} == {1, 5} and (1, 1) in of("paper_author") and (5, 10) in of("paper_author")
    assert names.found(p.limit(0), a.limit(0), i.limit(0)).count() == 0


ODD = [None, "", " ", "\t\n  \n", "Hello world", "I'll don't 'S", "a  b   c\n\n d ", "naïve café — “q”", "日本語 текст עברית", "👩‍👩‍👧 🇩🇪", "x" * 3000, "<|endoftext|>", "1234567 ½ ²", "  　z", "\U0001FAE8 ࡰ", "tab\tq", "\x1c\x1d a"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens(spark, clash, monkeypatch):
    rng = random.Random(6)
    alphabet = "ab '\n\t.,1é日👩ß  "
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["Long text with words. " * 5000, "Hello world"]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for hot in (tokens.HOT_WORDS, {4: 3, 40: 2}):  # with few frequent words most come through the join
        monkeypatch.setattr(tokens, "HOT_WORDS", hot)
        got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
        assert [got[i] for i in range(len(texts))] == plain_ids(texts)
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert tokens.encode(df.limit(0)).count() == 0


def test_packing(spark, clash):
    rng = random.Random(7)
    sizes = [rng.choice([rng.randint(1, 40), rng.randint(1, 400), rng.randint(200, 2048)]) for _ in range(3000)] + [0, None, 2048, 2049, 10_000, 1, 1, 1]
    df = clash(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size int"))
    for share in (200_000, 500):
        rows = packing.pack(df, "doc_id", "size", 2048, share=share).collect()
        used, whole = {}, {}
        for r in rows:
            used[r.container] = used.get(r.container, 0) + r.length
            whole.setdefault(r.item, []).append((r.part, r.length))
        assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
        for i, s in enumerate(sizes):
            parts = sorted(whole[i])
            assert sum(n for _, n in parts) == (s or 0) and [p for p, _ in parts] == list(range(len(parts))) and (len(parts) == 1 or s > 2048)
        assert sum(used.values()) / (2048 * len(used)) > (0.95 if share > 1000 else 0.9)  # two fifths of the space is taken by items over half a container
    assert packing.pack(df.limit(0), "doc_id", "size").count() == 0
    with pytest.raises(Exception, match="negative"):
        packing.pack(spark.createDataFrame([(1, -1)], "doc_id int, size int"), "doc_id", "size").count()


def test_labels(spark):
    cases = {"en": "en", "EN_us": "en", "English": "en", "deu": "de", "ger": "de", "pt-BR": "pt", "": None, None: None, "-": None, "??": None, "und": None, "mul": None, "zxx": None, "unknown": None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r.l: r.c for r in df.select("l", languages.language_of_label(F.col("l")).alias("c")).collect()} == cases


EN = "The quick growth of the plants was measured in all of the trials and the results were clear."
DE = "Die Ergebnisse zeigen, dass die Messung der Proben stärker schwankt als wir zuvor erwartet hatten."
FR = "Les résultats montrent que la mesure des échantillons varie davantage que nous ne le pensions avant."


def language_rows():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        lang, text = (("en", EN), ("de", DE), ("fr", FR))[i % 3]
        words = text.split()
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang))
    return rows


def test_languages(spark, clash):
    rows = language_rows() + [
        (200, DE, "en"), (201, DE.upper(), "German"), (202, f"{EN}\n\n{DE}\nkurz\n{EN} « {FR[:40]} »", "en"), (203, None, "en"), (204, "", None), (205, " \n ", "de"), (206, "12 34 56 78 90", "en"), (207, "[1] Abc, D. (2001). doi:10.1/2, 3(4), 5.", None),
        (208, FR, None), (209, (EN + "\n") * 3000, "xx"), (210, " ".join([FR] * 2000), "mul"), (211, f"{DE}\nx = [i ** 2 for i in range(41)]", "de"),
    ]
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {(r.doc_id, r.line_no): r.lang for r in languages.found(df).collect()}
    assert {k: v for k, v in got.items() if k[0] < 200} == {}
    assert {k: v for k, v in got.items() if k[0] >= 200} == {(200, 0): "de", (202, 1): "en", (202, 3): "de", (202, 5): "en", (208, 0): "fr", (209, 0): "en", (210, 0): "fr"}
    told = languages.detect(df).filter("line_no = 0").collect()
    assert all(0 <= r.confidence <= 1 for r in told)
    assert languages.found(df.limit(0)).count() == 0 and languages.found(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0


PL = ("Szybki wzrost roślin został zmierzony we wszystkich próbach, a wyniki były całkiem wyraźne dla badaczy.", "Badania pokazują, że jakość wody w jeziorach zależy od pory roku oraz od głębokości zbiornika.", "Autorzy opisują nową metodę, która pozwala dokładniej przewidzieć zmiany temperatury gleby.")


def test_rare_language_and_wrong_labels(spark):
    rows = [(i, " ".join(random.Random(i).sample(t.split(), len(t.split()))), lang) for i in range(900) for lang, t in ((("en", EN), ("de", DE), ("fr", FR))[i % 3],)]
    rows += [(1000 + i, t, "pl") for i, t in enumerate(PL)] + [(1100 + i, " ".join(random.Random(i).sample(EN.split(), 17)), "sv") for i in range(4)] + [(1200, "Wyniki badania pokazują, że próby zostały zmierzone dokładniej oraz jakość była wyraźna.", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang for r in languages.found(df).collect()}
    assert got == {**{1100 + i: "en" for i in range(4)}, 1200: "pl"}


def test_long_lines_are_scored_whole():
    lines = [languages.prepared(t) for t in (EN, DE, FR) for _ in range(10)]
    model = languages.fit(lines, ["en"] * 10 + ["de"] * 10 + ["fr"] * 10)
    long = languages.prepared(" ".join([EN, FR, DE, FR] * 2000))
    whole = languages._product([long], model.weights) + model.bias
    assert len(long) > 5 * languages._PIECE and abs(model.scores([lines[0], long, lines[20]])[1] - whole[0]).max() < 1e-3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_language_held_out_accuracy(spark):
    df = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    lines, labels = languages.training_lines(df.filter("doc_id % 2 = 0"), "text", "lang", lines_per_language=150)
    model = languages.fit(lines, labels)
    tested, truth = languages.training_lines(df.filter("doc_id % 2 = 1"), "text", "lang", lines_per_language=60)
    best = model.scores(tested).argmax(axis=1)
    right = sum(model.languages[b] == t for b, t in zip(best, truth)) / len(truth)
    assert right > 0.85  # the labels themselves are wrong for about a tenth


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    columns = {"p1_found": {"paper_id"}, "p2_found": {"first_id", "second_id"}, "p4_found": {"paper_id", "import_id"}, "p5_found": {"first_id", "second_id"}, "p6_found": {"group_id", "abstract_id", "citations_id", "doi", "sources"}, "p7_found": {"kind", "first_id", "second_id"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id", "line_no", "lang"}}
    df = queries.queries()[name](spark, f"{DATA}/sf0.001")
    rows = df.collect()
    assert rows and set(df.columns) == columns.get(name, set(df.columns))
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
