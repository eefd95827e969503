"""What the reviewer of round 1 found missing."""

import unicodedata

from pyspark.sql import functions as F

from folioweave.llm import canon, exact, languages, linkage, names, survivor, truncation


def test_slips_of_rare_words_reach_the_name_pass(spark):
    ddl = "{} bigint, title string, authors array<string>, year int, doi string"
    titles = [("Linear grid cells and the Redikustas problem", "Linear grid cells and the Reddiksutas problem"), ("On empirical motor neurons in Pulushatol systems", "On empirical motor neurons in Pullushatel {systems}"), ("Evidence for Honusifon effects in spectral seed banks", "Evidence for Hounsifoon effects in spectral seed banks")]
    # the other words are common, and each author wrote a like title about something else
    filler = [(100 + i, t.replace(t.split()[-2] if k == 0 else t.split()[2 if k == 2 else 5], f"Zamapa{i}"), ["Nobody Else"], 1900, None) for i in range(70) for k, (t, _) in enumerate(titles)]
    left = [(i, t, ["Wanda Kogotreb"], 2018, None) for i, (t, _) in enumerate(titles)]
    right = [(i, t, ["Kogotreb, W."], 2019, None) for i, (_, t) in enumerate(titles)] + [(10, "Linear grid cells and the Mikukroshol problem", ["Kogotreb, W."], 2018, None)]
    a = linkage.prepared(spark.createDataFrame(left + filler, ddl.format("paper_id")), "paper_id")
    b = linkage.prepared(spark.createDataFrame(right, ddl.format("import_id")), "import_id")
    got = {tuple(r) for r in linkage.candidates(a, b, *linkage.rare_words(a, b, 60)).filter(F.col("a") < 100).collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}


def slips(word):
    """Every word that one deletion, change, insertion or swap makes of ``word``."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + "q" + b[1:] for a, b in cut if b} | {a + "q" + b for a, b in cut} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1}
    return out - {word}


def test_single_slips_of_places_share_a_block():
    for place in ("ulmen", "leipzig", "jufelzuuford", "tovufzoifield", "rihecahvafield"):
        assert [s for s in slips(place) if not names._place_blocks(place) & names._place_blocks(s)] == []


def test_single_slips_of_family_names_share_a_block():
    for family in ("li", "meyer", "miller", "johnson", "anderson", "milhiike", "kogotrebi"):
        assert [s for s in slips(family) if not names._blocks(family) & names._blocks(s)] == []


def test_rare_spellings_are_compared_beside_a_common_one(spark):
    common = [f"Harborstonefield University ({i})" for i in range(60)]  # shares its first six letters with the others
    a, b = "Harborwickdaletown University", "Harborwikdaletwon University"
    got = {r.name: r.org for r in names.resolve_organisations(spark.createDataFrame([(n,) for n in [*common, a, b]], "name string")).collect()}
    assert got[a] == got[b] != got[common[0]] and len(set(got.values())) == 2


def test_short_words_name_a_place_where_no_longer_one_does():
    assert names.parse_organisation("University of Ulm") == names.parse_organisation("Univ. Ulm") == ("university", "ulm")
    assert names.parse_organisation("ETH") == ("other", "eth") and names.parse_organisation("MIT") == ("other", "mit")
    assert names.parse_organisation("ETH Zurich") == ("other", "zurich") and names.parse_organisation("Univ. of the") is None and names.parse_organisation("") is None


def test_decomposed_letters_of_any_kind_are_composed(spark):
    titles = ["Škoda a žížala", "Kůň, őz i ąę: řeč", "Мой йод", "Việt Nam ệ", "が ガ", "plain", "q\u0323\u0301 x", "a\nš\u0301"]
    rows = [(2 * i + k, unicodedata.normalize(f, t), None) for i, t in enumerate(titles) for k, f in enumerate(("NFC", "NFD"))]
    df = spark.createDataFrame(rows, "paper_id bigint, title string, doi string")
    got = {r.paper_id: r.c for r in df.select("paper_id", canon.canonical_characters(F.col("title")).alias("c")).collect()}
    assert [t for i, t in enumerate(titles) if not got[2 * i] == got[2 * i + 1] == unicodedata.normalize("NFC", t)] == []
    assert {tuple(r) for r in exact.found(df).collect()} == {(2 * i, 2 * i + 1) for i in range(len(titles))}


def test_short_texts_are_judged_by_visible_cuts(spark):
    rows = [(1, "We study the slow …", "a"), (2, "Plants grow [truncated]", "a"), (3, "A short note.", "a"), (4, "An editorial", "a"), (5, "No abstract available.", "a"), (6, "...", "a"), (7, "<p>N/A</p>", "a"), (8, None, "a")]
    df = spark.createDataFrame(rows, "paper_id bigint, abstract string, source string")
    got = {r.id: r.reason for r in truncation.judged(df, "abstract", "paper_id", "source").collect()}
    assert got == {1: "mark", 2: "mark", 3: None, 4: None}
    assert [tuple(r) for r in truncation.rates(truncation.judged(df, "abstract", "paper_id", "source")).collect()] == [("a", 4, 2, 0.5)]


def test_names_of_towns_keep_their_short_words():
    place = lambda n: names.parse_organisation(n)[1]
    assert place("New York University") == place("NEW YORK UNIV") == "newyork" and place("York University") == place("University of York") == "york"
    assert names.ratio("newyork", "york") < 0.85 and place("MIT") == "mit" and place("ETH Zurich") == "zurich"


def test_forms_of_letters_are_folded(spark):
    titles = ["\ufb01nite \ufb01eld", "\u212bngström", "Škoda řeka žába", "Привет йод", "\U0001d40balf \u2115"]
    rows = [(2 * i + k, unicodedata.normalize(f, t), None) for i, t in enumerate(titles) for k, f in enumerate(("NFC", "NFKD"))]
    got = {tuple(r) for r in exact.found(spark.createDataFrame(rows, "paper_id bigint, title string, doi string")).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(titles))}


def test_colliding_hashes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(canon, "fingerprint", lambda *parts: F.lit(bytes(16)))
    df = spark.createDataFrame([(1, "One", None), (2, "ONE!", "10.100/a"), (3, "Two", None), (4, "Three", None), (5, "three", None)], "paper_id bigint, title string, doi string")
    assert {tuple(r) for r in exact.found(df).collect()} == {(1, 2), (4, 5)}
    assert {tuple(r) for r in exact.collapsed(df).collect()} == {(1, 2, True), (3, 1, True), (4, 2, True)}


def test_trust_and_the_latest_moment(spark):
    at = "2024-01-02 00:00:00"
    rows = [(1, 1, "a", "x", at), (1, 2, "b", "y", at), (1, 3, "c", "z", "2023-05-05 00:00:00"), (1, 4, "c", "z", None), (2, 5, "a", "x", "2024-01-01 00:00:00"), (2, 6, "b", "y", at), (2, 7, "a", "x", "2024-01-01 12:00:00"), (3, 8, "a", None, at)]
    df = spark.createDataFrame(rows, "set_id int, id int, source string, v string, t string").withColumn("fetched_at", F.col("t").cast("timestamp_ntz"))
    of = lambda **k: {r.set_id: (r.v, r.v_id) for r in survivor.survivors(df, [survivor.Field("v", F.col("v"), **k)]).collect()}
    assert of(half_life_days=0.0, trust={"b": 2.0}) == {1: ("y", 2), 2: ("y", 6)} and of(half_life_days=0.0, trust={"a": 2.0}) == {1: ("x", 1), 2: ("y", 6)}
    assert of(half_life_days=365.0, trust={"b": 3.0}) == {1: ("y", 2), 2: ("y", 6)} and of() == {1: ("x", 1), 2: ("x", 7)}  # two votes outweigh a later one
    assert survivor.trust(("p", "q")) == {"p": 2.0, "q": 1.5}
