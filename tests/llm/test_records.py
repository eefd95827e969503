import collections
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from folioweave.llm import exact, linkage, neardup, survivor, truncation

SENTENCES = ["We study the slow growth of plants under bright light", "The new method needs no further prior at all", "Results show a strong effect in all of the trials", "Data were gathered from four large public archives", "These findings matter for the design of better tools"]
ABSTRACTS = "paper_id bigint, abstract string, source string"


def corpus(n=60):
    rng = random.Random(5)
    return [(i, ". ".join(rng.sample(SENTENCES, 4)) + ".", "a") for i in range(n)]


def reasons(spark, rows, clash=lambda d: d, **k):
    df = clash(spark.createDataFrame(rows, ABSTRACTS))
    return {r.id: r.reason for r in truncation.judged(df, "abstract", "paper_id", "source", **k).collect()}


def test_truncation(spark, clash):
    whole = ". ".join(SENTENCES)
    cuts = {1000: whole + ". These findings matter for the", 1001: whole + ". Data were gath", 1002: whole + ". Results show a …", 1003: whole + " (n = 4", 1004: "… " + whole + ".", 1005: whole + ". We study <jats:ita", 1006: whole + ". We st�", 1007: whole + " (ABSTRACT CUT AT 50 WORDS)"}
    fine = {2000: whole, 2001: whole + " (n = 41)", 2002: whole + ". © The authors", 2003: f"<jats:p>{whole}.</jats:p>", 2004: whole + ". Keywords: plants, tools", 2005: whole + ".\"", 2006: (whole + ". ") * 3000}
    none = {3000: None, 3001: "", 3002: "  \n", 3003: "No abstract available", 3004: "..."}
    rows = corpus() + [(i, t, "b") for i, t in {**cuts, **fine, **none}.items()]
    got = reasons(spark, rows, clash)
    assert {i for i in cuts if got[i] is None} == set() and {i: got[i] for i in fine if got[i] is not None} == {} and not set(none) & set(got)
    assert all(got[i] is None for i in range(60))
    doubled = reasons(spark, rows + rows)  # repeated rows are judged alike
    assert {i for i, r in doubled.items() if r} >= set(cuts)
    assert reasons(spark, []) == {}


def test_lengths_that_pile_up(spark):
    rng = random.Random(1)
    rows = corpus() + [(100 + i, (". ".join(rng.sample(SENTENCES, 4)) + " and " + " ".join(rng.sample(SENTENCES, 3)))[:255].rstrip() .ljust(255, "x"), "e") for i in range(40)]
    got = reasons(spark, rows)
    assert all(got[100 + i] for i in range(40))


def test_rates(spark):
    v = spark.createDataFrame([(1, "a,b", "tag"), (2, "a", None), (3, None, None)], "id bigint, source string, reason string")
    assert {(r.source, r.texts, r.cut) for r in truncation.rates(v).collect()} == {("a", 2, 1), ("b", 1, 1), ("", 1, 0)}


TITLED = "paper_id bigint, title string, doi string"


def brute_sets(rows):
    def title(t):
        return re.sub(r"[\W_]+", "", (t or "").lower())

    def doi(d):
        m = re.search(r"10\.\d{3,9}/\S*[^\s.,;:)\]}>\"']", (d or "").lower().replace("%2f", "/"))
        return m and m.group(0)

    by = collections.defaultdict(lambda: collections.defaultdict(list))
    for i, t, d in rows:
        if title(t):
            by[title(t)][doi(d)].append(i)
    out = set()
    for dois in by.values():
        named = [d for d in dois if d]
        groups = [sum(dois.values(), [])] if len(named) <= 1 else list(dois.values())
        for g in groups:
            out |= {(min(g), i) for i in g if i != min(g)}
    return out


def test_exact(spark, clash):
    rng = random.Random(2)
    titles, dois = ["Deep learning", "Über Wälder: Teil 2", "Preface", "«On x»"], ["10.1234/Ab.c", "10.1234/z", None, "", "N/A"]
    rows = []
    for i in range(300):
        t, d = rng.choice(titles), rng.choice(dois)
        t = rng.choice([str, str.upper, str.title, lambda s: "  " + s.replace(" ", " - ") + ".", lambda s: f"[{s}]"])(t)
        d = rng.choice([lambda s: s, lambda s: s and s.startswith("10") and "https://doi.test/" + s.replace("/", "%2F") or s, lambda s: s and s.startswith("10") and f" doi:{s.upper()}. " or s])(d)
        rows.append((i, t, d))
    rows += [(900, None, "10.1234/q"), (901, "", None), (902, "...", None), (903, None, None), (904, "x" * 100_000, None), (905, "X" * 100_000, None)]
    df = clash(spark.createDataFrame(rows, TITLED))
    assert {tuple(r) for r in exact.found(df).collect()} == brute_sets(rows)
    counts = {r.record_id: r.copies for r in exact.collapsed(df).collect()}
    assert counts[904] == 2 and sum(counts.values()) == 302 and not any(r.collided for r in exact.collapsed(df).collect())
    assert exact.found(df.limit(0)).count() == 0


def test_canonical_characters(spark):
    df = spark.createDataFrame([(1, "Ｄｅｅｐ Café & Co", None), (2, "deep café &amp; co", None), (3, "Deep cafe & co", None)], TITLED)
    assert {tuple(r) for r in exact.found(df).collect()} == {(1, 2)}


def bag_similarity(x, y):
    u, v = collections.Counter(neardup.words_of(*x)), collections.Counter(neardup.words_of(*y))
    common = sum((u & v).values())
    return common / (sum(u.values()) + sum(v.values()) - common)


def test_neardup(spark, clash):
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for edits in (0, 0, 4, 8, 12, 60):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = "e%d" % rng.randrange(10**6)
            if edits == 8:
                words = words[60:] + words[:60]
            rows.append((n, f"Title {n % 2}", ("<p>" + " ".join(words) + "</p>").upper() if edits == 4 else " ".join(words)))
            n += 1
    rows += [(900, None, None), (901, "", ""), (902, "t", "few words only"), (903, "t", "few words only"), (904, None, "long " * 200_000), (905, "", "LONG, " * 200_000)]
    df = clash(spark.createDataFrame(rows, "paper_id bigint, title string, abstract string"))
    got = {tuple(r) for r in neardup.found(df).collect()}
    long = [r for r in rows if len(neardup.words_of(r[2])) >= 30]
    like = {(x[0], y[0]): bag_similarity(x[1:], y[1:]) for i, x in enumerate(long) for y in long[i + 1 :]}
    assert all(like[p] >= 2 / 3 for p in got) and (904, 905) in got
    assert {p for p, v in like.items() if v >= 0.75} <= got  # bands find 99 % at 0.75, all but 1 in 10,000 at 0.8
    assert len(got) >= 0.85 * sum(v >= 2 / 3 for v in like.values())
    assert neardup.found(df.limit(0)).count() == 0
    told = {r.id: r for r in neardup.document_links(df, "paper_id", ["title", "abstract"], "abstract", 30).collect()}
    assert set(told) == {r[0] for r in long} and told[905].class_rep == 904 and told[905].copies == 2


def test_odd_sketches_estimate():
    import numpy as np

    rng = np.random.default_rng(3)
    k = neardup.ROWS * neardup.BANDS
    for j in (0.5, 0.7, 0.9):
        shared = int(300 * 2 * j / (1 + j))
        common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (shared, 300 - shared, 300 - shared))
        v = neardup._minhashes(np.concatenate([common, a, common, b]), np.array([0, 300, 600]), k)
        s = neardup._odd_sketches(v, neardup.FINE_BITS)
        assert abs(neardup.odd_similarity(np.bitwise_count(s[0] ^ s[1]).sum(), neardup.FINE_BITS, k) - j) < 0.08


def test_survivor(spark, clash):
    day = lambda n: dt.datetime(2024, 1, n)
    whole = ". ".join(SENTENCES) + "."
    rows = [
        (1, "Deep work", whole, "10.1234/x", "a", 5, day(1)), (2, "DEEP WORK", whole, None, "b,c", None, day(3)), (3, "deep work", whole + " (ABSTRACT CUT AT 9 WORDS)", "https://doi.test/10.1234/X", "a", -1, day(9)),
        (4, "deep  work", "No abstract available.", None, None, 0, day(8)), (5, "alone", whole, None, "z", 1, day(1)), (6, "Pair", None, "n/a", "q", None, day(1)), (7, "pair", "", "", "", None, None),
    ]
    df = clash(spark.createDataFrame(rows, "paper_id bigint, title string, abstract string, doi string, source string, citations_count bigint, fetched_at timestamp"))
    got = {r.group_id: tuple(r)[1:] for r in survivor.found(df).collect()}
    assert got == {1: (2, 4, "10.1234/x", "a,b,c"), 6: (None, None, "", "q")}
    assert survivor.found(df.limit(0)).count() == 0


def test_votes(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, s, v, t) for i, (s, v) in enumerate([("good", "x"), ("bad", "y"), ("bad", "y"), ("bad", None)])], "set_id int, id bigint, source string, v string, fetched_at timestamp")
    field = lambda **k: [survivor.Field("v", F.col("v"), **k)]
    assert survivor.survivors(df, field()).first().v == "y"
    assert survivor.survivors(df, field(trust={"good": 5.0})).first().v == "x"
    assert survivor.survivors(df, field(union=True)).first().v == ["x", "y"]


def test_marks(spark):
    cases = {
        "A study of x, Part II": "p:2", "A study of x, 3": "p:3", "Results from 84 trials": "", "Reply to A study": "r:rep", "ERRATUM TO: x": "r:err", "Erratm to x": "r:err", "On robust gels [v2]": "", "A study part iv (in press)": "p:4",
        "Review of things": "r:rev", "Reviewing of things": "", None: "", "": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.t: r.m for r in df.select("t", linkage.mark(F.coalesce(linkage._bare_title(F.col("t")), F.lit(""))).alias("m")).collect()}
    assert got == cases


def test_em_separates():
    rng = random.Random(4)
    patterns = collections.Counter()
    for _ in range(4000):
        match = rng.random() < 0.2
        levels = tuple(rng.choices(range(size), [0.5] + [(v**3 if match else (size - v) ** 3) for v in range(1, size)])[0] for size in linkage.FIELDS.values())
        patterns[levels] += 1
    share, m, u = linkage.fit(list(patterns.items()))
    assert 0.1 < share < 0.3 and all(m[f][-1] > u[f][-1] for f in range(len(m)))


def test_linkage(spark, clash):
    rng = random.Random(8)
    names = ["%s %s" % (g, f) for g in ("Wanda", "Robert", "Aiko") for f in ("Kogotreb", "Pulumanik", "Zastirobel", "Mivetrakon")]
    left, right, truth = [], [], set()
    for i in range(400):
        coined = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
        title, people = f"Measuring {coined} in porous media: {rng.choice(['methods', 'results', 'theory'])}", rng.sample(names, 2)
        left.append((i, title, people, rng.randint(1990, 2020), f"10.1234/{coined}" if i % 3 else None))
        if i % 2:
            broken = title.replace(coined, coined[:3] + coined[4:]) if i % 5 == 0 else title.upper()
            right.append((1000 + i, broken + " [PDF]", [p.split()[1] + ", " + p[0] + "." for p in people], left[-1][3] if i % 7 else None, None))
            truth.add((i, 1000 + i))
            right.append((5000 + i, "Reply to " + title, people, left[-1][3], None))
    ddl = "{} bigint, title string, authors array<string>, year int, doi string"
    extra = [(9000, None, None, None, None), (9001, "", [], 2000, "")]
    p, q = clash(spark.createDataFrame(left + extra, ddl.format("paper_id"))), clash(spark.createDataFrame(right + extra, ddl.format("import_id")))
    got = {tuple(r) for r in linkage.found(p, q).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    assert linkage.found(p.limit(0), q).count() == 0 and linkage.found(p, q.limit(0)).count() == 0
