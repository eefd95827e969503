"""Operators against planted truth: counted recall and precision."""

import random

from pyspark.sql import functions as F

from folioweave.llm import linkage, packing, truncation

NOUNS = ["harbours", "lanterns", "glaciers", "meadows", "engines", "violins", "orchards", "tunnels", "satellites", "markets", "rivers", "archives"]
ADJECTIVES = ["slow", "bright", "nested", "coastal", "hidden", "steady", "modern", "fragile", "distant", "quiet"]
SENTENCES = [
    "We study {a} {n} under {b} conditions and ask how far the effects persist.", "The main result is a {a} treatment of {n} that avoids the usual corrections.", "Older {n} were excluded, since they are known to distort the picture.",
    "Data on {n} were gathered over {k} seasons and cleaned before the analysis (n = {k}).", "How {n} emerge from {a} interactions is poorly understood.", "In contrast to {b} {m}, the new estimator needs no {a} prior.", "Results show a clear signal once {n} are treated as {a}.",
    "Because {n} interact, {a} corrections were required throughout.", "Between {k} and 90 samples were needed to detect the {a} trend [{k}].", "Only {b} {m} survived the second round of tests.",
]


def text(rng):
    fill = lambda s: s.format(a=rng.choice(ADJECTIVES), b=rng.choice(ADJECTIVES), n=rng.choice(NOUNS), m=rng.choice(NOUNS), k=rng.randint(2, 80))
    return " ".join(fill(rng.choice(SENTENCES)) for _ in range(rng.randint(4, 9)))


def test_planted_cuts(spark):
    rng = random.Random(11)
    rows, cut = [], set()
    for i in range(3000):
        t, mode = text(rng), rng.random()
        if mode < 0.10:
            at = rng.randint(len(t) // 2, len(t) - 2)
            while t[at - 1] in ".)] " or t[at] == " " and t[at - 1] == ".":
                at += 1
            if at < len(t) - 1:
                cut.add(i)
                t = t[:at] + rng.choice(["", "", "", "…", "...", " [...]", "... (continued)", "�"])
        elif mode < 0.15:
            t = t.rstrip(".")  # complete without its full stop
        elif mode < 0.20:
            t += rng.choice([" © The authors", " Keywords: lanterns, sand", " Registered as TR-1234", " MSC: 62G05"])
        rows.append((i, t, rng.choice(["a", "b"])))
    df = spark.createDataFrame(rows, "paper_id bigint, abstract string, source string")
    got = {r.id: r.reason for r in truncation.judged(df, "abstract", "paper_id", "source").collect()}
    found = {i for i, r in got.items() if r}
    assert len(found & cut) >= 0.97 * len(cut) and len(found & cut) >= 0.98 * len(found)
    assert sum(got[i] in truncation.LEVELS for i in found) >= 0.9 * len(found)
    rates = {r.source: r for r in truncation.rates(truncation.judged(df, "abstract", "paper_id", "source")).collect()}
    assert sum(r.cut for r in rates.values()) == len(found) and sum(r.texts for r in rates.values()) == len(rows)


def test_planted_links(spark):
    rng = random.Random(5)
    name = lambda k: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(k)).title()
    left, right, truth = [], [], set()
    for i in range(600):
        people = [f"{rng.choice(['Anna', 'Robert', 'Wanda', 'Oskar'])} {name(4)}" for _ in range(rng.randint(1, 3))]
        title, year = f"{name(5)} methods for {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)} and {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)}", rng.randint(1990, 2020)
        left.append((i, title, people, year, None))
        kind = rng.random()
        if kind < 0.5:
            truth.add((i, i))
            words = title.split()
            if kind < 0.15:
                words[0] = words[0][:3] + words[0][4:]  # a letter lost
            elif kind < 0.25:
                words = words[1:]  # the rare word lost
            elif kind < 0.3:
                words = [words[0] + words[1], *words[2:]]
            right.append((i, " ".join(words).upper() if kind > 0.45 else " ".join(words), [f"{p.split()[1]}, {p[0]}." for p in people], None if rng.random() < 0.15 else year + rng.choice([0, 0, 1]), None))
        elif kind < 0.6:
            right.append((i, f"Reply to {title}", [f"{name(4)}, X."], year + 1, None))
        else:
            right.append((i, f"{name(5)} methods for {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)} and {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)}", [f"{name(4)}, A."], year, None))
    ddl = "{} bigint, title string, authors array<string>, year int, doi string"
    got = {tuple(r) for r in linkage.found(spark.createDataFrame(left, ddl.format("paper_id")), spark.createDataFrame(right, ddl.format("import_id"))).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.98 * len(got)


def test_equal_ids_are_dealt_evenly(spark):
    df = spark.range(20_000).select(F.lit(7).alias("doc_id"), (F.col("id") % 900).alias("size"))
    packed = packing.pack(df, "doc_id", "size", share=5_000)
    assert packed.count() == 20_000
    r = packing.filling(packed).first()
    assert r.overfull == 0 and r.used > 0.97
