"""Records of two catalogues that share no key: multi-pass blocking, agreement levels, EM, posterior.

Blocking (a pair is compared once, whichever pass brings it up):
  doi     equal bare DOIs;
  word    a rare title word in common; a word that only one catalogue knows counts as the
          words of the other that begin or end alike and lie within three edits;
  name    a name, the year (plus or minus one, or missing on either side) and nine tenths of
          the longer title words in common, however frequent they are; a word that only its
          own catalogue knows is common if the other title has one within two fifths of its
          letters, four at most;
  title   a name and all letters and digits of the title in common, wherever words are divided.
A word is rare if at most ``rare`` distinct titles hold it, so copies of one record do not
make a word common.  As catalogues grow fewer words are rare; the other passes do not depend on it.

Pairs whose titles carry different marks of a dependent work (a reply, an erratum, a part
number) are different works by definition and never compared.

Comparison: title, its very rare words, names, year and DOI each give an agreement level.  Expectation
maximisation over the counts of level patterns (a few hundred at most, whatever the data)
estimates the share of matches and each level's probability among matches and non-matches
(Fellegi and Sunter, 1969; Winkler, 1988).  The posterior of a pair is its confidence.

Cases: a NULL, empty or blank field is a level of its own and counts neither for nor against;
a record without title, DOI and names is in no pair; texts may be long; repeated rows link
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.llm.canon import canonical_characters, doi_key
from folioweave.session import materialise

_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) == 2)
_FOLDED = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
# Words that open the title of a work about another work.
_DEPENDENT = ("erratum", "corrigendum", "correction", "reply", "response", "comment", "comments", "review", "discussion", "rejoinder", "addendum")
# Remarks of libraries and repositories that are no part of a title.
_REMARKS = r"[\[(]?\b(in press|pdf|full text|article|revised|corrected|accepted manuscript|online first|version \d+|v\d+)\b[\])]?"
# Roman numerals of parts.
_ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")


def folded(text: Column) -> Column:
    """Lower case without accents and without the braces of typesetting."""
    return F.translate(F.translate(F.lower(canonical_characters(text)), _ACCENTED.lower() + "ß", _FOLDED.lower() + "s"), "{}", "")


def _bare_title(title: Column) -> Column:
    t = F.regexp_replace(folded(title), _REMARKS, " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N},]+", " "))


def mark(t: Column) -> Column:
    """What makes a work depend on another: ``r:`` and the kind of note, ``p:`` and the part number; empty for neither. ``t`` is a bare title."""
    words = F.split(t, r"[\s,]+")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    near = F.greatest(*(F.levenshtein(first, F.lit(d), 1) for d in _DEPENDENT)) >= 0  # -1 beyond the bound
    note = F.when(second.isin("to", "on", "of"), F.when(near, F.concat(F.lit("r:"), F.left(first, F.lit(3)))))
    numeral = F.regexp_extract(t, r"(?:,\s*|\s)(?:par?r?t\s+)?(\d{1,2}|[ivx]{1,5})[\s,]*$", 1)
    told = t.rlike(r"(?:,|\sp\p{L}?r?\p{L}{0,2}t)\s*(?:\d{1,2}|[ivx]{1,5})[\s,]*$")
    roman = F.array_position(F.array(*map(F.lit, _ROMAN)), numeral)
    number = F.when(numeral.rlike(r"^\d+$"), numeral).otherwise(roman.cast("string"))
    part = F.when(told & (numeral != ""), F.concat(F.lit("p:"), number))
    return F.concat_ws("|", note, part)


def surnames(names: Column) -> Column:
    """Words of three letters or more of all names, given names among them, without accents."""
    text = folded(F.array_join(names, " "))
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"[^\p{L}]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.isin("phd", "and", "the")))


def prepared(records: DataFrame, record_id: str) -> DataFrame:
    """(id, key, words, names, year, doi, stem, mark): what is compared."""
    base = records.select(F.col(record_id).cast("long").alias("id"), F.coalesce(_bare_title(F.col("title")), F.lit("")).alias("bare"), surnames(F.col("authors")).alias("names"), F.col("year").cast("int").alias("year"), doi_key(F.col("doi")).alias("doi"))
    none = F.array().cast("array<string>")
    return base.select(
        "id", F.regexp_replace("bare", r"[\s,]+", "").alias("key"),
        F.array_distinct(F.array_remove(F.split("bare", r"[\s,]+"), "")).alias("words"),
        F.coalesce("names", none).alias("names"), "year", "doi", F.regexp_replace("doi", r"/v\d+$", "").alias("stem"), mark(F.col("bare")).alias("mark"),
    )


def _near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, other): words of the two tables that begin or end with the same four letters and lie within three edits."""
    def keyed(d: DataFrame, name: str) -> DataFrame:
        ends = F.array(F.concat(F.lit("<"), F.left("word", F.lit(4))), F.concat(F.lit(">"), F.right("word", F.lit(4))))
        return d.select(F.explode(ends).alias("end"), F.col("word").alias(name))

    pairs = keyed(left, "word").join(keyed(right, "other"), "end").select("word", "other")
    allowed = F.least(F.lit(3), F.floor(F.length("word") / 3))
    edits = F.levenshtein("word", "other", 3)
    return pairs.filter((F.abs(F.length("word") - F.length("other")) <= 3) & (edits > 0) & (edits <= allowed)).distinct()


def rare_words(a: DataFrame, b: DataFrame, rare: int) -> tuple[DataFrame, DataFrame]:
    """(word, id, mark, titles) for each word that at most ``rare`` distinct titles of both tables hold."""
    words_a, words_b = (d.select("id", "mark", F.xxhash64("key").alias("key"), F.explode("words").alias("word")).filter(F.length("word") >= 4) for d in (a, b))
    titles = words_a.select("key", "word").unionByName(words_b.select("key", "word")).distinct()
    few = titles.groupBy("word").agg(F.count("*").alias("titles")).filter(F.col("titles") <= rare)
    return tuple(w.join(few, "word").select("word", "id", "mark", "titles") for w in (words_a, words_b))


def candidates(a: DataFrame, b: DataFrame, rare_a: DataFrame, rare_b: DataFrame) -> DataFrame:
    """(a, b): ids of pairs that at least one pass brings together and whose marks agree."""
    rare_a, rare_b = rare_a.drop("titles"), rare_b.drop("titles")
    known_a, known_b = (d.select("word").filter(F.length("word") >= 6).distinct() for d in (rare_a, rare_b))
    only_b = known_b.join(known_a, "word", "left_anti")
    respelt = rare_b.join(_near_words(only_b, known_a), "word").select(F.col("other").alias("word"), "id", "mark")
    side_b = rare_b.unionByName(respelt).withColumnRenamed("id", "b")
    by_word = rare_a.withColumnRenamed("id", "a").join(side_b, ["word", "mark"]).select("a", "b")
    by_doi = a.filter("doi IS NOT NULL").select(F.col("id").alias("a"), "stem", "mark").join(b.filter("doi IS NOT NULL").select(F.col("id").alias("b"), "stem", "mark"), ["stem", "mark"]).select("a", "b")

    long = F.filter("words", lambda w: F.length(w) >= 5)
    named = F.filter("names", lambda n: F.length(n) >= 5)

    def keys(d: DataFrame, s: str, words: Column) -> DataFrame:
        rows = d.select(F.col("id").alias(s), "mark", words.alias("ws"), F.col("year").alias(f"year_{s}"), F.explode(named).alias("n"))
        return rows.select(s, f"year_{s}", "mark", "n", F.explode("ws").alias("w")).select(s, f"year_{s}", F.xxhash64("n", "w", "mark").alias("k"))

    used = a.select(F.explode(long).alias("word")).groupBy("word").agg(F.count("*").alias("used"))
    # a word that only the right side holds may be a slip: it is looked for among the words of the other title
    told = b.select("id", F.explode(long).alias("word")).join(used, "word", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("used", "word"))).alias("told"))  # no more words than the title has
    held = F.filter("told", lambda x: x["used"].isNotNull())
    asked = materialise(b.join(told, "id").select("id", "mark", "names", "year", held["word"].alias("held"), F.filter("told", lambda x: x["used"].isNull())["word"].alias("slips")))
    size = F.size("held") + F.size("slips")
    # a tenth of the words may be missing, so a pair shares one of the rarest words that are one more
    rarest = F.slice("held", 1, F.floor(size * 0.1).cast("int") + 1)
    same_time = F.coalesce(F.abs(F.col("year_a") - F.col("year_b")) <= 1, F.lit(True))
    met = keys(a, "a", long).join(keys(asked, "b", rarest).hint("merge"), "k").filter(same_time).select("a", "b").distinct()  # merged at every size: both sides grow
    met = met.join(asked.select(F.col("id").alias("b"), "held", "slips"), "b").join(a.select(F.col("id").alias("a"), long.alias("long")), "a")
    alike = F.filter("slips", lambda x: F.exists("long", lambda w: F.levenshtein(x, w, 4).between(0, F.floor(F.length(x) * 0.4))))  # -1 beyond the bound
    by_name = met.filter(F.size(F.array_intersect("held", "long")) + F.size(alike) >= 0.9 * size).select("a", "b")
    whole = lambda d, name: d.filter("key <> ''").select(F.col("id").alias(name), F.explode(named).alias("n"), "key", "mark").select(name, F.xxhash64("n", "key", "mark").alias("k"))
    by_title = whole(a, "a").join(whole(b, "b"), "k").select("a", "b")
    return by_word.unionByName(by_doi).unionByName(by_name).unionByName(by_title).distinct()


def _levels(c: DataFrame) -> DataFrame:
    """The agreement level of each field: 0 for missing, then from disagreement upwards."""
    least = lambda x: F.least(F.size(f"{x}_a"), F.size(f"{x}_b"))
    common = lambda x: F.size(F.array_intersect(f"{x}_a", f"{x}_b"))
    held = common("words") / F.greatest(least("words"), F.lit(1))
    longest = F.greatest(F.length("key_a"), F.length("key_b"))
    edits = F.levenshtein("key_a", "key_b", 40)
    close = F.when(edits >= 0, 1 - edits / F.greatest(longest, F.lit(1))).otherwise(0.0)
    title = F.when((F.col("key_a") == "") | (F.col("key_b") == ""), 0).when((held >= 0.95) | (close >= 0.9), 4).when((held >= 0.75) | (close >= 0.75), 3).when((held >= 0.6) | (close >= 0.6), 2).otherwise(1)
    share = common("names") / F.greatest(least("names"), F.lit(1))
    names = F.when(least("names") == 0, 0).when(share >= 0.6, 4).when(share >= 0.3, 3).when(share > 0, 2).otherwise(1)
    alike = F.exists("core_a", lambda x: F.exists("core_b", lambda y: F.levenshtein(x, y, 3) >= 0))  # -1 beyond the bound
    core = F.when((F.size("core_a") == 0) | (F.size("core_b") == 0), 0).when(common("core") > 0, 3).when(alike, 2).otherwise(1)
    gap = F.abs(F.col("year_a") - F.col("year_b"))
    year = F.when(gap.isNull(), 0).when(gap == 0, 3).when(gap == 1, 2).otherwise(1)
    doi = F.when(F.col("stem_a").isNull() | F.col("stem_b").isNull(), 0).when(F.col("stem_a") == F.col("stem_b"), 3).when(F.levenshtein("stem_a", "stem_b") <= 3, 2).otherwise(1)
    return c.select("a", "b", title.alias("title"), core.alias("core"), names.alias("names"), year.alias("year"), doi.alias("doi"))


FIELDS = {"title": 5, "core": 4, "names": 5, "year": 4, "doi": 4}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-7) -> tuple[float, list[list[float]], list[list[float]]]:
    """(share, m, u) by expectation maximisation over (levels, count); level 0 of a field says nothing."""
    sizes = list(FIELDS.values())
    share = 0.5
    m = [[0.0] + [float(v * v) for v in range(1, s)] for s in sizes]
    u = [[0.0] + [1.0 / v for v in range(1, s)] for s in sizes]
    for table in (m, u):
        for row in table:
            total = sum(row)
            row[:] = [x / total for x in row]
    for _ in range(rounds):
        new_m, new_u, hit, total = [[1e-3] * s for s in sizes], [[1e-3] * s for s in sizes], 0.0, 0
        for levels, count in patterns:
            p = _posterior(levels, share, m, u)
            hit += p * count
            total += count
            for f, v in enumerate(levels):
                if v:
                    new_m[f][v] += p * count
                    new_u[f][v] += (1 - p) * count
        for table, old in ((new_m, m), (new_u, u)):
            for row, prior in zip(table, old):
                row[0] = 0.0
                s = sum(row)
                prior[:] = [x / s for x in row]
        before, share = share, min(max(hit / max(total, 1), 1e-6), 1 - 1e-6)
        if abs(before - share) < tolerance:
            break
    return share, m, u


def _posterior(levels: tuple[int, ...], share: float, m: list[list[float]], u: list[list[float]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(m[f][v] / u[f][v]) for f, v in enumerate(levels) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def link(left: DataFrame, left_id: str, right: DataFrame, right_id: str, least: float = 0.5, rare: int = 60, very_rare: int = 15) -> DataFrame:
    """(a, b, title, core, names, year, doi, confidence) of each pair whose posterior is ``least`` or more."""
    spark = left.sparkSession
    a, b = materialise(prepared(left, left_id)), materialise(prepared(right, right_id))
    rare_a, rare_b = rare_words(a, b, rare)
    rare_a, rare_b = materialise(rare_a), materialise(rare_b)
    pairs = candidates(a, b, rare_a, rare_b)
    core = lambda d, w: d.join(w.filter((F.col("titles") <= very_rare) & (F.length("word") >= 6)).groupBy("id").agg(F.collect_set("word").alias("core")), "id", "left").withColumn("core", F.coalesce("core", F.array().cast("array<string>")))
    a, b = core(a, rare_a), core(b, rare_b)  # no more words than the title has
    fields = ("key", "words", "core", "names", "year", "stem")
    named = lambda d, s: d.select(F.col("id").alias(s), *(F.col(f).alias(f"{f}_{s}") for f in fields))
    compared = materialise(_levels(pairs.join(named(b, "b"), "b").join(named(a, "a"), "a")))
    counts = compared.groupBy(*FIELDS).count().collect()  # 5 * 4 * 5 * 4 * 4 rows at most
    patterns = [(tuple(r[f] for f in FIELDS), r["count"]) for r in counts]
    share, m, u = fit(patterns)
    scores = spark.createDataFrame([(*p, _posterior(p, share, m, u)) for p, _ in patterns], ", ".join(f"{f} int" for f in FIELDS) + ", confidence double")
    return compared.join(F.broadcast(scores), list(FIELDS)).filter(F.col("confidence") >= least).select("a", "b", *FIELDS, "confidence")


def found(papers: DataFrame, imports: DataFrame) -> DataFrame:
    """(paper_id, import_id) of each pair that is one work."""
    return link(papers, "paper_id", imports, "import_id").select(F.col("a").alias("paper_id"), F.col("b").alias("import_id"))
