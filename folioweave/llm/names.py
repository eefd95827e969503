"""Variant spellings of persons and organisations: suffix blocking and longest common subsequences.

Blocking indexes the suffix of ``SUFFIX`` letters of a name's leading word, and the suffix of
the word read backwards; words too short for one slip anywhere to leave one of the two intact,
and places, are indexed without each of their letters as well.  A suffix is
never dropped for being common: it is refined by another field first (the kind of
organisation, a shared organisation, the initial of the given name), which keeps blocks
small without losing a pair that could match.  Names in papers look for their whole family
name, the longest suffix, first; only names nobody bears go on to the short ones.  Pairs are
compared by the ratio of their longest common subsequence, ``2 * LCS / (|a| + |b|)``.

Organisations are a kind and a place.  Persons are rows of authors whose names can be
spellings of one name and that share an organisation or an ORCID, closed transitively.
Names in papers are assigned to the person they fit best: by family name, given names,
shared organisations in the paper's payload, then by the number of the person's rows.

Cases: NULL, empty and blank names, names of groups and names without a family name link to
nothing; NULL affiliations share nothing; long names are used whole; repeated rows are one
entity; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioweave.operators.components import connected_components
from folioweave.operators.joins import shuffled, skew_safe_left_join
from folioweave.operators.nested import PAPER_ORGANISATIONS, linked_rows
from folioweave.session import materialise

SUFFIX = 4

# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "becky": "rebecca", "ben": "benjamin", "bert": "robert albert", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "bob": "robert", "cathy": "catherine", "chris": "christopher", "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah",
    "debbie": "deborah", "dick": "richard", "dima": "dmitri", "dora": "theodora", "ed": "edward", "ellie": "eleanor", "fran": "francesca", "fred": "frederick", "gabby": "gabriela", "gabi": "gabriela", "gaby": "gabriela", "greg": "gregory",
    "hank": "henry", "izzy": "isabella", "harry": "henry", "jack": "john", "jim": "james", "joe": "joseph", "jon": "jonathan", "kate": "catherine katherine", "kathy": "catherine katherine", "katie": "catherine katherine", "ken": "kenneth",
    "larry": "lawrence", "len": "leonard", "leo": "leonard", "liz": "elizabeth", "lou": "louisa", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mike": "michael",
    "nate": "nathaniel", "nick": "nicholas", "nora": "eleanor", "pat": "patricia patrick", "patty": "patricia martha", "peggy": "margaret", "peg": "margaret", "pete": "peter", "ray": "raymond", "rich": "richard",
    "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sandy": "alexander", "sasha": "alexander", "steve": "stephen steven", "sue": "susannah susan", "susie": "susannah",
    "ted": "theodore edward", "theo": "theodora theodore", "tim": "timothy", "tina": "christina", "tom": "thomas", "tony": "anthony", "vicky": "victoria", "walt": "walter", "wally": "walter", "will": "william", "zoe": "zoe",
}
# Words that mark the name of a group.
_GROUP = re.compile(r"(?i)\b(collaboration|consortium|group|team|network|initiative|committee|society|investigators|project|alliance|authors|anonymous|et al)\b")
# Titles and degrees.
_TITLES = re.compile(r"(?i)(?:^|(?<=[\s,]))(?:dr|eds?|prof|professor|phd|ph\.d|md|m\.d|msc|jr|sr|mr|mrs|ms)\.?(?=[\s,.]|$)")
# Kinds of organisations by the stems of their words, most telling first.
KINDS = (
    ("hospital", ("hospital", "hosp", "clinic", "krankenhaus", "hopital")),
    ("laboratory", ("laboratory", "lab", "labs", "laboratoire", "laboratorio")),
    ("company", ("analytics", "ltd", "limited", "gmbh", "inc", "corp")),
    ("college", ("college", "coll", "teachers")),
    ("technology", ("technology", "technol", "tech", "technological", "institute", "inst")),
    ("university", ("university", "univ", "universite", "universidad", "universitat", "universita", "uni")),
)
# Further words of organisations' names that name no place.
_PLAIN = frozenset("of de la le the und and for general gen national natl nat school medicine dept department division soil science physics statistics faculty letters computing group centre center".split())
# Short words that only link others.
_LINKS = frozenset("a an am at by da das dei del den der des di do du e el et fur im in les los on to van von y zu zur".split())
_KIND_OF = {w: k for k, words in KINDS for w in words}
_RANK = {k: i for i, (k, _) in enumerate(KINDS)}


def repaired(text: str) -> str:
    """Text read in the wrong encoding put right."""
    if "Ã" in text or "Å" in text:
        try:
            return text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return text


def fold(text: str) -> str:
    """Lower case without accents."""
    text = repaired(text)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of ``a`` at a time (Hyyrö, 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def split_names(text: str | None) -> list[str]:
    """The single names in one entry: several may be joined by semicolons."""
    return [n for n in (text or "").split(";") if n.strip() and not _GROUP.search(n)]


def parse_person(name: str) -> list[tuple[str, tuple[str, ...]]]:
    """(family, given names and initials) of a name, in the order of likelihood; two where the order of its parts is open."""
    bare = re.sub(r"[*†‡\d\"()\[\]{}]+", " ", repaired(name))
    bare = _TITLES.sub(" ", bare).strip(" ,.\t\n ")

    def parts(piece: str) -> list[tuple[str, bool]]:
        out = []
        for t in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?", piece):
            w = t.rstrip(".")
            letters = fold(w).replace("'", "").replace("’", "")
            if len(letters) == 1:
                out.append((letters, True))
            elif len(w) <= 3 and w.isupper() and bare.upper() != bare:
                out += [(c, True) for c in letters]
            else:
                out.append((letters, False))
        return out

    if "," in bare:
        family, given = bare.split(",", 1)
        f, g = parts(family), parts(given)
        words = [w for w, initial in f if not initial]
        if words and g:
            return [("".join(words), tuple(w for w, _ in g))]
        bare = family + " " + given
    p = parts(bare)
    full = [i for i, (_, initial) in enumerate(p) if not initial]
    if not full or len(p) < 2:
        return []
    rest = lambda i: tuple(w for j, (w, _) in enumerate(p) if j != i)
    if len(full) == 1:
        return [(p[full[0]][0], rest(full[0]))]
    if p[-1][1]:
        return [(p[full[0]][0], rest(full[0]))]
    last = (p[full[-1]][0], rest(full[-1]))
    return [last, (p[0][0], rest(0))] if len(p) == len(full) == 2 else [last]


def _one_given(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return bool(_initials((a,)) & _initials((b,)))
    if a == b or a in NICKNAMES.get(b, "").split() or b in NICKNAMES.get(a, "").split():
        return True
    short, long = sorted((a, b), key=len)
    return (len(short) >= 3 and long.startswith(short)) or ratio(a, b) >= 0.75


@lru_cache(1 << 16)
def given_fit(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """How far two lists of given names agree: 0 not at all, 1 by initials, 2 by a full name; one more for an equal second initial."""
    if not a or not b or not _one_given(a[0], b[0]):
        return 0
    if len(a) > 1 and len(b) > 1 and a[1][0] != b[1][0]:
        return 0
    full = len(a[0]) > 1 and len(b[0]) > 1
    return 1 + full + (len(a) > 1 and len(b) > 1)


def form(name: str) -> str:
    """A name reduced to what is compared: family and given names for each reading; empty if it has none."""
    return "/".join(f"{family} {' '.join(given)}" for family, given in parse_person(name) if given)


@lru_cache(1 << 16)
def _readings(form_: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((p[0], tuple(p[1:])) for p in (r.split(" ") for r in form_.split("/")))


def form_fit(x: str, y: str, least: float = 0.85) -> float:
    """0 if two forms can't be spellings of one name, else how well they agree."""
    best = 0.0
    for i, (fa, ga) in enumerate(_readings(x)):
        for fb, gb in _readings(y)[: None if i == 0 else 1]:  # not both with their parts reversed
            r = ratio(fa, fb)
            if r >= least and (g := given_fit(ga, gb)):
                best = max(best, r + g)
    return best


def _word_kind(w: str) -> str | None:
    k = _KIND_OF.get(w)
    if k or len(w) < 7:
        return k
    near = [(ratio(w, known), k) for known, k in _KIND_OF.items() if len(known) >= 7]
    r, k = max(near)
    return k if r >= 0.86 else None


def parse_organisation(name: str) -> tuple[str, str] | None:
    """(kind, place) of an organisation; None for a name without a place."""
    bare = re.sub(r"['’]", "", repaired(name))
    kinds, places, short = set(), [], []
    for token in re.findall(r"[^\W\d_]+", bare):
        w = fold(token)
        k = _word_kind(w)
        acronym = len(w) <= 2 or (token.isupper() and not bare.isupper())
        if k:
            kinds.add(k)
        elif len(w) <= 3 and (acronym or w in _PLAIN or w in _LINKS):
            if w not in _PLAIN and w not in _LINKS:
                short.append(w)
        elif w not in _PLAIN and not any(ratio(w, p) >= 0.86 for p in _PLAIN if len(p) >= 7):
            places.append(w)
    places = places or short  # 'University of Ulm', 'ETH'
    if not places:
        return None
    if not kinds:
        return "other", "".join(places)
    return min(kinds, key=_RANK.__getitem__), "".join(places)


def _flat_map(df: DataFrame, f, schema: str) -> DataFrame:
    """Each row of ``df`` to any number of rows ``f`` gives for its values."""
    fields = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [y for x in zip(*(c.to_pylist() for c in batch.columns)) for y in f(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], fields.types[i]) for i in range(len(fields))], schema=fields)

    return df.mapInArrow(run, schema)


def _blocks(word: str) -> set[str]:
    """The keys of a word: its suffix, and the suffix of the word read backwards; what a single slip leaves where the two overlap or meet."""
    return {">" + word[-SUFFIX:], "<" + word[::-1][-SUFFIX:]} | (_slip_blocks(word) if len(word) <= 2 * SUFFIX else set())


def _slip_blocks(word: str) -> set[str]:
    """The word, and the word without each of its letters: two words that one edit or one swap of neighbours tells apart have one in common."""
    return {"-" + word, *("-" + word[:i] + word[i + 1 :] for i in range(len(word)))}


def _place_blocks(place: str) -> set[str]:
    """Long suffixes of a place's name, the suffix of the name read backwards that starts where they end, and what a single slip leaves."""
    return {">" + place[k:] for k in range(3, 7) if len(place) - k >= SUFFIX} | {"<" + place[:6]} | _slip_blocks(place)


def _initials(given: tuple[str, ...]) -> set[str]:
    """The first letter of the given name, and of the names it may be short for."""
    return {g[0] for g in (given[0], *NICKNAMES.get(given[0], "").split())} if given else set()


def resolve_organisations(names: DataFrame, addresses: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """(name, org): the organisation each distinct ``name`` stands for; names without a place are left out.

    ``addresses`` (name, address) links names of one web address as well.
    """
    distinct = names.filter("name IS NOT NULL").select("name").distinct()

    def parse(name: str):
        p = parse_organisation(name)
        return [(name, p[0] + "|" + p[1], p[0], p[1])] if p else []

    parsed = materialise(_flat_map(distinct, parse, "name string, node string, kind string, place string"))
    nodes = parsed.select("node", "kind", "place").distinct()
    keyed = materialise(_flat_map(nodes, lambda n, k, p: [(k + b, n, p) for b in _place_blocks(p)], "block string, node string, place string"))
    other = keyed.select("block", F.col("node").alias("node_b"), F.col("place").alias("place_b"))
    close = F.abs(F.length("place") - F.length("place_b")) <= (1 - least) * (F.length("place") + F.length("place_b"))  # beyond it no ratio reaches least
    pairs = keyed.join(shuffled(other), "block").filter((F.col("node") < F.col("node_b")) & close).select("node", "place", "node_b", "place_b").distinct()
    edges = _flat_map(pairs, lambda n, p, m, q: [(n, m)] if ratio(p, q) >= least else [], "a string, b string")
    if addresses is not None:
        host = F.regexp_extract(F.lower("address"), r"^(?:https?://)?(?:www\.)?([^/]+)", 1)
        sites = addresses.filter("address IS NOT NULL").select("name", host.alias("host")).filter("host <> ''").join(shuffled(parsed), "name")
        edges = edges.unionByName(sites.select(F.col("node").alias("a"), F.concat(F.lit("~"), "kind", F.lit("|"), "host").alias("b")).distinct())
    parts = connected_components(edges)
    return parsed.join(shuffled(parts), "node", "left").select("name", F.coalesce("component", "node").alias("org"))


def institution_pairs(institutions: DataFrame, orgs: DataFrame) -> DataFrame:
    """(first_id, second_id) of each two institutions that are one organisation."""
    rows = institutions.select("institution_id", "name").join(shuffled(orgs), "name").select("org", F.col("institution_id").alias("i"))
    other = rows.select("org", F.col("i").alias("j"))
    return rows.join(shuffled(other), "org").filter("i < j").select(F.col("i").alias("first_id"), F.col("j").alias("second_id"))


def shapes(table: DataFrame, name: str) -> DataFrame:
    """``table`` with ``shape``, the form of the name; rows whose name has none, or is a group's, are left out."""

    @F.pandas_udf("string")
    def shape(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None or _GROUP.search(n) else form(n) or None)

    return table.withColumn("shape", shape(F.col(name))).filter("shape IS NOT NULL")


def persons(authors: DataFrame, orgs: DataFrame) -> DataFrame:
    """(author_id, shape, person): the form of the name of each author row that has one, and the smallest author_id of its person."""
    def keys(i: int, shape: str, orcid: str | None, org: str | None):
        out = []
        for family, given in _readings(shape):
            if org:
                out += [(f"{org}{b}{g}", i, shape) for b in _blocks(family) for g in _initials(given)]
            if orcid:
                out.append((orcid, i, shape))
        return set(out)

    orcid = F.nullif(F.regexp_extract(F.regexp_replace("orcid", r"[\s-]", ""), r"(\d{15}[\dXx])", 1), F.lit(""))
    shaped = materialise(shapes(authors.filter("author_id IS NOT NULL"), "name").select("author_id", "shape", orcid.alias("orcid"), "affiliations"))
    rows = shaped.select("author_id", "shape", "orcid", F.explode_outer("affiliations").alias("affiliation"))
    rows = rows.join(shuffled(orgs.withColumnRenamed("name", "affiliation")), "affiliation", "left").select("author_id", "shape", "orcid", "org").distinct()
    keyed = materialise(_flat_map(rows, keys, "block string, author_id long, shape string").distinct())
    # rows of one block and one spelling are linked to the first of them; different spellings are compared once
    spelt = keyed.groupBy("block", "shape").agg(F.min("author_id").alias("lead"))
    same = keyed.join(shuffled(spelt), ["block", "shape"]).select(F.col("author_id").alias("a"), F.col("lead").alias("b"))
    other = spelt.select("block", F.col("shape").alias("shape_b"), F.col("lead").alias("lead_b"))
    pairs = spelt.join(shuffled(other), "block").filter("shape < shape_b").select("lead", "shape", "lead_b", "shape_b").distinct()
    edges = _flat_map(pairs, lambda i, x, j, y: [(i, j)] if form_fit(x, y) else [], "a long, b long")
    parts = connected_components(edges.unionByName(same.filter("a <> b")))
    return shaped.select("author_id", "shape").distinct().join(shuffled(parts.select(F.col("node").alias("author_id"), "component")), "author_id", "left").select("author_id", "shape", F.coalesce("component", "author_id").alias("person"))


def author_pairs(people: DataFrame) -> DataFrame:
    """(first_id, second_id) of each two author rows that are one person."""
    rows = people.select("person", F.col("author_id").alias("i"))
    return rows.join(shuffled(people.select("person", F.col("author_id").alias("j"))), "person").filter("i < j").select(F.col("i").alias("first_id"), F.col("j").alias("second_id"))


def _whole_keys(shape: str) -> set[str]:
    return {f"={family} {g}" for family, given in _readings(shape) for g in _initials(given)}


def _suffix_keys(shape: str) -> set[str]:
    return {b + g for family, given in _readings(shape) for b in _blocks(family) for g in _initials(given)}


def _fits(mentioned: DataFrame, variants: DataFrame, keys) -> DataFrame:
    """(shape, variant, fit): the borne forms each form can be a spelling of, among those that share a key."""
    def keyed(d: DataFrame, name: str) -> DataFrame:
        return _flat_map(d.select("shape"), lambda n: [(k, n) for k in keys(n)], f"block string, {name} string").select(F.xxhash64("block").alias("block"), name)

    pairs = keyed(mentioned, "shape").join(shuffled(keyed(variants, "variant")), "block").select("shape", "variant").distinct()
    return _flat_map(pairs, lambda n, v: [(n, v, f)] if (f := form_fit(n, v)) else [], "shape string, variant string, fit double")


def paper_people(papers: DataFrame, authors: DataFrame, people: DataFrame, orgs: DataFrame, said: DataFrame) -> DataFrame:
    """(paper_id, person) of each person named in a paper's authors; ``said`` is (paper_id, pos, name) of the organisations in payloads."""

    def read(i: int, pos: int, entry: str):
        return [(i, pos, f) for n in split_names(entry) if (f := form(n))]

    listed = papers.filter("authors IS NOT NULL").select("paper_id", F.posexplode("authors").alias("pos", "entry")).filter("entry IS NOT NULL")
    mentions = materialise(_flat_map(listed, read, "paper_id long, pos int, shape string"))
    mentioned = mentions.select("shape").distinct()
    spelt = materialise(people.groupBy(F.col("shape").alias("variant"), "person").agg(F.count("*").alias("rows")))
    variants = spelt.select(F.col("variant").alias("shape")).distinct()
    whole = materialise(_fits(mentioned, variants, _whole_keys))
    others = mentioned.join(shuffled(whole.select("shape")), "shape", "left_anti")
    found = whole.unionByName(_fits(others, variants, _suffix_keys)).join(shuffled(spelt), "variant")
    fits = materialise(found.groupBy("shape", "person").agg(F.max("fit").alias("fit"), F.sum("rows").alias("rows")))
    best = fits.groupBy("shape").agg(F.max_by("person", F.struct("fit", "rows", -F.col("person"))).alias("person"), F.max("fit").alias("top"), F.count("*").alias("persons"))
    best = materialise(best.select(F.xxhash64("shape").alias("h"), "shape", "person", "top", "persons"))
    borne = materialise(mentions.select("paper_id", "pos", F.xxhash64("shape").alias("h")).join(shuffled(best.select("h", "person", "persons")), "h"))
    # where a form fits several persons, organisations in the payload decide
    several = fits.join(shuffled(best.filter("persons > 1").select("shape", "top", "h")), "shape").filter("fit >= top - 1").select("h", F.col("person").alias("own"), "fit", "rows")
    homes = authors.select("author_id", F.explode("affiliations").alias("name")).join(shuffled(orgs), "name").join(shuffled(people.select("author_id", "person")), "author_id").select(F.col("person").alias("own"), F.xxhash64("org").alias("org")).distinct()
    told = several.join(shuffled(homes), "own").groupBy("h", "org").agg(F.max_by("own", F.struct("fit", "rows", -F.col("own"))).alias("own"), F.max("fit").alias("fit"))
    where = said.join(shuffled(orgs), "name").select("paper_id", "pos", F.xxhash64("org").alias("org"))
    open_ = borne.filter("persons > 1").select("paper_id", "pos", "h", "person")
    helped = open_.join(shuffled(where), ["paper_id", "pos"], "left").join(shuffled(told), ["h", "org"], "left")
    helped = helped.groupBy("paper_id", "pos", "h", "person").agg(F.max_by("own", F.struct("fit", -F.col("own"))).alias("own"))
    chosen = helped.select("paper_id", F.coalesce("own", "person").alias("person"))
    return borne.filter("persons = 1").select("paper_id", "person").unionByName(chosen).distinct()


def entities(authors: DataFrame, institutions: DataFrame, papers: DataFrame) -> DataFrame:
    """(kind, id, entity, members): each institution and author row with the smallest id of its entity and the entity's number of rows."""
    orgs, people, _ = resolved(papers, authors, institutions)
    rows = institutions.select("institution_id", "name").join(shuffled(orgs), "name").select(F.lit("institution").alias("kind"), F.col("institution_id").alias("id"), F.col("org").alias("key"))
    rows = materialise(rows.unionByName(people.select(F.lit("author").alias("kind"), F.col("author_id").alias("id"), F.col("person").cast("string").alias("key")).distinct()))
    told = rows.groupBy("kind", "key").agg(F.min("id").alias("entity"), F.count("*").alias("members"))
    joined = skew_safe_left_join(rows.withColumn("key", F.concat_ws("|", "kind", "key")), shuffled(told.select(F.concat_ws("|", "kind", "key").alias("key"), "entity", "members", F.col("members").alias("size"))), "key", F.xxhash64("kind", "id"), "size")
    return joined.select("kind", "id", "entity", "members")


def resolved(papers: DataFrame, authors: DataFrame, institutions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orgs, people, said): the organisation of each name, the person of each author row, and the organisations that payloads name."""
    said = linked_rows(papers, "paper_id", "raw_data", PAPER_ORGANISATIONS)
    said = materialise(said.select(F.col("record_id").alias("paper_id"), F.col("outer_pos").alias("pos"), "name"))
    names = institutions.select("name").unionByName(authors.select(F.explode("affiliations").alias("name"))).unionByName(said.select("name"))
    orgs = materialise(resolve_organisations(names, institutions.select("name", F.col("url").alias("address"))))
    return orgs, materialise(persons(authors, orgs)), said


def found(papers: DataFrame, authors: DataFrame, institutions: DataFrame) -> DataFrame:
    """(kind, first_id, second_id) for organisations, persons and persons named in papers."""
    orgs, people, said = resolved(papers, authors, institutions)
    labelled = lambda kind, d: d.select(F.lit(kind).alias("kind"), "first_id", "second_id")
    named = paper_people(papers, authors, people, orgs, said).select(F.col("paper_id").alias("first_id"), F.col("person").alias("second_id"))
    return labelled("institution", institution_pairs(institutions, orgs)).unionByName(labelled("author", author_pairs(people.select("author_id", "person")))).unionByName(labelled("paper_author", named))
