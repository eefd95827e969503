"""The SQL that DuckDB runs over the same tables, for the queries SQL expresses over whole tables."""

from __future__ import annotations

_WS = r"[\t-\r\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


_TITLE = rf"regexp_replace({_strip('lower(title)')}, '{_WS}+', ' ', 'g')"
_DOI = f"nullif(regexp_replace(lower({_strip('doi')}), '^(https?://(doi\\.test|dx\\.doi\\.test)/|doi:)', ''), '')"
_KEYED = f"keyed AS (SELECT *, paper_id AS ord, CASE WHEN {_DOI} IS NULL THEN 'title' ELSE 'doi' END AS key_kind, coalesce({_DOI}, {_TITLE}) AS key FROM papers)"
_EDGES = "e AS (SELECT DISTINCT citing_id, cited_id FROM citation_edges WHERE citing_id IN (SELECT paper_id FROM papers) AND cited_id IN (SELECT paper_id FROM papers))"
_DEGREES = (
    "d AS (SELECT p.paper_id, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM papers p"
    " LEFT JOIN (SELECT cited_id, count(*) n FROM e GROUP BY 1) i ON i.cited_id = p.paper_id LEFT JOIN (SELECT citing_id, count(*) n FROM e GROUP BY 1) o ON o.citing_id = p.paper_id)"
)
_LINES = rf"l AS (SELECT doc_id, i - 1 AS ord, {_strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"
_UNMARKED = r"regexp_replace(line, '^#{1,6}\s+', '')"
_BLOCKS = (
    _LINES + rf", b AS (SELECT doc_id, ord, CASE WHEN lv > 0 THEN 'title' ELSE 'text' END AS type, CASE WHEN lv > 0 THEN {_strip(_UNMARKED)} ELSE line END AS content, lv AS level"
    r" FROM (SELECT *, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) AS lv FROM l WHERE line <> ''))"
)
_KINDS = {
    "abstract": ("abstract", "summary"), "introduction": ("introduction", r"\d+\.?\s*introduction"),
    "methods": ("methods?", "methodology", r"materials?\s*(and|&)\s*methods?", r"experimental\s*(section|methods?)?", r"\d+\.?\s*methods?"),
    "results": ("results?", "findings", r"results?\s*(and|&)\s*discussion", r"\d+\.?\s*results?"), "discussion": ("discussion", r"\d+\.?\s*discussion"),
    "conclusion": ("conclusions?", r"concluding\s*remarks?", r"\d+\.?\s*conclusions?"), "references": ("references?", "bibliography", r"literature\s*cited", r"\d+\.?\s*references?"),
    "acknowledgments": ("acknowledgm?ents?", "acknowledgements?"),
}
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(trim({{0}}), '(?i)^({'|'.join(p)})$') THEN '{k}'" for k, p in _KINDS.items()) + " END"
_BARE = r"regexp_replace(content, '(?i)^abstract[\s:.—–-]*', '')"
_SECTIONS = (
    _BLOCKS + ", s AS (SELECT *, sum(CASE WHEN type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM b)"
    ", t AS (SELECT doc_id, section, max(CASE WHEN type = 'title' THEN content END) AS title, coalesce(string_agg(CASE WHEN type = 'text' THEN content END, chr(10) || chr(10) ORDER BY ord), '') AS text FROM s GROUP BY 1, 2)"
)


def _kind(column: str) -> str:
    return _KIND.replace("{0}", column)


def _latex(c: str) -> str:
    for old, new in (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")):
        c = f"replace({c}, '{old}', '{new}')"
    return c


def _xml(c: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        c = f"replace({c}, '{old}', '{new}')"
    return c


_NL = "chr(10)"


def _best(field: str, sources: tuple[str, ...], kind: str = "text") -> str:
    has = {"text": f"nullif({{}}, '')", "int": "nullif({}, 0)"}[kind]
    firsts = [has.format(f"first({field} ORDER BY ord) FILTER (WHERE list_contains(ss, '{s}'))") for s in sources]
    anyone = f"first({field} ORDER BY ord) FILTER (WHERE {has.format(field)} IS NOT NULL)"
    return f"coalesce({', '.join([*firsts, anyone])}) AS {field}"


def _authors() -> str:
    own = [f"first(authors ORDER BY ord) FILTER (WHERE list_contains(ss, '{s}'))" for s in ("crossref", "openalex", "semantic_scholar", "pubmed")]
    own.append("first(authors ORDER BY len(authors) DESC, ord) FILTER (WHERE source NOT IN ('crossref', 'openalex', 'semantic_scholar', 'pubmed') AND authors IS NOT NULL)")
    return ", ".join(f"{x} AS a{i}" for i, x in enumerate(own)) + ", first(authors ORDER BY ord) AS a9"


_LONGEST = "greatest(" + ", ".join(f"coalesce(len(a{i}), 0)" for i in range(5)) + ")"
_PICK = "coalesce(" + ", ".join(f"CASE WHEN {_LONGEST} > 0 AND len(a{i}) = {_LONGEST} THEN a{i} END" for i in range(5)) + ", a9)"
_KEYWORDS = (
    "kw AS (SELECT key_kind, key, ord, trim(w) AS w, i FROM (SELECT key_kind, key, ord, unnest(keywords) AS w, generate_subscripts(keywords, 1) AS i FROM keyed) WHERE w IS NOT NULL)"
    ", k1 AS (SELECT key_kind, key, lower(w) AS low, first(w ORDER BY ord, i) AS w, min(ord * 100000 + i) AS o FROM kw GROUP BY 1, 2, 3)"
    ", k2 AS (SELECT *, row_number() OVER (PARTITION BY key_kind, key ORDER BY o) AS rn FROM k1)"
    ", k3 AS (SELECT key_kind, key, string_agg(w, '|' ORDER BY rn) AS keywords FROM k2 WHERE rn <= 20 GROUP BY 1, 2)"
)


def _pagerank(rounds: int, dangling: bool) -> str:
    ctes = [_EDGES, _DEGREES, "n AS (SELECT count(*)::DOUBLE AS n FROM papers)", "r0 AS (SELECT paper_id, 1.0 / (SELECT n FROM n) AS score FROM papers)"]
    for i in range(1, rounds + 1):
        lost = f"coalesce((SELECT sum(score) FROM r{i - 1} JOIN d USING (paper_id) WHERE out_degree = 0), 0)" if dangling else "0.0"
        ctes.append(f"g{i} AS (SELECT cited_id AS paper_id, sum(score / out_degree) AS got FROM e JOIN r{i - 1} r ON r.paper_id = e.citing_id JOIN d ON d.paper_id = e.citing_id GROUP BY 1)")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT paper_id, 0.15 / (SELECT n FROM n) + 0.85 * (coalesce(got, 0) + {lost} / (SELECT n FROM n)) AS score FROM papers LEFT JOIN g{i} USING (paper_id))")
    return "WITH " + ", ".join(ctes) + f" SELECT paper_id, round(ln(score), 9) AS log_score FROM r{rounds}"


def _file_id(u: str) -> str:
    """The identifier in an address that names its file."""
    number = rf"coalesce(nullif(regexp_extract({u}, '(\d{{4}}\.\d{{4,5}})(v\d+)?', 1), ''), nullif(regexp_extract({u}, '([a-z-]+/\d{{7}})(v\d+)?', 1), ''))"
    return rf"coalesce('arxiv_' || replace({number}, '/', '_'), 'preprint_' || translate(nullif(regexp_extract({u}, '10\.1101/[\d.]+'), ''), '/.', '__'), lower(nullif(regexp_extract({u}, '(?i)PMC\d+'), '')))"


def _listed(x: str) -> str:
    """The elements of a JSON list, or the single value in its place."""
    return f"CASE WHEN {x} IS NULL THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def _organisations() -> str:
    specs = (
        ("paper", "$.authorships", "$.institutions", "$.display_name", ""), ("paper", "$.author", "$.affiliation", "$.name", ""), ("paper", "$.authors", "$.affiliations", "$", ""),
        ("paper", "$.MedlineCitation.Article.AuthorList", "$.AffiliationInfo", "$.Affiliation", ""), ("paper", "$.bibjson.author", "$.affiliation", "$", ""),
        ("author", "$", "$.affiliations", "$.institution.display_name", ""), ("author", "$", "$.affiliations", "$", ""), ("author", "$", '$."affiliation-current"', '$."affiliation-name"', ""), ("author", "$", "$.notes.note", "$.text", " AND o ->> '$.\"@type\"' = 'affiliation'"),
    )
    parts = []
    for owner, outer, inner, name, more in specs:
        a = f"SELECT id, unnest({_listed('x')}) AS a, generate_subscripts({_listed('x')}, 1) - 1 AS i FROM (SELECT id, json_extract(p, '{outer}') AS x FROM v WHERE owner = '{owner}')"
        o = f"SELECT id, i, unnest({_listed('y')}) AS o, generate_subscripts({_listed('y')}, 1) - 1 AS j FROM (SELECT id, i, json_extract(a, '{inner}') AS y FROM ({a}) WHERE json_type(a) = 'OBJECT')"
        parts.append(f"SELECT '{owner}' AS owner, id AS owner_id, i::INTEGER AS author_pos, j::INTEGER AS org_pos, json_extract_string(o, '{name}') AS org_name FROM ({o}) WHERE json_type(json_extract(o, '{name}')) = 'VARCHAR' AND json_extract_string(o, '{name}') <> ''{more}")
    return f"WITH {_PAYLOADS} " + " UNION ALL ".join(parts)


# Payloads of both kinds, unwrapped, those that can be read.
_PAYLOADS = (
    "u AS (SELECT owner, id, CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'VARCHAR' THEN json_extract_string(raw, '$') ELSE raw END END AS p FROM (SELECT 'paper' AS owner, paper_id AS id, raw_data AS raw FROM papers UNION ALL SELECT 'author', author_id, raw_data FROM authors))"
    ", v AS (SELECT owner, id, p::JSON AS p FROM u WHERE json_valid(p))"
)


def _paper_authors() -> str:
    specs = (("$.authorships", "$.author.display_name"), ("$.author", "$.family"), ("$.authors", "$.name"), ("$.MedlineCitation.Article.AuthorList", "$.LastName"), ("$.bibjson.author", "$.name"), ("$.info.authors.author", "$.text"))
    parts = []
    for path, name in specs:
        a = f"SELECT id, unnest({_listed('x')}) AS a, generate_subscripts({_listed('x')}, 1) - 1 AS i FROM (SELECT id, json_extract(p, '{path}') AS x FROM v WHERE owner = 'paper')"
        parts.append(f"SELECT id AS paper_id, i::INTEGER AS author_pos, json_extract_string(a, '{name}') AS name FROM ({a}) WHERE json_type(a) = 'OBJECT' AND json_type(json_extract(a, '{name}')) = 'VARCHAR' AND json_extract_string(a, '{name}') <> ''")
    return f"WITH {_PAYLOADS} " + " UNION ALL ".join(parts)


def _converged(rounds: int = 40, tolerance: float = 1e-6) -> str:
    """The scores of the first round that moves them by less than the tolerance."""
    ctes = [_EDGES, _DEGREES, "n AS (SELECT count(*)::DOUBLE AS n FROM papers)", "r0 AS (SELECT paper_id, 1.0 / (SELECT n FROM n) AS score FROM papers)"]
    for i in range(1, rounds + 1):
        ctes.append(f"g{i} AS (SELECT cited_id AS paper_id, sum(score / out_degree) AS got FROM e JOIN r{i - 1} r ON r.paper_id = e.citing_id JOIN d ON d.paper_id = e.citing_id GROUP BY 1)")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT paper_id, 0.15 / (SELECT n FROM n) + 0.85 * coalesce(got, 0) AS score FROM papers LEFT JOIN g{i} USING (paper_id))")
    moved = " UNION ALL ".join(f"SELECT {i} AS k, sum(abs(x.score - y.score)) AS d FROM r{i} x JOIN r{i - 1} y USING (paper_id)" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS k, paper_id, score FROM r{i}" for i in range(1, rounds + 1))
    return "WITH " + ", ".join(ctes) + f", moved AS ({moved}) SELECT paper_id, round(ln(score), 9) AS log_score FROM ({every}) WHERE k = (SELECT min(k) FROM moved WHERE d < {tolerance})"


def _expanded(depth: int = 2, cap: int = 10) -> str:
    """Papers met from the most cited one: per paper of the front so many on either side, then the first of all as the next front."""
    ctes = ["s AS (SELECT DISTINCT citing_id, cited_id FROM citation_edges)", "f0 AS (SELECT 1 AS o, cited_id AS paper_id FROM (SELECT DISTINCT citing_id, cited_id, source, seen_at FROM citation_edges) GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 1)"]
    for d in range(1, depth + 1):
        sides = f"SELECT o, 0 AS side, citing_id AS other FROM s JOIN f{d - 1} f ON f.paper_id = s.cited_id UNION ALL SELECT o, 1, cited_id FROM s JOIN f{d - 1} f ON f.paper_id = s.citing_id"
        ctes.append(f"a{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o, side ORDER BY other) AS nth FROM ({sides})) WHERE nth <= {cap})")
        ctes.append(f"f{d} AS (SELECT row_number() OVER (ORDER BY o, side, nth) AS o, other AS paper_id FROM (SELECT * FROM a{d} ORDER BY o, side, nth LIMIT {2 * cap}))")
    met = " UNION ALL ".join(["SELECT paper_id, 0 AS depth FROM f0", *(f"SELECT other, {d} FROM a{d}" for d in range(1, depth + 1))])
    return "WITH " + ", ".join(ctes) + f" SELECT paper_id, min(depth)::INTEGER AS depth FROM ({met}) GROUP BY 1"


_INVERTED = (
    "i AS (SELECT id, CAST(json_extract(p, '$.abstract_inverted_index') AS MAP(VARCHAR, INTEGER[])) AS m FROM v WHERE owner = 'paper' AND json_type(p, '$.abstract_inverted_index') = 'OBJECT')"
    ", ws AS (SELECT id, e.key AS w, unnest(e.value) AS pos FROM (SELECT id, unnest(map_entries(m)) AS e FROM i))"
    ", places AS (SELECT id, unnest(range(0, mx + 1)) AS pos FROM (SELECT id, max(pos) AS mx FROM ws GROUP BY 1))"
    ", inverted AS (SELECT id, string_agg(coalesce(w, ''), ' ' ORDER BY pos) AS text FROM places LEFT JOIN ws USING (id, pos) GROUP BY 1)"
)
_FULL = (
    ", own AS (SELECT doc_id, section, max(title) AS title, max(level) AS level, max(text) AS text FROM (SELECT t.*, s.level FROM t JOIN s USING (doc_id, section) WHERE s.type = 'title') WHERE section > 0 GROUP BY 1, 2)"
    ", ends AS (SELECT *, coalesce((SELECT min(q.section) FROM own q WHERE q.doc_id = o.doc_id AND q.section > o.section AND q.level <= o.level), 1152921504606846976) AS stop FROM own o)"
    ", full_text AS (SELECT e.doc_id, e.section, any_value(e.title) AS title, coalesce(string_agg(p.text, chr(10) || chr(10) ORDER BY p.section) FILTER (WHERE p.text <> ''), '') AS text FROM ends e JOIN own p ON p.doc_id = e.doc_id AND p.section >= e.section AND p.section < e.stop GROUP BY 1, 2)"
)


def _payload_holds(paths: tuple[str, ...], test: str) -> str:
    """Whether one of the values at the paths, lists flattened, passes ``test`` of x."""
    values = lambda path: f"list_filter(json_extract_string(p, '$.{path}'), lambda x: {test})"
    return "(" + " OR ".join(f"coalesce(len({values(path)}), 0) > 0" for path in paths) + ")"


def _author_payloads() -> str:
    text = lambda path: f"nullif(json_extract_string(p, '$.{path}'), '')"
    number = lambda path, kind="BIGINT": f"TRY_CAST(json_extract_string(p, '$.{path}') AS {kind})"
    bare = lambda x: f"regexp_replace({x}, '^https?://[^/]+/', '')"
    last = lambda x: f"regexp_replace({x}, '^.*/', '')"

    def names(path: str, inner: str, more: str = "true") -> str:
        items = _listed(f"json_extract(p, '$.{path}')")
        return f"list_filter(list_transform(list_filter({items}, lambda o: {more}), lambda o: json_extract_string(o, '{inner}')), lambda x: x IS NOT NULL AND x <> '')"

    preferred, core = '"preferred-name"', "coredata"
    given = f"nullif(concat_ws(' ', json_extract_string(p, '$.{preferred}.\"given-name\"'), json_extract_string(p, '$.{preferred}.surname')), '')"
    known = names("last_known_institutions", "$.display_name")
    plain = {"name": text("name"), "affiliations": names("affiliations", "$")}
    sources = {
        "openalex": {"name": text("display_name"), "source_id": last(text("id")), "affiliations": f"CASE WHEN len({known}) > 0 THEN {known} ELSE {names('affiliations', '$.institution.display_name')} END", "orcid": f"coalesce({bare(text('orcid'))}, {bare(text('ids.orcid'))})", "url": text("id"), "paper_count": number("works_count"), "citation_count": number("cited_by_count"), "h_index": number("summary_stats.h_index", "INTEGER")},
        "semantic_scholar": {**plain, "source_id": text("authorId"), "orcid": bare(text("externalIds.ORCID")), "url": text("url"), "paper_count": number("paperCount"), "citation_count": number("citationCount"), "h_index": number("hIndex", "INTEGER")},
        "elsevier": {"name": f"coalesce({given}, json_extract_string(p, '$.{preferred}.\"ced:indexed-name\"'))", "source_id": f"regexp_replace(json_extract_string(p, '$.{core}.\"dc:identifier\"'), '^AUTHOR_ID:', '')", "affiliations": "list_slice(" + names('"affiliation-current"', '$."affiliation-name"') + ", 1, 3)", "orcid": f"json_extract_string(p, '$.{core}.orcid')", "paper_count": number(f'{core}."document-count"'), "citation_count": number(f'{core}."citation-count"')},
        "dblp": {"name": text("author"), "source_id": f"regexp_replace({text('url')}, '^.*/pid/', '')", "affiliations": names("notes.note", "$.text", "json_extract_string(o, '$.\"@type\"') = 'affiliation'"), "url": text("url")},
        "google_scholar": {"name": text("name"), "source_id": text("author_id"), "affiliations": f"list_filter([{text('affiliations')}], lambda x: x IS NOT NULL)", "url": text("link"), "citation_count": number("cited_by")},
        "pubmed": plain, "wos": plain,
    }
    kinds = {"name": "VARCHAR", "source_id": "VARCHAR", "orcid": "VARCHAR", "url": "VARCHAR", "paper_count": "BIGINT", "citation_count": "BIGINT", "h_index": "INTEGER"}
    parts = [
        f"SELECT id AS author_id, source, array_to_string({f['affiliations']}, '|') AS affiliations, " + ", ".join(f"({f.get(c, 'NULL')})::{k} AS {c}" for c, k in kinds.items()) + f" FROM r WHERE source = '{source}'"
        for source, f in sources.items()
    ]
    return f"WITH {_PAYLOADS}, r AS (SELECT id, trim(split_part(source, ',', 1)) AS source, p FROM v JOIN authors ON author_id = id WHERE owner = 'author') SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE name IS NOT NULL"


def _paper_payloads() -> str:
    key = lambda path: ".".join(f'"{x}"' if "-" in x else x for x in path.split("."))
    raw = lambda path: f"json_extract_string(p, '$.{key(path)}')"
    text = lambda path: f"nullif({raw(path)}, '')"
    number = lambda path, kind="BIGINT": f"TRY_CAST({raw(path)} AS {kind})"
    bag = lambda path: _listed(f"json_extract(p, '$.{key(path)}')")
    told = lambda items: f"list_filter({items}, lambda x: x IS NOT NULL AND x <> '')"
    names = lambda path, inner: told(f"list_transform({bag(path)}, lambda o: {inner})")
    at = lambda field: f"json_extract_string(o, '$.{key(field)}')"
    first = lambda path: f"nullif(json_extract_string({bag(path)}[1], '$'), '')"
    whole = lambda path: f"list_transform({bag(path)}, lambda o: json_extract_string(o, '$'))"
    pdf = lambda x: f"ends_with(lower({x}), '.pdf')"
    year = lambda x: f"TRY_CAST(nullif(regexp_extract({x}, '(19|20)[0-9]{{2}}'), '') AS INTEGER)"
    size = lambda path: f"CASE WHEN json_type(p, '$.{path}') = 'ARRAY' THEN json_array_length(p, '$.{path}') END"
    oa, a = text("open_access.oa_url"), "MedlineCitation.Article"
    dates = ", ".join(f"TRY_CAST(json_extract_string(p, '$.{key(d)}.\"date-parts\"[0][0]') AS INTEGER)" for d in ("published-print", "published-online", "published", "issued", "created"))
    links = f"list_filter([{text('downloadUrl')}, {first('sourceFulltextUrls')}], lambda x: x IS NOT NULL)"
    electronic = whole("info.ee")
    plain = {"title": "nullif(regexp_replace(" + text("title") + ", '\\s*\\n\\s*', ' ', 'g'), '')", "authors": f"CASE WHEN json_type(p, '$.authors') = 'ARRAY' THEN {names('authors', at('name'))} ELSE list_filter(regexp_split_to_array({text('authors')}, '\\s*;\\s*'), lambda x: x <> '') END", "abstract": text("abstract"), "doi": text("doi"), "year": year(text("date")), "journal": text("journal")}
    sources = {
        "openalex": {"title": text("title"), "authors": names("authorships", at("author.display_name")), "abstract": "inverted.text", "doi": f"regexp_replace({text('doi')}, '^https?://[^/]+/', '')", "year": number("publication_year"), "journal": text("primary_location.source.display_name"), "url": f"coalesce({text('primary_location.landing_page_url')}, {text('id')})", "pdf_url": f"coalesce(CASE WHEN {pdf(oa)} THEN {oa} END, {text('primary_location.pdf_url')})", "citations_count": number("cited_by_count"), "references_count": size("referenced_works"), "open_access": number("open_access.is_oa", "BOOLEAN"), "keywords": f"list_slice({names('concepts', at('display_name'))}, 1, 5)"},
        "crossref": {"title": first("title"), "authors": names("author", f"CASE WHEN {at('family')} <> '' THEN concat_ws(' ', nullif({at('given')}, ''), {at('family')}) END"), "abstract": text("abstract"), "doi": text("DOI"), "year": f"coalesce({dates})", "journal": first("container-title"), "url": text("URL"), "pdf_url": f"json_extract_string(list_filter({bag('link')}, lambda o: {at('content-type')} = 'application/pdf')[1], '$.URL')", "citations_count": number("is-referenced-by-count"), "references_count": f"coalesce({number('references-count')}, {size('reference')})", "open_access": f"nullif(len(list_filter({bag('license')}, lambda o: regexp_matches(lower({at('URL')}), 'creativecommons|open'))) > 0, false)", "keywords": f"list_slice({whole('subject')}, 1, 10)"},
        "semantic_scholar": {"title": text("title"), "authors": names("authors", at("name")), "abstract": text("abstract"), "doi": text("externalIds.DOI"), "year": number("year"), "journal": text("venue"), "url": text("url"), "pdf_url": text("openAccessPdf.url"), "citations_count": number("citationCount"), "references_count": number("referenceCount"), "open_access": number("isOpenAccess", "BOOLEAN"), "keywords": whole("fieldsOfStudy")},
        "pubmed": {"title": text(a + ".ArticleTitle"), "authors": names(a + ".AuthorList", f"coalesce(nullif({at('CollectiveName')}, ''), CASE WHEN {at('LastName')} <> '' THEN concat_ws(' ', coalesce(nullif({at('ForeName')}, ''), nullif({at('Initials')}, '')), {at('LastName')}) END)"), "abstract": text(a + ".Abstract.AbstractText"), "doi": text(a + ".ELocationID"), "year": year(f"coalesce({text(a + '.Journal.JournalIssue.PubDate.Year')}, {text(a + '.Journal.JournalIssue.PubDate.MedlineDate')})"), "journal": f"coalesce({text(a + '.Journal.Title')}, {text(a + '.Journal.ISOAbbreviation')})"},
        "doaj": {"title": text("bibjson.title"), "authors": names("bibjson.author", at("name")), "abstract": text("bibjson.abstract"), "doi": f"json_extract_string(list_filter({bag('bibjson.identifier')}, lambda o: lower({at('type')}) = 'doi')[1], '$.id')", "year": number("bibjson.year"), "journal": text("bibjson.journal.title"), "url": f"json_extract_string(list_filter({bag('bibjson.link')}, lambda o: {at('type')} = 'fulltext')[-1], '$.url')", "open_access": "true", "keywords": f"list_slice({whole('bibjson.keywords')}, 1, 10)"},
        "core": {"title": text("title"), "authors": names("authors", at("name")), "abstract": text("abstract"), "doi": text("doi"), "year": number("yearPublished"), "journal": text("publisher"), "url": f"list_filter({links}, lambda x: NOT {pdf('x')})[1]", "pdf_url": f"list_filter({links}, lambda x: {pdf('x')})[1]", "citations_count": number("citationCount"), "open_access": "true", "keywords": f"list_slice({whole('topics')}, 1, 10)"},
        "dblp": {"title": f"nullif(regexp_replace({text('info.title')}, '\\.$', ''), '')", "authors": names("info.authors.author", at("text")), "doi": text("info.doi"), "year": number("info.year"), "journal": text("info.venue"), "url": f"coalesce({text('info.url')}, list_filter({electronic}, lambda x: NOT {pdf('x')})[1])", "pdf_url": f"list_filter({electronic}, lambda x: {pdf('x')})[1]", "keywords": f"list_filter([{text('info.type')}], lambda x: x IS NOT NULL)"},
        "arxiv": plain, "elsevier": plain, "wos": plain, "google_scholar": plain, "biorxiv": {**plain, "journal": "'bioRxiv'"}, "medrxiv": {**plain, "journal": "'medRxiv'"},
    }
    kinds = {"title": "VARCHAR", "abstract": "VARCHAR", "doi": "VARCHAR", "year": "INTEGER", "journal": "VARCHAR", "url": "VARCHAR", "pdf_url": "VARCHAR", "citations_count": "BIGINT", "references_count": "BIGINT", "open_access": "BOOLEAN"}
    parts = [
        f"SELECT r.id AS paper_id, source, coalesce(array_to_string({f['authors']}, '|'), '') AS authors, coalesce(array_to_string({f.get('keywords', '[]')}, '|'), '') AS keywords, " + ", ".join(f"({f.get(c, 'NULL')})::{k} AS {c}" for c, k in kinds.items()) + f" FROM r LEFT JOIN inverted ON inverted.id = r.id WHERE source = '{source}'"
        for source, f in sources.items()
    ]
    return f"WITH {_PAYLOADS}, {_INVERTED}, r AS (SELECT id, trim(split_part(source, ',', 1)) AS source, p FROM v JOIN papers ON paper_id = id WHERE owner = 'paper') SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE title IS NOT NULL"


# Numbers of shortest paths: those of each length by extending the ones one shorter, as far as any pair needs.
_BETWEENNESS = (
    f"WITH RECURSIVE {_EDGES}, g AS (SELECT citing_id AS v, cited_id AS w FROM e WHERE citing_id <> cited_id), n AS (SELECT count(*)::DOUBLE AS n FROM papers)"
    ", walks AS (SELECT v AS s, w AS t, 1 AS d, 1.0::DOUBLE AS k FROM g UNION ALL SELECT s, w AS t, d + 1, sum(k) FROM walks JOIN g ON g.v = t WHERE d < 40 GROUP BY s, w, d)"
    ", paths AS (SELECT s, t, min(d) AS d, arg_min(k, d) AS k FROM walks WHERE s <> t GROUP BY 1, 2)"
    ", passed AS (SELECT a.t AS paper_id, sum(a.k * b.k / p.k) AS share FROM paths a JOIN paths b ON b.s = a.t JOIN paths p ON p.s = a.s AND p.t = b.t AND p.d = a.d + b.d GROUP BY 1)"
    " SELECT paper_id, round(coalesce(share, 0) / (((SELECT n FROM n) - 1) * ((SELECT n FROM n) - 2)), 9) AS score FROM papers LEFT JOIN passed USING (paper_id)"
)


def statements() -> dict[str, str]:
    sources = ("openalex", "crossref", "semantic_scholar", "pubmed", "core", "arxiv", "dblp", "doaj", "elsevier", "google_scholar", "wos", "biorxiv", "medrxiv")
    ext = "CASE WHEN contains(split_part(lower(u), '?', 1), '.') THEN split_part(split_part(lower(u), '?', 1), '.', -1) ELSE '' END"
    pdf = f"({ext} = 'pdf' OR contains(lower(u), '/pdf/'))"
    page = f"({ext} IN ('html', 'htm') OR (regexp_matches(lower(u), '^https?://') AND {ext} NOT IN ('pdf', 'doc', 'docx', 'ppt', 'pptx', 'xls', 'xlsx')))"
    order = {"sort_citations": "coalesce(citations_count, 0) DESC, paper_id", "sort_date": "coalesce(year, 0) DESC, paper_id", "sort_date_asc": "coalesce(year, 0), paper_id"}
    fused = (
        f"WITH {_KEYED}, {_KEYWORDS}, m AS (SELECT key_kind, key, min(ord) AS first_ord, count(*) AS n, coalesce(first(title ORDER BY ord) FILTER (WHERE title <> ''), first(title ORDER BY ord)) AS title, "
        + ", ".join((
            _best("doi", ("crossref", "openalex", "semantic_scholar", "pubmed", "wos")), _best("abstract", ("semantic_scholar", "openalex", "pubmed", "crossref", "core")),
            _best("journal", ("crossref", "openalex", "pubmed", "semantic_scholar")), _best("year", ("crossref", "openalex", "pubmed", "semantic_scholar"), "int"),
            _best("pdf_url", ("core", "openalex", "semantic_scholar", "doaj", "arxiv", "biorxiv")), _best("url", ()), _authors(),
        ))
        + ", max(citations_count) AS citations_count, max(references_count) AS references_count, coalesce(bool_or(open_access), false) AS open_access, array_to_string(list_sort(list(DISTINCT source)), ',') AS source"
        " FROM (SELECT *, list_transform(string_split(source, ','), lambda s: trim(s)) AS ss FROM keyed) GROUP BY 1, 2)"
        f", fused AS (SELECT key_kind, key, first_ord, n, title, doi, abstract, journal, year, pdf_url, url, array_to_string({_PICK}, '|') AS authors, citations_count, references_count, open_access, source, coalesce(keywords, '') AS keywords FROM m LEFT JOIN k3 USING (key_kind, key))"
        # a record alone is no merger: it stays as it was read
        " SELECT key_kind, key, first_ord, n, title, doi, abstract, journal, year, pdf_url, url, authors, citations_count, references_count, open_access, source, keywords FROM fused WHERE n > 1"
        " UNION ALL SELECT key_kind, key, ord, 1, title, doi, abstract, journal, year, pdf_url, url, array_to_string(authors, '|'), citations_count, references_count, open_access, source, array_to_string(keywords, '|')"
        " FROM (SELECT *, count(*) OVER (PARTITION BY key_kind, key) AS copies FROM keyed) WHERE copies = 1"
    )
    out = {
        "p3_found": _organisations(),
        "p3_authors": _paper_authors(),
        "concept_scores": f"WITH {_PAYLOADS} SELECT id AS paper_id, json_extract_string(c, '$.display_name') AS concept, json_extract_string(c, '$.score')::DOUBLE AS score FROM (SELECT id, unnest({_listed('x')}) AS c FROM (SELECT id, json_extract(p, '$.concepts') AS x FROM v WHERE owner = 'paper')) WHERE json_extract_string(c, '$.score')::DOUBLE >= 0.3",
        "norm_title_keys": f"SELECT paper_id, {_TITLE} AS title_norm FROM papers",
        "norm_doi_keys": f"SELECT paper_id, {_DOI} AS doi_norm FROM papers",
        "year_from_text": r"SELECT paper_id, try_cast(nullif(regexp_extract(doi, '\b((19|20)\d{2})\b', 1), '') AS INTEGER) AS year_found FROM papers",
        "url_predicates": f"SELECT paper_id, u, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') AS is_url, (ends_with(lower(u), '.pdf') OR contains(lower(u), '/pdf/')) AS is_pdf, {ext} AS ext, CASE WHEN {pdf} THEN 'pdf' WHEN {page} THEN 'html' END AS extractor FROM (SELECT paper_id, unnest([url, pdf_url]) AS u FROM papers) WHERE u IS NOT NULL",
        "truncate_abstract": "SELECT paper_id, CASE WHEN length(abstract) <= 200 THEN abstract ELSE left(abstract, 197) || '...' END AS short FROM papers",
        "record_listing": (
            "SELECT paper_id, concat_ws(chr(10), title, CASE WHEN len(authors) > 5 THEN array_to_string(authors[1:5], ', ') || ' et al. (' || len(authors) || ' authors)' WHEN len(authors) > 0 THEN array_to_string(authors, ', ') END,"
            " nullif(concat_ws(' | ', CASE WHEN year <> 0 THEN year::VARCHAR END, nullif(journal, '')), ''), CASE WHEN citations_count > 0 THEN 'Citations: ' || citations_count END,"
            " CASE WHEN nullif(abstract, '') IS NOT NULL THEN CASE WHEN length(abstract) <= 303 THEN abstract ELSE left(abstract, 300) || '...' END END) AS listing FROM papers"
        ),
        "pdf_url_resolve": (
            "SELECT paper_id, CASE WHEN ends_with(lower(u), '.pdf') THEN u WHEN contains(u, 'arxiv.org/abs/') THEN 'https://arxiv.org/pdf/' || split_part(split_part(u, '/abs/', -1), 'v', 1) || '.pdf' WHEN contains(u, 'arxiv.org/pdf/') THEN u || '.pdf'"
            " WHEN contains(u, 'biorxiv.org/content/') OR contains(u, 'medrxiv.org/content/') THEN rtrim(u, '/') || '.full.pdf' WHEN contains(u, 'ncbi.nlm.nih.gov/pmc/articles/') THEN CASE WHEN ends_with(u, '/pdf/') THEN u ELSE rtrim(u, '/') || '/pdf/' END ELSE u END AS pdf,"
            f" coalesce({_file_id('u')}, {_file_id('o')}, 'paper_' || left(md5(o), 12)) AS file_name,"
            rf" left(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\t-\r\x{{85}}\p{{Z}}-]', '', 'g'), '{_WS}+', '_', 'g'), 100) AS title_file FROM (SELECT *, coalesce(pdf_url, url) AS u, coalesce(url, pdf_url) AS o FROM papers) WHERE u IS NOT NULL"
        ),
        "backoff_schedule": "SELECT i AS attempt, least(1.0 * pow(2.0, i), 60.0)::DOUBLE AS seconds FROM range(10) t(i)",
        "institution_types": "SELECT institution_id, CASE WHEN contains(lower(name), 'university') OR contains(lower(name), 'college') THEN 'education' WHEN contains(lower(name), 'hospital') OR contains(lower(name), 'medical') THEN 'healthcare' WHEN contains(lower(name), 'institute') OR contains(lower(name), 'laboratory') THEN 'research' END AS inferred FROM institutions",
        "text_match_filter": "SELECT paper_id, title FROM papers WHERE contains(lower(title), 'harbour') OR contains(lower(coalesce(abstract, '')), 'harbour') OR len(list_filter(coalesce(authors, []), lambda a: contains(lower(a), 'harbour'))) > 0",
        "filter_conjunction": "SELECT paper_id, year, citations_count FROM papers WHERE year BETWEEN 2000 AND 2015 AND citations_count > 5 AND open_access AND length(abstract) > 0",
        "source_author_filter": "SELECT paper_id, source, year FROM papers WHERE list_contains(regexp_split_to_array(source, '\\s*,\\s*'), 'openalex') AND year BETWEEN 0 AND 2020 AND len(list_filter(coalesce(authors, []), lambda a: contains(lower(a), 'wanda'))) > 0",
        "date_range_scan": "SELECT paper_id, strftime(fetched_at, '%Y-%m-%d') AS day FROM papers WHERE fetched_at >= TIMESTAMP '2024-03-01' AND fetched_at < TIMESTAMP '2024-06-01'",
        "recent_papers": "SELECT paper_id FROM papers WHERE fetched_at::DATE BETWEEN DATE '2024-12-31' - 30 AND DATE '2024-12-31'",
        "category_two_step_limit": "SELECT paper_id, journal FROM (SELECT * FROM (SELECT * FROM papers ORDER BY paper_id LIMIT 250) WHERE contains(lower(journal), 'letters') ORDER BY paper_id LIMIT 50)",
        **{k: f"SELECT paper_id, row_number() OVER (ORDER BY {o}) AS rank FROM papers" for k, o in order.items()},
        "page_offset": "SELECT paper_id, citations_count FROM papers ORDER BY coalesce(citations_count, 0) DESC, paper_id LIMIT 50 OFFSET 120",
        "interleave_round_robin": f"SELECT paper_id, source, row_number() OVER (ORDER BY rn, list_position({list(sources)!r}, own)) AS place FROM (SELECT paper_id, source, own, row_number() OVER (PARTITION BY own ORDER BY paper_id) AS rn FROM (SELECT *, trim(split_part(source, ',', 1)) AS own FROM papers) WHERE own IN {sources!r})",
        "source_counts": "SELECT source, count(*) AS papers FROM (SELECT unnest(regexp_split_to_array(source, '\\s*,\\s*')) AS source FROM papers) GROUP BY 1",
        "distinct_authors": "SELECT name, min(paper_id) AS first_ord FROM (SELECT paper_id, unnest(authors) AS name FROM papers) WHERE contains(lower(name), 'wanda') GROUP BY 1",
        "author_papers": "SELECT paper_id, citations_count FROM papers WHERE list_contains(authors, 'Aiko Zovipibran')",
        "author_search": "SELECT author_id, name FROM authors WHERE contains(lower(name), 'wanda') AND length(orcid) > 0",
        "author_institution_search": "SELECT author_id, name FROM authors WHERE contains(lower(name), 'albert') AND len(list_filter(affiliations, lambda x: contains(lower(x), 'hospital'))) > 0",
        "journal_search": "SELECT journal_id, title, issn FROM journals WHERE contains(lower(title), 'letters') AND is_oa",
        "journal_articles": "SELECT paper_id, journal FROM papers WHERE lower(journal) IN (SELECT lower(title) FROM journals WHERE is_oa) AND (contains(lower(title), 'gels') OR coalesce(contains(lower(abstract), 'gels'), false) OR coalesce(len(list_filter(authors, lambda x: contains(lower(x), 'gels'))), 0) > 0)",
        "concept_works": f"WITH {_PAYLOADS} SELECT paper_id, title FROM papers WHERE paper_id IN (SELECT id FROM (SELECT id, unnest({_listed('x')}) AS c FROM (SELECT id, json_extract(p, '$.concepts') AS x FROM v WHERE owner = 'paper')) WHERE lower(json_extract_string(c, '$.display_name')) = 'medicine' AND json_extract_string(c, '$.score')::DOUBLE >= 0.3)",
        "related_works": "SELECT citing_id AS paper_id, nth - 1 AS nth, cited_id AS other_id FROM (SELECT *, row_number() OVER (PARTITION BY citing_id ORDER BY cited_id) AS nth FROM (SELECT DISTINCT citing_id, cited_id FROM citation_edges)) WHERE nth <= 3 AND cited_id IN (SELECT paper_id FROM papers)",
        "payload_filter": f"WITH {_PAYLOADS} SELECT paper_id, source FROM papers JOIN v ON v.id = paper_id AND owner = 'paper' WHERE {_payload_holds(('concepts[*].display_name',), 'lower(x) = ' + repr('medicine'))} AND {_payload_holds(('authorships[*].institutions[*].display_name', 'author[*].affiliation[*].name', 'bibjson.author[*].affiliation', 'MedlineCitation.Article.AuthorList[*].AffiliationInfo[*].Affiliation'), 'contains(lower(x), ' + repr('hospital') + ')')}",
        "page_number": "SELECT paper_id, title FROM papers ORDER BY paper_id LIMIT 50 OFFSET 100",
        "dedup_first_records": f"WITH {_KEYED} SELECT paper_id, title, source, year FROM (SELECT *, row_number() OVER (PARTITION BY key_kind, key ORDER BY ord) AS rn FROM keyed) WHERE rn = 1",
        "graph_nodes": "SELECT node_id, ord AS first_ord, title, year FROM (SELECT coalesce(nullif(doi, ''), 'title:' || sha256(lower(title))) AS node_id, paper_id AS ord, title, year, row_number() OVER (PARTITION BY coalesce(nullif(doi, ''), 'title:' || sha256(lower(title))) ORDER BY paper_id) AS rn FROM papers) WHERE rn = 1 AND node_id IS NOT NULL",
        "graph_json": f"WITH {_EDGES} SELECT 'node' AS kind, '{{\"paper_id\":' || paper_id || coalesce(',\"year\":' || year, '') || '}}' AS json FROM papers UNION ALL SELECT 'edge', '{{\"citing_id\":' || citing_id || ',\"cited_id\":' || cited_id || '}}' FROM e UNION ALL SELECT 'stats', '{{\"node_count\":' || (SELECT count(*) FROM papers) || ',\"edge_count\":' || (SELECT count(*) FROM e) || '}}'",
        "bfs_depth2": _expanded(),
        "betweenness_all": _BETWEENNESS,
        "parse_authors": _author_payloads(),
        "parse_records": _paper_payloads(),
        # the entities that occur in the table: one by name, and a cut one that stands for no character
        "clean_markup": f"SELECT paper_id, coalesce({_strip('t')}, '') AS plain FROM (SELECT paper_id, regexp_replace(regexp_replace(replace(replace(abstract, '&#x2', ''), '&amp;', '&'), '<[^>]+>', '', 'g'), '{_WS}+', ' ', 'g') AS t FROM papers)",
        "pagerank_converged": _converged(),
        "inverted_index_text": f"WITH {_PAYLOADS}, {_INVERTED} SELECT id AS paper_id, md5(text) AS text_md5 FROM inverted",
        "section_full_text": f"WITH {_SECTIONS}{_FULL} SELECT doc_id, section::BIGINT AS section, title, length(text) AS n_chars, md5(text) AS text_md5 FROM full_text",
        "section_lookup": f"WITH {_SECTIONS} SELECT doc_id, min(section)::BIGINT AS section, first(title ORDER BY section) AS title, md5(first(text ORDER BY section)) AS text_md5 FROM t WHERE contains(lower(title), 'method') GROUP BY 1",
        "institution_search": "SELECT institution_id, name FROM institutions WHERE country = 'MX' AND type = 'healthcare'",
        "journal_works": "SELECT journal_id, count(*) AS works, sum(coalesce(citations_count, 0))::BIGINT AS citations FROM papers p JOIN journals j ON p.journal = j.title GROUP BY 1",
        "batch_lookup_semi": "SELECT paper_id, title FROM papers WHERE paper_id IN (SELECT cited_id FROM citation_edges)",
        "dedup_keep_first": f"WITH {_KEYED} SELECT key_kind, key, min(ord) AS first_ord, count(*) AS n FROM keyed GROUP BY 1, 2",
        "dedup_order": f"WITH {_KEYED} SELECT key, row_number() OVER (ORDER BY key_kind, first_ord) AS place FROM (SELECT key_kind, key, min(ord) AS first_ord FROM keyed GROUP BY 1, 2)",
        "merge_keywords": f"WITH {_KEYED}, {_KEYWORDS} SELECT key_kind, key, keywords FROM k3",
        "merge_provenance": f"WITH {_KEYED} SELECT key_kind, key, ord, source, md5(raw_data) AS raw_md5 FROM keyed",
        "lookup_first_source": f"WITH {_KEYED} SELECT key, first(source ORDER BY p, ord) AS source, first(ord ORDER BY p, ord) AS found_ord FROM (SELECT *, list_position(['semantic_scholar', 'openalex', 'crossref'], source) AS p FROM keyed WHERE key_kind = 'doi') WHERE p > 0 GROUP BY 1",
        "citing_papers": f"WITH {_EDGES} SELECT cited_id AS paper_id, citing_id AS other_id FROM e",
        "cited_papers": f"WITH {_EDGES} SELECT citing_id AS paper_id, cited_id AS other_id FROM e",
        "degree_counts": f"WITH {_EDGES}, {_DEGREES} SELECT * FROM d",
        "degree_centrality": f"WITH {_EDGES}, {_DEGREES}, n AS (SELECT count(*) - 1 AS n FROM papers) SELECT paper_id, round(in_degree / (SELECT n FROM n), 9) AS in_centrality, round(out_degree / (SELECT n FROM n), 9) AS out_centrality FROM d",
        "h_index_contribution": f"WITH {_EDGES}, {_DEGREES}, o AS (SELECT *, row_number() OVER (ORDER BY in_degree DESC, paper_id) AS i FROM d), h AS (SELECT coalesce(max(i) FILTER (WHERE in_degree >= i), 0) AS h FROM o) SELECT paper_id, round(CASE WHEN i <= h THEN 1.0::DOUBLE WHEN in_degree > 0 THEN least(in_degree / (h + 1), 0.9::DOUBLE) ELSE 0.0 END, 9) AS score FROM o, h",
        "pagerank_10": _pagerank(10, False),
        "pagerank_dangling_10": _pagerank(10, True),
        "influential_top_10": f"WITH {_EDGES}, {_DEGREES} SELECT row_number() OVER (ORDER BY in_degree DESC, paper_id) AS place, paper_id, in_degree AS score FROM d ORDER BY in_degree DESC, paper_id LIMIT 10",
        "influence_ranking": f"WITH {_EDGES}, {_DEGREES} SELECT row_number() OVER (ORDER BY in_degree DESC, paper_id) AS place, paper_id, in_degree AS score FROM d",
        "citation_burst": "WITH y AS (SELECT coalesce(max(nullif(year, 0)), 2024) AS now FROM papers) SELECT paper_id, round(CASE WHEN coalesce(year, 0) = 0 OR coalesce(citations_count, 0) = 0 THEN 0.0::DOUBLE WHEN now - year <= 0 THEN citations_count::DOUBLE WHEN now - year <= 3 THEN citations_count / (now - year) * (1 + (3 - (now - year)) / 3) ELSE citations_count / (now - year) * 3 / (now - year) END, 9) AS score FROM papers, y",
        "section_text": f"WITH {_SECTIONS} SELECT doc_id, section::BIGINT AS section, title, length(text) AS n_chars, md5(text) AS text_md5 FROM t",
        "standard_sections": f"WITH {_SECTIONS} SELECT doc_id, kind, md5(first(text ORDER BY section DESC)) AS text_md5 FROM (SELECT *, {_kind('title')} AS kind FROM t) WHERE kind IS NOT NULL GROUP BY 1, 2",
        "chapter_parents": f"WITH {_BLOCKS} SELECT doc_id, ord, content AS title, level, (SELECT max(q.ord) FROM b q WHERE q.doc_id = b.doc_id AND q.type = 'title' AND q.ord < b.ord AND q.level < b.level) AS parent FROM b WHERE type = 'title'",
        "doc_type": f"WITH {_BLOCKS}, pts AS (SELECT doc_id, sum(CASE WHEN type = 'title' AND {_kind('content')} IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS paper_points, (sum(CASE WHEN type = 'title' AND regexp_matches(lower(content), '^chapter\\s+\\d+') THEN 2 ELSE 0 END) + sum(CASE WHEN type = 'title' AND regexp_matches(lower(content), '^\\d+\\.\\d+') THEN 1 ELSE 0 END))::BIGINT AS book_points FROM b GROUP BY 1) SELECT *, CASE WHEN book_points > paper_points THEN 'book' ELSE 'paper' END AS type FROM pts",
        "doc_titles": f"WITH {_BLOCKS} SELECT doc_id, first(content ORDER BY ord) AS title FROM b WHERE type = 'title' GROUP BY 1",
        "abstract_finder": f"WITH {_BLOCKS} SELECT doc_id, md5(coalesce(first({_strip(_BARE)} ORDER BY ord) FILTER (WHERE type = 'text' AND starts_with(lower(content), 'abstract')), CASE WHEN length(first(content ORDER BY ord) FILTER (WHERE type = 'text' AND length(content) > 50)) < 2000 THEN first(content ORDER BY ord) FILTER (WHERE type = 'text' AND length(content) > 50) END)) AS abstract_md5 FROM b GROUP BY 1",
        "stream_first_seen": f"WITH {_KEYED} SELECT DISTINCT key_kind, key FROM keyed",
        "dedup_merge": fused,
        "lookup_merge_all": f"SELECT key, n, title, year, journal, citations_count, source FROM ({fused}) WHERE key_kind = 'doi' AND n > 1",
        "ris_export": (
            "SELECT paper_id, concat_ws(chr(10), CASE WHEN coalesce(journal, '') <> '' THEN 'TY  - JOUR' ELSE 'TY  - GEN' END, 'TI  - ' || nullif(title, ''), nullif(array_to_string(list_transform(authors, lambda x: 'AU  - ' || x), chr(10)), ''),"
            " 'PY  - ' || nullif(year, 0)::VARCHAR, 'JO  - ' || nullif(journal, ''), 'DO  - ' || nullif(doi, ''), 'UR  - ' || nullif(url, ''), 'AB  - ' || nullif(abstract, ''), nullif(array_to_string(list_transform(keywords, lambda x: 'KW  - ' || x), chr(10)), ''), 'DB  - ' || nullif(source, ''), 'ER  -') AS entry FROM papers"
        ),
        "endnote_export": (
            "SELECT paper_id, concat_ws(chr(10), '<record>', CASE WHEN coalesce(journal, '') <> '' THEN '    <ref-type name=\"Journal Article\">17</ref-type>' ELSE '    <ref-type name=\"Generic\">13</ref-type>' END,"
            f" '    <contributors>' || chr(10) || '        <authors>' || chr(10) || nullif(array_to_string(list_transform(authors, lambda x: '            <author>' || {_xml('x')} || '</author>'), chr(10)), '') || chr(10) || '        </authors>' || chr(10) || '    </contributors>',"
            f" '    <titles>', '        <title>' || {_xml('nullif(title, chr(0))')} || '</title>', '        <secondary-title>' || {_xml('nullif(journal, chr(0))')} || '</secondary-title>', '    </titles>',"
            " '    <dates>' || chr(10) || '        <year>' || nullif(year, 0)::VARCHAR || '</year>' || chr(10) || '    </dates>',"
            f" '    <electronic-resource-num>' || {_xml('d')} || '</electronic-resource-num>',"
            f" '    <urls>' || chr(10) || '        <related-urls>' || chr(10) || nullif(concat_ws(chr(10), '            <url>' || {_xml('u')} || '</url>', '            <url>' || {_xml('pu')} || '</url>'), '') || chr(10) || '        </related-urls>' || chr(10) || '    </urls>',"
            f" '    <abstract>' || {_xml('ab')} || '</abstract>', '    <keywords>' || chr(10) || nullif(array_to_string(list_transform(keywords, lambda x: '        <keyword>' || {_xml('x')} || '</keyword>'), chr(10)), '') || chr(10) || '    </keywords>', '</record>') AS entry"
            " FROM (SELECT *, nullif(doi, '') AS d, nullif(url, '') AS u, nullif(pdf_url, '') AS pu, nullif(abstract, '') AS ab FROM papers)"
        ),
        "bibtex_export": (
            "SELECT paper_id, '@' || CASE WHEN coalesce(journal, '') <> '' THEN 'article' ELSE 'misc' END || '{' || coalesce(nullif(fam || yr || word, ''), 'unknown') || ',' || chr(10) || concat_ws(',' || chr(10),"
            + ", ".join((
                f"'    title = {{' || {_latex('ti')} || '}}'", f"'    author = {{' || CASE WHEN len(authors) > 0 THEN array_to_string(list_transform(authors, lambda x: {_latex('x')}), ' and ') END || '}}'", "'    year = {' || nullif(year, 0)::VARCHAR || '}'",
                f"'    journal = {{' || {_latex('jo')} || '}}'", "'    doi = {' || d || '}'", "'    url = {' || u || '}'", f"'    abstract = {{' || {_latex('left(ab, 2000)')} || '}}'", f"'    keywords = {{' || {_latex('CASE WHEN len(keywords) > 0 THEN array_to_string(keywords, chr(44) || chr(32)) END')} || '}}'",
            ))
            + ") || chr(10) || '}' AS entry FROM (SELECT *, nullif(title, '') AS ti, nullif(journal, '') AS jo, nullif(doi, '') AS d, nullif(url, '') AS u, nullif(abstract, '') AS ab, coalesce(nullif(year, 0)::VARCHAR, '') AS yr,"
            rf" coalesce(lower(regexp_replace(strip_accents(regexp_extract(authors[1], '({_WS.replace('[', '[^')}+){_WS}*$', 1)), '[^A-Za-z0-9]', '', 'g')), '') AS fam,"
            rf" coalesce(left(list_filter(list_transform(regexp_split_to_array(lower(title), '{_WS}+'), lambda w: lower(regexp_replace(strip_accents(w), '[^A-Za-z0-9]', '', 'g'))), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'on', 'in', 'of', 'for', 'to', 'and'))[1], 10), '') AS word FROM papers)"
        ),
    }
    return out
