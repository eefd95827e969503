"""Records as citation text: BibTeX, RIS and EndNote XML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from folioweave.functions.text import citation_word, truthy

# Replacements in the order they apply, and title words a key skips.
_LATEX = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))
_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
_SKIPPED = ("a", "an", "the", "on", "in", "of", "for", "to", "and")


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def latex(text: Column) -> Column:
    return _replaced(text, _LATEX)


def xml(text: Column) -> Column:
    return _replaced(text, _XML)


def bibtex_key(title: Column, authors: Column, year: Column) -> Column:
    """Last word of the first author, year, first title word that says something."""
    name = F.regexp_extract(F.get(authors, F.lit(0)), r"(?U)(\S+)\s*$", 1)
    # one Python call for all title words: they are joined, cleaned and split again
    cleaned = F.split(F.regexp_replace(citation_words(title), r"\s+", " "), " ")
    word = F.get(F.filter(cleaned, lambda w: (w != "") & ~w.isin(*_SKIPPED)), F.lit(0))
    key = F.concat(F.coalesce(citation_word(name), F.lit("")), F.coalesce(F.when(year != 0, year.cast("string")), F.lit("")), F.coalesce(F.left(word, F.lit(10)), F.lit("")))
    return F.coalesce(truthy(key), F.lit("unknown"))


def citation_words(title: Column) -> Column:
    """The words of a title as they enter a key, set apart by blanks."""
    from folioweave.functions.text import _ascii

    marked = F.regexp_replace(F.lower(title), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(_ascii(marked), r"[^A-Za-z0-9 ]", ""))


def bibtex(r: Callable[[str], Column]) -> Column:
    """A BibTeX entry; ``r`` gives the column of a field."""
    field = lambda name, value: F.concat(F.lit(f"    {name} = {{"), value, F.lit("}"))
    some = lambda c: F.when(F.size(c) > 0, c)
    abstract = truthy(r("abstract"))
    fields = F.concat_ws(
        ",\n",
        field("title", latex(truthy(r("title")))),
        field("author", F.array_join(F.transform(some(r("authors")), latex), " and ")),
        field("year", F.when(r("year") != 0, r("year").cast("string"))),
        field("journal", latex(truthy(r("journal")))),
        field("doi", truthy(r("doi"))),
        field("url", truthy(r("url"))),
        field("abstract", latex(F.left(abstract, F.lit(2000)))),
        field("keywords", latex(F.array_join(some(r("keywords")), ", "))),
    )
    kind = F.when(truthy(r("journal")).isNotNull(), "article").otherwise("misc")
    head = F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(r("title"), r("authors"), r("year")))
    return F.concat(F.concat_ws(",\n", head, truthy(fields)), F.lit("\n}"))


def ris(r: Callable[[str], Column]) -> Column:
    """A RIS record; authors and keywords take a line each."""
    line = lambda tag, value: F.concat(F.lit(f"{tag}  - "), value)
    each = lambda tag, items: truthy(F.array_join(F.transform(items, lambda x: line(tag, x)), "\n"))
    return F.concat_ws(
        "\n", F.when(truthy(r("journal")).isNotNull(), "TY  - JOUR").otherwise("TY  - GEN"), line("TI", truthy(r("title"))), each("AU", r("authors")),
        line("PY", F.when(r("year") != 0, r("year").cast("string"))), line("JO", truthy(r("journal"))), line("DO", truthy(r("doi"))), line("UR", truthy(r("url"))),
        line("AB", truthy(r("abstract"))), each("KW", r("keywords")), line("DB", truthy(r("source"))), F.lit("ER  -"),
    )


def endnote(r: Callable[[str], Column]) -> Column:
    """An EndNote XML record."""
    tag = lambda indent, name, value: F.concat(F.lit(f"{' ' * indent}<{name}>"), xml(value), F.lit(f"</{name}>"))

    def block(indent: int, name: str, inner: Column) -> Column:
        pad = " " * indent
        return F.concat(F.lit(f"{pad}<{name}>\n"), truthy(inner), F.lit(f"\n{pad}</{name}>"))

    each = lambda indent, name, items: truthy(F.array_join(F.transform(items, lambda x: tag(indent, name, x)), "\n"))
    journal, year = truthy(r("journal")), F.when(r("year") != 0, r("year").cast("string"))
    titles = F.concat_ws("\n", F.lit("    <titles>"), tag(8, "title", truthy(r("title"))), tag(8, "secondary-title", journal), F.lit("    </titles>"))
    urls = truthy(F.concat_ws("\n", tag(12, "url", truthy(r("url"))), tag(12, "url", truthy(r("pdf_url")))))
    kind = F.when(journal.isNotNull(), '    <ref-type name="Journal Article">17</ref-type>').otherwise('    <ref-type name="Generic">13</ref-type>')
    return F.concat_ws(
        "\n", F.lit("<record>"), kind, block(4, "contributors", block(8, "authors", each(12, "author", r("authors")))), titles, block(4, "dates", tag(8, "year", year)),
        tag(4, "electronic-resource-num", truthy(r("doi"))), block(4, "urls", block(8, "related-urls", urls)), tag(4, "abstract", truthy(r("abstract"))),
        block(4, "keywords", each(8, "keyword", r("keywords"))), F.lit("</record>"),
    )


FORMATS: dict[str, Callable[[Callable[[str], Column]], Column]] = {"bibtex": bibtex, "bib": bibtex, "ris": ris, "endnote": endnote, "xml": endnote}


def formatter(name: str) -> Callable[[Callable[[str], Column]], Column]:
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown citation format: {name}")
    return FORMATS[name.lower()]
