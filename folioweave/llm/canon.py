"""Canonical forms of bibliographic fields, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Full-width ASCII and the characters it stands for.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
# Phrases that stand where an abstract is missing.
FILLERS = ("n/a", "null", "none", "-", "no abstract available", "abstract not available", "see pdf", "not provided", "no abstract", "not available")


def _composed() -> str:
    """Every canonical pair of a character and a combining mark, each before the character it makes."""
    import sys
    import unicodedata

    out = []
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and len(pair := "".join(chr(int(x, 16)) for x in d.split())) == 2 and unicodedata.normalize("NFC", pair) == c:
            out.append(pair + c)
    return "\t".join(f"{x[:2]}\n{x[2]}" for x in out)


_COMPOSED = _composed()


def _compose(text: Column) -> Column:
    """``text`` with each character and the marks that follow it composed as far as there are characters for them."""
    pairs = F.str_to_map(F.lit(_COMPOSED), F.lit("\t"), F.lit("\n"))
    last = lambda s, c: F.try_element_at(pairs, F.concat(F.right(s, F.lit(1)), c))
    add = lambda s, c: F.coalesce(F.concat(F.left(s, F.length(s) - 1), last(s, c)), F.concat(s, c))
    pieces = F.regexp_extract_all(text, F.lit(r"\P{M}\p{M}+|\P{M}+(?!\p{M})|\p{M}+"), F.lit(0))
    one = lambda p: F.when(p.rlike(r"\p{M}"), F.aggregate(F.split(p, ""), F.lit(""), add)).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


def _variants() -> tuple[str, str]:
    """Letters that are forms of others, as ligatures and mathematical letters are: pairs with what they stand for, and a class of them all."""
    import sys
    import unicodedata

    found = [c for c in map(chr, range(0xAA, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and unicodedata.decomposition(c).startswith("<")]
    ranges: list[list[int]] = []
    for c in map(ord, found):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "\t".join(f"{c}\n{unicodedata.normalize('NFKC', c)}" for c in found), "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


_VARIANTS, _VARIANT = _variants()


def _plain_letters(text: Column) -> Column:
    """``text`` with each letter that is a form of others replaced by them."""
    known = F.str_to_map(F.lit(_VARIANTS), F.lit("\t"), F.lit("\n"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")


def canonical_characters(text: Column) -> Column:
    """Forms of letters and full-width ASCII become plain letters, letters with combining marks one character, markup and the commonest entities plain text."""
    plain = F.translate(text, _WIDE, _PLAIN)
    other = plain.rlike(r"[^\x00-\xa9\xab-\xb4\xb6-\xb9\xbb-\xff]")  # the tests behind it are dear
    plain = F.when(other & plain.rlike(_VARIANT), _plain_letters(plain)).otherwise(plain)
    plain = F.when(other & plain.rlike(r"\p{M}"), _compose(plain)).otherwise(plain)
    stripped = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"</?[A-Za-z][^<>]*>", ""), "&amp;", "&"), r"&(lt|gt|quot|apos|nbsp|#\d+);", " ")
    return F.when(plain.rlike("[<&]"), stripped).otherwise(plain)


def title_key(title: Column) -> Column:
    """Letters and digits of a title in lower case; NULL where there are none."""
    return F.nullif(F.regexp_replace(F.lower(canonical_characters(title)), r"[^\p{L}\p{M}\p{N}]+", ""), F.lit(""))


def doi_key(doi: Column) -> Column:
    """The bare DOI in lower case; NULL where the text names none.

    Resolver addresses, ``doi:`` prefixes, percent escapes of the slash, blanks and closing
    punctuation are notation; what follows ``10.`` and the registrant is the name.
    """
    low = F.replace(F.lower(F.translate(doi, _WIDE, _PLAIN)), F.lit("%2f"), F.lit("/"))
    return F.nullif(F.regexp_extract(low, r"(10\.[0-9]{3,9}(?:\.[0-9]+)*/[^\s]*[^\s.,;:)\]}>\"'])", 1), F.lit(""))


def is_filler(text: Column) -> Column:
    """Whether a text holds no abstract: blank, only markup, or a stock phrase."""
    shown = F.trim(F.when(text.contains("<"), F.regexp_replace(text, r"<[^<>]*>", "")).otherwise(text))
    bare = F.trim(F.regexp_replace(F.lower(shown), r"^[\s\[(]+|[\s\]).]+$", ""))
    longest = 3 * max(map(len, FILLERS))  # with what may stand around a phrase
    return text.isNull() | F.when(F.length(shown) > longest, F.lit(False)).otherwise((bare == "") | bare.isin(*FILLERS))


def checked(text: Column) -> Column:
    """128 bits of a text and 64 independent ones as a check, as 24 bytes: texts that collide in the first still differ."""
    return F.concat(fingerprint(text), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def fingerprint(*parts: Column) -> Column:
    """128 bits of the parts, NULL parts told apart from empty ones, as 16 bytes."""
    told = [F.when(p.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(p).cast("string"), F.lit(":"), p)) for p in parts]
    return F.unhex(F.md5(F.concat(*told)))
