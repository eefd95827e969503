"""Duplicates by normalised identifier or title, and their fusion field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioweave.functions.text import RESOLVERS, normalize_doi, normalize_title, truthy
from folioweave.session import materialise

# Sources a field is taken from, best first.
PRIORITIES: dict[str, tuple[str, ...]] = {
    "doi": ("crossref", "openalex", "semantic_scholar", "pubmed", "wos"),
    "abstract": ("semantic_scholar", "openalex", "pubmed", "crossref", "core"),
    "journal": ("crossref", "openalex", "pubmed", "semantic_scholar"),
    "year": ("crossref", "openalex", "pubmed", "semantic_scholar"),
    "authors": ("crossref", "openalex", "semantic_scholar", "pubmed"),
    "pdf_url": ("core", "openalex", "semantic_scholar", "doaj", "arxiv", "biorxiv"),
    "url": (),
}


def keyed(records: DataFrame, resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """With ``key_kind`` (doi before title) and ``key``: the normalised DOI, or the title where there is none."""
    doi = normalize_doi(F.col("doi"), resolvers)
    return records.withColumn("key_kind", F.when(doi.isNotNull(), "doi").otherwise("title")).withColumn("key", F.coalesce(doi, normalize_title(F.col("title"))))


def keep_first(records: DataFrame, ord: str = "ord", resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """(key_kind, key, first_ord, n): the place of the first record of each key and the number of its records."""
    return keyed(records, resolvers).groupBy("key_kind", "key").agg(F.min(ord).alias("first_ord"), F.count("*").alias("n"))


def first_records(records: DataFrame, ord: str = "ord", resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """The first record of each key, whole and unchanged; the rest of its key is left out.  ``ord`` must tell records apart."""
    first = keep_first(records, ord, resolvers).select(F.col("first_ord").alias(ord))
    return records.join(first, ord, "left_semi")


def _present(value: Column, kind: str) -> Column:
    if kind == "string":
        return truthy(value)
    if kind.startswith("array"):
        return F.when(F.size(value) > 0, value)
    return F.nullif(value, F.lit(0))


def fuse(records: DataFrame, ord: str = "ord", resolvers: tuple[str, ...] = RESOLVERS, priorities: dict[str, tuple[str, ...]] = PRIORITIES) -> DataFrame:
    """One record per key, field by field from the best source; a record alone in its key stays as it is.

    The earliest record of a source speaks for it, even where its value is empty; a source in a comma list counts as that
    source.  A field takes the first filled value in order of its sources, else the first filled one of all records.  Counts
    take the maximum, open access is true if any record says so, authors the longest list, keywords the union in order of
    appearance without regard to case, twenty at most.

    One aggregation over places and flags decides which record gives which field; the texts themselves are fetched by place
    afterwards, so none is carried through it.  ``ord`` must tell records apart.
    """
    rows = keyed(records, resolvers)
    kinds = dict(rows.dtypes)
    plain = [f for f in priorities if f != "authors"]
    flagged = (*plain, "title")
    flags = F.array(*(_present(F.col(f), kinds[f]).isNotNull() for f in flagged))
    slim = rows.select(
        "key_kind", "key", F.col(ord).alias("o"), "source", F.transform(F.split("source", ","), lambda s: F.trim(s)).alias("names"), flags.alias("has"),
        F.coalesce(F.size("authors"), F.lit(0)).alias("len"), "citations_count", "references_count", "open_access",
    )
    speakers = list(dict.fromkeys(s for names in priorities.values() for s in names))
    told = F.struct("o", "has", "len")
    other = ~F.coalesce(F.col("source").isin(*priorities["authors"]), F.lit(False)) & (F.col("len") > 0)
    aggs = [F.min("o").alias("first_ord"), F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("citations_count", "references_count"))]
    aggs += [F.min(F.when(F.array_contains("names", s), told)).alias(f"_by_{s}") for s in speakers]
    aggs += [F.min(F.when(F.col("has")[i], F.col("o"))).alias(f"_any_{f}") for i, f in enumerate(flagged)]
    aggs.append(F.max(F.when(other, F.struct("len", (-F.col("o")).alias("o")))).alias("_other"))  # the longest list of the unlisted, then the earliest
    aggs += [F.coalesce(F.bool_or("open_access"), F.lit(False)).alias("open_access"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source")]  # bounded by the combinations of sources
    g = slim.groupBy("key_kind", "key").agg(*aggs)

    def winner(f: str) -> Column:
        i = flagged.index(f)
        chosen = [F.when(F.col(f"_by_{s}.has")[i], F.col(f"_by_{s}.o")) for s in priorities.get(f, ())]
        return F.coalesce(*chosen, F.col(f"_any_{f}"), *([F.col("first_ord")] if f == "title" else []))

    lists = [(F.col(f"_by_{s}.len"), F.col(f"_by_{s}.o")) for s in priorities["authors"]] + [(F.col("_other.len"), -F.col("_other.o"))]
    longest = F.greatest(*(F.coalesce(n, F.lit(0)) for n, _ in lists))
    authors = F.coalesce(*(F.when((longest > 0) & (n == longest), o) for n, o in lists), F.col("first_ord"))
    fetched = ("title", *plain, "authors")
    g = materialise(g.select("key_kind", "key", "first_ord", "n", "citations_count", "references_count", "open_access", "source", F.struct(*(winner(f).alias(f) for f in (*plain, "title")), authors.alias("authors")).alias("won")))
    names = ("key_kind", "key", "first_ord", "n", "title", *plain, "authors", "citations_count", "references_count", "open_access", "source", "keywords")

    alone = g.filter("n = 1").select("key_kind", "key", "first_ord", "n").join(records.withColumnRenamed(ord, "first_ord"), "first_ord").select(*names)
    several = g.filter("n > 1")
    asked = several.withColumn("o", F.explode(F.array_distinct(F.array_compact(F.array(*(F.col(f"won.{f}") for f in fetched))))))
    values = asked.select("key_kind", "key", "won", "o").join(records.select(F.col(ord).alias("o"), *fetched), "o")  # as many rows a key as fields at most
    values = values.groupBy("key_kind", "key").agg(*(F.first(F.when(F.col("o") == F.col(f"won.{f}"), F.col(f)), ignorenulls=True).alias(f) for f in fetched))
    words = merged_keywords(rows.join(several.select("key_kind", "key"), ["key_kind", "key"], "left_semi"), ord)
    fused = several.drop("won").join(values, ["key_kind", "key"], "left").join(words, ["key_kind", "key"], "left")
    return alone.unionByName(fused.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))).select(*names))


def merged_keywords(rows: DataFrame, ord: str = "ord", most: int = 20) -> DataFrame:
    """(key_kind, key, keywords): distinct keywords of each key by first appearance, ``most`` at most."""
    each = rows.select("key_kind", "key", ord, F.posexplode("keywords").alias("pos", "word")).filter("word IS NOT NULL").withColumn("word", F.trim("word"))
    first = each.groupBy("key_kind", "key", F.lower("word").alias("low")).agg(F.min(F.struct(ord, "pos", "word")).alias("w"))
    order = Window.partitionBy("key_kind", "key").orderBy(F.col(f"w.{ord}"), F.col("w.pos"))
    kept = first.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)  # cut before the sort's shuffle by Spark's group limit
    listed = kept.groupBy("key_kind", "key").agg(F.array_sort(F.collect_list(F.struct("rn", F.col("w.word").alias("word")))).alias("k"))
    return listed.select("key_kind", "key", F.col("k.word").alias("keywords"))


def provenance(records: DataFrame, resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """(key_kind, key, ord, source, raw_data): the payloads a fused record was made from, a row each."""
    return keyed(records, resolvers).select("key_kind", "key", "ord", "source", "raw_data")


def first_source_wins(records: DataFrame, order: tuple[str, ...], ord: str = "ord", resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """(key, source, found_ord): for each DOI the record of the first source, in the given order, that has it."""
    rows = keyed(records, resolvers).filter("key_kind = 'doi'").withColumn("_p", F.array_position(F.array(*map(F.lit, order)), F.col("source"))).filter("_p > 0")
    best = F.min(F.struct("_p", ord, "source"))
    return rows.groupBy("key").agg(best.alias("b")).select("key", F.col("b.source").alias("source"), F.col(f"b.{ord}").alias("found_ord"))
