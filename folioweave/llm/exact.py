"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts with map-side combining.

Copies agree in their canonical title and do not contradict each other in their canonical
DOI.  A record without a DOI belongs to the one DOI of its title; where a title has several
DOIs it forms, with the title's other records without one, a set of its own.

Cases: a NULL, empty or letterless title agrees with no other record, so such a record is a
set of one; a NULL, blank or filler DOI counts as missing; repeated rows are copies; an empty
table gives an empty result; columns other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.llm.canon import checked, doi_key, title_key
from folioweave.operators.joins import skew_safe_left_join
from folioweave.session import materialise

HASH_BYTES = 16  # of a key; the rest of it is the check


def keyed(papers: DataFrame, record_id: str = "paper_id") -> DataFrame:
    """(id, title_hash, doi_hash): fingerprints of each record with a title, each with its check behind it."""
    t, d = title_key(F.col("title")), doi_key(F.col("doi"))
    keys = papers.select(F.col(record_id).alias("id"), t.alias("t"), d.alias("d")).filter("t IS NOT NULL")
    return keys.select("id", checked(F.col("t")).alias("title_hash"), F.when(F.col("d").isNotNull(), checked(F.col("d"))).alias("doi_hash"))


def pair_counts(keys: DataFrame) -> DataFrame:
    """One row per distinct (title, DOI): copies and smallest id.

    All aggregates have fixed width, so Spark combines them before the shuffle; a hot pair leaves each map task as one row.
    The check is part of the key all the way, so two texts under one 128-bit hash stay apart.
    """
    return keys.groupBy("title_hash", "doi_hash").agg(F.count("*").alias("copies"), F.min("id").alias("least"))


def copy_sets(papers: DataFrame, record_id: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(keys, sets): the fingerprints of each record, and for each (title, DOI) its set: ``set_id`` is the smallest id, ``set_size`` the copies."""
    keys = materialise(keyed(papers, record_id))
    pairs = materialise(pair_counts(keys))
    titles = pairs.groupBy("title_hash").agg(F.min("doi_hash").alias("lo"), F.max("doi_hash").alias("hi"))
    one = F.col("lo") == F.col("hi")
    joined = pairs.join(titles, "title_hash")
    joined = joined.withColumn("set_doi", F.when(F.col("doi_hash").isNull() & one, F.col("lo")).otherwise(F.col("doi_hash")))
    sets = joined.groupBy("title_hash", "set_doi").agg(F.min("least").alias("set_id"), F.sum("copies").alias("set_size"), F.collect_set(F.coalesce("doi_hash", F.lit(b""))).alias("own"))
    # ``own`` holds the set's DOI and the missing one: two entries at most
    return keys, sets.select("title_hash", F.explode("own").alias("own"), "set_id", "set_size").withColumn("pair", F.concat("title_hash", "own"))


def members(papers: DataFrame, record_id: str = "paper_id", least_size: int = 2) -> DataFrame:
    """(id, set_id, set_size) of each record whose set has ``least_size`` copies or more."""
    keys, sets = copy_sets(papers, record_id)
    rows = keys.select("id", F.concat("title_hash", F.coalesce("doi_hash", F.lit(b""))).alias("pair"))
    groups = sets.filter(F.col("set_size") >= least_size).select("pair", "set_id", "set_size", F.col("set_size").alias("rows"))
    joined = skew_safe_left_join(rows, groups, "pair", F.col("id"), "rows")
    return joined.filter("set_id IS NOT NULL").select("id", "set_id", "set_size")


def collapsed(papers: DataFrame, record_id: str = "paper_id") -> DataFrame:
    """(record_id, copies, collided): one row for each set of copies, under its smallest id; ``collided`` if another title has the same 128-bit hash."""
    _, sets = copy_sets(papers, record_id)
    each = materialise(sets.select("title_hash", "set_id", "set_size").distinct().withColumn("h", F.substring("title_hash", 1, HASH_BYTES)))
    twins = each.select("h", "title_hash").distinct().groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.lit(True).alias("twin"))
    return each.join(twins, "h", "left").select(F.col("set_id").alias("record_id"), F.col("set_size").alias("copies"), F.coalesce("twin", F.lit(False)).alias("collided"))


def found(papers: DataFrame) -> DataFrame:
    """(first_id, second_id): the smallest paper_id of each set and each other row of it."""
    return members(papers).filter("id <> set_id").select(F.col("set_id").alias("first_id"), F.col("id").alias("second_id"))


def normalised(column: Column) -> Column:
    """Lower case with runs of white space collapsed, for reports."""
    return F.trim(F.regexp_replace(F.lower(column), r"(?U)\s+", " "))
