"""One surviving record for each set of copies: votes for field values, unpivoted and pivoted back.

Every copy votes in every field for the normalised value it holds, with the weight ``trust of its source * 2 ** -(age /
half life)``.  Weights are summed per set, field and value; the value with the largest sum wins, ties going to the latest
record, then to the smaller id.  With a half life of 0, the limit of ever faster decay, only the votes of the latest moment
count and trust decides among them.  Ages count from a fixed day: another day would scale all weights alike.  Along with
the value comes the record that stands for it, the latest of those that voted for it.  A field may ask for the union of its
values instead.

Cases: a NULL value casts no vote, so a field nobody fills stays NULL; a NULL time counts as the oldest; repeated rows vote
each; sets may hold a third of all rows, since votes are summed map-side before the shuffle; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.llm import exact, truncation
from folioweave.llm.canon import doi_key, is_filler
from folioweave.operators.resolve import PRIORITIES
from folioweave.session import materialise

# Days since 1970 to the day ages count from, 2020-01-01.
_DAY = 18_262.0


def trust(preferred: tuple[str, ...]) -> dict[str, float]:
    """Weights between 1 and 2 from an order of preference, best first; sources it does not name weigh 1."""
    return {name: 1 + (len(preferred) - i) / len(preferred) for i, name in enumerate(preferred)}


@dataclass(frozen=True)
class Field:
    """A field of the survivor: the value a copy votes for, as text, and how votes weigh.

    ``trust`` maps source names to weights (1 where it names none); ``half_life_days`` is the age at which a vote has lost
    half its weight, 0 for the latest votes alone; ``union`` keeps all values instead of one.
    """

    name: str
    value: Column
    trust: dict[str, float] = field(default_factory=dict)
    half_life_days: float = 365.0
    union: bool = False


def survivors(copies: DataFrame, fields: list[Field], set_id: str = "set_id", record_id: str = "id", source: str = "source", time: str = "fetched_at") -> DataFrame:
    """One row per set: ``set_id``, and for each field its text and ``<field>_id``, the record that stands for it (a sorted array alone for a union)."""
    age = F.lit(_DAY) - F.unix_micros(F.col(time).cast("timestamp")) / F.lit(86_400e6)

    def vote(f: Field) -> Column:
        decay = F.coalesce(F.pow(F.lit(2.0), -age / F.lit(f.half_life_days)), F.lit(0.0)) if f.half_life_days > 0 else F.lit(1.0)
        if not f.trust:
            return decay
        known = F.create_map(*(F.lit(x) for kv in f.trust.items() for x in kv))
        best = F.array_max(F.transform(F.split(F.coalesce(F.col(source), F.lit("")), r"\s*,\s*"), lambda s: F.coalesce(F.try_element_at(known, F.trim(s)), F.lit(1.0))))
        return best * decay

    def ballot(f: Field) -> Column:
        at = F.lit(None).cast(copies.schema[time].dataType) if f.half_life_days > 0 else F.col(time)
        return F.struct(F.lit(f.name).alias("field"), f.value.cast("string").alias("value"), vote(f).alias("vote"), at.alias("at"))

    long = copies.select(F.col(set_id).alias("set_id"), F.col(record_id).alias("id"), F.col(time).alias("time"), F.inline(F.array(*map(ballot, fields)))).filter("value IS NOT NULL")
    votes = long.groupBy("set_id", "field", "value", "at").agg(F.sum("vote").alias("vote"), F.max(F.struct("time", (-F.col("id")).alias("id"))).alias("last"))
    rank = F.struct("at", "vote", "last")
    mine = lambda f, c: F.when(F.col("field") == f.name, c)
    one = lambda f: F.max_by(mine(f, F.struct("value", (-F.col("last.id")).alias("id"))), mine(f, rank))
    every = lambda f: F.array_sort(F.collect_set(mine(f, F.col("value"))))
    # a union holds distinct values only: for sources, a list bounded by the number of sources
    won = votes.groupBy("set_id").agg(*((every(f) if f.union else one(f)).alias(f.name) for f in fields))
    return won.select("set_id", *(c for f in fields for c in ([F.col(f.name)] if f.union else [F.col(f"{f.name}.value").alias(f.name), F.col(f"{f.name}.id").alias(f"{f.name}_id")])))


def found(papers: DataFrame) -> DataFrame:
    """(group_id, abstract_id, citations_id, doi, sources) for each set of two copies or more.

    Copies vote for their abstract, in whatever case, if it is whole and genuine, for their count of citations and for their DOI;
    for the first two the latest moment counts, as the query defines it.  The sources are a union.
    """
    sets = materialise(exact.members(papers))
    verdicts = materialise(truncation.judged(papers, "abstract", "paper_id", "source").filter("reason IS NOT NULL").select("id", F.lit(True).alias("cut")))
    letters = F.md5(F.lower(F.trim("abstract")))
    slim = papers.select(F.col("paper_id").alias("id"), "source", "fetched_at", doi_key(F.col("doi")).alias("doi_bare"), F.when(~is_filler(F.col("abstract")), letters).alias("letters"), F.when(F.col("citations_count") >= 0, F.col("citations_count")).alias("count"))
    copies = sets.join(slim, "id").join(verdicts, "id", "left")
    names = F.transform(F.split(F.coalesce("source", F.lit("")), ","), lambda s: F.trim(s))
    copies = copies.select("*", F.posexplode(names).alias("nth", "name"))
    first = F.col("nth") == 0  # a record votes once, and names each of its sources
    fields = [
        Field("abstract", F.when(first & F.col("cut").isNull(), F.col("letters")), trust(PRIORITIES["abstract"]), 0.0),
        Field("citations", F.when(first, F.col("count")), trust(PRIORITIES["abstract"]), 0.0),
        Field("doi", F.when(first, F.col("doi_bare")), trust(PRIORITIES["doi"])),
        Field("sources", F.nullif(F.col("name"), F.lit("")), union=True),
    ]
    out = survivors(copies, fields)
    return out.select(F.col("set_id").alias("group_id"), "abstract_id", "citations_id", F.coalesce("doi", F.lit("")).alias("doi"), F.array_join("sources", ",").alias("sources"))
