"""Scores, schedules and classifications of single values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Section kinds in the order they are tried, with the patterns of whole titles that name them.
SECTION_KINDS = {
    "abstract": (r"^abstract$", r"^summary$"),
    "introduction": (r"^introduction$", r"^\d+\.?\s*introduction$"),
    "methods": (r"^methods?$", r"^methodology$", r"^materials?\s*(and|&)\s*methods?$", r"^experimental\s*(section|methods?)?$", r"^\d+\.?\s*methods?$"),
    "results": (r"^results?$", r"^findings$", r"^results?\s*(and|&)\s*discussion$", r"^\d+\.?\s*results?$"),
    "discussion": (r"^discussion$", r"^\d+\.?\s*discussion$"),
    "conclusion": (r"^conclusions?$", r"^concluding\s*remarks?$", r"^\d+\.?\s*conclusions?$"),
    "references": (r"^references?$", r"^bibliography$", r"^literature\s*cited$", r"^\d+\.?\s*references?$"),
    "acknowledgments": (r"^acknowledgm?ents?$", r"^acknowledgements?$"),
}
# Answers of a server after which a request is worth repeating.
RETRYABLE = (429, 500, 502, 503, 504, 520, 521, 522, 523, 524)


def section_kind(title: Column) -> Column:
    """The kind of section a title names; NULL for none."""
    out = None
    for kind, patterns in SECTION_KINDS.items():
        hit = F.trim(title).rlike(f"(?i){'|'.join(patterns)}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def citation_burst(year: Column, citations: Column, now: Column, window: int = 3) -> Column:
    """Citations per year, weighted up for works younger than ``window`` years and down for older ones."""
    age = now - year
    rate = citations / age
    known = (F.coalesce(year, F.lit(0)) != 0) & (F.coalesce(citations, F.lit(0)) != 0)
    return F.when(~known, 0.0).when(age <= 0, citations.cast("double")).when(age <= window, rate * (1 + (window - age) / window)).otherwise(rate * window / age)


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before the next attempt, without the random part."""
    return F.greatest(F.lit(0.0), F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most)))


def retry_after(header: Column) -> Column:
    """The seconds a server asks for; NULL if the header holds no number."""
    return F.try_to_number(F.when(header.rlike(r"^\s*\d+(?:\.\d+)?\s*$"), F.trim(header)), F.lit("9999999999.999999")).cast("double")


def retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False))


def institution_type(name: Column) -> Column:
    """Education, healthcare or research by words of a name; NULL for none."""
    low = F.lower(name)
    has = lambda *w: F.greatest(*(low.contains(x) for x in w)) if len(w) > 1 else low.contains(w[0])
    return F.when(has("university", "college"), "education").when(has("hospital", "medical"), "healthcare").when(has("institute", "laboratory"), "research")
