"""Settings of a run: from a file, the environment or code."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

# Rows a request to each kind of source may ask for, the largest offset it allows (None: any), whether it hands out cursors.
CAPABILITIES: dict[str, tuple[int, int | None, bool]] = {
    "openalex": (200, 10_000, True), "semantic_scholar": (100, 1_000, False), "crossref": (1_000, None, True), "pubmed": (10_000, 10_000, False), "elsevier": (200, 5_000, True), "google_scholar": (20, None, False), "google_scholar_scraper": (10, None, False), "wos": (100, 100_000, False),
    "arxiv": (2_000, None, False), "biorxiv": (100, None, True), "medrxiv": (100, None, True), "core": (100, None, True), "dblp": (1_000, None, True), "doaj": (100, None, True),
}

# How many records a scan of all records of a source reads.
SCAN_LIMITS = {"openalex": 10_000, "semantic_scholar": 1_000, "crossref": 10_000, "elsevier": 5_000, "google_scholar": 100, "pubmed": 10_000, "wos": 10_000, "dblp": 10_000, "doaj": 10_000, "core": 10_000}


@dataclass
class Config:
    """``sources`` are searched where none are named; ``limits`` bound a scan of all records of a source."""

    sources: tuple[str, ...] = ("openalex", "semantic_scholar")
    search_limit: int = 10
    citations_limit: int = 100
    recent_days: int = 7
    default_scan_limit: int = 1_000
    limits: dict[str, int] = field(default_factory=lambda: dict(SCAN_LIMITS))

    def scan_limit(self, source: str) -> int:
        return self.limits.get(source, self.default_scan_limit)


_NAMES = ("folioweave.json", "folioweave.yaml")
_current: list[Config] = []


def find(places: tuple[Path, ...] | None = None) -> Path | None:
    """The file ``FOLIOWEAVE_CONFIG`` names, else the first in the working folder or at home."""
    named = os.environ.get("FOLIOWEAVE_CONFIG")
    if named:
        return Path(named) if Path(named).is_file() else None
    return next((p / n for p in places or (Path.cwd(), Path.home()) for n in _NAMES if (p / n).is_file()), None)


def load(path: str | Path | None = None) -> Config:
    """The settings of a file; unknown ones are an error, no file gives the defaults."""
    file = Path(path) if path else find()
    if file is None:
        return Config()
    raw = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        values = json.loads(raw or "{}")
    else:
        import yaml  # only where it is installed

        values = yaml.safe_load(raw) or {}
    unknown = set(values) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "sources" in values:
        values["sources"] = tuple(values["sources"])
    return Config(**values)


def current() -> Config:
    if not _current:
        _current.append(load())
    return _current[0]


def reset() -> None:
    _current.clear()
