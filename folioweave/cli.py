"""Commands: search, info, extract, sources, config."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import functions as F

from folioweave import config
from folioweave.functions.text import listing, normalize_doi
from folioweave.operators import resolve, search
from folioweave.operators.documents import read_page
from folioweave.sources.files import read_papers
from folioweave.sources.records import PARSERS


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioweave")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search all sources, interleave and fuse")
    s.add_argument("query")
    s.add_argument("--papers", required=True)
    s.add_argument("--sources", nargs="*")
    s.add_argument("--limit", type=int, default=None)
    s.add_argument("--sort", choices=("relevance", "citations", "date", "date_asc"), default="relevance")
    s.add_argument("--json", action="store_true")
    s.add_argument("--no-dedup", action="store_true")
    i = sub.add_parser("info", help="a record by DOI")
    i.add_argument("doi")
    i.add_argument("--papers", required=True)
    i.add_argument("--merge", action="store_true")
    i.add_argument("--json", action="store_true")
    e = sub.add_parser("extract", help="a web page as markdown")
    e.add_argument("page")
    e.add_argument("--json", action="store_true")
    sub.add_parser("sources")
    sub.add_parser("config")
    return p


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "sources":
        print("\n".join(sorted(PARSERS)))
        return 0
    if a.command == "config":
        print(json.dumps(dataclasses.asdict(config.current()), indent=2))
        return 0
    if a.command == "extract":
        with open(a.page, encoding="utf-8") as f:
            page = read_page(f.read())
        print(json.dumps(page, ensure_ascii=False) if a.json else page["markdown"])
        return 0

    from folioweave.session import get_spark

    records = read_papers(get_spark(), a.papers)
    c = F.col
    shown = listing(c("title"), c("authors"), c("year"), c("journal"), c("abstract"), c("citations_count"))
    if a.command == "info":
        key = normalize_doi(F.lit(a.doi))
        rows = resolve.keyed(records).filter((c("key_kind") == "doi") & (c("key") == key)).select(*records.columns)
        rows = resolve.fuse(rows) if a.merge else rows.orderBy("ord").limit(1)
    else:
        sources = tuple(a.sources or config.current().sources)
        limit = a.limit or config.current().search_limit
        hits = records.filter(search.text_match(a.query))
        rows = search.interleave(hits, sources).filter(c("place") <= limit * len(sources))
        rows = rows.withColumn("ord", c("place")).drop("place")
        rows = rows if a.no_dedup else resolve.fuse(rows).withColumn("ord", c("first_ord"))
        rows = rows.orderBy(*search.sort_order(a.sort))
    out = rows.select(F.to_json(F.struct(*rows.columns)).alias("x") if a.json else shown.alias("x")).collect()  # as many as asked for
    print(("\n" if a.json else "\n\n").join(r.x for r in out))
    return 0 if out else 1


if __name__ == "__main__":
    sys.exit(main())
