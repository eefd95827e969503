"""Every core query against its SQL on the smallest tables; the entry point; a stream; the sinks."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from folioweave.plans import catalogue
from folioweave.sources import files

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, bool) or getattr(getattr(x, "dtype", None), "kind", "") == "b":
            return str(bool(x))
        return float(x) if hasattr(x, "dtype") and x.dtype.kind in "if" or isinstance(x, (int, float)) else str(x)

    return sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_sinks(spark, tmp_path):
    papers = files.read_papers(spark, f"{DATA}/papers.parquet")
    files.write_citations(papers, "ris", f"{tmp_path}/ris")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/ris").collect())
    assert text.count("ER  -") == papers.count()
    assert files.after(papers, 10, 5).agg({"ord": "min"}).first()[0] == 11
    assert files.scan_all(papers, "semantic_scholar", 7).count() == 7
    with pytest.raises(ValueError):
        files.citations(papers, "nonsense")
