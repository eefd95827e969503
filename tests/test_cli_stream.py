import json
import os

import pytest
from pyspark.sql import functions as F

from folioweave import cli
from folioweave.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_commands(spark, capsys, tmp_path):
    papers = f"{DATA}/papers.parquet"
    assert cli.main(["search", "theory", "--papers", papers, "--limit", "3", "--json", "--sort", "citations"]) == 0
    hits = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert 0 < len(hits) <= 6 and all("theory" in json.dumps(h).lower() for h in hits)
    counts = [h.get("citations_count") or 0 for h in hits]
    assert counts == sorted(counts, reverse=True)
    doi = spark.read.parquet(papers).filter("doi LIKE '10.%'").orderBy("paper_id").first().doi
    assert cli.main(["info", doi, "--papers", papers, "--merge"]) == 0 and capsys.readouterr().out.strip()
    page = tmp_path / "p.html"
    page.write_text("<main><h1>T</h1><p>x</p></main>")
    assert cli.main(["extract", str(page)]) == 0 and capsys.readouterr().out.strip() == "# T\n\nx"
    assert cli.main(["sources"]) == 0 and "openalex" in capsys.readouterr().out
    assert cli.main(["config"]) == 0 and json.loads(capsys.readouterr().out)["search_limit"] == 10


def test_arrivals_are_taken_once(spark, tmp_path):
    def write(rows):
        df = spark.createDataFrame(rows, "paper_id bigint, title string, doi string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = ingest.first_of_key(ingest.arrivals(spark, f"{tmp_path}/in"), delay="9000 days")
        ingest.land(stream.select("paper_id", "key"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect())

    write([(1, "A", "10.1/x", "2024-01-01"), (2, "B", None, "2024-01-02"), (3, "b", None, "2024-01-03")])
    assert run() == ["10.1/x", "b"]
    write([(4, "Z", "https://doi.org/10.1/X", "2024-02-01"), (5, "C", "", "2024-02-01")])
    assert run() == ["10.1/x", "b", "c"] and run() == ["10.1/x", "b", "c"]
