"""What the reviewer of round 2 found missing."""

from folioweave.llm import names
from folioweave.operators import components


def test_names_broadcast_nothing_that_grows(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (names, components):
        kept = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, *by, kept=kept: plan(df) or kept(df, *by))
    hospital = "General Hospital of Gadetokograd"
    a = spark.createDataFrame([(1, "Wanda Kogotreb", [hospital], None), (2, "Kogotreb, W.", ["Gadetokograd Gen. Hosp."], None), (3, "Walter Kogotreb", [], None)], "author_id bigint, name string, affiliations array<string>, orcid string")
    i = spark.createDataFrame([(1, hospital, None), (2, "Gadetokograd Gen. Hosp.", "https://g-hosp.test/")], "institution_id bigint, name string, url string")
    p = spark.createDataFrame([(1, ["W. Kogotreb"], f'{{"authors": [{{"affiliations": ["{hospital}"]}}]}}'), (2, ["Kogotrep, Wanda"], None)], "paper_id bigint, authors array<string>, raw_data string")
    found = names.found(p, a, i)
    plan(found)
    assert {tuple(r) for r in found.collect()} == {("institution", 1, 2), ("author", 1, 2), ("paper_author", 1, 1), ("paper_author", 2, 1)}
    assert sum(t.count("SortMergeJoin") for t in plans) > 20 and not any("Broadcast" in t for t in plans)
    plans.clear()
    entities = names.entities(a, i, p)
    plan(entities)
    assert {tuple(r) for r in entities.collect()} == {("institution", 1, 1, 2), ("institution", 2, 1, 2), ("author", 1, 1, 2), ("author", 2, 1, 2), ("author", 3, 3, 1)}
    assert sum(t.count("BroadcastHashJoin") for t in plans) == 1 and "TakeOrderedAndProject(limit=1000" in plans[-1]  # the 1,000 largest groups
