"""Citation graphs as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioweave.functions.score import citation_burst
from folioweave.operators.ranking import row_numbers
from folioweave.session import materialise


def edge_set(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (citing_id, cited_id); with ``nodes``, only edges both of whose ends are nodes."""
    e = edges.select("citing_id", "cited_id").distinct()
    if nodes is not None:
        n = nodes.select("paper_id")
        e = e.join(n.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").join(n.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi")
    return e.select("citing_id", "cited_id")


def node_id(doi: Column, title: Column) -> Column:
    """The name of a record in a graph: its DOI as written, else a hash of its title without regard to case."""
    return F.coalesce(F.nullif(doi, F.lit("")), F.concat(F.lit("title:"), F.sha2(F.lower(title), 256)))


def node_set(records: DataFrame, ord: str = "ord") -> DataFrame:
    """(node_id, ord, title, year, citations_count, source): each node once, as its first record tells it."""
    named = records.select(node_id(F.col("doi"), F.col("title")).alias("node_id"), ord).filter("node_id IS NOT NULL")
    first = named.groupBy("node_id").agg(F.min(ord).alias(ord))
    return first.join(records.select(ord, "title", "year", "citations_count", "source"), ord).select("node_id", ord, "title", "year", "citations_count", "source")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, in_degree, out_degree) of every node; ``edges`` is an edge set."""
    into = edges.groupBy(F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("citing_id").alias("paper_id")).agg(F.count("*").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("paper_id").join(into, "paper_id", "left").join(out, "paper_id", "left").select("paper_id", zero("in_degree"), zero("out_degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, in_centrality, out_centrality): degrees over the number of other nodes, 0 for a node alone."""
    n = nodes.count()
    share = lambda c: (F.col(c) / (n - 1) if n > 1 else F.lit(0.0)).alias(c.replace("degree", "centrality"))
    return degrees(nodes, edges).select("paper_id", share("in_degree"), share("out_degree"))


def citing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, other_id): for each node the nodes that cite it."""
    return edge_set(edges, nodes).select(F.col("cited_id").alias("paper_id"), F.col("citing_id").alias("other_id"))


def cited(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, other_id): for each node the nodes it cites."""
    return edge_set(edges, nodes).select(F.col("citing_id").alias("paper_id"), F.col("cited_id").alias("other_id"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, dangling: bool = False, cut_every: int = 5) -> DataFrame:
    """(paper_id, score) by power iteration from a uniform start.

    Without ``dangling`` the weight of nodes that cite nothing is lost, so scores sum to less
    than 1; with it that weight is spread evenly.  Stops after ``rounds``, or when the scores
    together move by less than ``tolerance``.  Edges are laid out by citing node once; each
    round joins them with the scores and sums by cited node, combined map-side, so a node
    that draws most citations costs no more than others.
    """
    base = materialise(degrees(nodes, edges).select("paper_id", "out_degree"))
    n = base.count()
    if not n:
        return base.select("paper_id", F.lit(0.0).alias("score"))
    links = materialise(edges.select(F.col("citing_id").alias("paper_id"), "cited_id"))
    scores = base.withColumn("score", F.lit(1.0 / n))
    for i in range(rounds):
        given = links.join(scores.filter("out_degree > 0").select("paper_id", (F.col("score") / F.col("out_degree")).alias("part")), "paper_id")
        got = given.groupBy(F.col("cited_id").alias("paper_id")).agg(F.sum("part").alias("got"))
        lost = scores.filter("out_degree = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0] if dangling else 0.0
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))
        after = scores.join(got, "paper_id", "left").select("paper_id", "out_degree", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))
        if tolerance is not None or (i + 1) % cut_every == 0:
            after = materialise(after)
        scores = after.drop("moved")
        if tolerance is not None and after.agg(F.sum("moved")).first()[0] < tolerance:
            break
    return scores.select("paper_id", "score")


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, score): share of shortest directed paths between two others that pass a node, over (n-1)(n-2).

    Breadth-first search from all nodes at once, a level a round, then dependencies summed
    back level by level (Brandes, 2001).  Work is that of all reachable pairs, spread over the
    cluster by (source, node); every level is written to the shared folder.
    """
    n = nodes.count()
    none = nodes.select("paper_id", F.lit(0.0).alias("score"))
    if n <= 2:
        return none
    e = materialise(edges.filter("citing_id <> cited_id").select(F.col("citing_id").alias("v"), F.col("cited_id").alias("w")))
    levels = [materialise(e.select("v").distinct().select(F.col("v").alias("s"), "v", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("s", "v")
    while True:
        step = levels[-1].join(e, "v").groupBy("s", "w").agg(F.sum("paths").alias("paths")).withColumnRenamed("w", "v")
        step = materialise(step.join(seen, ["s", "v"], "left_anti"))
        if step.isEmpty():
            break
        levels.append(step)
        seen = materialise(seen.unionByName(step.select("s", "v")))
    total = None
    behind = levels[-1].withColumn("share", F.lit(0.0))
    for i in range(len(levels) - 1, 0, -1):
        inner = behind.filter("share > 0").select("v", "share")
        total = inner if total is None else total.unionByName(inner)
        back = behind.select("s", F.col("v").alias("w"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        given = levels[i - 1].join(e, "v").join(back, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("paths") * F.col("part")).alias("share"))
        behind = materialise(levels[i - 1].join(given, ["s", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0))))
    if total is None:
        return none
    sums = total.groupBy(F.col("v").alias("paper_id")).agg((F.sum("share") / ((n - 1) * (n - 2))).alias("s"))
    return nodes.select("paper_id").join(sums, "paper_id", "left").select("paper_id", F.coalesce("s", F.lit(0.0)).alias("score"))


def h_index(nodes: DataFrame, edges: DataFrame) -> int:
    """The largest h such that h nodes are cited h times or more, from a count per degree."""
    counts = degrees(nodes, edges).groupBy("in_degree").count()
    ranked = counts.withColumn("at_least", F.sum("count").over(Window.orderBy(F.col("in_degree").desc())))  # a row per degree
    return ranked.agg(F.max(F.least("in_degree", "at_least"))).first()[0] or 0


def h_contribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, score): 1 for the h most cited nodes, less for others in proportion, 0 for those never cited."""
    h = h_index(nodes, edges)
    placed = row_numbers(degrees(nodes, edges), [F.col("in_degree").desc(), F.col("paper_id")], "place")
    less = F.least(F.col("in_degree") / (h + 1), F.lit(0.9))
    return placed.select("paper_id", F.when(F.col("place") <= h, 1.0).when(F.col("in_degree") > 0, less).otherwise(0.0).alias("score"))


def bursts(nodes: DataFrame, window: int = 3, now: int | None = None) -> DataFrame:
    """(paper_id, score) of each node by year and citations; ``now`` is the latest year, or 2024 where none is known."""
    if now is None:
        now = nodes.agg(F.coalesce(F.max(F.nullif("year", F.lit(0))), F.lit(2024))).first()[0]
    return nodes.select("paper_id", citation_burst(F.col("year"), F.col("citations_count"), F.lit(now), window).alias("score"))


def top(scores: DataFrame, k: int | None = None) -> DataFrame:
    """(place, paper_id, score), best first, ties by id; the first ``k``, or all for None or 0."""
    order = [F.col("score").desc(), F.col("paper_id")]
    if k:
        some = scores.orderBy(*order).limit(k)
        return some.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "paper_id", "score")  # k rows
    return row_numbers(scores, order, "place").select("place", "paper_id", "score")


METRICS = {
    "pagerank": pagerank,
    "in_degree": lambda n, e: degree_centrality(n, e).select("paper_id", F.col("in_centrality").alias("score")),
    "out_degree": lambda n, e: degree_centrality(n, e).select("paper_id", F.col("out_centrality").alias("score")),
    "betweenness": betweenness,
    "h_index": h_contribution,
}


def rank(nodes: DataFrame, edges: DataFrame, metric: str, k: int | None = None) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return top(METRICS[metric](nodes, edge_set(edges, nodes)), k)


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, cap: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reached from ``seeds`` (paper_id) in ``depth`` rounds.

    In each round every paper of the front, in order, adds up to ``cap`` papers citing it and
    up to ``cap`` it cites; the first ``2 * cap`` of all added, repeats included, are the next
    front.  ``nodes`` is (paper_id, depth) at the first depth met, ``edges`` a set.
    """
    e = edge_set(edges)
    front = row_numbers(seeds.select("paper_id").distinct(), [F.col("paper_id")], "o")
    nodes = front.select("paper_id", F.lit(0).alias("depth"))
    found = None
    for d in range(1, depth + 1):
        into = e.join(front, e.cited_id == front.paper_id).select("o", F.lit(0).alias("side"), F.col("citing_id").alias("other"), "citing_id", "cited_id")
        out = e.join(front, e.citing_id == front.paper_id).select("o", F.lit(1).alias("side"), F.col("cited_id").alias("other"), "citing_id", "cited_id")
        place = F.row_number().over(Window.partitionBy("o", "side").orderBy("other"))
        added = materialise(into.unionByName(out).withColumn("nth", place).filter(F.col("nth") <= cap))  # 2 * cap per paper of the front
        nodes = nodes.unionByName(added.select(F.col("other").alias("paper_id"), F.lit(d).alias("depth")))
        new = added.select("citing_id", "cited_id")
        found = new if found is None else found.unionByName(new)
        order = [F.col("o"), F.col("side"), F.col("nth")]
        front = added.orderBy(*order).limit(2 * cap).select(F.row_number().over(Window.orderBy(*order)).alias("o"), F.col("other").alias("paper_id"))
    return nodes.groupBy("paper_id").agg(F.min("depth").alias("depth")), found.distinct()


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): the graph's nodes and edges as lines of JSON, and one line of its counts."""
    node = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    edge = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json"))
    counts = nodes.agg(F.count("*").alias("node_count"), F.lit(edges.count()).alias("edge_count"))
    return node.unionByName(edge).unionByName(counts.select(F.lit("stats").alias("kind"), F.to_json(F.struct("node_count", "edge_count")).alias("json")))


def from_json(lines: DataFrame, node_schema: str = "paper_id BIGINT, title STRING, year INT", edge_schema: str = "citing_id BIGINT, cited_id BIGINT") -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of the lines ``as_json`` writes."""
    read = lambda kind, schema: lines.filter(F.col("kind") == kind).select(F.from_json("json", schema).alias("r")).select("r.*")
    return read("node", node_schema), read("edge", edge_schema)
