import itertools
import random

from folioweave.operators import graph
from folioweave.operators.components import connected_components

EDGES = [(2, 1), (3, 1), (1, 4), (2, 4)]


def tables(spark, edges=EDGES, n=4):
    nodes = spark.createDataFrame([(i, "t", 2020, 3) for i in range(1, n + 1)], "paper_id bigint, title string, year int, citations_count bigint")
    return nodes, graph.edge_set(spark.createDataFrame(edges + edges[:1] + [(1, 99)], "citing_id bigint, cited_id bigint"), nodes)


def scores(df):
    return {r[0]: r.score for r in df.collect()}


def test_fixture_graph(spark):
    nodes, edges = tables(spark)
    assert edges.count() == 4
    d = {r.paper_id: (r.in_degree, r.out_degree) for r in graph.degrees(nodes, edges).collect()}
    assert d == {1: (2, 1), 2: (0, 2), 3: (0, 1), 4: (2, 0)}
    c = {r.paper_id: round(r.in_centrality, 6) for r in graph.degree_centrality(nodes, edges).collect()}
    assert c == {1: 0.666667, 2: 0, 3: 0, 4: 0.666667}
    p = scores(graph.pagerank(nodes, edges))
    assert abs(p[1] - 0.0853125) < 1e-9 and abs(p[4] - 0.125953125) < 1e-9 and abs(p[2] - 0.0375) < 1e-9
    assert abs(sum(scores(graph.pagerank(nodes, edges, dangling=True)).values()) - 1) < 1e-6
    b = scores(graph.betweenness(nodes, edges))
    assert abs(b[1] - 1 / 6) < 1e-12 and b[2] == b[3] == b[4] == 0
    assert graph.h_index(nodes, edges) == 2
    assert scores(graph.h_contribution(nodes, edges)) == {1: 1.0, 4: 1.0, 2: 0.0, 3: 0.0}
    assert [r.paper_id for r in graph.rank(nodes, edges, "in_degree", 2).orderBy("place").collect()] == [1, 4]


def brute_betweenness(n, edges):
    out = {i: 0.0 for i in range(1, n + 1)}
    nxt = {i: [w for v, w in edges if v == i] for i in out}
    dist = {}
    paths = {}
    for s in out:
        d, p, front = {s: 0}, {s: 1}, [s]
        while front:
            new = []
            for v in front:
                for w in nxt[v]:
                    if w not in d:
                        d[w] = d[v] + 1
                        p[w] = 0
                        new.append(w)
                    if d[w] == d[v] + 1:
                        p[w] += p[v]
            front = new
        dist[s], paths[s] = d, p
    for s, t, v in itertools.permutations(out, 3):
        if t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
            out[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_brute_force(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randint(1, 14), rng.randint(1, 14)) for _ in range(30)})
    nodes, e = tables(spark, edges, 14)
    got, want = scores(graph.betweenness(nodes, e)), brute_betweenness(14, [x for x in edges if x[0] != x[1]])
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_expand(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (1, 4), (5, 2), (6, 3), (4, 7), (7, 8)], "citing_id bigint, cited_id bigint")
    seeds = spark.createDataFrame([(1,)], "paper_id bigint")
    nodes, found = graph.expand(edges, seeds, 2, 10)
    assert {r.paper_id: r.depth for r in nodes.collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}
    assert found.count() == 6
    nodes, _ = graph.expand(edges, seeds, 1, 1)
    assert {r.paper_id for r in nodes.collect()} == {1, 2, 4}


def test_json_round_trip(spark):
    nodes, edges = tables(spark)
    lines = graph.as_json(nodes.select("paper_id", "title", "year"), edges)
    back_nodes, back_edges = graph.from_json(lines)
    assert back_nodes.count() == 4 and back_edges.exceptAll(edges).isEmpty()


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    assert got == {x: find(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
