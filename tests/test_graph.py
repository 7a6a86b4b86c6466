"""Toy graphs with known results."""

import itertools
import os

import pytest

from graphloom.operators import embed, graph

G1 = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "B"), ("D", "C")]
G4 = [("A", "B"), ("B", "C"), ("D", "B"), ("B", "E")]
G5 = [("Alice", "Bob"), ("Bob", "Carol"), ("Carol", "Dave"), ("Alice", "Eve"), ("Bob", "Carol")]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def start(spark, node):
    return spark.createDataFrame([(node,)], "node string")


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def test_pagerank(spark):
    r = values(graph.pagerank(edges(spark, G1), iterations=50))
    assert r == pytest.approx({"A": 0.314958, "B": 0.321121, "C": 0.326421, "D": 0.0375}, abs=1e-6)
    r = values(graph.pagerank(edges(spark, G5), iterations=20))
    assert r == pytest.approx({"Alice": 0.03, "Bob": 0.04275, "Eve": 0.04275, "Carol": 0.066338, "Dave": 0.086387}, abs=1e-6)
    assert sum(values(graph.pagerank(edges(spark, G5), redistribute=True)).values()) == pytest.approx(1)


def test_components(spark):
    two = [("A", "B"), ("C", "D")]
    assert len(set(values(graph.scc(edges(spark, two))).values())) == 4
    assert values(graph.wcc(edges(spark, two))) == {"A": "A", "B": "A", "C": "C", "D": "C"}
    assert values(graph.scc(edges(spark, G1))) == {"A": "A", "B": "A", "C": "A", "D": "D"}


def test_components_of_a_long_chain_and_cycles(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)]
    assert set(values(graph.wcc(edges(spark, chain))).values()) == {"n000"}
    assert values(graph.scc(edges(spark, [*chain[:6], ("n002", "n001"), ("n005", "n004"), ("x", "x")]))) == {"n000": "n000", "n001": "n001", "n002": "n001", "n003": "n003", "n004": "n004", "n005": "n004", "n006": "n006", "x": "x"}


def test_shortest_paths(spark):
    e = edges(spark, [("A", "B"), ("B", "C")])
    assert graph.shortest_paths(e, "A", "C").first().path == ["A", "B", "C"]
    assert graph.shortest_paths(e, "C", "A").count() == 0
    assert graph.shortest_paths(e, "A", "A").first().path == ["A"]
    assert graph.shortest_paths(e, "X", "A").count() == 0


def test_betweenness(spark):
    b = values(graph.betweenness(edges(spark, G4)))
    assert b == pytest.approx({"A": 0, "B": 1 / 3, "C": 0, "D": 0, "E": 0})


def test_path_counts(spark):
    e = edges(spark, G5)
    assert values(graph.path_counts(e, "Alice", 5, "Carol")) == {"Carol": 2}
    assert values(graph.path_counts(e, "Alice", 5))["Dave"] == 2
    assert values(graph.path_counts(e, "Alice", 5, "Alice")) == {"Alice": 1}


def test_bfs_and_neighbours(spark):
    e = edges(spark, G5)
    assert values(graph.bfs(e, start(spark, "Alice"), 2)) == {"Alice": 0, "Bob": 1, "Eve": 1, "Carol": 2}
    chain = edges(spark, [("A", "B"), ("B", "C")])
    assert [graph.neighbours(chain, "A", d).count() for d in (0, 1, 2)] == [0, 1, 2]
    with pytest.raises(ValueError):
        graph.neighbours(chain, "A", 11)


def test_degrees_count_loops_twice(spark):
    assert graph.degrees(edges(spark, [("A", "A"), ("A", "B")])).where("node = 'A'").first().degree == 3


def test_spectral_is_orthonormal_and_both_ways_agree(spark):
    import numpy as np

    rows = [(f"n{i:02d}", f"n{j:02d}") for i, j in itertools.combinations(range(12), 2) if (i * j + i) % 3 == 0 or j == i + 1]
    e = edges(spark, rows)
    v = {r.node: r.vec for r in embed.spectral(e, 3).collect()}
    m = np.array([v[k] for k in sorted(v)])
    assert np.allclose(m.T @ m, np.eye(3), atol=1e-8)
    w = {r.node: r.vec for r in embed.spectral(e, 3, dense=0, rounds=90).collect()}
    n = np.array([w[k] for k in sorted(w)])
    assert np.allclose(np.abs(np.linalg.svd(m[:, :1].T @ n[:, :1])[1]), 1, atol=1e-2)
    assert embed.spectral(edges(spark, [("A", "A")]), 2).count() == 0
    assert len(embed.spectral(edges(spark, [("A", "B")]), 4).first().vec) == 4


def test_walks_follow_edges_and_repeat(spark):
    e = edges(spark, G5)
    a = sorted(map(tuple, (r.path for r in embed.walks(e, 3, 6, 1.0, 0.5).collect())))
    near = {frozenset(x) for x in G5}
    assert a == sorted(map(tuple, (r.path for r in embed.walks(e, 3, 6, 1.0, 0.5).collect())))
    assert all(frozenset(p) in near for w in a for p in itertools.pairwise(w)) and all(len(w) == 6 for w in a)


def test_walks_take_what_the_weights_say(spark):
    star = edges(spark, [("hub", f"n{i}") for i in range(40)] + [("n0", "n1"), ("lone", "lone")])
    home = [r.path for r in embed.walks(star, 20, 3, 1.0, 1e-6).collect() if r.path[0] == "n0"]
    assert {r.path[0] for r in embed.walks(star, 1, 4).collect()} == {"hub", "lone", *(f"n{i}" for i in range(40))}
    ends = {r.a for r in graph.both_ways(star).groupBy("a").count().where("count = 1").collect()}
    assert all(len(w) == 3 and w[2] != w[0] for w in home if w[1] not in ends)
    far = [r.path for r in embed.walks(star, 20, 3, 1e-6, 1.0).collect() if r.path[0] != "lone"]
    assert all(w[2] == w[0] for w in far)
    assert {r["path"][1] for r in embed.walks(star, 400, 2).where("path[0] = 'hub'").select("path").collect()} == {f"n{i}" for i in range(40)}
    assert [r.path for r in embed.walks(star, 1, 5).where("path[0] = 'lone'").collect()] == [["lone"]]


def test_approximate_search_recalls(spark):
    import numpy as np

    from graphloom.operators import search

    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(400)], "id long, vec array<double>")
    q = rng.normal(size=16).tolist()
    a, b = ({r.id for r in f(v, q, 10).collect()} for f in (embed.ann, search.knn))
    assert len(a & b) >= 7


def test_spring(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "node string, vec array<double>")
    got = values(embed.spring(v, edges(spark, [("a", "b")])))
    assert got["a"] == pytest.approx([0.9, 0.1, 0]) and got["b"] == pytest.approx([0.1, 0.9, 0])


def test_long_chains_are_walked_to_the_end(spark):
    n = 70
    e = edges(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(n)]).coalesce(1)
    assert graph.shortest_paths(e, "n00", f"n{n:02d}").first().hops == n
    b = values(graph.betweenness(e, start(spark, "n00")))
    assert b == pytest.approx({f"n{i:02d}": (n - i) / (n * (n - 1)) if 0 < i < n else 0 for i in range(n + 1)})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no fixture tables")
def test_approximate_search_recalls_nine_of_ten(spark):
    from graphloom.operators import search
    from graphloom.sources import fixture

    v = fixture.vectors(spark, "/root/testdata/sf0.001").cache()
    every = {r.id: r.vec for r in v.collect()}
    hits = [len({r.id for r in embed.ann(v, every[i], 10).collect()} & {r.id for r in search.knn(v, every[i], 10).collect()}) for i in sorted(every)[::25]]
    print("mean recall at 10:", sum(hits) / len(hits) / 10, "over", len(hits), "queries")
    assert sum(hits) >= 9 * len(hits)
