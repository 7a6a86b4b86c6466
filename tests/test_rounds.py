"""Loops over large graphs: what a round moves, and that results stay those of the plain way."""

import random

import pytest

from graphloom.operators import embed, graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


STAR = [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", f"n{i * 7 % 40}") for i in range(40)] + [("lone", "lone"), ("a", "b"), ("a", "b")]


@pytest.mark.parametrize("chunk,hub", [(7, 10), (1, 3)])
def test_walks_do_not_depend_on_rows_of_neighbours(spark, monkeypatch, chunk, hub):
    got = lambda: sorted((r.walk, *r.path) for r in embed.walks(frame(spark, STAR), 3, 6, 0.5, 2.0).collect())
    whole = got()
    assert {(r[1]) for r in whole} == {x for e in STAR for x in e} and ("lone#1", "lone") in whole
    monkeypatch.setattr(embed, "CHUNK", chunk)
    monkeypatch.setattr(embed, "HUB", hub)
    assert got() == whole


@pytest.fixture
def large(spark):
    """Plans as for tables that are too large to be sent to every task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_step_of_walks_moves_no_neighbours(spark, large):
    text = plan(embed.walks(frame(spark, STAR), 2, 5))
    assert text.count("Bucketed: true") >= 4 and text.count("Exchange hashpartitioning(element_at(path") == 4
    assert text.split("Exchange hashpartitioning(element_at(path")[1].count("Exchange") == 0


def test_components_of_many_shapes(spark):
    rnd = random.Random(4)
    pairs = [(f"v{rnd.randrange(80):02}", f"v{rnd.randrange(80):02}") for _ in range(60)] + [(f"z{i + 1:02}", f"z{i:02}") for i in range(40)] + [("y", "y")]
    pairs += [(f"p{i * 7 % 40:02}", f"p{(i + 1) * 7 % 40:02}") for i in range(39)]
    at = {x: x for e in pairs for x in e}
    for _ in at:
        for a, b in pairs:
            at[a] = at[b] = min(at[a], at[b])
    assert {r.node: r.component for r in graph.wcc(frame(spark, pairs)).collect()} == at


def test_edges_of_components_are_not_written(spark, monkeypatch):
    sizes = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df: (lambda x: (sizes.append(x.count()), x)[1])(keep(df)))
    # 400 edges between 20 nodes and a hub in a few rounds: rows of nodes only
    pairs = [(f"n{i % 20:02}", "a") for i in range(400)]
    assert {r.component for r in graph.wcc(frame(spark, pairs)).collect()} == {"a"}
    assert sizes and max(sizes) <= 21


def test_a_round_of_spectral_moves_no_entries(spark, large, monkeypatch):
    plans = []
    keep = embed.settle
    monkeypatch.setattr(embed, "settle", lambda df: (plans.append(plan(df)), keep(df))[1])
    ring = [(f"n{i:02}", f"n{(i + 1) % 12:02}") for i in range(12)] + [("n00", "n05")]
    got = {r.node: r.vec for r in embed.spectral(frame(spark, ring), 2, dense=0, rounds=3).collect()}
    assert len(got) == 12
    rounds = [p for p in plans if p.count("Bucketed: true") == 3]
    # the start is dealt once, and each round's sums are dealt by node
    assert len(rounds) == 1 and rounds[0].count("Exchange") == 4


def test_many_walks_are_learnt_by_several_tasks(spark, monkeypatch):
    import pyspark.ml.feature as ml

    asked, keep = [], ml.Word2Vec.fit
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda self, df: (asked.append(self.getNumPartitions()), keep(self, df))[1])
    monkeypatch.setattr(embed, "ALONE", 50)
    got = embed.node2vec(frame(spark, STAR), 4, per_node=3, length=4)
    assert {r.node for r in got.collect()} == {x for e in STAR for x in e} and asked == [3]
