"""Steps that must not grow faster than their input: same results as the plain way, and plans without what made them grow."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import exchange, learning, store
from graphloom.plans import catalogue
from graphloom.sources import fixture

SF = "/root/testdata/sf0.001"
fixtures = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@fixtures
@pytest.mark.parametrize("name", ["shares_list", "lru_demote", "idle_demote"])
def test_a_pattern_reads_its_tables_only(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert "l_partkey" not in text and "ps_" not in text and "part:" not in text


@fixtures
def test_lines_are_dealt_once(spark):
    t = fixture.stored(spark, SF).where("predicate = 'contains'")
    assert t.select("id", "w")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(l_orderkey") == 1


@pytest.mark.parametrize("few", [10_000, 5])
def test_marked_is_the_plain_order(spark, monkeypatch, few):
    monkeypatch.setattr(store, "FEW", few)
    rnd = random.Random(3)
    rows = [(f"t{i:03}", rnd.choice([None, 0.1, 0.2, 0.5, 0.9])) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, w double").repartition(3)
    by = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for k in (0, 1, 4, 90, 100, 197, 200):
        got = {r.id for r in store.marked(df, ["w", "id"], 200, k).where("_first").collect()}
        assert got == {r[0] for r in by[:k]}


def test_bounds_look_for_one_row(spark):
    t = spark.range(300).select(F.format_string("t%03d", "id").alias("id"), (F.col("id") % 7 / 7.0).alias("local_weight"))
    kept = learning.enforce(t, 100)
    assert kept.count() == 80
    assert "LeftAnti" not in plan(kept)
    out = store.over_capacity(t.withColumnRenamed("local_weight", "last_accessed"), 20)
    assert out.count() == 280 and "280" not in plan(out)


@pytest.mark.parametrize("action", ["keep_a", "keep_b", "keep_both", "archive_both"])
def test_tensions_settle_without_pairs(spark, action):
    rnd = random.Random(5)
    rows = [(f"t{i:02}", f"s{rnd.randint(0, 3)}", rnd.choice(["is", "knows", "has"]), f"o{rnd.randint(0, 2)}", rnd.choice([0.0, 0.5, 1.0])) for i in range(60)]
    t = spark.createDataFrame(rows, "id string, subject string, predicate string, object string, local_weight double")
    want = {r.id: r.local_weight for r in store.resolve_tensions(t, store.tensions(t), action).collect()}
    out = store.resolve_all_tensions(t, action)
    assert {r.id: r.local_weight for r in out.collect()} == want
    assert "Join" not in plan(out)


def test_headers_by_bytes(spark):
    t = spark.createDataFrame([("00" * 16, "a"), ("11" * 16, "b"), ("22" * 16, "c")], "id string, s string")
    have = exchange.headers(t, t.where("s < 'z'").select(F.sha2(F.unhex("id"), 256).alias("hash"))).collect()
    asked = [r.hash for r in have if r.s == "a"] * 2 + [r.hash.upper() for r in have if r.s == "b"] + ["no hash"]
    got = exchange.headers(t, spark.createDataFrame([(x,) for x in asked], "hash string"))
    assert [r.s for r in got.collect()] == ["a"] and "_key" in plan(got)


def plain_ranks(edges, iterations):
    nodes = {x for e in edges for x in e}
    out = {x: sum(a == x for a, _ in edges) for x in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(iterations):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("iterations", [1, 4, 9])
def test_pagerank_works_off_layers(spark, iterations):
    from graphloom.operators import graph

    # a chain with a shortcut and a double edge into a cycle that leaves for another chain, a loop, and a separate pair
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("f", "g"), ("g", "h"), ("l", "l"), ("x", "y")]
    got = graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), iterations=iterations)
    assert {r.node: r.rank for r in got.collect()} == pytest.approx(plain_ranks(edges, iterations))


def test_pagerank_of_layers_does_not_iterate(spark):
    from graphloom.operators import graph

    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("layers", "layers")
    graph.pagerank(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), iterations=60).collect()
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(seen.getJobIdsForGroup("layers")) < 150


@pytest.mark.parametrize("few", [200_000, 0])
def test_steps_do_not_move_all_edges(spark, monkeypatch, few):
    from graphloom.operators import graph
    from graphloom.sources import scratch

    monkeypatch.setattr(scratch, "FEW_ROWS", few)
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "d"), ("x", "y"), ("a", "b")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    near = graph.neighbours(e, "b", 2)
    assert sorted(map(tuple, near.collect())) == sorted(p for p in pairs if {"a", "b", "c"} & set(p))
    assert ("Exchange hashpartitioning(src" in near._jdf.queryExecution().executedPlan().toString()) == (not few)
    assert {r.node: r.dist for r in graph.bfs(e, spark.sql("SELECT 'a' AS node"), 3, directed=True).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node: r.path for r in graph.shortest_paths(e, "a").collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "c", "d"]}
    assert graph.shortest_paths(e, "nobody").count() == 0


def test_confidence_takes_counts_that_facts_carry(spark):
    from graphloom.operators import search

    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    f = e.selectExpr("src || dst AS id", "src", "dst", "2L AS n_sources")
    for context in (None, "a"):
        assert search.confidence(e, f, None, context).orderBy("id").collect() == search.confidence(e, f.drop("n_sources"), f, context).orderBy("id").collect()


@fixtures
def test_neighbours_filter_the_lines_before_grouping(spark):
    from graphloom.operators import graph

    text = re.sub(r"#\d+L?", "", plan(graph.neighbours(catalogue.fact_rows(spark, SF), "part:1", 2).select("src", "dst", "weight")))
    assert text.count("LeftSemi, (concat(order:, cast(l_orderkey") == 1 and text.count("LeftSemi, (concat(part:, cast(l_partkey") == 2  # contains from both ends, supplies from one


@pytest.mark.parametrize("few", [200_000, 0])
def test_neighbours_keep_each_edge_once(spark, monkeypatch, few):
    from graphloom.operators import graph, search
    from graphloom.sources import scratch

    monkeypatch.setattr(scratch, "FEW_ROWS", few)
    rnd = random.Random(9)
    rows = [(rnd.choice("abcdefghij"), rnd.choice(["a", "b", "c", "d", "h", "i", "j", None]), rnd.choice([0.25, 0.5, 1.0])) for _ in range(40)] + [("a", "a", 0.5), (None, "a", 1.0)]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    near = {"a"} | {x for s, o, _ in rows if "a" in (s, o) for x in (s, o)} - {None}
    met = [r for r in rows if near & {r[0], r[1]}]
    assert sorted(map(str, map(tuple, graph.neighbours(e, "a", 2).collect()))) == sorted(map(str, met))
    ends = [(x, w) for s, o, w in met for x in (s, o)]
    want = {x: (max(w for y, w in ends if y == x), sum(y == x for y, _ in ends)) for x, _ in ends}
    assert {r.node: (r.confidence, r.times) for r in search.graph_working_set(e, "a", 2).collect()} == want


@fixtures
def test_lines_are_dealt_by_size(spark, monkeypatch):
    shares = lambda: {r.n for r in fixture.stored(spark, SF).where("predicate = 'contains'").select(F.spark_partition_id().alias("n")).distinct().collect()}
    want = sorted(map(tuple, fixture.edges(spark, SF).where("p = 'contains'").select("s", "o", "w", "ts").collect()))
    size = os.path.getsize(f"{SF}/lineitem.parquet")
    monkeypatch.setattr(fixture, "PIECE", size // 20)
    assert len(shares()) >= 20
    assert sorted(map(tuple, fixture.edges(spark, SF).where("p = 'contains'").select("s", "o", "w", "ts").collect())) == want


def test_tier_three_asks_for_its_nodes_only(spark):
    from graphloom.operators import search

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.9]), ("c", [0.1, 1.0]), ("d", [0.0, 1.0]), ("y", [-1.0, 0.0])], "node string, vec array<double>")
    f = e.selectExpr("src || dst AS id", "src", "dst", "2L AS n_sources")
    asked, clock = [], iter([0] * 99)

    def conf_of(context, near):
        asked.extend(r.node for r in near.collect())
        return search.confidence(e, f.join(near.selectExpr("node AS src"), "src", "left_semi"), None, context)

    out, tier = search.tiered(e, v, conf_of, "a", 3, search.Budget(1000, results=3, clock=clock.__next__))
    whole, _ = search.tiered(e, v, lambda context, near: search.confidence(e, f, None, context), "a", 3, search.Budget(1000, results=3, clock=iter([0] * 99).__next__))
    assert tier == 3 and set(asked) == {"a", "b", "c", "d", "y", "x"} and len(asked) == 6
    assert out.orderBy("node").collect() == whole.orderBy("node").collect() and out.count() == 3


@fixtures
def test_facts_of_few_nodes_filter_the_lines_before_grouping(spark):
    near = spark.range(30).select(F.format_string("order:%d", "id").alias("node"))
    got = catalogue.fact_rows(spark, SF, near)
    assert "LeftSemi, (concat(order:, cast(l_orderkey" in re.sub(r"#\d+L?", "", plan(got))
    few = [r.node for r in near.collect()]
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in catalogue.fact_rows(spark, SF).where(F.col("src").isin(few)).collect())


@pytest.mark.parametrize("few", [200_000, 0])
def test_edges_between_nodes_are_sieved_first(spark, monkeypatch, few):
    from graphloom.operators import graph
    from graphloom.sources import scratch

    monkeypatch.setattr(scratch, "FEW_ROWS", few)
    rnd = random.Random(11)
    rows = [tuple(rnd.choice(["n%03d" % rnd.randint(0, 299), None] if rnd.random() < 0.02 else ["n%03d" % rnd.randint(0, 299)]) for _ in range(2)) for _ in range(3000)]
    e = spark.createDataFrame(rows, "src string, dst string")
    nodes = spark.range(0, 300, 3).select(F.format_string("n%03d", "id").alias("node"))
    keep = {r.node for r in nodes.collect()}
    want = sorted(r for r in rows if set(r) <= keep)
    assert sorted(map(lambda r: (r.src, r.dst), graph._between(e, nodes).collect())) == want
    assert want == sorted((r.src, r.dst) for r in graph._sieved(e, nodes, "src", "dst").collect())  # 100 names in 2 ** 27 bits
    assert {r.node: r.component for r in graph.scc(e.na.drop()).collect()} == strong([r for r in rows if None not in r])


def strong(edges):
    out = {x: set() for e in edges for x in e}
    for a, b in edges:
        out[a].add(b)

    def far(x):
        seen, todo = {x}, [x]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    reach = {x: far(x) for x in out}
    return {x: min(y for y in reach[x] if x in reach[y]) for x in out}


@fixtures
def test_trimming_moves_no_line_that_leaves(spark, monkeypatch):
    from graphloom.operators import graph
    from graphloom.sources import scratch

    monkeypatch.setattr(scratch, "FEW_ROWS", 0)
    nodes = spark.range(5).select(F.format_string("customer:%d", "id").alias("node"))
    text = re.sub(r"#\d+L?", "", plan(graph._between(catalogue.links(spark, SF), nodes)))
    below = text[text.index("RepartitionByExpression [l_orderkey]") :]
    assert "LeftSemi" in below[: below.index("Relation")] and "_map" in below[: below.index("Relation")]
