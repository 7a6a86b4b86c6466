"""Scalars, stores, learning, exchange, retrieval control."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ids, scores
from graphloom.functions.vectors import cosine
from graphloom.operators import exchange, learning, resilience, search, store

FACT = "s string, p string, o string, w double, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def facts(spark, rows):
    return spark.createDataFrame([(s, p, o, 1.0, T0) for s, p, o in rows], FACT)


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_scalars(spark):
    for x, want in ((1, 1), (0, 0.5), (-1, 0)):
        assert value(spark, scores.unit(F.lit(x))) == want
    for days, want in ((0, 1), (30, 0.5), (60, 0.25), (-5, 1)):
        assert value(spark, scores.recency(F.lit(T0 - dt.timedelta(days=days)), F.lit(T0))) == pytest.approx(want)
    for d, want in ((0, 1), (5, 0.5), (10, 0), (20, 0)):
        assert value(spark, scores.nearness(F.lit(d))) == want
    for n, want in ((0, 0), (1, 0.1), (5, 0.5), (30, 1)):
        assert value(spark, scores.support(F.lit(n))) == want
    f = scores.fusion(scores.FUSION["default"], F.lit(0.8), F.lit(0.6), scores.recency(F.lit(T0 - dt.timedelta(days=30)), F.lit(T0)), F.lit(2), F.lit(3))
    assert value(spark, f) == pytest.approx(0.675)
    assert value(spark, scores.activation(F.lit(0.5), F.lit(1.0), F.lit(1))) == pytest.approx(0.25 + 0.3 + 0.2 * math.log(2) / math.log(11))
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    for v, want in (((2, 0), 1), ((0, 1), 0), ((-1, 0), -1), ((0, 0), 0)):
        assert value(spark, cosine(a(1, 0), a(*v))) == want
    assert value(spark, scores.adjusted(F.lit(1.0), F.lit("cited"))) == 1.5
    assert value(spark, scores.adjusted(F.lit(1.0), F.lit("cited"), "hybrid")) == 1.0
    assert value(spark, scores.blend((0.5, 0.3, 0.2), F.lit(None).cast("double"), F.lit(0.4), F.lit(None).cast("double"))) == pytest.approx(0.4)
    with pytest.raises(ValueError):
        scores.FusionWeights(0.5, 0.5, 0.5, 0, 0)


def test_identity_is_by_content(spark):
    t = store.triples(facts(spark, [("A", "knows", "B"), ("A", "knows", "B"), ("B", "knows", "A")]))
    assert t.count() == 2 and store.nodes(facts(spark, [("A", "knows", "B")])).count() == 2
    assert value(spark, ids.predicate_id(F.lit("p"))) == value(spark, ids.node_id(F.lit("predicate:p")))


def test_stats_and_matching(spark):
    f = facts(spark, [("A", "knows", "B"), ("B", "likes", "C")])
    t, n = store.triples(f), store.nodes(f)
    s = store.stats(t).first()
    assert (s.n_triples, s.n_nodes, s.avg_weight) == (2, 3, 1.0)
    assert store.match_values(t, n, subject="A").count() == 1
    assert store.match_values(t, n, subject="nobody").count() == 0
    assert store.match_values(t, n, subject="nobody", strict=False).count() == 2
    assert store.search_nodes(n, "b", 5).first().value == "B"
    assert store.match(t, limit=1).count() == 1


def test_decay_evict_bounds(spark):
    t = store.triples(facts(spark, [(f"s{i}", "p", f"o{i}") for i in range(10)]))
    half = learning.decay(learning.decay(t, 0.5), 0.5)
    assert {r.local_weight for r in half.collect()} == {0.25}
    assert learning.evict(half, 0.3).count() == 0 and learning.evict(t, 0).count() == 10 and learning.evict(t, 1.1).count() == 0
    assert learning.enforce(t, 10).count() == 8 and learning.enforce(t, 100).count() == 10
    assert learning.utilisation(8000, 1000) == 0.8
    with pytest.raises(ValueError):
        learning.decay(t, 1.5)


def test_co_access_and_reinforcement(spark):
    ctx = spark.createDataFrame([(f"c{i}", [1, 2], T0) for i in range(10)] + [("x", [3], T0)], "context string, refs array<int>, ts timestamp_ntz")
    pairs = learning.pair_counts(ctx, 3)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 10)]
    f = spark.createDataFrame([(1, "Alice", "Bob"), (2, "Charlie", "Diana"), (3, "Eve", "Frank")], "ref int, src string, dst string")
    new = learning.reinforce(pairs, f, f.select("src", "dst"))
    assert new.count() == 2
    assert learning.reinforce(pairs, f, f.select("src", "dst").unionByName(new)).count() == 0
    assert learning.pair_counts(ctx, 11).count() == 0


def test_blend_tuner(spark):
    rows = [("c", "cited", 0.9, 0.2, 0.1), ("c", "cited", 0.85, 0.15, 0.1), ("d", "cited", None, None, None)]
    a = spark.createDataFrame(rows, "context string, signal string, spring double, node2vec double, spectral double")
    r = learning.blend_step(a).collect()
    assert len(r) == 1 and tuple(r[0])[1:] == pytest.approx((0.760870, 0.152174, 0.086957), abs=1e-6)
    assert learning.blended((0.34, 0.33, 0.33), tuple(r[0])[1:]) == pytest.approx((0.344167, 0.328239, 0.327594), abs=1e-6)
    assert learning.blended((2, 1, 1), (0, 0, 0)) == pytest.approx((0.5, 0.25, 0.25))
    assert learning.blended((0, 0, 0), (0, 0, 0), least=0.0) == pytest.approx((1 / 3,) * 3)


def test_patterns(spark):
    p = spark.createDataFrame([(1, 0.65, "emerging", [4], "a b"), (2, 0.1, "emerging", [4], "B c"), (3, 0.05, "archived", [4], "x")], "id int, confidence double, status string, sessions array<bigint>, description string")
    e = spark.createDataFrame([(1, 4), (1, 5)], "id int, session long")
    r = {x.id: x for x in learning.reinforce_patterns(p, e).collect()}
    assert r[1].confidence == pytest.approx(0.85) and r[1].status == "established" and r[1].sessions == [4, 5] and r[2].confidence == 0.1
    d = {x.id: x for x in learning.decay_patterns(p).collect()}
    assert d[2].status == "archived" and d[3].confidence == 0.05 and d[1].status == "emerging"
    assert [x.id for x in learning.search_patterns(p, "B", 5).collect()] == [1, 2]


def known(spark, rows, base=0.5):
    f = facts(spark, rows)
    a, b = ids.node_id(F.col("s")), ids.node_id(F.col("o"))
    return f.select(ids.triple_id(a, F.col("p"), b).alias("id"), "s", "p", "o", F.lit(base).alias("base_weight"), F.lit(1.0).alias("local_weight"))


def test_merge_laws(spark):
    mine, sent = known(spark, [("A", "p", "B")], 0.98), known(spark, [("A", "p", "B"), ("C", "p", "D")]).withColumn("origin_did", F.lit("did:x"))
    none = facts(spark, []).select("s", "p", "o")
    r = {x.s: x for x in exchange.merge(mine, sent, none).collect()}
    assert r["A"].base_weight == 1.0 and r["C"].base_weight == 0.1 and r["C"].local_weight == 0
    forged = sent.withColumn("o", F.lit("Z"))
    assert exchange.merge(mine, forged, none).count() == 1
    gone = mine.select(F.col("id").alias("s"), F.lit("retracted_by").alias("p"), F.lit("local").alias("o"))
    assert {x.s: x.base_weight for x in exchange.merge(mine, sent, gone).collect()} == {"A": 0.98, "C": 0.1}
    ab = {x.id for x in exchange.merge(mine, sent, none).collect()}
    ba = {x.id for x in exchange.merge(sent.drop("origin_did"), mine.withColumn("origin_did", F.lit("y")), none).collect()}
    assert ab == ba
    assert exchange.missing(sent, mine).count() == 1


def test_shareability(spark):
    t = known(spark, [("A", "p", "B"), ("C", "p", "D"), ("E", "p", "F"), ("A", "retracted_by", "x")]).select("id", "s", "p", "o")
    pol = spark.createDataFrame([("A", "local_only", "true"), ("C", "shareable_with", "did:a")], "s string, p string, o string")
    ok = lambda who: sorted((r.s, r.p) for r in exchange.shareable(t, pol, who).collect())
    assert ok("did:a") == [("A", "retracted_by"), ("C", "p"), ("E", "p")]
    assert ok("did:b") == ok(None) == [("A", "retracted_by"), ("E", "p")]


def test_beliefs(spark):
    rows = spark.createDataFrame([(1, "x" * 300, ["tech", "rust"], [("9", "Ann", "person", "subject")])], "id int, content string, path array<string>, entities array<struct<id:string,name:string,type:string,role:string>>")
    f = {(r.s, r.p): r.o for r in exchange.beliefs(rows).collect()}
    assert len(f[("belief:1", "has_content")]) == 203
    assert f[("belief:1", "belongs_to_domain")] == "domain:tech/rust" and f[("domain:tech/rust", "subdomain_of")] == "domain:tech"
    assert f[("belief:1", "about")] == "entity:person:9"


def test_tiers(spark):
    rows = [(str(i), i, T0 + dt.timedelta(hours=i)) for i in range(6)]
    cold = spark.createDataFrame(rows, "id string, access_count long, last_accessed timestamp_ntz")
    hot = cold.where("access_count >= 4")
    assert store.read_tiers(hot, cold).count() == 6
    assert {r.id for r in store.promotable(cold, hot).collect()} == {"3"}
    assert store.promotable(cold, hot, "immediate").count() == 4
    assert {r.id for r in store.promotable(cold, hot, "frequency", as_of=F.lit(T0 + dt.timedelta(hours=3)), hours=1).collect()} == {"3"}
    assert [r.id for r in store.over_capacity(hot, 1).collect()] == ["4"]
    assert store.idle(hot, F.lit(T0 + dt.timedelta(hours=6)), 1).count() == 1


def test_tensions_and_resolution(spark):
    t = store.triples(facts(spark, [("A", "is", "x"), ("A", "is", "y"), ("A", "knows", "B"), ("A", "knows", "C")]))
    x = store.tensions(t)
    assert x.count() == 1 and x.first().severity == "high" and store.tensions(t, "medium").count() == 0
    assert sorted(r.local_weight for r in store.resolve_tensions(t, x, "keep_a").collect()) == [0.1, 1, 1, 1]
    assert store.resolve_tensions(t, x, "archive_both").where("local_weight < 1").count() == 2


def test_resilience():
    h = resilience.Health()
    assert h.level == "full"
    h.failed("embeddings")
    assert h.level == "cold"
    h.failed("graph")
    assert h.level == "minimal"
    h.failed("storage")
    assert h.level == "offline"
    for part in ("storage", "graph", "embeddings"):
        for _ in range(3):
            h.succeeded(part)
    assert h.level == "full"
    assert resilience.with_fallback(lambda: 1 / 0, lambda: 7)[0] == 7


def test_search_falls_back_and_budgets(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "src string, dst string")
    v = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.9, 0.1])], "node string, vec array<double>")
    assert [r.node for r in search.search(e, v, "C", 10).collect()] == ["C", "B", "D", "A"]
    assert search.search(e, v, "A", 10).first().node == "A"
    out, tier = search.tiered(e, v, None, "A", 5, search.Budget(1000, clock=iter(range(99)).__next__))
    assert tier == 1
    with pytest.raises(ValueError):
        search.check_k(0)
    with pytest.raises(ValueError):
        search.Budget(0)
    c = search.combined(e, v, "A", "B", 2, 5)
    assert [r.node for r in c.collect()][:2] == ["A", "B"] and {r.node: r.score for r in c.collect()}["C"] == pytest.approx(0.5 / 3, abs=1e-6)
    text = spark.createDataFrame([("A", "knows", "B", 0.5)], "src string, predicate string, dst string, score double")
    assert search.render(text).startswith("## A") and search.render(text, "plain") == "A knows B" and '"knows"' in search.render(text, "json")
