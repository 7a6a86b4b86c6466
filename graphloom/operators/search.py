"""Vector search, confidence, fusion, combined and tiered retrieval, working sets and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scores
from graphloom.functions.vectors import cosine
from graphloom.operators import graph
from graphloom.sources.scratch import hinted, settle


def one(df: DataFrame, **values) -> DataFrame:
    """A frame of one row of literals, on the session of df."""
    return df.sparkSession.sql("SELECT 1").select(*[F.lit(v).alias(k) for k, v in values.items()])


def check_k(k: int) -> None:
    if not 1 <= k <= 1000:
        raise ValueError("k is between 1 and 1000")


def query_vector(vectors: DataFrame, key: str, value) -> list[float] | None:
    """The vector of one row; a single point look-up."""
    row = vectors.where(F.col(key) == value).select("vec").first()
    return None if row is None else list(row.vec)


def knn(vectors: DataFrame, vec: list[float], k: int, key: str = "id", exclude=None) -> DataFrame:
    """(key, similarity): the k most similar rows, ties by key. The query is a literal, so this is one scan and a top-k."""
    check_k(k)
    q = F.array(*[F.lit(float(x)) for x in vec])
    rows = vectors if exclude is None else vectors.where(F.col(key) != exclude)
    if rows.where(F.size("vec") != len(vec)).take(1):
        raise ValueError("the query's dimension differs from the vectors'")
    return rows.select(key, cosine(F.col("vec"), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def confidence(edges: DataFrame, facts: DataFrame, source_counts: DataFrame | None, context: str | None = None, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """Confidence of facts (id, src, dst): reliability, diversity, centrality, confidence. PageRank and degrees are computed once for all.

    source_counts (id, n_sources) is None where the facts carry n_sources. A node's figures are one row, so facts move once an end.
    """
    rank = graph.pagerank(edges, damping, iterations)
    rows = facts if source_counts is None else facts.join(source_counts.select("id", "n_sources"), "id", "left")
    more = graph.degrees(edges).select("node", "degree") if context is None else graph.path_counts(edges, context, 5)
    node = settle(rank.join(more, "node", "full"))
    rows = rows.join(node.toDF("src", "rs", "ds" if context is None else "ps"), "src", "left").join(node.toDF("dst", "ro", "do" if context is None else "po"), "dst", "left")
    if context is None:
        diversity = F.least(F.coalesce("ds", F.lit(0)) + F.coalesce("do", F.lit(0)), F.lit(20)) / 20.0
    else:
        diversity = F.least(F.coalesce("ps", F.lit(0)) + F.coalesce("po", F.lit(0)), F.lit(10)) / 10.0
    rows = rows.withColumn("reliability", F.least(F.coalesce("n_sources", F.lit(0)), F.lit(10)) / 10.0).withColumn("diversity", diversity)
    rows = rows.withColumn("centrality", (F.coalesce("rs", F.lit(0.0)) + F.coalesce("ro", F.lit(0.0))) / 2)
    return rows.select("id", "src", "dst", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "reliability", "diversity", "centrality", scores.confidence(F.col("reliability"), F.col("diversity"), F.col("centrality")).alias("confidence"))


def fuse(signals: DataFrame, preset: str, as_of: Column) -> DataFrame:
    """Ranked signals (id, similarity, confidence, last_accessed, distance, n_sources): adds score and rank."""
    w = scores.FUSION[preset]
    s = scores.fusion(w, F.col("similarity"), F.col("confidence"), scores.recency(F.col("last_accessed"), as_of), F.col("distance"), F.col("n_sources"))
    return signals.withColumn("score", F.round(s, 9))


def top(df: DataFrame, k: int, by: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(k)


def combined(edges: DataFrame, vectors: DataFrame, anchor: str, target: str, depth: int = 2, k: int = 10, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """Graph nearness of anchor times vector likeness to target: (node, distance, likeness, score), best first.

    vectors: (node, vec), or (node, strategy, vec) with weights of the strategies spring, node2vec and spectral.
    """
    check_k(k)
    near = graph.bfs(edges, one(edges, node=anchor), depth)
    if weights is None:
        q = query_vector(vectors, "node", target)
        sim = F.lit(None).cast("double") if q is None else cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in q]))
        rows = near.join(vectors.select("node", sim.alias("cos")), "node", "left").withColumn("blend", F.coalesce("cos", F.lit(0.0)))
    else:
        t = vectors.where(F.col("node") == target).select("strategy", F.col("vec").alias("tv"))
        per = vectors.join(F.broadcast(t), "strategy")  # three rows at most
        per = per.groupBy("node").pivot("strategy", ["spring", "node2vec", "spectral"]).agg(F.first(cosine(F.col("vec"), F.col("tv"))))
        rows = near.join(per, "node", "left").withColumn("blend", scores.blend(weights, F.col("spring"), F.col("node2vec"), F.col("spectral")))
    rows = rows.withColumn("likeness", scores.unit(F.col("blend")))
    rows = rows.select("node", F.col("dist").alias("distance"), F.round("likeness", 6).alias("likeness"), F.round(F.col("likeness") / (1 + F.col("dist")), 6).alias("score"))
    return top(rows, k, "score", "node")


def search(edges: DataFrame, vectors: DataFrame, node: str, k: int) -> DataFrame:
    """(node, similarity): nearest by vector; without a vector, the node and what is within two hops, similarity 0."""
    q = query_vector(vectors, "node", node)
    if q is None:
        return cold_search(edges, node, k)
    return knn(vectors, q, k, "node").select("node", F.round("similarity", 6).alias("similarity"))


def search_confident(edges: DataFrame, vectors: DataFrame, conf: DataFrame, node: str, k: int) -> DataFrame:
    """search with the confidence of each node's first fact (the least id), 0 without one; conf: (id, src, confidence)."""
    per = conf.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("id", "confidence")).alias("x")).select("node", F.col("x.confidence").alias("confidence"))
    return search(edges, vectors, node, k).join(per, "node", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def explained(conf: DataFrame) -> DataFrame:
    """Confidence rows with the weight of each component."""
    weights = F.struct(F.lit(0.5).alias("reliability"), F.lit(0.3).alias("diversity"), F.lit(0.2).alias("centrality"))  # fixed values, those of scores.confidence
    return conf.withColumn("weights", weights)


def cold_search(edges: DataFrame, node: str, k: int) -> DataFrame:
    check_k(k)
    near = graph.bfs(edges, one(edges, node=node), 2)
    return near.orderBy("dist", "node").limit(k).select("node", F.lit(0.0).alias("similarity"))


def tier_one(vectors: DataFrame, node: str, k: int, exclude_self: bool = False) -> DataFrame:
    q = query_vector(vectors, "node", node)
    if q is None:
        raise ValueError(f"{node} has no vector")
    return knn(vectors, q, k, "node", node if exclude_self else None)


def tier_two(edges: DataFrame, vectors: DataFrame, first: DataFrame, hops: int, heads: int = 5) -> DataFrame:
    """Tier one and the surroundings of its best five, by likeness to its best."""
    best = first.orderBy(F.desc("similarity"), "node").limit(heads)
    head = best.orderBy(F.desc("similarity"), "node").first()
    near = graph.bfs(edges, best.select("node"), hops).select("node").join(first.select("node"), "node", "left_anti")
    q = query_vector(vectors, "node", head.node)
    like = vectors.select("node", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in q])).alias("similarity"))
    more = near.join(like, "node", "left").select("node", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return first.select("node", "similarity").unionByName(more)


def tier_three(second: DataFrame, conf: DataFrame) -> DataFrame:
    """Half likeness, half confidence of a node's fact with the least id; conf: (id, src, confidence)."""
    per = conf.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("id", "confidence")).alias("x")).select("node", F.col("x.confidence").alias("confidence"))
    rows = second.join(per, "node", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return rows.withColumn("score", 0.5 * F.col("similarity") + 0.5 * F.col("confidence"))


class Budget:
    """Limits of one retrieval: milliseconds, hops and results."""

    def __init__(self, millis: int = 1000, hops: int = 3, results: int = 100, clock=None):
        if not 1 <= millis <= 10_000:
            raise ValueError("the time budget is between 1 and 10000 ms")
        import time

        self.millis, self.hops, self.results, self.clock = millis, hops, results, clock or time.monotonic
        self.began = self.clock()

    def spent(self) -> bool:
        return (self.clock() - self.began) * 1000 >= self.millis


def tiered(edges: DataFrame, vectors: DataFrame, conf_of, node: str, k: int, budget: Budget, enough: float = 0.9, exclude_self: bool = True) -> tuple[DataFrame, int]:
    """(results, tier reached): stops between tiers when the budget is spent or the best is alike enough.

    conf_of(context, near) builds the confidence frame, of which only the facts from the nodes of near are asked for.
    """
    q = query_vector(vectors, "node", node)
    if q is None:
        return cold_search(edges, node, k), 0
    first = tier_one(vectors, node, 100 if budget.results > 100 else 20, exclude_self)
    head = first.orderBy(F.desc("similarity"), "node").first()
    if head is None or budget.spent() or head.similarity >= enough:
        return top(first, k, "similarity", "node"), 1
    second = tier_two(edges, vectors, first, 3 if budget.hops > 3 else 1)
    if budget.spent():
        return top(second, k, "similarity", "node"), 2
    second = settle(second)  # only now: its cost is tier three's, not tier two's
    return top(tier_three(second, conf_of(head.node, second)), k, "score", "node"), 3


def explore(results: DataFrame, facts: DataFrame, per_node: int = 3, total: int = 50) -> DataFrame:
    """A few facts (id, src, dst) around each result (node, similarity), best nodes first."""
    both = facts.select("id", F.col("src").alias("node"), "src", "dst").union(facts.where("src <> dst").select("id", "dst", "src", "dst"))
    near = both.join(results, "node")
    place = Window.partitionBy("node").orderBy("id")
    return near.withColumn("r", F.row_number().over(place)).where(F.col("r") <= per_node).orderBy(F.desc("similarity"), "node", "r").limit(total).select("node", "id", "src", "dst", "similarity")


# working sets and contexts


def working_set(edges: DataFrame, vectors: DataFrame, facts: DataFrame, node: str, nearest: int = 20, max_nodes: int = 100) -> DataFrame:
    """(node, confidence, times) from a query node: itself at 1, its nearest at their likeness, then nodes one and two hops on.

    Where a node is met again, its first confidence stays and its uses count.
    """
    q = query_vector(vectors, "node", node)
    if q is None:
        return graph_working_set(facts, node, 2).limit(max_nodes)
    near = knn(vectors, q, nearest, "node").select("node", "similarity")
    steps = facts.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").union(facts.where("src <> dst").select("dst", "src", "weight"))
    hop = near.join(steps, near["node"] == steps["a"]).select(F.col("b").alias("node"), (F.lit(0.7) * F.col("similarity")).alias("confidence"), F.lit(2).alias("step"))
    rows = one(edges, node=node, confidence=1.0, step=0).unionByName(near.select("node", F.col("similarity").alias("confidence"), F.lit(1).alias("step"))).unionByName(hop)
    best = rows.groupBy("node").agg(F.min(F.struct("step", -F.col("confidence"))).alias("x"), F.count("*").alias("times"))
    return best.select("node", (-F.col("x.col2")).alias("confidence"), "times").orderBy(F.desc("confidence"), "node").limit(max_nodes)


def working_facts(near: DataFrame, facts: DataFrame, max_facts: int = 500) -> DataFrame:
    """(id, confidence, times) of facts (id, src, dst, weight) around near (node): those at a near node at their weight, those one hop on at half of it.

    Where a fact is met again, its first confidence stays and its uses count.
    """
    ends = facts.select("id", "weight", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    first = ends.join(near.select("node").distinct(), "node").groupBy("id").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    ring = facts.join(first.select("id"), "id").select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(near.select("node"), "node", "left_anti")
    second = ends.join(ring, "node").groupBy("id").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    rows = first.select("id", F.lit(1).alias("step"), F.col("weight").alias("confidence"), "n").unionByName(second.select("id", F.lit(2).alias("step"), (0.5 * F.col("weight")).alias("confidence"), "n"))
    per = rows.groupBy("id").agg(F.min(F.struct("step", "confidence")).alias("x"), F.sum("n").alias("times"))
    return per.select("id", F.col("x.confidence").alias("confidence"), "times").orderBy(F.desc("confidence"), "id").limit(max_facts)


def graph_working_set(facts: DataFrame, node: str, depth: int = 2) -> DataFrame:
    """(node, confidence, times) without vectors: the ends of facts (src, dst, weight) within depth, their heaviest weight."""
    around = graph.neighbours(facts, node, depth)
    ends = around.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.max("weight").alias("confidence"), F.count("*").alias("times"))


def activated(ws: DataFrame, elapsed: Column, half_life: float) -> DataFrame:
    """Activation scores of (node, confidence, times) some seconds after their last use."""
    rec = F.exp(-elapsed / F.lit(float(half_life)))
    return ws.withColumn("recency", rec).withColumn("activation", scores.activation(F.col("confidence"), F.col("recency"), F.col("times")))


def turn(threads: DataFrame, threshold: float) -> DataFrame:
    """Threads (id, status, recency, score) after a turn: faded active ones sleep, resolved ones below the threshold go."""
    slept = threads.withColumn("status", F.when((F.col("status") == "active") & (F.col("recency") < 0.3), "dormant").otherwise(F.col("status")))
    return slept.where(~((F.col("status") == "resolved") & (F.col("score") < threshold)))


def context_facts(facts: DataFrame, vectors: DataFrame, active: DataFrame, node: str, limit: int) -> DataFrame:
    """The best facts (id, src, dst) for a query node: mean likeness of their ends times activation; without a query vector, nearness times activation."""
    if not 1 <= limit <= 1000:
        raise ValueError("a context has 1 to 1000 facts")
    a = hinted(settle(active.select("node", "activation")))
    rows = facts.join(a.toDF("src", "act_s"), "src", "left").join(a.toDF("dst", "act_o"), "dst", "left")
    rows = rows.withColumn("act", F.greatest(F.coalesce("act_s", F.lit(0.0)), F.coalesce("act_o", F.lit(0.0))))
    q = query_vector(vectors, "node", node)
    if q is None:
        near = F.when((F.col("src") == node) | (F.col("dst") == node), 1.0).when(F.col("act_s").isNotNull() | F.col("act_o").isNotNull(), 0.5).otherwise(0.25)
        rows = rows.withColumn("score", near * F.col("act"))
    else:
        like = vectors.select("node", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in q])).alias("c"))
        like = hinted(settle(like))
        rows = rows.join(like.toDF("src", "cs"), "src", "left").join(like.toDF("dst", "co"), "dst", "left")
        have = F.col("cs").isNotNull().cast("int") + F.col("co").isNotNull().cast("int")
        mean = (F.coalesce("cs", F.lit(0.0)) + F.coalesce("co", F.lit(0.0))) / F.greatest(have, F.lit(1))
        rows = rows.withColumn("score", mean * F.col("act"))
    return rows.select("id", "src", "dst", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def context_nodes(chosen: DataFrame, node: str, limit: int) -> DataFrame:
    """(node, degree) over the chosen facts, and the query node."""
    ends = chosen.select(F.explode(F.array("src", "dst")).alias("node"))
    deg = ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(limit)
    return deg.unionByName(one(chosen, node=node, degree=0).withColumn("degree", F.col("degree").cast("long")).join(deg.select("node"), "node", "left_anti"))


def render(chosen: DataFrame, fmt: str = "markdown") -> str:
    """Text of a context (src, predicate, dst, score) of at most a thousand facts."""
    import json

    rows = chosen.limit(1000).collect()
    if fmt == "plain":
        return "\n".join(f"{r.src} {r.predicate} {r.dst}" for r in rows)
    if fmt == "json":
        return json.dumps([r.asDict() for r in rows], indent=2, default=str)
    if fmt != "markdown":
        raise ValueError("a context is plain, markdown or json")
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.src, []).append(r)
    return "\n".join(line for s, rs in by.items() for line in (f"## {s}", *(f"- {r.predicate}: {r.dst} ({r.score:.3f})" for r in rs), ""))


def summary(active: DataFrame, threads: DataFrame | None = None, n: int = 10) -> dict:
    """The top nodes and open threads of a working set, as a small dict."""
    top_n = [(r.node, r.activation) for r in active.orderBy(F.desc("activation"), "node").limit(n).collect()]
    open_t = [] if threads is None else [r.id for r in threads.where("status = 'active'").orderBy("id").limit(100).collect()]
    return {"top_nodes": top_n, "threads": open_t}
