"""Vectors from topology: spectral, biased walks with Word2Vec, spring nudges; approximate search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine, norm, nudge
from graphloom.operators import graph
from graphloom.sources.scratch import hinted, settle, written


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b, w): weights of both directions and of parallel edges summed, no loops."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    one = edges.where("src <> dst").select("src", "dst", w.alias("w"))
    both = one.union(one.select("dst", "src", "w"))
    return both.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("w").alias("w"))


def spectral(edges: DataFrame, dims: int, dense: int = 2000, rounds: int = 60, seed: int = 7) -> DataFrame:
    """(node, vec): eigenvectors of the normalised Laplacian for its smallest eigenvalues but the first trivial one, zero-padded to dims.

    Graphs of up to ``dense`` nodes (counted first) are solved in one dense step on the driver; larger ones by
    subspace iteration, where only dims x dims products leave the executors.
    """
    if not 1 <= dims <= 512:
        raise ValueError("dims is between 1 and 512")
    nodes = settle(graph.vertices(edges))
    n = nodes.count()
    if n < 2:
        return nodes.limit(0).select("node", F.array(F.lit(0.0)).alias("vec"))
    if n > dense:
        return _subspace(nodes, edges, min(dims, n - 1), dims, rounds, seed)
    adj = symmetric(edges)
    names = [r.node for r in nodes.orderBy("node").collect()]  # at most `dense` rows
    at = {v: i for i, v in enumerate(names)}
    a = np.zeros((n, n))
    for r in adj.toLocalIterator():
        a[at[r.a], at[r.b]] = r.w
    d = a.sum(1)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    value, vector = np.linalg.eigh(np.diag((d > 0).astype(float)) - s[:, None] * a * s[None, :])
    skip = 1 if abs(value[0]) < 1e-10 else 0
    v = vector[:, skip : skip + min(dims, n - 1)]
    for j in range(v.shape[1]):  # the sign is free: the first entry that counts is positive
        big = np.flatnonzero(np.abs(v[:, j]) > 1e-9)
        if len(big) and v[big[0], j] < 0:
            v[:, j] = -v[:, j]
    full = np.zeros((n, dims))
    full[:, : v.shape[1]] = v
    return edges.sparkSession.createDataFrame([(names[i], full[i].tolist()) for i in range(n)], "node string, vec array<double>")


def _subspace(nodes: DataFrame, edges: DataFrame, k: int, dims: int, rounds: int, seed: int) -> DataFrame:
    """Nodes go by numbers. The entries lie dealt by their column in a bucketed table, so a round moves sums of nodes' rows, never entries."""
    width = k + 1
    names = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    one = edges.where("src <> dst").select("src", "dst", w.alias("weight")).join(names.toDF("src", "_a"), "src").select("dst", F.col("_a").alias("src"), "weight")
    one = one.join(names.toDF("dst", "_b"), "dst").select("src", F.col("_b").alias("dst"), "weight")
    adj = written(symmetric(one), "a")
    deg = written(adj.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d")))
    # (I + normalised adjacency) / 2 has the wanted vectors on top: half of each entry, and a half for each node itself
    scaled = adj.join(deg.toDF("a", "da"), "a").join(deg.toDF("b", "db"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db")) / 2).alias("w"))
    m = written(scaled.unionByName(names.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.5).alias("w"))), "a")
    cols = [f"x{i}" for i in range(width)]
    x = settle(names.select("id", *[(F.xxhash64("node", F.lit(seed + j)) / F.lit(float(2**63))).alias(c) for j, c in enumerate(cols)]))

    def gram(df):
        row = df.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)]).first()
        g = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                g[i, j] = g[j, i] = row[f"g{i}_{j}"]
        return g

    def times(df, t):
        return df.select("id", *[sum(F.col(cols[i]) * float(t[i, j]) for i in range(width)).alias(cols[j]) for j in range(width)])

    for r in range(rounds):
        sent = x.join(m, x["id"] == m["a"]).select(F.col("b").alias("id"), *[(F.col(c) * F.col("w")).alias(c) for c in cols])
        x = sent.groupBy("id").agg(*[F.sum(c).alias(c) for c in cols])
        if r % 3 == 2 or r == rounds - 1:
            x = settle(x)
            value, vector = np.linalg.eigh(gram(x))
            x = times(x, (vector / np.sqrt(np.maximum(value, 1e-12)))[:, ::-1])
    x = settle(x).join(names, "id")
    return x.select("node", F.array(*[F.col(cols[i + 1]) if i < k else F.lit(0.0) for i in range(dims)]).alias("vec"))


#: Neighbours that one row of _adjacent may hold, ends of edges from which a node's neighbours are dealt by shares, and their number.
CHUNK, HUB, SHARES = 1024, 100_000, 256


def _share(name):
    return F.pmod(F.xxhash64(name), F.lit(SHARES))


def _adjacent(edges: DataFrame) -> DataFrame:
    """(a, c, near): each node's neighbours (b, n) in the order of their share and name, n that of b's neighbours, CHUNK a row and the first one of the next row.

    Every pair is moved three times, once to be counted, once to be ranked and once into its row. A hub's neighbours are dealt by
    shares: ranks are counted within a share and offset by the shares before, so no window holds all of them.
    """
    ends = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = ends.union(ends.select("b", "a"))
    hubs = hinted(settle(ends.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > HUB).select("a", F.lit(True).alias("hub"))))
    dealt = lambda df: df.join(hubs, "a", "left").withColumn("s", F.when(F.col("hub"), _share("b")).otherwise(F.lit(0))).repartition("a", "s")
    total = lambda df: hinted(settle(df.where("hub").groupBy("a", "s").agg(F.count("*").alias("m"))))
    once = dealt(ends).groupBy("a", "s", "b", "hub").agg(F.lit(1))
    parts = total(once)
    sizes = F.broadcast(parts.groupBy("a").agg(F.sum("m").alias("all")))  # a row a hub
    each = once.withColumn("m", F.count("*").over(Window.partitionBy("a", "s"))).join(sizes, "a", "left")
    back = dealt(each.select(F.col("b").alias("a"), F.col("a").alias("b"), F.coalesce("all", "m").alias("n")))
    # neighbours are mutual, so a hub's shares have the same sizes from either side
    before = parts.select("a", "s", F.coalesce(F.sum("m").over(Window.partitionBy("a").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    place = F.row_number().over(Window.partitionBy("a", "s").orderBy(_share("b"), "b"))
    ranked = back.withColumn("r", place).join(hinted(settle(before)), ["a", "s"], "left").select("a", "b", "n", (F.col("r") + F.coalesce("off", F.lit(0)) - 1).alias("r"))
    c = F.floor(F.col("r") / CHUNK)
    rows = F.when((F.col("r") % CHUNK == 0) & (F.col("r") > 0), F.array(c - 1, c)).otherwise(F.array(c))
    near = F.transform(F.sort_array(F.collect_list(F.struct("r", "b", "n"))), lambda e: F.struct(e["b"].alias("b"), e["n"].alias("n")))
    return written(ranked.select("a", F.explode(rows).alias("c"), "r", "b", "n").groupBy("a", "c").agg(near.alias("near")), "a", "c")


def walks(edges: DataFrame, per_node: int = 4, length: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(walk, path): seeded walks over undirected neighbours; 1/p is the weight of going back, 1/q that of any other neighbour.

    A step draws a neighbour's rank and joins on its row of neighbours: no row holds a hub's neighbours, and the walks that stand on a
    hub spread over its rows. Rows of neighbours lie dealt by that key, so a step moves the walks only. A node without neighbours
    but itself gives walks of itself alone.
    """
    near = _adjacent(edges)
    sizes = near.groupBy(F.col("a").alias("node")).agg(F.sum(F.least(F.size("near"), F.lit(CHUNK))).alias("n"))
    lone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(near.where("c = 0").select(F.col("a").alias("node")), "node", "left_anti")
    start = sizes.unionByName(lone.withColumn("n", F.lit(None).cast("long")))
    w = start.select(F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("i"), F.array("node").alias("path"), "n", F.lit(None).cast("long").alias("n_back"))
    walk = F.concat(F.col("path")[0], F.lit("#"), F.col("i").cast("string"))
    cur, prev = F.element_at("path", -1), F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2)))
    for step in range(1, length):
        u = F.pmod(F.xxhash64(walk, F.lit(step), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        v = F.pmod(F.xxhash64(walk, F.lit(-step), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        others = F.col("n") - F.when(prev.isNull(), 0).otherwise(1)
        returns = prev.isNotNull() & ((others == 0) | (u * (F.lit(1 / p) + others / q) < F.lit(1 / p)))
        # drawn: among the others, from 0
        w = w.select("i", "path", "n", "n_back", F.floor(v * others).alias("drawn"), returns.alias("returns"))
        w = w.join(near, (cur == near["a"]) & (F.floor(F.col("drawn") / CHUNK) == near["c"]), "left")
        at = (F.col("drawn") % CHUNK).cast("int")
        w = w.select("i", "path", "n", "n_back", "returns", F.get("near", at).alias("here"), F.get("near", at + 1).alias("after"))
        # the others are the neighbours without the one before: from its place on, ranks are one more
        apart = F.struct(_share("here.b"), F.col("here.b")) < F.struct(_share(prev), prev)
        one = F.when(prev.isNull() | apart, F.col("here")).otherwise(F.col("after"))
        to = F.when(F.col("n").isNull(), None).when(F.col("returns"), F.struct(prev.alias("b"), F.col("n_back").alias("n"))).otherwise(one)
        w = w.select("i", "path", "n", to.alias("to"))
        w = w.select("i", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("to.b"))).alias("path"), F.col("to.n").alias("n"), F.col("n").alias("n_back"))
        if step % 16 == 0 and step < length - 1:
            w = written(w)
    return w.select(walk.alias("walk"), "path")


#: Walks that one task learns from alone.
ALONE = 200_000


def node2vec(edges: DataFrame, dims: int = 16, per_node: int = 8, length: int = 12, p: float = 1.0, q: float = 1.0, window: int = 3, seed: int = 42) -> DataFrame:
    """(node, vec): skip-gram vectors of seeded walks. All walks are learnt from: up to ALONE by one task in order, more by as many tasks as run at once, whose vectors are averaged after each pass; then reruns differ, as tasks of one executor learn on the same arrays."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import Word2Vec

    w = written(walks(edges, per_node, length, p, q, seed))
    tasks = min(max(1, -(-w.count() // ALONE)), max(1, edges.sparkSession.sparkContext.defaultParallelism))
    if tasks == 1:
        w = settle(w.orderBy("walk"))
    model = Word2Vec(vectorSize=dims, minCount=0, windowSize=window, seed=seed, inputCol="path", outputCol="v", numPartitions=tasks, maxIter=2).fit(w)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vec"))


def ann(vectors: DataFrame, vec: list[float], k: int, tables: int = 6, width: float = 0.6, seed: int = 11, wide: int = 20) -> DataFrame:
    """(id, similarity): approximate cosine search by random projections of unit vectors, candidates ranked again exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = vectors.where(norm(F.col("vec")) > 0).withColumn("u", array_to_vector(F.transform("vec", lambda x: x / norm(F.col("vec")))))
    q = np.array(vec, float)
    q = q / max(float(np.linalg.norm(q)), 1e-300)
    lsh = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    found = lsh.approxNearestNeighbors(unit, Vectors.dense(q.tolist()), k * wide)
    return found.select("id", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in q])).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def spring(vectors: DataFrame, edges: DataFrame, rate: float = 0.1) -> DataFrame:
    """(node, vec) after one nudge along every edge at once: an end moves by the sum of its edges' nudges."""
    a, b = vectors.toDF("src", "va"), vectors.toDF("dst", "vb")
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    moved = edges.join(a, "src").join(b, "dst")
    na, nb = nudge(F.col("va"), F.col("vb"), rate, w)
    parts = moved.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.zip_with(na, F.col("va"), lambda x, y: x - y).alias("d")), F.struct(F.col("dst").alias("node"), F.zip_with(nb, F.col("vb"), lambda x, y: x - y).alias("d")))).alias("e"))
    steps = parts.select("e.node", F.posexplode("e.d").alias("i", "x")).groupBy("node", "i").agg(F.sum("x").alias("x"))
    delta = steps.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("d"))
    return vectors.join(delta, "node", "left").select("node", F.when(F.col("d").isNull(), F.col("vec")).otherwise(F.zip_with("vec", F.transform("d", lambda e: e["x"]), lambda x, y: x + y)).alias("vec"))


def first_vectors(nodes: DataFrame, edges: DataFrame, known: DataFrame, dims: int) -> DataFrame:
    """(node, vec): known vectors, and for nodes without one the mean of their neighbours' or else small numbers made from the node's name."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).where("node <> other").distinct()
    bare = nodes.select("node").distinct().join(known.select("node"), "node", "left_anti")
    seen = bare.join(ends, "node").join(known.toDF("other", "vec"), "other").select("node", F.posexplode("vec").alias("i", "x"))
    mean = seen.groupBy("node", "i").agg(F.avg("x").alias("x")).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean"))
    small = F.array(*[F.lit(0.1) * (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(256)) / 255.0 - 0.5) for i in range(dims)])
    return known.select("node", "vec").unionByName(bare.join(mean, "node", "left").select("node", F.coalesce("mean", small).alias("vec")))


def recompute(spark, path: str, vectors: DataFrame, strategy: str, dims: int) -> DataFrame:
    """Puts a strategy's new vectors (node, vec) in place of its old ones in the store at path; other strategies stay. Gives the store."""
    from graphloom.sources import stores

    stores.save_vectors(vectors.select("node", F.lit(strategy).alias("strategy"), "vec"), path, dims)
    return stores.load(spark, path)


def long_form(vectors: DataFrame, key: str = "id") -> DataFrame:
    """(id, strategy, vec): the fixture vectors as three strategies, each missing where id mod 3 is its number."""
    names = F.array(*[F.lit(s) for s in ("spring", "node2vec", "spectral")])
    rows = vectors.select(key, "vec", F.posexplode(names).alias("i", "strategy")).where(F.col(key) % 3 != F.col("i"))
    return rows.select(key, "strategy", F.transform("vec", lambda x: x * (F.col("i") + 1) + F.col("i")).alias("vec"))


def nearest_by_strategy(long: DataFrame, key: str, value, k: int) -> DataFrame:
    """(strategy, rank, key, similarity): each strategy's k nearest to one row."""
    q = F.broadcast(long.where(F.col(key) == value).select("strategy", F.col("vec").alias("q")))  # a row a strategy
    rows = long.join(q, "strategy").select("strategy", key, F.round(cosine(F.col("vec"), F.col("q")), 6).alias("similarity"))
    place = Window.partitionBy("strategy").orderBy(F.desc("similarity"), key)
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
