"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are range-partitioned by length (Euclidean norm) and packed into buckets of bounded size, so a
bucket holds vectors of similar length; neighbouring buckets form a group. Queries are packed into blocks by
what they need: the least length that could still beat their bound. Before any vector travels, headers of
query blocks and groups are joined, and a pair stays only if the group's longest vector is long enough. In a
task a query block meets the buckets of one group in turn. A query whose local cosine threshold, bound /
(query length x longest vector of the bucket), is above one skips the bucket; with a high threshold it uses
coordinate pruning (a vector whose direction is too far from the query's in the query's largest coordinates
can't reach the bound), else length pruning (a suffix of the bucket, which is sorted by length, is cut). What
is left is verified by integer products. The bound of a query is its k-th best (score, vec_id) so far, so
ties beyond it are cut as well; a task gives at most k rows a query.

The longest bucket goes first. The other groups are dealt at random to rounds, each ``STEP`` times as large
as all before it, and bounds are raised after each round. So the rows that leave the tasks are a small
multiple of k a query and round, also where a large cluster of near copies lies in one range of lengths.

Query blocks against groups is a block join of a stated query set. Bounds are rounded outwards, so pruning
loses nothing, ties included.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
without vec_id; products are taken between vectors of equal dimension only; rows with a query's vec_id are
the query's own and never its candidates; rows that share a query's vec_id are one query, with the least of
their vectors by dimension, then by components; each row is a candidate of its own, so repeated rows take
several ranks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, table, tidy

K, EVERY, SCALE = 20, 20, 64
BUCKET, QUERIES_A_BLOCK, BUCKETS_A_GROUP, STEP, FOCUS, HIGH = 4096, 512, 16, 4, 4, 0.7
_NONE = -(2**63)  # below every score: no bound yet
_BLOCK = "dim int, block long, part int, n int, longest double, need double, biggest double, ids binary, lows binary, low_ids binary, rows binary"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>, dim, norm) of the rows that take part; v is floor(scale x)."""
    x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x")).where("vec_id is not null and x is not null")
    fine = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    x = x.where(fine).select("vec_id", v.alias("v"))
    return x.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("norm"))


def _narrow(m: np.ndarray, biggest: float) -> bytes:
    """The components in the least integer type that holds them; readers know the type from the biggest one."""
    return m.astype(_width(biggest)).tobytes()


def _width(biggest: float) -> str:
    return "<i1" if biggest < 128 else "<i2" if biggest < 2**15 else "<i4" if biggest < 2**31 else "<i8"


def _pack(size: int):
    """Rows (vec_id, v, dim, norm, need, low, low_id), sorted by dim, into blocks of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), []

        def out(rows):
            m = np.array([r[1] for r in rows], np.int64).reshape(len(rows), -1)
            biggest = float(np.abs(m.astype(float)).max(initial=0))
            long = lambda i: np.array([r[i] for r in rows], np.int64).tobytes()
            values = (rows[0][2], uuid.uuid4().int >> 65, part, len(rows), max(r[3] for r in rows), min(r[4] for r in rows), biggest, long(0), long(5), long(6), _narrow(m, biggest))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _TYPES, strict=True)], _NAMES)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= size or held[0][2] != r[2]):
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    return run


def _blocks(df: DataFrame, size: int, parts: int, *order) -> Kept:
    by = df.repartitionByRange(parts, F.col("dim"), *order, F.col("vec_id")).sortWithinPartitions("dim", *order, "vec_id")
    return Kept(by.select("vec_id", "v", "dim", "norm", "need", "low", "low_id").mapInArrow(tidy(_pack(size), 4096), _BLOCK))


class Queries:
    """A block of queries with their bounds and the best hits so far."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, low: np.ndarray, low_id: np.ndarray, k: int):
        self.q, self.ids, self.low, self.low_id, self.k = q, ids, low.copy(), low_id.copy(), k
        self.f = q.astype(float)
        self.length = np.sqrt((self.f * self.f).sum(1))
        self.hits = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, vec_id, score

    def meet(self, v: np.ndarray, v_ids: np.ndarray, exact_float: bool = True) -> None:
        """Takes in a bucket sorted by length, the longest first."""
        fv = v.astype(float)
        vl = np.sqrt((fv * fv).sum(1))
        low = np.where(self.low == _NONE, -np.inf, self.low.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            top = self.length * vl.max(initial=0)
            local = np.where(top > 0, low / top, np.where(low > 0, np.inf, -np.inf))
            # length pruning: vectors too short for the bound are a suffix
            reach = np.where(low > 0, low / np.maximum(self.length, 1e-300), 0.0) * (1 - 1e-9)
        n = np.where(low > 0, np.searchsorted(-vl, -reach, side="right"), len(v))
        n = np.where(local <= 1 + 1e-9, n, 0)
        out = [self.hits]
        plain = np.flatnonzero((n > 0) & (local < HIGH))
        if len(plain):
            most = int(n[plain].max())
            s = np.rint(self.f[plain] @ fv[:most].T).astype(np.int64) if exact_float else self.q[plain].astype(np.int64) @ v[:most].astype(np.int64).T
            out.append(self._best(plain, s, v_ids[:most]))
        for i in np.flatnonzero((n > 0) & (local >= HIGH)):
            # coordinate pruning: what the largest coordinates leave is bounded by Cauchy-Schwarz
            m, f = int(n[i]), np.argsort(-np.abs(self.f[i]))[:FOCUS]
            part = fv[:m, f]
            rest = np.sqrt(np.maximum(self.length[i] ** 2 - (self.f[i, f] ** 2).sum(), 0)) * np.sqrt(np.maximum(vl[:m] ** 2 - (part**2).sum(1), 0))
            rows = np.flatnonzero(part @ self.f[i, f] + rest >= low[i] - 1e-6 * max(1.0, abs(low[i])))
            if len(rows):
                s = np.rint(fv[rows] @ self.f[i]).astype(np.int64) if exact_float else v[rows].astype(np.int64) @ self.q[i].astype(np.int64)
                out.append(self._best(np.array([i]), s[None, :], v_ids[rows]))
        if len(out) > 1:
            self._settle(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def _best(self, i: np.ndarray, s: np.ndarray, v_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of queries i in a matrix of scores: not their own, not beyond their bound, not below the row's k-th best."""
        own = v_ids[None, :] == self.ids[i][:, None]
        floor = self.low[i]
        if s.shape[1] > self.k:
            s = np.where(own, _NONE, s)
            floor = np.maximum(floor, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        r, c = np.nonzero((s >= floor[:, None]) & ~own)
        q, ids, score = i[r], v_ids[c], s[r, c]
        keep = (score > self.low[q]) | (ids < self.low_id[q]) | (self.low[q] == _NONE)
        return q[keep], ids[keep], score[keep]

    def _settle(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        better = (s[last] > self.low[q[last]]) | (self.low[q[last]] == _NONE) | ((s[last] == self.low[q[last]]) & (ids[last] < self.low_id[q[last]]))
        at = q[last][better]
        self.low[at], self.low_id[at] = s[last][better], ids[last][better]
        mine = place < self.k
        self.hits = (q[mine], ids[mine], s[mine])


def _meet(k: int):
    """Pairs of a query block and a bucket; buckets of one group follow each other, so a task gives at most k rows a query and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def out():
            q, ids, s = block.hits
            return pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(s)], ["query_id", "vec_id", "score"])

        for b in batches:
            for j in range(b.num_rows):
                get = lambda c: b.column(c)[j].as_py()  # noqa: E731, B023
                long = lambda c: np.frombuffer(get(c), "<i8")  # noqa: E731, B023
                dim, q_big, v_big = get("dim"), get("q_biggest"), get("v_biggest")
                if get("q_block") != now:
                    if block is not None:
                        yield out()
                    ids = long("q_ids")
                    now, block = get("q_block"), Queries(np.frombuffer(get("q_rows"), _width(q_big)).reshape(len(ids), dim), ids, long("q_lows"), long("q_low_ids"), k)
                ids = long("v_ids")
                block.meet(np.frombuffer(get("v_rows"), _width(v_big)).reshape(len(ids), dim), ids, q_big * v_big * max(dim, 1) < 2**52)
        if block is not None:
            yield out()

    return run


_HIT = "query_id long, vec_id long, score long"


def _round(q: DataFrame, v: DataFrame, k: int, q_blocks: int, v_groups: int) -> DataFrame:
    """(query_id, vec_id, score): at most k hits a query and group of buckets, none beyond the query's bound. q_blocks and v_groups: about how many there are."""
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # headers first, dealt over salts, since most vectors are of one dimension
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias("salt")
    groups = v.groupBy("dim", "part").agg(F.max("longest").alias("longest"))
    heads = q.select("dim", F.col("block").alias("q_block"), "need", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"))
    pairs = heads.join(groups.select("dim", "part", "longest", salt("part")), ["dim", "salt"]).where("longest >= need * (1 - 1e-9)").select("q_block", "part")
    named = lambda df, p, cols: [F.col(c).alias(f"{p}_{c}") for c in cols]
    left = q.select("dim", *named(q, "q", ("block", "biggest", "ids", "lows", "low_ids", "rows"))).join(pairs, "q_block")
    right = v.select("dim", "part", *named(v, "v", ("biggest", "ids", "rows")))
    # where a round has few groups, each is sent to several tasks, which share the query blocks: a copy for every eight of them at most
    shares = max(1, min(4 * n // max(v_groups, 1), -(-q_blocks // 8)))
    left = left.withColumn("share", F.pmod(F.xxhash64("q_block"), F.lit(shares)).cast("int"))
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return left.repartition("dim", "part", "share").join(right, ["dim", "part", "share"]).mapInArrow(tidy(_meet(k), 8), _HIT)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best; is_query is a condition on vec_id."""
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = [F.lit(0.0).alias("need"), F.lit(_NONE).alias("low"), F.lit(0).cast("long").alias("low_id")]
    x = Kept(scaled(vectors, id_col, vec_col, scale))
    total = x.df.count()
    parts = max(1, min(n, -(-total // bucket)), -(-total // (bucket * BUCKETS_A_GROUP)))
    v = _blocks(x.df.select("*", *none), bucket, parts, F.col("norm").desc())
    queries = Kept(x.df.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "norm")).alias("x")).select("vec_id", "x.*"))
    x.drop()
    q_blocks = max(1, -(-queries.df.count() // QUERIES_A_BLOCK))
    # the longest bucket of each dimension goes first; then groups by chance, each round STEP times as many as before
    first = v.df.groupBy("dim").agg(F.max(F.struct("longest", "block")).alias("t")).select(F.col("t.block").alias("block"))
    blocks, dims, size = v.df.agg(F.count("*"), F.count_distinct("dim"), F.count_distinct("dim", "part")).first()
    rest = v.df.join(first, "block", "left_anti").withColumn("chance", F.pmod(F.xxhash64("dim", "part"), F.lit(1 << 30)) / float(1 << 30))
    rounds, below = [(v.df.join(first, "block", "left_semi"), dims)], 0.0
    while below < 1 and blocks > dims:
        above = STEP ** len(rounds) / size
        above = 1.0 if above * 2 > 1 else above
        rounds.append((rest.where((F.col("chance") >= below) & (F.col("chance") < above)), int(size * (above - below))))
        below = above
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    for buckets, v_groups in rounds:
        if best is None:
            bounded = queries.df.select("*", *none)
        else:
            low = best.df.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("low"), F.col("vec_id").alias("low_id"))
            known = queries.df.join(low, "vec_id", "left")
            need = F.when(F.coalesce("low", F.lit(0)) <= 0, 0.0).when(F.col("norm") == 0, float("inf")).otherwise(F.col("low") / F.col("norm"))
            bounded = known.select("vec_id", "v", "dim", "norm", need.alias("need"), F.coalesce("low", F.lit(_NONE)).alias("low"), F.coalesce("low_id", F.lit(0)).alias("low_id"))
        q = _blocks(bounded, QUERIES_A_BLOCK, min(q_blocks, 4096), F.col("need"))
        hits = Kept(_round(q.df, buckets, k, q_blocks, v_groups))
        every = hits.df if best is None else hits.df.unionByName(best.df.drop("rank"))
        better = Kept(every.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
        for used in (q, hits, best):
            if used is not None:
                used.drop()
        best = better
    for used in (v, queries):
        used.drop()
    return best.df.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)), true)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
