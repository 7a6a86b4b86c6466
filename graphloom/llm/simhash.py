"""SimHash near-duplicate groups by anchor-point covering.

The 64 fingerprint bits are cut into two halves of 32. Two fingerprints within 4 bits differ in at most
2 bits of one half. In each half, 31 bits are covered by the perfect [31, 26] Hamming code (covering
radius 1) and the 32nd bit stands for itself, so there are 2^27 anchors a half. Two halves within 2 bits
have a midpoint within 1 bit of both; the anchor that covers this midpoint is within the covering radius
plus one of each. A fingerprint is replicated to all such anchors (17 a half at most, 2 where the half
is itself a code word) and fingerprints are compared per anchor only. No pair within the threshold is lost.

Equal fingerprints are one node, so exact copies cost nothing beyond an aggregate with map-side combine.
Per anchor, only the links of a spanning forest leave the comparison, never all pairs of a group; an
anchor with more than ``chunk`` fingerprints is compared chunk against chunk in separate tasks.

Defined cases: a null or wordless text has fingerprint zero and links like any other; repeated rows keep
one row each; a null doc_id never names a component (a component of null ids only has a null id); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep, table, tidy

SHINGLE, SEED, THRESHOLD, CHUNK = 4, 42, 4, 2048


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text, by majority over all shingles."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six separators
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = np.array([h(flat, seed)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: n - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((h(flat[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    total = len(hashes)
    sums = np.zeros(64, np.int64)
    for i in range(0, total, 1 << 14):
        sums += np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns named in more: fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x) for x in b.column(1).to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *more])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return d.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


#: Syndrome masks of the [31, 26] Hamming code: bit j of the syndrome is the parity of the positions (1 to 31) that have bit j.
_MASKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def anchors(fp: str = "fp") -> F.Column:
    """array<long>: the anchors of both halves that a fingerprint is replicated to."""
    every = []
    for half in (0, 1):
        v = f"(shiftrightunsigned({fp}, {32 * half}) & 2147483647L)"
        raw = f"(shiftrightunsigned({fp}, {32 * half + 31}) & 1L)"
        s = " + ".join(f"{1 << j} * (bit_count({v} & {m}L) & 1)" for j, m in enumerate(_MASKS))
        tag = half << 40
        flip = lambda i: f"shiftleft(1L, {i} - 1)"
        # code words within 2 bits: the one that covers v, and those over a pair of positions i, j with i xor j = syndrome
        every.append(
            f"transform(array(struct({v} as v, {raw} as r, cast({s} as int) as s)), x -> concat("
            f"array({tag}L + shiftleft(x.r, 32) + (if(x.s = 0, x.v, x.v ^ {flip('x.s')})), {tag}L + shiftleft(1L - x.r, 32) + (if(x.s = 0, x.v, x.v ^ {flip('x.s')}))),"
            f"if(x.s = 0, array(), transform(filter(sequence(1, 31), i -> i < (i ^ x.s) and (i ^ x.s) > 0), i -> {tag}L + shiftleft(x.r, 32) + (x.v ^ {flip('i')} ^ {flip('(i ^ x.s)')})))))[0]"
        )
    return F.expr(f"concat({every[0]}, {every[1]})")


def _forest(fps: np.ndarray, split: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within the threshold. With split > 0, rows before it against rows from it on, as well."""
    n = len(fps)
    if n == 2:
        return (fps[:1], fps[1:]) if int(fps[0] ^ fps[1]).bit_count() <= threshold else (fps[:0], fps[:0])
    seen, left = np.zeros(n, bool), np.ones(n, bool)
    a, b = [], []
    u = fps.view(np.uint64)
    while True:
        rest = np.flatnonzero(left)
        if not len(rest):
            break
        queue = [rest[0]]
        left[rest[0]] = False
        while queue:
            x = queue.pop()
            seen[x] = True
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(u[rest] ^ u[x]) <= threshold]
            left[near] = False
            queue += near.tolist()
            a += [x] * len(near)
            b += near.tolist()
    return fps[np.array(a, int)], fps[np.array(b, int)]


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (anchor, ci, cj): each run is compared in itself. A run holds two chunks at most."""
        key, held = None, np.zeros(0, np.int64)
        names = ["a", "b"]

        def out(found: list) -> pa.RecordBatch:
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

        for batch in batches:
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            fp = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            found = []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if key is not None and tuple(k[i]) == key:
                    held = np.concatenate((held, fp[i:j]))
                else:
                    if len(held) > 1:
                        found.append(_forest(held, 0, threshold))
                    key, held = tuple(k[i]), fp[i:j]
            yield out(found)
        if len(held) > 1:
            yield out([_forest(held, 0, threshold)])

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within the threshold."""
    if threshold > 4:
        raise ValueError("the covering radius used here serves thresholds up to 4")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # eight bytes a row, but a row becomes 34: dealt out anew, else a few tasks would make all replicas
    rows = keep(fps.select("fp").distinct()).repartition(n, "fp").select(F.explode(anchors()).alias("anchor"), "fp")
    shared = keep(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"))
    two = shared.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= threshold)).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = shared.where("n > 2").select("anchor", F.ceil(F.col("n") / chunk).cast("int").alias("g"))
    # a hot anchor's rows are dealt to chunks, and each pair of chunks is a run of its own
    met = (
        rows.join(more, "anchor")
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .select("anchor", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least("c", o).alias("ci"), F.greatest("c", o).alias("cj")))).alias("p"), "fp")
        .select("anchor", "p.ci", "p.cj", "fp")
    )
    runs = met.repartition(n, "anchor", "ci", "cj").sortWithinPartitions("anchor", "ci", "cj")
    found = runs.mapInArrow(tidy(_compare(threshold)), "a long, b long")
    return two.union(found).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    fps = keep(fingerprints(docs, id_col, text_col))
    roots = components(links(fps, threshold))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = keep(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = keep(named.join(least, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
